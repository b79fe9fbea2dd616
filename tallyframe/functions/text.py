"""Differences of texts: lines, words, invisible characters; and numbers put into words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from typing import Any

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed limits of a line diff: lines of a text, edits, unchanged lines around a change, least likeness of paired lines.
MOST_LINES, MOST_EDITS, CONTEXT, LEAST_LIKE = 2000, 500, 3, 0.3

#: Invisible characters with a mark and a name (fixed values).
INVISIBLE_NAMES = {
    "\t": ("→", "tab"),
    "\n": ("↵", "line feed"),
    "\r": ("␍", "carriage return"),
    "\u00a0": ("⍽", "no-break space"),
    "\u202f": ("⍽", "narrow no-break space"),
    "\u2007": ("⍽", "figure space"),
    "\u2009": ("⍽", "thin space"),
    "\u3000": ("⍽", "ideographic space"),
    "\u200b": ("ZWSP", "zero-width space"),
    "\u200c": ("ZWNJ", "zero-width non-joiner"),
    "\u200d": ("ZWJ", "zero-width joiner"),
    "\u2060": ("WJ", "word joiner"),
    "\ufeff": ("BOM", "byte order mark"),
    "\u00ad": ("SHY", "soft hyphen"),
    "\u200e": ("LRM", "left-to-right mark"),
    "\u200f": ("RLM", "right-to-left mark"),
}
#: Characters that count as invisible, as a space, and as nothing (fixed values).
INVISIBLE = r"[\u0000-\u001f\u007f-\u00a0\u00ad\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]"
SPACES = r"[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]"
NOTHING = r"[\u0000-\u001f\u007f-\u009f\u00ad\u180e\u200b-\u200f\u2028-\u202e\u2060-\u2064\ufeff]"
#: White space as the front end's pattern language has it.
BLANK = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
_LINE = re.compile(r"[^\r\n\u2028\u2029]*(?:\r\n|[\n\r\u2028\u2029])|[^\r\n\u2028\u2029]+")
_BREAK = re.compile(r"\r\n|[\n\r\u2028\u2029]")
_TOKEN = regex.compile(rf"[\p{{L}}\p{{N}}_]+|{BLANK}+|[^\p{{L}}\p{{N}}_]")
_WORDLY = regex.compile(r"[\p{L}\p{N}]")
_INVISIBLE = re.compile(INVISIBLE)


# ---- sequences -----------------------------------------------------------------------------------------------------


def edit_script(a: Sequence[Any], b: Sequence[Any], most: int = MOST_EDITS) -> str | None:
    """A shortest edit script, one of "=", "-" and "+" per element, or None if it takes more than `most` edits.

    Myers' greedy search: for each number of edits, the furthest point on every diagonal, here with the path to it as
    a linked list of steps. What one side has more often is edits in any script, so a search that can't end isn't begun;
    where nothing but elements that the other side lacks differs, there is one way to match the rest, and no search.
    """
    n, m = len(a), len(b)
    in_a, in_b = Counter(a), Counter(b)
    if (in_a - in_b).total() + (in_b - in_a).total() > most:
        return None
    if [x for x in a if x in in_b] == [y for y in b if y in in_a]:
        steps, at = [], 0
        for x in a:
            if x in in_b:
                while b[at] not in in_a:
                    steps.append("+")
                    at += 1
                at += 1
            steps.append("=" if x in in_b else "-")
        return "".join(steps) + "+" * (m - at)

    def along(x: int, diagonal: int, path: tuple | None) -> tuple[int, tuple | None]:
        start = x
        while x < n and x - diagonal < m and a[x] == b[x - diagonal]:
            x += 1
        return x, (("=" * (x - start), path) if x > start else path)

    furthest = {0: along(0, 0, None)}
    for edits in range(min(n + m, most) + 1):
        if edits:
            found = {}
            for diagonal in range(-edits, edits + 1, 2):
                left, right = furthest.get(diagonal - 1), furthest.get(diagonal + 1)
                if left is None or (right is not None and left[0] < right[0]):
                    x, path = right[0], ("+", right[1])
                else:
                    x, path = left[0] + 1, ("-", left[1])
                found[diagonal] = along(x, diagonal, path)
            furthest = found
        end = furthest.get(n - m)
        if end is not None and end[0] >= n:
            steps, path = [], end[1]
            while path is not None:
                steps.append(path[0])
                path = path[1]
            return "".join(reversed(steps))
    return None


def lines(text: str) -> list[str]:
    """The lines of a text, each with its line break."""
    return _LINE.findall(text)


def line_breaks(text: str) -> list[str]:
    return _BREAK.findall(text)


def lines_without_breaks(text: Any) -> list[str] | None:
    """The lines of a text that has line breaks, else None."""
    return _BREAK.split(text) if isinstance(text, str) and _BREAK.search(text) else None


@dataclass(frozen=True, slots=True)
class WordDiff:
    """Which characters of each text belong to words that differ; the share of characters in common words."""

    left: tuple[bool, ...]
    right: tuple[bool, ...]
    likeness: float


def word_diff(a: str, b: str) -> WordDiff | None:
    """The words that differ, or None where no word is common."""
    left, right = _TOKEN.findall(a), _TOKEN.findall(b)
    script = edit_script(left, right)
    if script is None:
        return None
    marks: dict[str, list[bool]] = {"-": [], "+": []}
    common = 0
    sides = {"-": iter(left), "+": iter(right)}
    for op in script:
        for side in "-+" if op == "=" else op:
            word = next(sides[side])
            marks[side] += [op != "="] * len(word)
        if op == "=" and _WORDLY.search(word):
            common += len(word)
    if not common:
        return None
    return WordDiff(tuple(marks["-"]), tuple(marks["+"]), common / max(len(marks["-"]), len(marks["+"]), 1))


@dataclass(frozen=True, slots=True)
class DiffLine:
    """op: "=", "-", "+", or "…" for hidden unchanged lines; a and b: line numbers, 0 for none; marked: what differs."""

    op: str
    text: str
    a: int
    b: int
    marked: tuple[bool, ...] | None = None
    hidden: int = 0


def unified_diff(a: str, b: str) -> list[DiffLine] | None:
    """The lines that differ, those around them, and the words that differ in paired lines; None for too large texts."""
    left, right = lines(a), lines(b)
    script = edit_script(left, right) if max(len(left), len(right)) <= MOST_LINES else None
    if script is None:
        return None
    out, i, j = [], 0, 0
    for part in re.findall("=+|[-+]+", script):
        if part[0] == "=":
            out += [DiffLine("=", left[i + k], i + k + 1, j + k + 1) for k in range(len(part))]
            i, j = i + len(part), j + len(part)
            continue
        gone, new = part.count("-"), part.count("+")
        out += _paired([DiffLine("-", left[i + k], i + k + 1, 0) for k in range(gone)], [DiffLine("+", right[j + k], 0, j + k + 1) for k in range(new)])
        i, j = i + gone, j + new
    return collapsed(out)


def _paired(gone: list[DiffLine], new: list[DiffLine]) -> list[DiffLine]:
    """Removed lines, then added ones; each removed line marked against the most alike added line after the last pair.

    The words that two lines share, in any order, bound their likeness; pairs that can't win aren't diffed.
    """
    words = [Counter(w for w in _TOKEN.findall(x.text) if _WORDLY.search(w)) for x in gone + new]
    first = 0
    for k, line in enumerate(gone):
        best, most, where = None, 0.0, 0
        for at in range(first, len(new)):
            other = new[at].text
            bound = sum(n * len(w) for w, n in (words[k] & words[len(gone) + at]).items()) / max(len(line.text), len(other), 1)
            if bound < LEAST_LIKE or bound <= most:
                continue
            found = word_diff(line.text, other)
            if found and found.likeness >= LEAST_LIKE and found.likeness > most:
                best, most, where = found, found.likeness, at
        if best:
            gone[k], new[where] = replace(line, marked=best.left), replace(new[where], marked=best.right)
            first = where + 1
    return gone + new


def collapsed(diff: list[DiffLine], context: int = CONTEXT) -> list[DiffLine]:
    """Long runs of unchanged lines cut to `context` lines next to a change; a mark stands for more than one line."""
    out: list[DiffLine] = []
    at = 0
    for run in re.findall("=+|[^=]+", "".join("=" if x.op == "=" else "x" for x in diff)):
        part = diff[at : at + len(run)]
        head = context if at else 0
        tail = context if at + len(run) < len(diff) else 0
        if run[0] == "=" and len(run) - head - tail > 1:
            part = [*part[:head], DiffLine("…", "", 0, 0, hidden=len(run) - head - tail), *part[len(run) - tail :]]
        out += part
        at += len(run)
    return out


# ---- invisible characters ------------------------------------------------------------------------------------------


def marked_spaces(text: str) -> list[bool]:
    """Which characters are spaces that lead, trail or repeat."""
    out = [False] * len(text)
    for found in re.finditer(" +", text):
        if found.start() == 0 or found.end() == len(text) or len(found[0]) > 1:
            out[found.start() : found.end()] = [True] * len(found[0])
    return out


def has_invisible(text: Any) -> bool:
    return isinstance(text, str) and (text == "" or bool(_INVISIBLE.search(text)) or any(marked_spaces(text)))


def visible(text: str) -> str:
    """A text with marks for its invisible characters and for spaces that lead, trail or repeat."""
    if text == "":
        return '""'
    spaces = marked_spaces(text)
    return "".join("␣" if spaces[k] else INVISIBLE_NAMES.get(c, (f"U+{ord(c):04X}",))[0] if _INVISIBLE.match(c) else c for k, c in enumerate(text))


def normalised(text: str) -> str:
    text = re.sub(NOTHING, "", re.sub(SPACES, " ", text))
    return re.sub(BLANK + "+", " ", text).strip(" ")


def only_invisible(a: Any, b: Any) -> bool:
    """Whether two texts differ, but only in invisible characters."""
    return isinstance(a, str) and isinstance(b, str) and a != b and normalised(a) == normalised(b)


def literal(value: Any) -> str:
    """A text in quotes with its invisible characters as escapes; other values as they are."""
    if not isinstance(value, str):
        return "null" if value is None else str(value).lower() if isinstance(value, bool) else str(value)
    return '"' + "".join(f"\\u{ord(c):04x}" if _INVISIBLE.match(c) else c for c in value) + '"'


# ---- as columns ----------------------------------------------------------------------------------------------------


def normalised_column(text: Column) -> Column:
    """normalised() as built-in expressions."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, SPACES, " "), NOTHING, ""), BLANK + "+", " "))


def only_invisible_column(a: Column, b: Column) -> Column:
    """only_invisible() as built-in expressions; false where a side is null."""
    return F.coalesce((a != b) & (normalised_column(a) == normalised_column(b)), F.lit(False))


def has_invisible_column(text: Column) -> Column:
    return F.coalesce((text == "") | text.rlike(INVISIBLE) | text.rlike("^ | $|  "), F.lit(False))


_LINES = "array<struct<op:string,text:string,a:int,b:int,marked:array<boolean>,hidden:int>>"


def unified_diff_column(a: Column, b: Column) -> Column:
    """unified_diff() of two columns, in Arrow batches; null where a side is null or a text is too large."""
    @F.pandas_udf(_LINES)
    def diffs(left: pd.Series, right: pd.Series) -> pd.Series:
        def one(x: Any, y: Any):
            found = None if x is None or y is None else unified_diff(x, y)
            return None if found is None else [{"op": d.op, "text": d.text, "a": d.a, "b": d.b, "marked": None if d.marked is None else list(d.marked), "hidden": d.hidden} for d in found]

        return pd.Series([one(x, y) for x, y in zip(left, right, strict=True)], dtype=object)

    return diffs(a, b)


def text_diffs(rows: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """keys, too_large, op, text, a, b, marked and hidden: a row for each line of the diff of each row's texts.

    A pair without a diff has one row without a line: too_large tells whether it has texts on both sides.
    """
    diffed = rows.withColumn("__fd_lines", unified_diff_column(F.col(left), F.col(right)))
    too_large = F.col(left).isNotNull() & F.col(right).isNotNull() & F.col("__fd_lines").isNull()
    return diffed.select(*keys, too_large.alias("too_large"), F.inline_outer("__fd_lines"))


# ---- numbers, filters and statuses in words ------------------------------------------------------------------------


def share(part: int, whole: int) -> str:
    """A share in percent that is 0 or 100 only if exact."""
    if not whole:
        return "–"
    if part in (0, whole):
        return "100%" if part else "0%"
    p = 100 * part / whole
    return "<0.1%" if p < 0.1 else ">99.9%" if p > 99.9 else f"{p:.1f}%"


def delta(a: Any, b: Any) -> str | None:
    """b - a with its sign, exact for whole numbers that come as text; None if a side is no number."""
    whole = re.compile(r"-?\d+")
    if (isinstance(a, str) or isinstance(b, str)) and all(not isinstance(v, (bool, float)) and whole.fullmatch(str(v)) for v in (a, b)):
        return f"{int(b) - int(a):+,}" if int(b) != int(a) else "0"
    if any(isinstance(v, bool) or not isinstance(v, (int, float)) for v in (a, b)):
        return None
    d = b - a
    if d and abs(d) < 0.01:
        digits, power = f"{d:+.2e}".split("e")
        return f"{digits}e{int(power):+d}"
    said = f"{d:,.2f}".rstrip("0").rstrip(".") if isinstance(d, float) else f"{d:,}"
    return ("+" if d > 0 else "") + said


#: Words for the filter operators (fixed values).
OPERATOR_WORDS = {
    "contains": "contains", "not_contains": "does not contain", "equals": "equals", "starts": "starts with", "ends": "ends with",
    "is_empty": "is empty", "not_empty": "is not empty", "is_null": "is null", "not_null": "is not null",
    "between": "between", "eq": "=", "ne": "≠", "true": "is true", "false": "is false",
}
_BARE = ("is_empty", "not_empty", "is_null", "not_null", "true", "false")


def describe_filter(kind: str, op: str, a: str = "", b: str = "") -> str:
    """A filter in words."""
    if op in _BARE:
        return OPERATOR_WORDS[op]
    if op == "between":
        return f"{a} – {b}" if a and b else f"≥ {a}" if a else f"≤ {b}"
    return f"{OPERATOR_WORDS.get(op, op)} “{a}”" if kind == "string" else f"{OPERATOR_WORDS.get(op, op)} {a}"


#: Presets of the status filter.
PRESETS = {"all": ("equal", "mismatch", "missing_right", "missing_left"), "diff": ("mismatch", "missing_left", "missing_right"), "single": ("missing_left", "missing_right")}


def describe_statuses(statuses: Iterable[str], label: Callable[[str], str] = str) -> str:
    """A choice of statuses in words."""
    chosen = set(statuses)
    if not chosen or chosen == set(PRESETS["all"]):
        return "All" if chosen else "None"
    if chosen == set(PRESETS["diff"]):
        return "All differences"
    return ", ".join(label(s) for s in PRESETS["all"] if s in chosen)


def next_sort(column: Any, current: Any, descending: bool) -> tuple[Any, bool]:
    """What a click on a column makes of the sort: ascending, descending, off."""
    if column != current:
        return column, False
    return (None, False) if descending else (column, True)


def visible_columns(columns: Sequence[Any], diff_columns: Iterable[int], filtered: Iterable[int] = (), diff_column: int | None = None, only_differing: bool = True) -> list[int]:
    """Places of the columns to show: all, or those not compared, differing in the view, or filtered on."""
    keep = {*diff_columns, *filtered, diff_column}
    return [k for k, c in enumerate(columns) if not only_differing or c.kind != "compared" or k in keep]
