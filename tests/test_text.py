"""Text functions."""

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import text as t

BEFORE = ["# Bread", "Mix 500 g flour with water.", "Knead.", "", *(f"step {k}: wait" for k in range(12)), "Bake at 230 degrees for an hour.", "Cool"]


def marked(line):
    return "".join(c for c, m in zip(line.text, line.marked, strict=True) if m)


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[-1]))
    return row[-1]


def test_edit_scripts_are_shortest_and_rebuild():
    dice = random.Random(6)
    for _ in range(200):
        a, b = ("".join(dice.choice("pqr") for _ in range(dice.randrange(12))) for _ in range(2))
        script = t.edit_script(a, b)
        assert len(script) - script.count("=") == len(a) + len(b) - 2 * longest_common(a, b)
        old, new = iter(a), iter(b)
        made = [(next(old) if op != "+" else None, next(new) if op != "-" else None) for op in script]
        assert all(x == y for (x, y), op in zip(made, script, strict=True) if op == "=") and next(old, None) is None and next(new, None) is None
    assert t.edit_script(range(520), range(1000, 1520)) is None


def test_unified_diff_marks_words_and_hides_what_is_far():
    after = list(BEFORE)
    after[1] = "Mix 450 g flour with water."
    after[-2:] = ["Bake at 210 degrees for an hour.", "Cool", "Slice"]
    diff = t.unified_diff("\n".join(BEFORE), "\n".join(after))
    shown = lambda op: [d.text.rstrip("\n") for d in diff if d.op == op]
    assert shown("-") == [BEFORE[1], BEFORE[-2], BEFORE[-1]][: len(shown("-"))] and after[1] in shown("+") and "Slice" in shown("+")
    words = lambda op: [marked(d) for d in diff if d.op == op and d.marked is not None]
    assert words("-")[:2] == ["500", "230"] and words("+")[:2] == ["450", "210"]
    hidden = sum(d.hidden for d in diff if d.op == "…")
    assert hidden > 5 and hidden + sum(d.op in "=-" for d in diff) == len(BEFORE)


def test_lines_with_nothing_in_common_are_not_marked():
    diff = t.unified_diff("head\nred\ntail", "head\nBLUE\ntail")
    assert [(d.op, d.text.strip(), d.marked) for d in diff] == [("=", "head", None), ("-", "red", None), ("+", "BLUE", None), ("=", "tail", None)]


def test_large_texts_are_not_diffed():
    assert t.unified_diff("x\n" * 2001, "y") is None


@pytest.mark.parametrize(("a", "b", "same"), [("a b", "a b", True), ("a", "a ", True), ("a​b", "ab", True), ("a", "b", False), ("a", "a", False), ("a", None, False)])
def test_only_invisible(spark, a, b, same):
    assert t.only_invisible(a, b) is same
    row = spark.createDataFrame([(a, b)], "a string, b string").select(t.only_invisible_column(F.col("a"), F.col("b"))).first()
    assert row[0] is same


@pytest.mark.parametrize(("text", "found", "shown"), [("", True, '""'), ("a b", False, "a b"), (" a", True, "␣a"), ("a  b", True, "a␣␣b"), ("a\tb", True, "a→b"), ("​", True, "ZWSP"), ("\x01", True, "U+0001")])
def test_invisible(spark, text, found, shown):
    assert t.has_invisible(text) is found
    assert t.visible(text) == shown
    assert spark.createDataFrame([(text,)], "a string").select(t.has_invisible_column(F.col("a"))).first()[0] is found


def test_shares_are_whole_only_if_exact():
    for whole in (1, 3, 1000, 123_457):
        for part in (0, 1, whole // 3, whole - 1, whole):
            said = t.share(part, whole)
            assert (said == "0%") == (part == 0) and (said == "100%") == (part == whole)
            if said[0].isdigit() and 0 < part < whole:
                assert abs(float(said[:-1]) - 100 * part / whole) <= 0.05


def test_words_follow_views():
    assert t.describe_filter("datetime", "between", "", "2020-02-02") == "≤ 2020-02-02"
    clicks, state = [], (None, False)
    for _ in range(4):
        state = t.next_sort("kilos", *state)
        clicks.append(state)
    assert clicks == [("kilos", False), ("kilos", True), (None, False), ("kilos", False)]
    assert "".join(t.lines("x\r\n\ny\u2028z")) == "x\r\n\ny\u2028z"


def test_diff_rows(spark):
    large = "".join(f"line {k}\n" for k in range(2500))
    rows = spark.createDataFrame([(1, "kept\nold", "kept\nnew"), (2, None, "alone"), (3, large, large + "more\n")], "id int, a string, b string")
    got = sorted((tuple(r) for r in t.text_diffs(rows, ["id"], "a", "b").select("id", "too_large", F.coalesce("op", F.lit("none")), "text").where("id < 3").collect()), key=str)
    assert got == sorted([(1, False, "=", "kept\n"), (1, False, "-", "old"), (1, False, "+", "new"), (2, False, "none", None)], key=str)
    assert [tuple(r) for r in t.text_diffs(rows.where("id = 3"), ["id"], "a", "b").select("id", "too_large", "op").collect()] == [(3, True, None)]
