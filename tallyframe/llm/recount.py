"""Edit-aware token counts: a segment tree of pre-tokens for each document.

A byte-pair tokenizer splits a text into pre-tokens and encodes each by itself, so a document's count is the sum over
its pre-tokens. The tree keeps that sum, and how many characters and pre-tokens there are, for every subtree. An edit
splits anew only from the first pre-token whose match could have looked at an edited character to the first border
after the edit that was one before; only new pre-tokens are encoded, and sums change on the paths above them. Trees
are kept as a column, so that the next edits of a document begin with what the last ones left.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import empty_text, table, written

#: Pre-tokens of a leaf; pre-tokens whose count a worker keeps.
LEAF, MOST_KEPT = 32, 500_000
#: Characters that a match may have looked at behind its end and a run of white space that follows: an apostrophe's two letters.
AHEAD = 3
#: What makes a match depend on characters before it, which edits there would change.
BEHIND = ("(?<=", "(?<!", r"\b", r"\B", r"\G", r"\K", r"\m", r"\M", "^")
EDITS = "array<struct<start:long,end:long,text:string>>"


@cache
def counter(path: str, pattern: str):
    """A function that counts the tokens of a pre-token, by a file of ranked tokens."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    kept: dict[str, int] = {}

    def count(piece: str) -> int:
        n = kept.get(piece)
        if n is None:
            n = len(encode(piece))
            if len(kept) < MOST_KEPT:
                kept[piece] = n
        return n

    return count


class Node:
    """A subtree: its characters, tokens and pre-tokens; a leaf has the pre-tokens and their counts."""

    __slots__ = ("chars", "tokens", "pieces", "left", "right", "texts", "counts")

    def __init__(self, texts: list[str] | None, counts: list[int] | None, left: Node | None = None, right: Node | None = None):
        self.texts, self.counts, self.left, self.right = texts, counts, left, right
        if texts is None:
            self.chars, self.tokens, self.pieces = left.chars + right.chars, left.tokens + right.tokens, left.pieces + right.pieces
        else:
            self.chars, self.tokens, self.pieces = sum(map(len, texts)), sum(counts), len(texts)

    @staticmethod
    def built(texts: list[str], counts: list[int]) -> Node:
        if len(texts) <= LEAF:
            return Node(texts, counts)
        mid = len(texts) // 2
        return Node(None, None, Node.built(texts[:mid], counts[:mid]), Node.built(texts[mid:], counts[mid:]))

    def at(self, char: int) -> tuple[int, int]:
        """The number of the pre-token that covers a character and where it starts; at the end: one past the last."""
        node, before, start = self, 0, 0
        while node.texts is None:
            if char < start + node.left.chars:
                node = node.left
            else:
                before, start, node = before + node.left.pieces, start + node.left.chars, node.right
        for x in node.texts:
            if char < start + len(x):
                break
            before, start = before + 1, start + len(x)
        return before, start

    def pieces_from(self, first: int) -> Iterator[str]:
        if self.texts is not None:
            yield from self.texts[first:]
        else:
            if first < self.left.pieces:
                yield from self.left.pieces_from(first)
            yield from self.right.pieces_from(max(0, first - self.left.pieces))

    def piece(self, number: int) -> str:
        return next(self.pieces_from(number))

    def flat(self) -> tuple[list[str], list[int]]:
        """All pre-tokens and their counts."""
        texts, counts, todo = [], [], [self]
        while todo:
            node = todo.pop()
            if node.texts is None:
                todo += (node.right, node.left)
            else:
                texts += node.texts
                counts += node.counts
        return texts, counts

    def replaced(self, first: int, end: int, texts: list[str], counts: list[int]) -> Node:
        """This tree with pre-tokens first to end exchanged; subtrees outside stay as they are."""
        if self.texts is not None:
            return Node.built(self.texts[:first] + texts + self.texts[end:], self.counts[:first] + counts + self.counts[end:])
        mid = self.left.pieces
        if end <= mid and (first < mid or not self.right.pieces):
            return Node._joined(self.left.replaced(first, end, texts, counts), self.right)
        if first >= mid:
            return Node._joined(self.left, self.right.replaced(first - mid, end - mid, texts, counts))
        return Node._joined(self.left.replaced(first, mid, texts, counts), self.right.replaced(0, end - mid, [], []))

    @staticmethod
    def _joined(left: Node, right: Node) -> Node:
        """Both under one node; where one holds over three quarters of both, or both fit a leaf, built anew, so that no path grows long."""
        if not left.pieces or not right.pieces:
            return right if not left.pieces else left
        node, both = Node(None, None, left, right), left.pieces + right.pieces
        if both <= LEAF or 4 * max(left.pieces, right.pieces) > 3 * both + 4 * LEAF:
            return Node.built(*node.flat())
        return node

    def packed(self) -> bytes:
        """The tree's pre-tokens and their counts, to be kept."""
        texts, counts = self.flat()
        lens, counts = np.fromiter(map(len, texts), "<u4", len(texts)), np.array(counts, "<u4")
        short = bool(len(texts) and max(lens.max(), counts.max()) < 256)
        kind = "u1" if short else "<u4"
        raw = b"".join((lens.astype(kind).tobytes(), counts.astype(kind).tobytes(), "".join(texts).encode("utf-8", "surrogatepass")))
        return b"".join((len(raw).to_bytes(8, "little"), len(texts).to_bytes(8, "little"), bytes([short]), pa.Codec("zstd", 1).compress(raw, asbytes=True)))

    @staticmethod
    def unpacked(kept: bytes) -> Node:
        size, n, short = int.from_bytes(kept[:8], "little"), int.from_bytes(kept[8:16], "little"), kept[16]
        raw = pa.Codec("zstd", 1).decompress(kept[17:], size, asbytes=True)
        kind = np.dtype("u1" if short else "<u4")
        lens, counts = np.frombuffer(raw, kind, n), np.frombuffer(raw, kind, n, n * kind.itemsize)
        text, ends = raw[2 * n * kind.itemsize :].decode("utf-8", "surrogatepass"), np.cumsum(lens, dtype=np.int64).tolist()
        return Node.built([text[s:e] for s, e in zip([0, *ends], ends)], counts.tolist())  # noqa: B905


class Counted:
    """A document whose token count follows edits.

    pattern: of pre-tokens, which must cover every character, and whose matches depend on no character before them and
    on at most AHEAD behind their end and the white space that follows. One that looks back is refused, and so is a
    text that it doesn't cover.
    """

    def __init__(self, text: str | None, path: str, pattern: str, tree: Node | None = None):
        if any(x in pattern.replace("[^", "") for x in BEHIND):
            raise ValueError(f"the pattern's matches depend on what comes before them: {pattern}")
        self.split, self.count, self.encoded = regex.compile(pattern), counter(path, pattern), 0
        if tree is None:
            texts = self.split.findall(text)
            if sum(map(len, texts)) != len(text):
                raise ValueError(f"the pattern leaves characters out: {pattern}")
            tree = Node.built(texts, list(map(self.count, texts)))
        self.tree = tree

    @property
    def tokens(self) -> int:
        return self.tree.tokens

    @property
    def text(self) -> str:
        return "".join(self.tree.pieces_from(0))

    def _first(self, start: int) -> tuple[int, int]:
        """The first pre-token whose match may have looked at the character at start, and where it starts."""
        number, at = self.tree.at(max(0, start - AHEAD))
        upto = max(0, start - AHEAD) - at  # of this pre-token lies before
        while number:
            if upto and not (self.tree.piece(number)[:upto]).isspace():
                break
            piece = self.tree.piece(number - 1)
            number, at, upto = number - 1, at - len(piece), len(piece)
        return number, at

    def edit(self, start: int, end: int, text: str) -> None:
        """Puts text in the place of the characters from start to end, both moved into the document."""
        size = self.tree.chars
        start = min(max(0, start), size)
        end = min(max(start, end), size)
        first, at = self._first(start)
        old = self.tree.pieces_from(first)
        taken, borders, ahead = [], {}, at  # old pre-tokens read so far, their ends
        want = end + 64

        def read() -> None:
            nonlocal ahead
            while ahead < want:
                piece = next(old, None)
                if piece is None:
                    return
                taken.append(piece)
                ahead += len(piece)
                borders[ahead] = len(taken)

        while True:
            read()
            over = "".join(taken)
            region = over[: start - at] + text + over[end - at :]
            shift = start + len(text) - end
            whole = ahead >= size
            new, upto, met = [], 0, None
            for match in self.split.finditer(region):
                if not whole and _blank_end(region, match.end()) + AHEAD > len(region):
                    break
                new.append(match.group())
                upto = match.end()
                place = at + upto - shift
                if place >= end and place in borders:
                    met = borders[place]
                    break
            if met is None and whole:
                met = len(taken)
            if met is not None:
                break
            want += max(64, want - at)  # twice as far, so that long runs are read in linear time
        self.encoded += len(new)
        self.tree = self.tree.replaced(first, first + met, new, list(map(self.count, new)))


def _blank_end(text: str, at: int) -> int:
    """Where the white space that begins at a place ends."""
    while at < len(text) and text[at].isspace():
        at += 1
    return at


_COUNTS = "n_pieces long, n_tokens long"


def trees(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in keep, n_pieces, n_tokens and tree (bytes) of each row of docs.

    Null text: empty. Other columns are ignored. Empty table: no rows.
    """
    asked = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                made = [Counted(x.as_py(), path, pattern).tree for x in batch.column(len(asked))]
                counts = [pa.array([getattr(t, c) for t in made], pa.int64()) for c in ("pieces", "tokens")]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *counts, pa.array([t.packed() for t in made], pa.binary())], [*asked, "n_pieces", "n_tokens", "tree"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select(*asked, empty_text().alias("counted text")).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in asked), _COUNTS, "tree binary"]))


def edited(kept: DataFrame, path: str, pattern: str, edits: str = "edits", keep: bool = True) -> DataFrame:
    """doc_id, n_pieces, n_tokens, n_edits, n_pieces_after, n_tokens_after, n_encoded and, to keep, the new tree of each row of kept.

    kept: as trees() makes it, or this function, with a column of type EDITS. Edits are applied in order; positions are
    code points in the text as it then is and are moved into it. n_encoded: pre-tokens that the edits had encoded. Null
    edits, or a null in one's places, are left out; a null replacement is empty. Empty table: no rows.
    """
    kind = kept.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_pieces", "n_tokens", "n_edits", "n_pieces_after", "n_tokens_after", "n_encoded", "tree"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                rows = []
                for tree, todo in zip(batch.column(1), batch.column(2), strict=True):
                    doc = Counted(None, path, pattern, Node.unpacked(tree.as_py()))
                    row = [doc.tree.pieces, doc.tokens]
                    fine = [e for e in todo.as_py() or [] if e and e["start"] is not None and e["end"] is not None]
                    for e in fine:
                        doc.edit(e["start"], e["end"], e["text"] or "")
                    rows.append((*row, len(fine), doc.tree.pieces, doc.tokens, doc.encoded, doc.tree.packed() if keep else None))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1], pa.binary())], names)

    schema = ", ".join([f"doc_id {kind}", *(f"{n} long" for n in names[1:-1]), "tree binary"])
    return kept.select("doc_id", "tree", F.col(edits).cast(EDITS).alias("edits")).mapInArrow(run, schema).drop(*([] if keep else ["tree"]))


def recounted(docs: DataFrame, path: str, pattern: str, edits: str = "edits", keep: bool = True) -> DataFrame:
    """What edited() gives for trees of docs, which are written to the shared folder first. Repeated rows are edited each."""
    return edited(written(trees(docs, path, pattern, (edits,)), "token-trees"), path, pattern, edits, keep)


def op8_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents before and after three edits each: a replacement, an insertion and a deletion."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    size = F.length(empty_text()) + 1
    at = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), size)
    edit = lambda start, more, text: F.struct(start.alias("start"), (start + more).alias("end"), F.lit(text).alias("text"))
    edits = F.array(edit(at(1), 12, " it's 2024, changed"), edit(at(2), 0, "new  words\n"), edit(at(3), 40, ""))
    return recounted(docs.withColumn("edits", edits), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=False)
