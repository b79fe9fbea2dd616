"""Token counts that follow edits, against counting the edited text anew."""

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402

from tallyframe.llm import recount  # noqa: E402

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
#: A pattern whose matches look past white space for a line's end, and one with case runs and contractions behind words.
LINES = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
CASES = r"[^\r\n\p{L}\p{N}]?\p{Lu}*\p{Ll}+(?i:'s|'t|'re|'ve|'m|'ll|'d)?|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+|\s+(?!\S)|\s+"
POOL = ["a", "word", "WORD", " ", "  ", "\n", "\t", "\r\n", "     ", "'s", "'", "'r", "e", "12", "3", ",", "...", "é", "日本", "don't", "I'll", " ", "x" * 50]


def some(dice, n):
    return "".join(dice.choice(POOL) for _ in range(dice.randint(0, n)))


@pytest.mark.parametrize("pattern", [PATTERN, LINES, CASES])
def test_edits_match_counting_anew(pattern):
    dice = random.Random(3)
    for _ in range(250):
        text = some(dice, dice.choice([3, 30, 400]))
        doc = recount.Counted(text, PATH, pattern)
        for _ in range(6):
            start = dice.randint(-2, len(text) + 2)
            end = start + dice.choice([0, 0, 1, 3, 20, 500])
            new = some(dice, dice.choice([0, 2, 10]))
            doc.edit(start, end, new)
            low = min(max(0, start), len(text))
            text = text[:low] + new + text[min(max(low, end), len(text)) :]
            assert doc.text == text
            assert list(doc.tree.pieces_from(0)) == doc.split.findall(text)
            assert doc.tokens == recount.Counted(text, PATH, pattern).tokens
            assert doc.tree.chars == len(text)
        kept = recount.Node.unpacked(doc.tree.packed())
        assert list(kept.pieces_from(0)) == list(doc.tree.pieces_from(0)) and kept.tokens == doc.tokens


def test_a_line_end_reaches_back_over_white_space():
    doc = recount.Counted("a\n     x", PATH, LINES)
    doc.edit(6, 6, "\n")
    assert list(doc.tree.pieces_from(0)) == doc.split.findall("a\n    \n x")


def test_a_small_edit_encodes_little():
    doc = recount.Counted("some words here, and more. " * 4000, PATH, PATTERN)
    doc.edit(50_000, 50_003, "new")
    assert doc.encoded < 12


def _deep(node):
    return 1 if node.texts is not None else 1 + max(_deep(node.left), _deep(node.right))


def test_trees_stay_shallow():
    doc = recount.Counted("", PATH, PATTERN)
    for _ in range(20_000):  # at the end
        doc.edit(doc.tree.chars, doc.tree.chars, " ab")
    assert doc.tree.pieces == 20_000 and _deep(doc.tree) < 40
    for _ in range(5_000):  # at the beginning
        doc.edit(0, 0, " cd")
    assert _deep(doc.tree) < 40
    doc.edit(0, 15_000, "")
    for _ in range(20):  # large parts go
        doc.edit(0, doc.tree.pieces * 2 // 5 * 3, "")
    assert _deep(doc.tree) < 20 and doc.text == " ab" * doc.tree.pieces


def test_patterns_that_look_back_or_leave_out_are_refused():
    with pytest.raises(ValueError, match="come"):
        recount.Counted("a b", PATH, r"(?<=a) b|\w|\s")
    with pytest.raises(ValueError, match="out"):
        recount.Counted("a b", PATH, r"\w+")


def _slow(text, edits):
    text = text or ""
    before, n = recount.Counted(text, PATH, PATTERN), 0
    for e in edits or []:
        if e and e[0] is not None and e[1] is not None:
            low = min(max(0, e[0]), len(text))
            text = text[:low] + (e[2] or "") + text[min(max(low, e[1]), len(text)) :]
            n += 1
    after = recount.Counted(text, PATH, PATTERN)
    return before.tree.pieces, before.tokens, n, after.tree.pieces, after.tokens


def test_rows(spark):
    dice = random.Random(5)
    rows = [(k, some(dice, 200), [(dice.randint(-3, 300), dice.randint(-3, 300), some(dice, 4)) for _ in range(dice.randint(0, 4))], "clash", "clash", "clash") for k in range(40)]
    rows += [(40, None, [(0, 0, "new"), None, (None, 2, "x"), (1, None, "x"), (0, 1, None)], *("clash",) * 3), (41, "", None, *("clash",) * 3), (None, "some text", [], *("clash",) * 3), (43, "long word " * 30_000, [(150_000, 150_004, "else")], *("clash",) * 3)]
    rows += [rows[0], rows[0]]
    schema = f"doc_id long, text string, edits {recount.EDITS}, tree string, n_tokens string, `counted text` string"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    got = recount.recounted(docs, PATH, PATTERN).collect()
    assert len(got) == len(rows)
    want = {r[0]: _slow(r[1], r[2]) for r in rows}
    for r in got:
        assert tuple(r)[1:6] == want[r.doc_id]
    assert [r.n_encoded for r in got if r.doc_id == 43][0] < 12
    assert recount.recounted(docs.limit(0), PATH, PATTERN).count() == 0


def test_trees_follow_one_edit_after_another(spark):
    docs = spark.createDataFrame([(1, "one two  three"), (2, "it's")], "doc_id long, text string")
    kept = recount.trees(docs, PATH, PATTERN)
    for k, new in enumerate(["more ", "'ll ", "\n"]):
        kept = recount.edited(kept.withColumn("edits", F.array(F.struct(F.lit(k).cast("long").alias("start"), F.lit(k).cast("long").alias("end"), F.lit(new).alias("text")))), PATH, PATTERN)
    texts = {1: "one two  three", 2: "it's"}
    for d, t in texts.items():
        for k, new in enumerate(["more ", "'ll ", "\n"]):
            t = t[:k] + new + t[k:]
        texts[d] = t
    for r in kept.collect():
        anew = recount.Counted(texts[r.doc_id], PATH, PATTERN)
        assert (r.n_pieces_after, r.n_tokens_after) == (anew.tree.pieces, anew.tokens)
        assert list(recount.Node.unpacked(r.tree).pieces_from(0)) == list(anew.tree.pieces_from(0))
