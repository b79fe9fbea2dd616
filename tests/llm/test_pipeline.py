"""The pipeline's stages over a small table, each against a slow version on the rows that it was given."""

import random
import re
from collections import Counter, defaultdict

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from tallyframe.llm import mixing, quality  # noqa: E402
from tallyframe.llm.common import written  # noqa: E402

from .test_documents import slow_components, slow_counts  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus():
    """Clean documents, junk, copies, near copies and documents that share a passage of 60 words."""
    dice = random.Random(12)
    clean = lambda n: [f"word{dice.randrange(30000)}" for _ in range(n)]
    texts = [" ".join(clean(dice.choice([80, 150, 400]))) for _ in range(160)]
    passage = clean(60)
    for _ in range(4):
        own = clean(120)
        texts.append(" ".join(own[:50] + passage + own[50:]))
    texts += texts[:3]
    for k in range(5):
        near = texts[3].split()
        near[k * 10] = "changed"
        texts.append(" ".join(near))
    texts += ["too short", None, "spam " * 200, "# $ % " * 100]
    return [(k, t, "en" if k % 2 else "de", f"s{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def stages(spark, corpus):
    docs = written(spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars long"), "corpus")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""), "stage")
        out.append(docs)
    return [(d.columns, d.collect()) for d in out]


def test_all_but_the_last_return_documents(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "repeated passages", "source weights", "packed sequences"]
    assert all(columns == COLUMNS for columns, _ in stages[:-1])


def test_quality(stages):
    before, after = stages[0][1], stages[1][1]
    kept = {r.doc_id for r in after}
    for r in before:
        n = slow_counts(r.text)
        if n[0] < 50 or 100 * n[4] > 50 * n[0]:
            assert r.doc_id not in kept
    assert set(range(172)) <= kept and not kept & {172, 173, 174, 175}
    assert Counter(after) == Counter(r for r in before if r.doc_id in kept)


def test_near_duplicates(stages):
    before, after = stages[1][1], stages[2][1]
    want = slow_components([(r.doc_id, r.text) for r in before])
    assert {r.doc_id for r in after} == {d for d, (_, c) in want.items() if c == d}
    assert set(after) <= set(before) and len(after) < len(before)


def test_passages(stages):
    before, after = {r.doc_id: r for r in stages[2][1]}, {r.doc_id: r for r in stages[3][1]}
    assert before.keys() == after.keys()
    first = {}
    for d in sorted(before):
        w = WORD.findall(before[d].text)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), d)
    for d, r in before.items():
        w = WORD.findall(r.text)
        repeated = {k + j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < d for j in range(50)}
        left = WORD.findall(after[d].text)
        if repeated:
            assert left == [x for k, x in enumerate(w) if k not in repeated]
        else:
            assert after[d] == r
        assert after[d].n_chars == len(after[d].text)
    assert sum(after[d] != before[d] for d in before) == 3


def test_weights(stages):
    before, after = stages[3][1], stages[4][1]
    size, taken = Counter(), Counter()
    for r in before:
        size[r.source] += len(WORD.findall(r.text))
    for r in after:
        taken[r.source] += len(WORD.findall(r.text))
    names = sorted(size)
    assert [taken[s] for s in names] == [round(t) for t in mixing.targets([(s, size[s]) for s in names])]
    texts = {r.doc_id: r.text for r in before}
    assert all(" ".join(WORD.findall(texts[r.doc_id])).startswith(" ".join(WORD.findall(r.text))) for r in after)
    assert max(Counter(r.doc_id for r in after).values()) <= 3


def test_packing(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    before, pieces = stages[4][1], stages[5][1]
    want = Counter()
    for r in before:
        want[r.doc_id] += len(tok.encode(r.text, add_special_tokens=False).ids) + 1
    got, held = Counter(), defaultdict(list)
    for p in pieces:
        got[p.doc_id] += p.length
        held[p.sequence_id].append((p.offset, p.length))
    assert got == want
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= -(-sum(want.values()) // 2048) * 11 // 9 + 1


def test_run(spark, corpus, stages, tmp_path):
    spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    made = corpus_pipeline.run(spark, str(tmp_path)).collect()
    shown = lambda rows: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert shown(made) == shown(stages[5][1])


def test_verdicts_are_the_filter(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in quality.filtered(docs).collect()} == {r.doc_id for r in quality.judge(docs).where("kept").collect()}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _staged(spark, rows):
    docs, out = spark.createDataFrame(rows, SCHEMA), []
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""), "stage")
        out.append(docs.collect())
    return out


def test_rows_without_or_with_repeated_ids(spark):
    dice = random.Random(31)
    clean = lambda n: " ".join(f"term{dice.randrange(10**6)}" for _ in range(n))
    a, b, c = clean(90), clean(120), clean(150)
    passage = clean(70)
    near = a.split()
    near[40] = "other"
    texts = [(None, a), (5, a), (5, b), (None, c), (None, c), (8, " ".join(near)), (9, f"{clean(60)} {passage}"), (None, f"{passage} {clean(60)}"), (9, None), (None, None), (None, ""), (8, "too short")]
    rows = [(d, t, [None, "en"][k % 2], [None, "s"][k % 3 == 0], None if t is None else len(t)) for k, (d, t) in enumerate(texts)]
    good, alone, cut, mix, packed = _staged(spark, rows)
    assert Counter((r.doc_id, r.text) for r in good) == Counter((d, t) for d, t in texts if t and len(t.split()) >= 50)
    # one row of each component: the least doc_id, null ones last
    assert Counter((r.doc_id, r.text) for r in alone) == Counter([(5, a), (5, b), (None, c), texts[6], texts[7]])
    assert set(alone) <= set(rows_of(rows))
    left = {(r.doc_id, r.text) for r in cut}
    assert texts[6] in left and len(cut) == len(alone) and [len(t.split()) for d, t in left if d is None and t != c] == [60]
    assert {r.doc_id for r in mix} <= {5, 9, None} and sum(p.length for p in packed) > 0


def rows_of(rows):
    from pyspark.sql import Row

    return [Row(doc_id=r[0], text=r[1], lang=r[2], source=r[3], n_chars=r[4]) for r in rows]


def test_no_rows(spark, tmp_path):
    assert _staged(spark, []) == [[]] * 5
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
