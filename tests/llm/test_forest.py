"""Neighbours from a forest of random projections."""

import numpy as np
import pytest

from tallyframe.llm import forest

SCHEMA = "vec_id long, embedding array<float>, leaf string, value string, first string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "clash", "clash", "clash") for i, v in rows], SCHEMA).repartition(3)


def exact(rows, query, k):
    v = np.array([x for _, x in rows], np.float32).astype(np.float64)
    ids = np.array([i for i, _ in rows])
    d = np.sqrt(((v - v[ids == query][0]) ** 2).sum(1))
    return [(int(ids[j]), d[j]) for j in np.lexsort((ids, d)) if ids[j] != query][:k]


def test_exhaustive_search_is_exact_with_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(forest, "ROWS", 8)
    monkeypatch.setattr(forest, "QUERIES", 4)
    dice = np.random.Generator(np.random.PCG64(2))
    rows = [(k, dice.integers(-2, 3, 4)) for k in range(150)]
    rows = [(k, v if v.any() else np.ones(4, int)) for k, v in rows] + [(150 + k, [1, 1, 1, 2]) for k in range(60)]
    bad = [(900, None), (901, [0, 0, 0, 0]), (902, [float("nan"), 1, 1, 1]), (903, [float("inf"), 1, 1, 1]), (904, [None, 1, 1, 1]), (905, []), (906, [1, 2]), (None, [1, 1, 1, 1])]
    vectors = frame(spark, rows + bad)
    got = forest.neighbours(vectors, vectors.where("vec_id % 10 = 0"), 5, seen=99.0)
    by = {}
    for r in got.collect():
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(by) == list(range(0, 210, 10))
    for q, found in by.items():
        want = exact(rows, q, 5)
        assert [(a, b) for a, b, _ in sorted(found)] == [(k + 1, i) for k, (i, _) in enumerate(want)]
        assert np.allclose([s for _, _, s in sorted(found)], [d for _, d in want], rtol=1e-12)


def test_recall(spark):
    dice = np.random.Generator(np.random.PCG64(5))
    rows = [(k, v) for k, v in enumerate(dice.standard_normal((3000, 32)).astype(np.float32))]
    vectors = frame(spark, rows)
    got = forest.neighbours(vectors, vectors.where("vec_id % 100 = 0"), 10)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(found[q] & {i for i, _ in exact(rows, q, 10)}) for q in range(0, 3000, 100))
    assert hits >= 0.9 * 300


def test_few_or_no_vectors(spark):
    none = frame(spark, [])
    assert forest.neighbours(none, none).count() == 0
    nulls = frame(spark, [(None, None)] * 3)
    assert forest.neighbours(nulls, nulls).count() == 0
    one = frame(spark, [(100, [1, 0])])
    assert forest.neighbours(one, one).count() == 0
    two = frame(spark, [(100, [1, 0]), (100, [1, 0]), (7, [0, 1])])
    got = forest.neighbours(two, two.where("vec_id = 100")).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(100, 1, 7, pytest.approx(2**0.5))]


def test_queue_opens_every_leaf_in_the_end():
    dice = np.random.Generator(np.random.PCG64(9))
    trees = forest.Forest(dice.standard_normal((500, 6)), trees=3, depth=4)
    opened = trees.search(dice.standard_normal(6), 99.0)
    assert sorted(opened) == [(t, k) for t in range(3) for k in range(16)]
    q = dice.standard_normal(6)
    assert {(t, int(k)) for t, k in enumerate(trees.leaves(q[None])[0])} <= set(trees.search(q, 99.0)[:3])
