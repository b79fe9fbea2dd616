"""Pairing of repeated keys: the same rows however many there are, in one step where no key has many."""

import pytest

from tallyframe import compare
from tallyframe.operators import pairing

from .test_compare import counts, greedy, rows


@pytest.mark.parametrize("most", [10_000, 1])
def test_likeness_decides_however_many_candidates(spark, monkeypatch, most):
    monkeypatch.setattr(pairing, "MOST_FOR_KEY", most)
    monkeypatch.setattr(pairing, "MOST_IN_ALL", 3, raising=False)
    before = [(k, i, 7 * i % 5, i % 3) for k in (None, 1) for i in range(9)]
    after = [(k, 8 - i, 3 * i % 5, i % 4) for k in (None, 1) for i in range(11)]
    a, b = (spark.createDataFrame(x, "k int, p int, q int, r int").coalesce(1) for x in (before, after))
    result = compare(a, b, "k")
    want = [greedy([x[1:] for x in before if x[0] == k], [x[1:] for x in after if x[0] == k]) for k in (None, 1)]
    shown = rows(result.frame("mismatch"), "k", "p [left]", "q [left]", "r [left]", "p [right]", "q [right]", "r [right]")
    assert shown == sorted([(k, *x, *y) for k, w in zip((None, 1), want, strict=True) for x, y in w[1]], key=repr)
    assert counts(result) == (sum(w[0] for w in want), sum(len(w[1]) for w in want), 0, 4)


def test_a_key_with_over_ten_thousand_candidates_pairs_by_likeness(spark):
    a = spark.createDataFrame([("x", i, 0) for i in range(110)], "k string, p int, q int").coalesce(1)
    b = spark.createDataFrame([("x", 109 - i, 1) for i in range(110)], "k string, p int, q int").coalesce(1)
    assert rows(compare(a, b, "k").frame("mismatch"), "p [left]", "p [right]") == sorted([(i, i) for i in range(110)], key=repr)
