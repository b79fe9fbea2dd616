"""Invariants over generated pairs of tables. Many small pairs go through one comparison, told apart by a key column."""

import math
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallyframe import compare
from tallyframe.plans.view import ColumnFilter, Query, ViewEngine

few = settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True)
value = st.tuples(
    st.none() | st.integers(-3, 3),
    st.none() | st.sampled_from([math.nan, 0.0, -0.0, 1.5, 2.0, 1e300]),
    st.none() | st.sampled_from(["", " ", "a", "a ", "b", " ", "ä"]),
    st.none() | st.booleans(),
)
unique_side = st.dictionaries(st.integers(0, 40), value, max_size=25)
pairs = st.lists(st.tuples(unique_side, unique_side), min_size=20, max_size=30)
repeated_side = st.lists(st.tuples(st.none() | st.integers(0, 3), st.none() | st.integers(0, 2)), max_size=12)
repeated_pairs = st.lists(st.tuples(repeated_side, repeated_side), min_size=20, max_size=30)
SCHEMA = "case long, id long, i long, f double, s string, b boolean"


def frames(spark, cases):
    return tuple(spark.createDataFrame([(k, i, *v) for k, case in enumerate(cases) for i, v in case[side].items()], SCHEMA) for side in (0, 1))


def plain(v):
    return tuple(None if isinstance(x, float) and math.isnan(x) else x for x in v)


@few
@given(pairs)
def test_unique_keys(spark, cases):
    left, right = frames(spark, cases)
    result = compare(left, right, ["case", "id"])
    want = Counter()
    by_column = Counter()
    for a, b in cases:
        for key in a.keys() | b.keys():
            if key in a and key in b:
                x, y = plain(a[key]), plain(b[key])
                want["equal" if x == y else "mismatch"] += 1
                by_column.update(c for c, p, q in zip("ifsb", x, y, strict=True) if p != q)
            else:
                want["missing_right" if key in a else "missing_left"] += 1
    s = result.summary
    assert {n: getattr(s, n) for n in ("equal", "mismatch", "missing_left", "missing_right")} == {n: want[n] for n in ("equal", "mismatch", "missing_left", "missing_right")}
    assert s.total == want.total() and s.left_rows == left.count() and s.right_rows == right.count()
    assert {c.name: c.mismatches for c in result.columns if c.kind == "compared"} == {c: by_column[c] for c in "ifsb"}
    assert Counter(r["column"] for r in result.mismatches().collect()) == +by_column
    for r in result.frame().select("status", "differing").collect():
        assert (r["status"] == "mismatch") == bool(r["differing"])
    swapped = compare(right, left, ["case", "id"]).summary
    assert (swapped.equal, swapped.mismatch, swapped.missing_left, swapped.missing_right) == (s.equal, s.mismatch, s.missing_right, s.missing_left)
    same = compare(left, left, ["case", "id"]).summary
    assert (same.equal, same.total) == (s.left_rows, s.left_rows)


@few
@given(pairs)
def test_views(spark, cases):
    result = compare(*frames(spark, cases), ["case", "id"])
    engine = ViewEngine(result)
    ids = lambda q: list(engine._sorted(q, engine.view(q)))
    whole = ids(Query())
    assert whole == list(range(result.summary.total))
    parts = [ids(Query(statuses=frozenset({s}))) for s in ("equal", "mismatch", "missing_right", "missing_left")]
    assert sorted(sum(parts, [])) == whole
    for column in (2, 3):
        differ, equal = ids(Query(diff_column=column)), ids(Query(diff_column=column, diff_equal=True))
        assert sorted(differ + equal) == sorted(parts[0] + parts[1])
    for q in (Query(sort_column=3), Query(sort_column=4, descending=True), Query(sort_by_status=True)):
        assert sorted(ids(q)) == whole
    some = Query(filters=(ColumnFilter(2, "between", "-1", ""),), sort_column=2)
    first = engine.page(some, 0, 7)
    paged = [r["id"] for k in range(-(-first["filtered"] // 7)) for r in engine.page(some, k, 7)["rows"]]
    assert paged == ids(some) and engine.page(some, 10**6, 7)["page"] == max(0, -(-first["filtered"] // 7) - 1)
    assert len(engine.export_csv(Query(statuses=frozenset({"mismatch"}))).decode().split("\n")) >= len(parts[1]) + 1


@pytest.mark.parametrize("mode", ["match", "number"])
@few
@given(repeated_pairs)
def test_repeated_keys(spark, mode, cases):
    sides = tuple(spark.createDataFrame([(k, *row) for k, case in enumerate(cases) for row in case[side]], "case long, id long, v long").coalesce(1) for side in (0, 1))
    result = compare(*sides, ["case", "id"], duplicates=mode)
    s = result.summary
    counts = [Counter((k, row[0]) for k, case in enumerate(cases) for row in case[side]) for side in (0, 1)]
    assert s.left_rows == counts[0].total() and s.right_rows == counts[1].total()
    assert s.found == sum((counts[0] & counts[1]).values())
    assert (s.duplicate_keys_left, s.duplicate_keys_right) == tuple(sum(n > 1 for n in c.values()) for c in counts)
    shown = defaultdict(Counter)
    for r in result.frame().collect():
        if r["status"] != "missing_left":
            shown[0][r["case"], r["id"], r["v [left]"]] += 1
        if r["status"] != "missing_right":
            shown[1][r["case"], r["id"], r["v [right]"]] += 1
    full = [Counter((k, *row) for k, case in enumerate(cases) for row in case[side]) for side in (0, 1)]
    assert [shown[0], shown[1]] == full
    common = sum((full[0] & full[1]).values())
    assert s.equal == common if mode == "match" else s.equal <= common
