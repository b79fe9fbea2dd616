"""Comparison: statuses, types, errors, repeated keys."""

import datetime as dt
import decimal
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe import compare
from tallyframe.functions.types import DtypeMismatchError, common_type
from tallyframe.operators import pairing


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)


def counts(result):
    s = result.summary
    return s.equal, s.mismatch, s.missing_right, s.missing_left


def test_rows_and_counts(result, expected):
    assert rows(result.frame(), "crate", "status", "differing") == sorted([(r.key, r.status, [c for c in result.compared if c in r.differing]) for r in expected], key=repr)
    many = lambda *statuses: sum(r.status in statuses for r in expected)
    s = result.summary
    assert counts(result) == tuple(many(x) for x in ("equal", "mismatch", "missing_right", "missing_left"))
    assert (s.left_rows, s.right_rows, s.total) == (len(expected) - many("missing_left"), len(expected) - many("missing_right"), len(expected))
    assert (s.found, s.not_found) == (many("equal", "mismatch"), many("missing_left", "missing_right"))
    assert f"equal={many('equal')}" in repr(result) and "crate" in repr(result)
    assert {c.name: c.kind for c in result.columns if c.kind != "compared"} == {"crate": "key", "clerk": "left_only", "scanner": "right_only"}


def test_wide_and_long_tables(result, expected):
    wide = result.frame(("mismatch", "missing_left"))
    assert wide.columns[:3] == ["crate", "status", "differing"] and "clerk [left]" in wide.columns and "clerk [right]" not in wide.columns
    assert {r["crate"] for r in wide.collect()} == {r.key for r in expected if r.status in ("mismatch", "missing_left")}
    with pytest.raises(ValueError, match="lost"):
        result.frame("lost")
    picked = [7, 2, 7, len(expected) - 1]
    assert [r["crate"] for r in result.frame(rows=picked).collect()] == [expected[i].key for i in picked]
    equal = [i for i in picked if expected[i].status == "equal"]
    assert [r["crate"] for r in result.frame("equal", rows=picked).collect()] == [expected[i].key for i in equal]
    for outside in (-1, len(expected)):
        with pytest.raises(IndexError, match=str(outside)):
            result.frame(rows=[0, outside])
    want = [(r.key, c) for r in expected for c in r.differing]
    assert rows(result.mismatches(), "crate", "column") == sorted(want, key=repr)
    shown = {(r["crate"], r["column"]): (r["left"], r["right"]) for r in result.mismatches().collect()}
    assert all(shown[r.key, "goods"] == (r.before["goods"], r.after["goods"]) for r in expected if "goods" in r.differing)
    stats, found = result.column_stats().collect(), result.summary.found
    assert [r["mismatches"] for r in stats] == sorted((sum(c == x for _, x in want) for c in result.compared), reverse=True)
    assert all(r["equal_share"] == (found - r["mismatches"]) / found for r in stats)


def test_row_ids_follow_the_left_side_then_the_right(result, expected):
    assert sorted((r["row_id"], r["k0"]) for r in result.numbered().collect()) == list(enumerate(r.key for r in expected))


def test_keys_of_several_columns_and_null_keys(spark):
    before = [(a, b, f"{a}{b}") for a in ("s", "t", None) for b in (10, 20, None)]
    after = [(a, b, v if b != 20 else "other") for a, b, v in before[2:]] + [("u", 10, "new")]
    a, b = (spark.createDataFrame(x, "shelf string, slot int, v string") for x in (before, after))
    r = compare(a, b, ["shelf", "slot"])
    assert counts(r) == (5, 2, 2, 1) and r.keys == ("shelf", "slot")
    assert (None, 20, ["v"]) in rows(r.frame("mismatch"), "shelf", "slot", "differing")


def test_missing_values(spark):
    a = spark.createDataFrame([(1, float("nan"), None), (2, None, ""), (3, 0.0, "a")], "k long, f double, s string")
    b = spark.createDataFrame([(1, None, None), (2, float("nan"), None), (3, -0.0, "a")], "k long, f double, s string")
    assert rows(compare(a, b, "k").mismatches(), "k", "column") == [(2, "s")]


def test_ignored_columns(left, right, expected):
    r = compare(left, right, "crate", ignore_columns=("kilos", "crate", "absent", "kilos"))
    assert r.ignored == ("kilos", "absent") and "kilos" not in r.frame().columns[3:] and "kilos" not in r.compared
    assert r.summary.mismatch == sum(any(c != "kilos" for c in x.differing) for x in expected)


def test_lossless_types(spark):
    a = spark.sql("select cast(k as int) k, cast(k as smallint) n, cast(0.5 + k as float) f, cast(null as void) e, cast(k as decimal(5,1)) d from values (1), (2), (3) t(k)")
    b = spark.sql("select cast(k as bigint) k, cast(if(k = 3, 4, k) as tinyint) n, cast(0.5 + k as double) f, if(k = 1, 'x', null) e, cast(k as decimal(5,2)) d from values (1), (2), (3) t(k)")
    r = compare(a, b, "k", strict=False)
    assert rows(r.frame(), "k", "differing") == [(1, ["e"]), (2, []), (3, ["n"])]
    assert {c.name: c.compare_dtype for c in r.columns} == {"k": None, "n": T.ShortType(), "f": T.DoubleType(), "e": T.StringType(), "d": T.DecimalType(6, 2)}
    with pytest.raises(ValueError, match="different dtypes") as error:
        compare(a, b, "k")
    assert "k: int in left, bigint in right" in str(error.value) and "strict=False" in str(error.value) and "n: " in str(error.value)


@pytest.mark.parametrize(
    ("left", "right", "common"),
    [
        (T.LongType(), T.LongType(), None),
        (T.ByteType(), T.LongType(), T.LongType()),
        (T.FloatType(), T.DoubleType(), T.DoubleType()),
        (T.DecimalType(38, 0), T.DecimalType(38, 2), DtypeMismatchError),
        (T.DecimalType(10, 0), T.DecimalType(10, 2), T.DecimalType(12, 2)),
        (T.NullType(), T.DateType(), T.DateType()),
        (T.VarcharType(5), T.StringType(), T.StringType()),
        (T.DayTimeIntervalType(0, 1), T.DayTimeIntervalType(2, 3), T.DayTimeIntervalType(0, 3)),
        (T.LongType(), T.DoubleType(), DtypeMismatchError),
        (T.LongType(), T.StringType(), DtypeMismatchError),
        (T.BooleanType(), T.LongType(), DtypeMismatchError),
        (T.DateType(), T.TimestampType(), DtypeMismatchError),
        (T.TimestampType(), T.TimestampNTZType(), DtypeMismatchError),
        (T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType()), DtypeMismatchError),
        (T.ArrayType(T.LongType(), True), T.ArrayType(T.LongType(), False), None),
        (T.CalendarIntervalType(), T.CalendarIntervalType(), DtypeMismatchError),
        (T.VariantType(), T.VariantType(), DtypeMismatchError),
    ],
)
def test_common_types(left, right, common):
    for pair in ((left, right), (right, left)):
        if common is DtypeMismatchError:
            with pytest.raises(DtypeMismatchError):
                common_type(*pair)
        else:
            assert common_type(*pair) == common


def test_nested_values(spark):
    made = "select {k} id, map_from_arrays(array({m}), transform(array({m}), x -> length(x))) sizes, array(named_struct('lot', {lot}, 'tags', array({tags}))) lots"
    one = made.format(k=1, m="'ab', 'c'", lot=4, tags="'x', null")
    a = spark.sql(f"{one} union all {made.format(k=2, m="'ab'", lot=5, tags="'x'")}")
    b = spark.sql(f"{made.format(k=1, m="'c', 'ab'", lot=4, tags="'x', null")} union all {made.format(k=2, m="'abc'", lot=5, tags="'y'")}")
    assert rows(compare(a, b, "id").mismatches(), "id", "column", "left", "right") == [(2, "lots", '[{"lot":5,"tags":["x"]}]', '[{"lot":5,"tags":["y"]}]'), (2, "sizes", '{"ab":2}', '{"abc":3}')]
    with pytest.raises(ValueError, match="map cannot be a key"):
        compare(a, b, "sizes")


WRONG = [
    ({"key": ()}, ValueError, "at least one key"),
    ({"key": ("crate", "bay", "crate")}, ValueError, "distinct"),
    ({"key": "clerk"}, ValueError, "missing in right"),
    ({"key": ["crate", "scanner"]}, ValueError, "missing in left"),
    ({"right_name": "left"}, ValueError, "must differ"),
    ({"duplicates": "first"}, ValueError, "duplicates must be"),
    ({"order_by": ["bay", "clerk"]}, ValueError, "clerk.*missing in right"),
]


@pytest.mark.parametrize(("options", "error", "message"), WRONG)
def test_what_cannot_be_asked(left, right, options, error, message):
    with pytest.raises(error, match=message):
        compare(left, right, **({"key": "crate"} | options))


def test_what_cannot_be_compared(spark, left, right):
    twice = left.union(left.where("crate < 103"))
    with pytest.raises(ValueError, match=r"left: 6 rows share a key \['crate'\]"):
        compare(twice, right, "crate", duplicates="raise")
    assert compare(left, right, "crate", duplicates="raise").summary.duplicates == "match"
    with pytest.raises(ValueError, match="reserved.*__fd_bay"):
        compare(left, right.withColumnRenamed("bay", "__fd_bay"), "crate")
    with pytest.raises(TypeError, match="right: unsupported.*set"):
        compare(left, {1, 2}, "crate")
    named = [x.withColumnRenamed("crate", "differing") for x in (left, right)]
    with pytest.raises(ValueError, match="more than one column"):
        compare(*named, "differing").frame()


def test_failures_of_the_engine_are_value_errors(spark):
    strange = spark.createDataFrame([(1, 2)], "k long, v long").select(F.parse_json(F.lit("1")).alias("k"), "v")
    for duplicates in ("match", "number", "raise"):
        with pytest.raises(ValueError):
            compare(strange, strange, "k", duplicates=duplicates)


def test_strange_names(spark):
    a = spark.createDataFrame([(1, 2, 3, 4)], ["a.b", "A", "a", "x y`z"])
    r = compare(a, a, "a.b")
    assert counts(r) == (1, 0, 0, 0) and "x y`z [left]" in r.frame().columns


def test_other_frames(spark):
    import pandas as pd
    import pyarrow as pa

    p = pd.DataFrame({"id": [1, 2], "v": ["a", 2]})
    t = pa.table({"id": [1, 2], "v": ["a", "2"]})
    assert counts(compare(p, t, "id", spark=spark)) == (2, 0, 0, 0)


def greedy(before, after):
    """How many rows of a key pair as equal, and the values that pair otherwise: the fewest differences first, then by place."""
    before, after, equal = list(enumerate(before)), list(enumerate(after)), 0
    for x in list(before):
        if hit := next((y for y in after if y[1] == x[1]), None):
            before.remove(x)
            after.remove(hit)
            equal += 1
    near = sorted((sum(a != b for a, b in zip(x[1], y[1], strict=True)), x, y) for x in before for y in after) if before and after else []
    near.sort(key=lambda p: (p[0], p[1][0], p[2][0]))
    pairs, left, right = [], set(), set()
    for _, x, y in near:
        if x[0] not in left and y[0] not in right:
            left.add(x[0])
            right.add(y[0])
            pairs.append((x[1], y[1]))
    return equal, pairs, len(before) - len(pairs), len(after) - len(pairs)


@pytest.mark.parametrize("run", [1 << 20, 2])
def test_repeated_keys_pair_by_content_then_by_likeness(spark, monkeypatch, run):
    monkeypatch.setattr(pairing, "MOST_IN_RUN", run)
    dice = random.Random(11)
    some = lambda: [(k, dice.choice("ab"), dice.randrange(2), dice.randrange(2)) for k in [None, 1, 2, 3, 4] for _ in range(dice.randrange(5))]
    for _ in range(4):
        before, after = some(), some()
        a, b = (spark.createDataFrame(x, "k int, p string, q int, r int").coalesce(1) for x in (before, after))
        result = compare(a, b, "k")
        want = {k: greedy([x[1:] for x in before if x[0] == k], [x[1:] for x in after if x[0] == k]) for k in [None, 1, 2, 3, 4]}
        assert counts(result) == (sum(w[0] for w in want.values()), sum(len(w[1]) for w in want.values()), sum(w[2] for w in want.values()), sum(w[3] for w in want.values()))
        shown = rows(result.frame("mismatch"), "k", "p [left]", "q [left]", "r [left]", "p [right]", "q [right]", "r [right]")
        assert shown == sorted([(k, *x, *y) for k, w in want.items() for x, y in w[1]], key=repr)
        again = {k: (sum(x[0] == k for x in before), sum(x[0] == k for x in after)) for k in want}
        assert sorted((tuple(r) for r in result.duplicates.collect()), key=repr) == sorted(((k, *n) for k, n in again.items() if max(n) > 1), key=repr)
        assert result.summary.duplicate_keys_left == sum(n[0] > 1 for n in again.values())


@pytest.mark.parametrize("run", [1 << 20, 2])
def test_repeated_keys_pair_by_number(spark, monkeypatch, run):
    monkeypatch.setattr(pairing, "MOST_IN_RUN", run)
    before = [("s", 30, "c"), ("s", None, "d"), ("s", 10, "a"), (None, 2, "z"), ("s", 20, "b"), (None, 1, "y")]
    after = [("s", 10, "a"), ("s", 20, "b"), ("s", 25, "c"), (None, 1, "y"), ("s", None, "d"), ("t", 0, "x")]
    a, b = (spark.createDataFrame(x, "k string, at int, v string").coalesce(1) for x in (before, after))
    by_place = compare(a, b, "k", duplicates="number", ignore_columns=["at"])
    assert rows(by_place.frame(), "k", "v [left]", "v [right]") == sorted([("s", "c", "a"), ("s", "d", "b"), ("s", "a", "c"), ("s", "b", "d"), (None, "z", "y"), (None, "y", None), ("t", None, "x")], key=repr)
    by_time = compare(a, b, "k", duplicates="number", order_by=["at"], ignore_columns=["at"])
    assert rows(by_time.frame(), "k", "v [left]", "v [right]") == sorted([("s", "a", "a"), ("s", "b", "b"), ("s", "c", "c"), ("s", "d", "d"), (None, "y", "y"), (None, "z", None), ("t", None, "x")], key=repr)


def test_a_key_that_nearly_all_rows_have(spark):
    n = pairing.MOST_IN_RUN + 40_000
    a = spark.range(0, n, 1, 4).select(F.lit(None).cast("int").alias("k"), (F.col("id") % 7).alias("v"))
    b = spark.range(0, n, 1, 3).select(F.lit(None).cast("int").alias("k"), (F.col("id") % 7 + F.when(F.col("id") < 3, 100).otherwise(0)).alias("v"))
    assert counts(compare(a, b, "k")) == (n - 3, 3, 0, 0)


def test_too_many_candidates_pair_by_position(spark, monkeypatch):
    monkeypatch.setattr(pairing, "MOST_FOR_KEY", 11)
    before, after = [("m", f"a{k}") for k in range(4)] + [("n", "p"), ("n", "q")], [("m", f"b{k}") for k in range(3)] + [("n", "q"), ("n", "r")]
    a, b = (spark.createDataFrame(x, "k string, v string").coalesce(1) for x in (before, after))
    r = compare(a, b, "k")
    assert rows(r.frame("mismatch"), "v [left]", "v [right]") == [("a0", "b0"), ("a1", "b1"), ("a2", "b2"), ("p", "r")]
    assert counts(r) == (1, 4, 1, 0)


def test_empty_tables(left, right):
    none, keys = right.where("false"), left.select("crate")
    n = left.count()
    assert counts(compare(left, none, "crate")) == (0, 0, n, 0) and counts(compare(none, none, "crate")) == (0, 0, 0, 0)
    assert [r["mismatch_share"] for r in compare(left, none, "crate").column_stats().collect()] == [None] * 6
    r = compare(keys, keys, "crate")
    assert counts(r) == (n, 0, 0, 0) and r.mismatches().isEmpty() and r.column_stats().isEmpty()


def test_more_types(spark):
    a = spark.createDataFrame([(1, decimal.Decimal("1.5"), dt.date(2024, 1, 1), b"a", True)], "k long, d decimal(5,2), t date, b binary, f boolean")
    b = a.withColumn("b", F.lit(b"b"))
    assert rows(compare(a, b, "k").mismatches(), "column", "left", "right") == [("b", "61", "62")]
