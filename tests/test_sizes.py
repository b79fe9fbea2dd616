"""What comparisons of tables with repeated keys leave out: shuffles, kept tables, row ids."""

from pyspark.sql import functions as F

from tallyframe import compare, more_queries
from tallyframe.functions.text import edit_script
from tallyframe.plans.view import Query, ViewEngine

from .test_compare import counts, rows


def pair(spark):
    a = spark.range(0, 300, 1, 3).select((F.col("id") % 120).alias("k"), (F.col("id") % 7).alias("v"), F.col("id").alias("at"))
    b = spark.range(0, 280, 1, 2).select((F.col("id") % 130).alias("k"), (F.col("id") % 5).alias("v"), F.col("id").alias("at"))
    return a, b


def kept(spark):
    return len(spark.sparkContext._jsc.getPersistentRDDs())


def exchanges(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_by_position_where_ids_of_one_side_are_ids_of_the_other(spark, tmp_path):
    spark.createDataFrame([(0, "a", 5.0), (1, "a", 1.0), (1_000_000, "a", 6.0)], "event_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert rows(more_queries.QUERIES["dup_by_position"](spark, str(tmp_path)), "event_left", "event_right", "status") == [(0, 1_000_000, "mismatch"), (1, 1_000_001, "mismatch"), (1_000_000, 2_000_000, "mismatch")]
def test_a_view_of_repeated_keys_takes_no_row_ids(spark):
    a, b = (x.coalesce(1) for x in pair(spark))
    result, again = compare(a, b, "k"), compare(a, b, "k")
    query = Query(duplicates_only=True, sort_column=1)
    frame = ViewEngine(result).frame(query)
    shown = [tuple(r) for r in frame.collect()]
    assert "_numbered" not in result.__dict__
    page = ViewEngine(again).page(query, 0, 1000)["rows"]
    assert [(r[3], r[4]) for r in shown] == [(x["l"] and x["l"][1], x["r"] and x["r"][1]) for x in page]


def test_rows_of_a_key_meet_by_one_shuffle(spark):
    had = kept(spark)
    for options in ({"duplicates": "match"}, {"duplicates": "number"}, {"duplicates": "number", "order_by": ["v", "at"]}):
        result = compare(*pair(spark), "k", ignore_columns=["at"], **options)
        assert exchanges(result.frame()) == 1
        result.frame().count()
        assert kept(spark) == had


def test_counts_without_pairing_are_those_of_the_rows(spark):
    result = compare(*pair(spark), "k", ignore_columns=["at"])
    before = counts(result)
    assert "joined" not in result.__dict__
    found = {r["status"]: r["count"] for r in result.frame().groupBy("status").count().collect()}
    assert before == tuple(found.get(s, 0) for s in ("equal", "mismatch", "missing_right", "missing_left"))


def test_keys_that_repeat_take_one_aggregation(spark):
    had = kept(spark)
    result = compare(*pair(spark), "k")
    shown = result.duplicates
    assert "look" not in result._matcher.__dict__ and kept(spark) == had
    assert [r["k"] for r in shown.collect()] == list(range(130))


def test_rows_of_repeated_keys_are_counted_without_pairing(spark):
    result = compare(*pair(spark), "k", ignore_columns=["at"])
    assert result.duplicate_rows and "joined" not in result.__dict__
    assert result.duplicate_rows == result.frame().join(result.duplicates.select("k"), "k").count()


def test_an_edit_script_that_is_known_needs_no_search():
    class Word(int):
        seen = 0
        __hash__ = int.__hash__

        def __eq__(self, other):
            Word.seen += 1
            return int.__eq__(self, other)

    a, b = ([Word(2 * i + k) for i in range(600)] for k in (0, 1))
    assert edit_script(a, b) is None and Word.seen < 10_000
    a, b = ([Word(10_000 * (i % 2) * k + i) for i in range(480)] for k in (1, 2))
    assert edit_script(a, b) == "=" + "-+=".join([""] * 240) + "-+" and Word.seen < 20_000
