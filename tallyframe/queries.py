"""Queries over the test tables, and SQL that must give the same rows.

Each pair of sides is SQL that Spark and DuckDB both run; {t} stands for table t.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import has_invisible_column, only_invisible_column, text_diffs
from .operators.compare import compare
from .plans.result import DiffResult
from .plans.view import ColumnFilter, Query, ViewEngine

#: left and right of each pair
SIDES = {
    "orders": (
        "SELECT * FROM {orders} WHERE o_orderkey % 100 <> 1",
        """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 97 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
           CASE WHEN o_orderkey % 20 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
           FROM {orders} WHERE o_orderkey % 100 <> 2""",
    ),
    "events": (
        "SELECT event_id, user_id, event_type, value FROM {events} WHERE event_id % 11 <> 3",
        """SELECT event_id, user_id, CASE WHEN event_id % 13 = 0 THEN event_type || ' ' ELSE event_type END AS event_type,
           CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM {events} WHERE event_id % 11 <> 4""",
    ),
    "nan": (
        "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value, event_type FROM {events}",
        "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 10 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS value, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS event_type FROM {events}",
    ),
    "null_key": (
        "SELECT CASE WHEN event_id = 1000 THEN NULL ELSE event_id END AS event_id, user_id, event_type FROM {events} WHERE event_id % 11 <> 3",
        "SELECT CASE WHEN event_id = 1000 THEN NULL ELSE event_id END AS event_id, user_id, CASE WHEN event_id % 40 = 0 THEN 'x' ELSE event_type END AS event_type FROM {events} WHERE event_id % 11 <> 4",
    ),
    "types": (
        "SELECT CAST(o_orderkey AS INT) AS k, CAST(o_custkey AS INT) AS n, CAST(o_totalprice AS FLOAT) AS f, CAST(o_custkey AS DECIMAL(12,1)) AS d, o_orderstatus AS s FROM {orders}",
        "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 30 = 0 THEN o_custkey + 1 ELSE o_custkey END AS n, CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) + CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS f, CAST(o_custkey AS DECIMAL(14,2)) AS d, CAST(NULL AS VARCHAR(3)) AS s FROM {orders}",
    ),
    "lineitem": (
        "SELECT * FROM {lineitem} WHERE l_partkey % 50 <> 1",
        """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_suppkey % 10 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity,
           l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM {lineitem} WHERE l_partkey % 50 <> 2""",
    ),
    "flags": (
        "SELECT o_orderkey, o_orderstatus = 'F' AS done, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice > 100000 END AS large FROM {orders} WHERE o_orderkey % 10 <> 1",
        "SELECT o_orderkey, o_orderstatus <> 'O' AS done, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice > 100000 END AS large FROM {orders} WHERE o_orderkey % 10 <> 2",
    ),
    "nations": (
        "SELECT n_nationkey, n_name, n_regionkey FROM {nation} WHERE n_nationkey <> 3",
        "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey FROM {nation} WHERE n_nationkey <> 4",
    ),
    "documents": (
        "SELECT doc_id, text, lang FROM {documents}",
        """SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN text || ' ' WHEN doc_id % 10 = 2 THEN replace(text, ' ', '  ') WHEN doc_id % 10 = 3 THEN text || ' end'
           WHEN doc_id % 10 = 4 THEN concat('new first line', chr(10), text) ELSE text END AS text, lang FROM {documents}""",
    ),
}


def sides(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame]:
    def one(sql: str) -> DataFrame:
        return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in re.findall(r"\{(\w+)\}", sql)})

    return tuple(one(sql) for sql in SIDES[name])


def _of(spark: SparkSession, sf_dir: str, name: str, key, **options) -> DiffResult:
    return compare(*sides(spark, sf_dir, name), key, **options)


def _flat(frame: DataFrame) -> DataFrame:
    """A wide table with plain names and the list of columns as text."""
    names = [re.sub(r" \[(\w+)\]", r"_\1", c) for c in frame.columns]
    return frame.toDF(*names).withColumn("differing", F.array_join("differing", ","))


def _summary(result: DiffResult) -> DataFrame:
    s = result.summary
    names = ["equal", "mismatch", "missing_left", "missing_right", "left_rows", "right_rows", "duplicate_keys_left", "duplicate_keys_right"]
    return result.spark.createDataFrame([tuple(getattr(s, n) for n in names)], ", ".join(f"`{n}` long" for n in names))


def _view(name: str, key, make: Callable[[DiffResult], Query], **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = _of(spark, sf_dir, name, key, **options)
        return _flat(ViewEngine(result).frame(make(result)))

    return run


def _place(result: DiffResult, column: str) -> int:
    return next(i for i, x in enumerate(result.layout) if x.info.name == column)


def _filter(name: str, key, column: str, op: str, a: str = "", b: str = ""):
    return _view(name, key, lambda r: Query(filters=(ColumnFilter(_place(r, column), op, a, b),)))


def _status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _of(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber"])
    return r.frame().groupBy("l_orderkey", "l_linenumber").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("equal", "mismatch", "missing_left", "missing_right")])


def _sorted_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _of(spark, sf_dir, "events", "event_id")
    place = _place(result, "value")
    page = ViewEngine(result).page(Query(sort_column=place, descending=True), 7, 50)
    rows = [(k, (r["l"] or r["r"])[0], r["s"], (r["l"] or r["r"])[place]) for k, r in enumerate(page["rows"])]
    return spark.createDataFrame(rows, "place long, event_id long, status string, value double")


def _other_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pandas frame against an Arrow table, of a table of 25 rows."""
    left, right = sides(spark, sf_dir, "nations")
    return _flat(compare(left.toPandas(), right.toArrow(), "n_nationkey", spark=spark).frame())


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an export."""
    result = _of(spark, sf_dir, "events", "event_id")
    lines = csv.DictReader(io.StringIO(ViewEngine(result).export_csv(Query(diff_column=_place(result, "event_type"))).decode()))
    rows = [(int(x["event_id"]), x["status"], x["differing"], x["event_type [left]"], x["event_type [right]"], int(x["user_id [left]"]), x["value [right]"] == "") for x in lines]
    return spark.createDataFrame(rows, "event_id long, status string, differing string, old string, new string, user_id long, empty boolean")


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values differ between paired rows, for each number of differences."""
    r = _of(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber"])
    return r.frame("mismatch").groupBy(F.size("differing").alias("differing")).count()


def _text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _of(spark, sf_dir, "documents", "doc_id").frame("mismatch").select("doc_id", F.col("text [left]").alias("a"), F.col("text [right]").alias("b"))
    return text_diffs(rows, ["doc_id"], "a", "b").withColumn("marked", F.size(F.filter("marked", lambda m: m)))


def _invisible(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _of(spark, sf_dir, "documents", "doc_id").frame("mismatch")
    a, b = F.col("text [left]"), F.col("text [right]")
    return rows.select("doc_id", only_invisible_column(a, b).alias("only_invisible"), has_invisible_column(b).alias("has_invisible"))


_ORDERS = ("orders", "o_orderkey")
_EVENTS = ("events", "event_id")
_LINES = ["l_orderkey", "l_linenumber"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "diff_frame_orders": lambda s, d: _flat(_of(s, d, *_ORDERS).frame()),
    "diff_summary_orders": lambda s, d: _summary(_of(s, d, *_ORDERS)),
    "diff_summary_lineitem": lambda s, d: _summary(_of(s, d, "lineitem", _LINES)),
    "diff_mismatch_only": lambda s, d: _flat(_of(s, d, *_ORDERS).frame("mismatch")),
    "diff_missing_left": lambda s, d: _flat(_of(s, d, *_ORDERS).frame("missing_left")),
    "diff_missing_right": lambda s, d: _flat(_of(s, d, *_ORDERS).frame("missing_right")),
    "diff_mismatches_long": lambda s, d: _of(s, d, *_ORDERS).mismatches(),
    "diff_column_stats": lambda s, d: _of(s, d, *_ORDERS).column_stats(),
    "diff_null_nan": lambda s, d: _of(s, d, "nan", "event_id").frame().select("event_id", "status", F.array_join("differing", ",").alias("differing")),
    "diff_events": lambda s, d: _flat(_of(s, d, *_EVENTS).frame()),
    "diff_ignore_columns": lambda s, d: _flat(_of(s, d, *_ORDERS, ignore_columns=["o_totalprice", "o_orderdate", "o_orderpriority"]).frame()),
    "diff_one_sided_columns": lambda s, d: _flat(compare(sides(s, d, "orders")[0].drop("o_custkey"), sides(s, d, "orders")[1].drop("o_orderdate", "o_orderpriority"), "o_orderkey").frame()),
    "diff_composite_key": lambda s, d: _of(s, d, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"], duplicates="number", order_by="l_quantity").frame().groupBy("status").count(),
    "diff_null_keys": lambda s, d: _flat(_of(s, d, "null_key", "event_id").frame()),
    "diff_widened_types": lambda s, d: _of(s, d, "types", "k", strict=False).frame().select("k", "status", F.array_join("differing", ",").alias("differing")),
    "dup_keys_lineitem": lambda s, d: _of(s, d, "lineitem", _LINES).duplicates.withColumnsRenamed({"left": "n_left", "right": "n_right"}),
    "dup_number_order_by": lambda s, d: _of(s, d, "lineitem", _LINES, duplicates="number", order_by=["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]).frame().groupBy(*_LINES, "status").count(),
    "dup_match_status_counts": _status_counts,
    "dup_similar_pairs": _similar,
    "source_pandas_arrow": _other_frames,
    "view_export_csv": _csv,
    "view_filter_true": _filter("flags", "o_orderkey", "done", "true"),
    "view_filter_false": _filter("flags", "o_orderkey", "large", "false"),
    "view_filter_boolean_null": _filter("flags", "o_orderkey", "large", "is_null"),
    "view_combined": _view("events", "event_id", lambda r: Query(statuses=frozenset({"mismatch", "missing_right"}), search="click", filters=(ColumnFilter(_place(r, "value"), "between", "", "50"), ColumnFilter(_place(r, "user_id"), "between", "10", "")))),
    "view_status": _view(*_ORDERS, lambda r: Query(statuses=frozenset({"mismatch", "missing_left"}))),
    "view_search_ascii": _view(*_ORDERS, lambda r: Query(search="urgENT")),
    "view_search_unicode": _view("documents", "doc_id", lambda r: Query(search="ÈÇ")),
    "view_diff_column": _view(*_ORDERS, lambda r: Query(diff_column=_place(r, "o_orderstatus"))),
    "view_equal_column": _view(*_ORDERS, lambda r: Query(diff_column=_place(r, "o_totalprice"), diff_equal=True)),
    "view_filter_contains": _filter(*_EVENTS, "event_type", "contains", "LI"),
    "view_filter_not_contains": _filter(*_EVENTS, "event_type", "not_contains", "li"),
    "view_filter_equals": _filter(*_EVENTS, "event_type", "equals", "click "),
    "view_filter_starts": _filter(*_EVENTS, "event_type", "starts", "C"),
    "view_filter_ends": _filter(*_EVENTS, "event_type", "ends", " "),
    "view_filter_empty": _filter("nan", "event_id", "event_type", "is_empty"),
    "view_filter_between": _filter(*_EVENTS, "value", "between", "10", "20"),
    "view_filter_ne": _filter(*_EVENTS, "user_id", "ne", "7"),
    "view_filter_eq": _filter(*_EVENTS, "user_id", "eq", "7"),
    "view_filter_null": _filter(*_EVENTS, "value", "is_null"),
    "view_filter_not_null": _filter(*_EVENTS, "value", "not_null"),
    "view_filter_date": _filter(*_ORDERS, "o_orderdate", "between", "1996-01-01", "1996-06-30"),
    "view_duplicates_only": lambda s, d: ViewEngine(_of(s, d, "lineitem", _LINES)).frame(Query(duplicates_only=True)).groupBy(*_LINES).count(),
    "view_sorted_page": _sorted_page,
    "text_unified_diff": _text_lines,
    "text_invisible_only": _invisible,
}


# ---- SQL -----------------------------------------------------------------------------------------------------------


def _plain(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def _joined(name: str, key: str, compared: list[str], left_only=(), right_only=(), nan: tuple[str, ...] = (), keys: str | None = None) -> str:
    """A CTE j: the full join with flags, status and the list of differing columns."""
    value = lambda side, c: f"CASE WHEN isnan({side}.{c}) THEN NULL ELSE {side}.{c} END" if c in nan else f"{side}.{c}"
    flag = {c: f"(l.p AND r.p AND ({value('l', c)}) IS DISTINCT FROM ({value('r', c)}))" for c in compared}
    anywhere = " OR ".join(flag.values()) or "FALSE"
    listed = ", ".join(f"CASE WHEN {f} THEN '{c}' END" for c, f in flag.items())
    columns = [f"l.{c} AS {c}_left, r.{c} AS {c}_right" for c in compared] + [f"l.{c} AS {c}_left" for c in left_only] + [f"r.{c} AS {c}_right" for c in right_only]
    return f"""WITH a AS ({_plain(SIDES[name][0])}), b AS ({_plain(SIDES[name][1])}),
      l AS (SELECT *, TRUE AS p FROM a), r AS (SELECT *, TRUE AS p FROM b),
      j AS (SELECT coalesce(l.{key}, r.{key}) AS {key}, coalesce(l.p, FALSE) AS pl, coalesce(r.p, FALSE) AS pr,
        CASE WHEN r.p IS NULL THEN 'missing_right' WHEN l.p IS NULL THEN 'missing_left' WHEN {anywhere} THEN 'mismatch' ELSE 'equal' END AS status,
        concat_ws(',', {listed or "NULL"}) AS differing, {", ".join(columns)}
      FROM l FULL JOIN r ON l.{key} IS NOT DISTINCT FROM r.{key})"""


_O = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_E = ["user_id", "event_type", "value"]
_JO, _JE = _joined(*_ORDERS, _O), _joined(*_EVENTS, _E)
_JN = _joined("nan", "event_id", ["value", "event_type"], nan=("value",))
_JD = _joined("documents", "doc_id", ["text", "lang"])
_ALL = "SELECT * EXCLUDE (pl, pr) FROM j"


def _sides_where(test: str, join: str = _JE) -> str:
    """Rows of which a side that is there satisfies a test of {{c}}."""
    return f"{join} {_ALL} WHERE coalesce(pl AND ({test.format('left')}), FALSE) OR coalesce(pr AND ({test.format('right')}), FALSE)"


_LI = f"WITH a AS ({_plain(SIDES['lineitem'][0])}), b AS ({_plain(SIDES['lineitem'][1])})"
_VALUES = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_PER_KEY = f"""{_LI}, x AS (SELECT {_VALUES}, sum(s) AS cl, sum(1 - s) AS cr FROM (SELECT {_VALUES}, 1 AS s FROM a UNION ALL SELECT {_VALUES}, 0 AS s FROM b) GROUP BY ALL),
  k AS (SELECT l_orderkey, l_linenumber, CAST(sum(least(cl, cr)) AS BIGINT) AS e, CAST(sum(cl) AS BIGINT) AS nl, CAST(sum(cr) AS BIGINT) AS nr FROM x GROUP BY 1, 2)"""


def _numbered(order: str, keys: str, values: list[str]) -> str:
    pair = " AND ".join(f"l.{k} IS NOT DISTINCT FROM r.{k}" for k in [*keys.split(", "), "n"])
    differ = " OR ".join(f"l.{v} IS DISTINCT FROM r.{v}" for v in values)
    number = lambda t: f"(SELECT *, TRUE AS p, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS n FROM {t})"
    return f"""{_LI} , j AS (SELECT {", ".join(f"coalesce(l.{k}, r.{k}) AS {k}" for k in keys.split(", "))},
      CASE WHEN r.p IS NULL THEN 'missing_right' WHEN l.p IS NULL THEN 'missing_left' WHEN {differ} THEN 'mismatch' ELSE 'equal' END AS status
      FROM {number("a")} l FULL JOIN {number("b")} r ON {pair})"""


_INVISIBLE_SQL = r"regexp_replace(regexp_replace(regexp_replace({}, '[\x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}]', ' ', 'g'), '[\x00-\x1f\x7f-\x{{009f}}\x{{00ad}}\x{{200b}}-\x{{200f}}\x{{2028}}-\x{{202e}}\x{{2060}}-\x{{2064}}\x{{feff}}]', '', 'g'), '\s+', ' ', 'g')"
_OTHERS = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

ORACLE: dict[str, str] = {
    "diff_frame_orders": f"{_JO} {_ALL}",
    "diff_summary_orders": f"{_JO} SELECT " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("equal", "mismatch", "missing_left", "missing_right")) + ", count(*) FILTER (WHERE pl) AS left_rows, count(*) FILTER (WHERE pr) AS right_rows, CAST(0 AS BIGINT) AS duplicate_keys_left, CAST(0 AS BIGINT) AS duplicate_keys_right FROM j",
    "diff_summary_lineitem": f"{_PER_KEY} SELECT CAST(sum(e) AS BIGINT) AS equal, CAST(sum(least(nl, nr) - e) AS BIGINT) AS mismatch, CAST(sum(greatest(nr - nl, 0)) AS BIGINT) AS missing_left, CAST(sum(greatest(nl - nr, 0)) AS BIGINT) AS missing_right, CAST(sum(nl) AS BIGINT) AS left_rows, CAST(sum(nr) AS BIGINT) AS right_rows, count(*) FILTER (WHERE nl > 1) AS duplicate_keys_left, count(*) FILTER (WHERE nr > 1) AS duplicate_keys_right FROM k",
    "diff_mismatch_only": f"{_JO} {_ALL} WHERE status = 'mismatch'",
    "diff_missing_left": f"{_JO} {_ALL} WHERE status = 'missing_left'",
    "diff_missing_right": f"{_JO} {_ALL} WHERE status = 'missing_right'",
    "diff_mismatches_long": f"{_JO} " + " UNION ALL ".join(f"SELECT o_orderkey, '{c}' AS \"column\", CAST({c}_left AS VARCHAR) AS \"left\", CAST({c}_right AS VARCHAR) AS \"right\" FROM j WHERE pl AND pr AND {c}_left IS DISTINCT FROM {c}_right" for c in ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")),
    "diff_column_stats": f"{_JO} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS dtype_left, '{t}' AS dtype_right, count(*) FILTER (WHERE {c}_left IS DISTINCT FROM {c}_right) AS mismatches, (count(*) - count(*) FILTER (WHERE {c}_left IS DISTINCT FROM {c}_right))::DOUBLE / count(*) AS equal_share, count(*) FILTER (WHERE {c}_left IS DISTINCT FROM {c}_right)::DOUBLE / count(*) AS mismatch_share FROM j WHERE pl AND pr" for c, t in zip(_O, ("bigint", "string", "double", "timestamp_ntz", "string"), strict=True)),
    "diff_null_nan": f"{_JN} SELECT event_id, status, differing FROM j",
    "diff_events": f"{_JE} {_ALL}",
    "diff_ignore_columns": f"{_joined(*_ORDERS, _O[:2])} {_ALL}",
    "diff_one_sided_columns": f"{_joined(*_ORDERS, _O[1:3], _O[3:], _O[:1])} {_ALL}",
    "diff_composite_key": f"{_numbered('l_quantity', 'l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice', ['l_quantity', *_OTHERS[4:]])} SELECT status, count(*) AS count FROM j GROUP BY status",
    "diff_null_keys": f"{_joined('null_key', 'event_id', ['user_id', 'event_type'])} {_ALL}",
    "diff_widened_types": f"{_joined('types', 'k', ['n', 'f', 'd', 's'])} SELECT k, status, differing FROM j",
    "dup_keys_lineitem": f"{_PER_KEY} SELECT l_orderkey, l_linenumber, nl AS n_left, nr AS n_right FROM k WHERE nl > 1 OR nr > 1",
    "dup_number_order_by": f"{_numbered('l_partkey, l_suppkey, l_extendedprice, l_shipdate', 'l_orderkey, l_linenumber', _OTHERS)} SELECT l_orderkey, l_linenumber, status, count(*) AS count FROM j GROUP BY ALL",
    "dup_match_status_counts": f"{_PER_KEY} SELECT l_orderkey, l_linenumber, e AS equal, least(nl, nr) - e AS mismatch, greatest(nr - nl, 0) AS missing_left, greatest(nl - nr, 0) AS missing_right FROM k",
    "source_pandas_arrow": f"{_joined('nations', 'n_nationkey', ['n_name', 'n_regionkey'])} {_ALL}",
    "view_export_csv": f"{_JE} SELECT event_id, status, '[' || concat_ws(',', '\"event_type\"', CASE WHEN value_left IS DISTINCT FROM value_right THEN '\"value\"' END) || ']' AS differing, event_type_left AS old, event_type_right AS new, user_id_left AS user_id, value_right IS NULL AS empty FROM j WHERE pl AND pr AND event_type_left IS DISTINCT FROM event_type_right",
    "view_filter_true": _sides_where("done_{0}", _joined("flags", "o_orderkey", ["done", "large"])),
    "view_filter_false": _sides_where("NOT large_{0}", _joined("flags", "o_orderkey", ["done", "large"])),
    "view_filter_boolean_null": _sides_where("large_{0} IS NULL", _joined("flags", "o_orderkey", ["done", "large"])),
    "view_combined": f"""{_JE} {_ALL} WHERE status IN ('mismatch', 'missing_right')
      AND (coalesce(contains(lower(event_type_left), 'click'), FALSE) OR coalesce(contains(lower(event_type_right), 'click'), FALSE))
      AND (coalesce(pl AND value_left <= 50, FALSE) OR coalesce(pr AND value_right <= 50, FALSE)) AND (coalesce(pl AND user_id_left >= 10, FALSE) OR coalesce(pr AND user_id_right >= 10, FALSE))""",
    "view_status": f"{_JO} {_ALL} WHERE status IN ('mismatch', 'missing_left')",
    "view_search_ascii": f"{_JO} {_ALL} WHERE coalesce(contains(lower(o_orderpriority_left), 'urgent'), FALSE) OR coalesce(contains(lower(o_orderpriority_right), 'urgent'), FALSE)",
    "view_search_unicode": f"{_JD} {_ALL} WHERE coalesce(contains(lower(text_left), 'èç'), FALSE) OR coalesce(contains(lower(text_right), 'èç'), FALSE)",
    "view_diff_column": f"{_JO} {_ALL} WHERE pl AND pr AND o_orderstatus_left IS DISTINCT FROM o_orderstatus_right",
    "view_equal_column": f"{_JO} {_ALL} WHERE pl AND pr AND o_totalprice_left IS NOT DISTINCT FROM o_totalprice_right",
    "view_filter_contains": _sides_where("contains(lower(event_type_{0}), 'li')"),
    "view_filter_not_contains": _sides_where("NOT contains(lower(event_type_{0}), 'li')"),
    "view_filter_equals": _sides_where("event_type_{0} = 'click '"),
    "view_filter_starts": _sides_where("starts_with(lower(event_type_{0}), 'c')"),
    "view_filter_ends": _sides_where("event_type_{0} LIKE '% '"),
    "view_filter_empty": _sides_where("event_type_{0} IS NULL OR event_type_{0} = ''", _JN),
    "view_filter_between": _sides_where("value_{0} BETWEEN 10 AND 20"),
    "view_filter_ne": _sides_where("user_id_{0} <> 7"),
    "view_filter_eq": _sides_where("user_id_{0} = 7"),
    "view_filter_null": _sides_where("value_{0} IS NULL"),
    "view_filter_not_null": _sides_where("value_{0} IS NOT NULL"),
    "view_filter_date": _sides_where("CAST(o_orderdate_{0} AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-06-30'", _JO),
    "view_duplicates_only": f"{_PER_KEY} SELECT l_orderkey, l_linenumber, greatest(nl, nr) AS count FROM k WHERE nl > 1 OR nr > 1",
    "view_sorted_page": f"""{_JE}, v AS (SELECT event_id, status, CASE WHEN pl THEN value_left ELSE value_right END AS value, pl FROM j),
      o AS (SELECT *, row_number() OVER (ORDER BY value DESC NULLS LAST, NOT pl, event_id) - 1 AS place FROM v)
      SELECT place - 350 AS place, event_id, status, value FROM o WHERE place BETWEEN 350 AND 399""",
    "text_invisible_only": f"""{_JD}, n AS (SELECT doc_id, text_left, text_right, trim({_INVISIBLE_SQL.format("text_left")}) AS a, trim({_INVISIBLE_SQL.format("text_right")}) AS b FROM j WHERE status = 'mismatch')
      SELECT doc_id, a = b AS only_invisible, text_right = '' OR regexp_matches(text_right, '[\\x00-\\x1f\\x7f-\\x{{00a0}}\\x{{00ad}}\\x{{2000}}-\\x{{200f}}\\x{{2028}}-\\x{{202f}}\\x{{205f}}-\\x{{2064}}\\x{{3000}}\\x{{feff}}]') OR regexp_matches(text_right, '^ | $|  ') AS has_invisible FROM n""",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of orders that differ, with what differs."""
    return _flat(_of(spark, sf_dir, *_ORDERS).frame("mismatch"))
