"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

compare_*: a comparison with its counts; view_*: queries on a result that is kept, as an interactive session has it;
generated_*: the same on two generated tables of BENCH_ROWS rows a side, whose columns and differences are those of the
views on a result that is numbered already; the operators on text (opN_) are timed in their first run.
"""

from __future__ import annotations

import importlib.util
import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ROWS = int(os.environ.get("BENCH_ROWS", "5000000"))


def session() -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": CPUS if CPUS.isdigit() else "8",
        "spark.driver.memory": "16g",
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",  # partitions that small are hashed, not sorted
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
    }
    spark = SparkSession.builder.master(f"local[{CPUS}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def generated(spark: SparkSession, n: int):
    base = spark.range(n).select("id", F.concat(F.lit("name "), F.col("id")).alias("name"), F.lit("Kiel").alias("city"), (F.col("id") * 1.5).alias("revenue"), (F.col("id") % 2 == 0).alias("active"))
    left = base.where("id % 100 <> 1")
    right = base.where("id % 100 <> 2").withColumn("revenue", F.when(F.col("id") % 20 == 0, F.col("revenue") + 1).otherwise(F.col("revenue")))
    return left, right.withColumn("city", F.when(F.col("id") % 97 == 0, F.lit("Ulm")).otherwise(F.col("city")))


def main() -> None:
    if len(sys.argv) > 1:
        sys.exit(f"{sys.argv[0]} takes no arguments; set BENCH_SF_DIR, BENCH_CPUS, BENCH_ROWS.\n{__doc__}")
    from tallyframe import compare
    from tallyframe import queries as q
    from tallyframe.plans.view import ColumnFilter, Query, ViewEngine

    spark = session()
    took: dict[str, float] = {}

    def timed(name: str, run) -> None:
        run()
        began = time.perf_counter()
        run()
        took[name] = round(time.perf_counter() - began, 3)

    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    timed("compare_orders", lambda: q._of(spark, SF_DIR, *q._ORDERS).summary)
    timed("compare_events", lambda: q._of(spark, SF_DIR, *q._EVENTS).summary)
    timed("compare_repeated_keys_match", lambda: q._of(spark, SF_DIR, "lineitem", q._LINES).summary)
    timed("compare_repeated_keys_number", lambda: q._of(spark, SF_DIR, "lineitem", q._LINES, duplicates="number", order_by="l_partkey").summary)
    timed("mismatches_long", lambda: noop(q._of(spark, SF_DIR, *q._ORDERS).mismatches()))
    timed("frame", lambda: noop(q._of(spark, SF_DIR, *q._ORDERS).frame()))

    left, right = (x.persist() for x in generated(spark, ROWS))
    left.count(), right.count()
    timed(f"generated_{ROWS}_compare", lambda: compare(left, right, "id").summary)
    result = compare(left, right, "id")
    timed(f"generated_{ROWS}_mismatches", lambda: noop(result.mismatches()))
    began = time.perf_counter()
    result.numbered()
    took[f"generated_{ROWS}_numbered"] = round(time.perf_counter() - began, 3)

    def page(query: Query, number: int = 0):
        def run() -> None:
            ViewEngine(result).page(query, number, 25)

        return run

    timed("view_first_page", page(Query()))
    timed("view_status", page(Query(statuses=frozenset({"mismatch"}))))
    timed("view_search", page(Query(search="kiel")))
    timed("view_range", page(Query(filters=(ColumnFilter(3, "between", "1000", "200000"),))))
    timed("view_sort", page(Query(sort_column=3, descending=True)))
    kept = ViewEngine(result)
    kept.view(Query())
    timed("view_next_page_kept", lambda: kept.page(Query(), 1, 25))
    by = Query(sort_column=3, descending=True)
    kept.page(by, 10_000, 25)
    timed("view_far_page_kept", lambda: kept.page(by, 20_000, 25))

    if importlib.util.find_spec("tallyframe.llm") is not None:
        from tallyframe.llm import queries as llm

        for name, run in llm.QUERIES.items():
            began = time.perf_counter()
            noop(run(spark, SF_DIR))
            took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "seconds for all queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rstrip("/").rpartition("sf")[2], "rows_generated": ROWS}))


if __name__ == "__main__":
    main()
