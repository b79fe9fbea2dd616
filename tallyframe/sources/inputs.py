"""What can be compared: Spark frames, pandas frames, Arrow tables and what turns into one."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_spark(frame: Any, side: str, spark: SparkSession | None = None) -> DataFrame:
    """frame as a Spark DataFrame; a Spark DataFrame stays as lazy as it is."""
    if isinstance(frame, DataFrame):
        return frame
    if type(frame).__module__.partition(".")[0] == "pandas" and hasattr(frame, "columns"):
        return _from_pandas(frame, _session(spark))
    if (table := _arrow(frame)) is not None:
        return _session(spark).createDataFrame(table)
    raise TypeError(f"{side}: unsupported frame type '{type(frame).__module__}.{type(frame).__qualname__}'")


def _session(spark: SparkSession | None) -> SparkSession:
    return spark or SparkSession.active()


def _arrow(frame: Any):
    """An Arrow table from a table, a lazy frame, a relation, or anything with the Arrow stream interface."""
    import pyarrow as pa

    if isinstance(frame, pa.Table):
        return frame
    if hasattr(frame, "collect") and not hasattr(frame, "__arrow_c_stream__"):
        frame = frame.collect()
    if callable(getattr(frame, "to_polars", None)):
        frame = frame.to_polars()
    for method in ("toArrow", "to_arrow", "arrow"):
        if callable(getattr(frame, method, None)):
            found = getattr(frame, method)()
            return found.read_all() if isinstance(found, pa.RecordBatchReader) else found
    if hasattr(frame, "__arrow_c_stream__"):
        return pa.table(frame)
    return None


def _from_pandas(frame: Any, spark: SparkSession) -> DataFrame:
    """The columns of a pandas frame, its index left out; object columns that mix types become text."""
    import pyarrow as pa

    try:
        return spark.createDataFrame(pa.Table.from_pandas(frame, preserve_index=False))
    except (pa.ArrowInvalid, pa.ArrowTypeError):
        text = frame.copy()
        for c in text.columns:
            if text[c].dtype == object:
                text[c] = [None if v is None or v != v else str(v) for v in text[c]]
        return spark.createDataFrame(pa.Table.from_pandas(text, preserve_index=False))


def settled(frame: DataFrame) -> DataFrame:
    """frame with its rows fixed: a checkpoint where the session has a folder for them, else persisted.

    For what decides how rows pair and must not change when a part is computed again.
    """
    return frame.checkpoint() if frame.sparkSession.sparkContext.getCheckpointDir() else frame.persist()


def ordered(frame: DataFrame, name: str) -> tuple[DataFrame, int, DataFrame]:
    """frame with its rows numbered from 0, gapless, in the order in which Spark reads them; how many; what is kept for it.

    The number of rows in each partition goes to the driver, one row a partition, and comes back as a map from which
    every row takes its start. Spark fixes no order of rows; this one is as stable as the source's.
    """
    spark = frame.sparkSession
    kept = settled(frame.withColumn("__fd_mono", F.monotonically_increasing_id()))
    part = F.shiftright("__fd_mono", 33)
    sizes = dict(kept.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    start, at = [], 0
    for p in sorted(sizes):
        start.append((p, at))
        at += sizes[p]
    starts = spark.createDataFrame(start or [(0, 0)], T.StructType([T.StructField("__fd_part", T.LongType()), T.StructField("__fd_start", T.LongType())]))
    numbered = kept.join(F.broadcast(starts), part == F.col("__fd_part"))  # a row for each partition
    return numbered.withColumn(name, F.col("__fd_start") + F.col("__fd_mono").bitwiseAND((1 << 33) - 1)).select(*[f"`{c}`" for c in frame.columns], name), at, kept
