"""What the operators share: word rules, the shared folder, and sizes that follow the input."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Input bytes (as the plan estimates them) that one cell or bucket stands for.
CELL_BYTES = 4 << 20
#: A size from which a plan means that it doesn't know.
UNKNOWN = 1 << 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run in one process, as in tests."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir isn't set: executors have no folder in common")
        there = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, read as often as needed, no lineage behind it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_alone(df: DataFrame, name: str) -> DataFrame:
    """written(), and what was shuffled for it goes at once instead of when the driver next collects garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return written(df, name)
    finally:
        conf.set(key, before)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that written() made; nothing may read them any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def cells(docs: DataFrame, per: int = CELL_BYTES, least: int = 8) -> int:
    """How many bounded groups to deal docs into: by the size its plan states, which for tables is that of their files.

    Where the plan's leaves state none, as for rows from the driver, the texts are measured.
    """
    plan = docs._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    size = min(int(plan.stats().sizeInBytes()), sum(int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())))
    if size >= UNKNOWN:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, -(-size // per))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def empty_text(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
