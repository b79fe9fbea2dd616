"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt into blocks by a hash, so the order of its blocks is a random one. A source's quota
is the number of blocks, over at most REPEATS passes, that its target needs. A binary tree over the output shards
splits the quotas: every node gives its left half a draw without replacement from what it holds, so all sums stay
exact. A shard then draws the next blocks of each source's order, disjoint from every other shard's, and orders the
rows it got by a hash of its own. The tree works on one row of sums per source; rows stay in the cluster. Blocks grow
with the corpus once there are MOST_BLOCKS, so that every draw is within what the exact sampler takes.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, empty_text, table, written

#: Weights of the sources in order, repeating; how often at most a document is taken.
WEIGHTS, REPEATS = (5, 2, 1), 3
#: Words that a block holds, about; blocks of all sources, beyond which they hold more.
BLOCK_WORDS, MOST_BLOCKS = 50_000, 100_000_000
#: Parts of a source's order of blocks within which a task sums.
PARTS = 1024
#: Sources whose sums the driver takes; more are refused.
MOST_SOURCES = 1_000_000


def targets(sources: list[tuple[str | None, int]], weights=WEIGHTS, repeats: int = REPEATS) -> list[float]:
    """Words each source shall give. sources: (name, words), in order. What is above repeats x words is reshared."""
    total = sum(n for _, n in sources)
    weight = [weights[k % len(weights)] for k in range(len(sources))]
    full: set[int] = set()
    while True:
        free = sum(w for k, w in enumerate(weight) if k not in full)
        left = total - sum(repeats * sources[k][1] for k in full)
        now = {k for k, w in enumerate(weight) if k not in full and free and left * w >= repeats * sources[k][1] * free}
        if not now:
            return [float(repeats * sources[k][1]) if k in full else left * weight[k] / free for k in range(len(sources))]
        full |= now


def tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """quotas split among shards: an array of shards x sources whose columns sum to quotas, rows as even as can be."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def split(held: np.ndarray, first: int, last: int) -> None:
        if last - first == 1:
            out[first] = held
            return
        mid = (first + last) // 2
        draw = int(held.sum()) * (mid - first) // (last - first)
        dice = np.random.Generator(np.random.PCG64([seed, first, last]))
        left, rest, need = np.zeros_like(held), int(held.sum()), draw
        for k, n in enumerate(held.tolist()):
            rest -= n
            left[k] = int(dice.hypergeometric(n, rest, need)) if need and n else 0
            need -= int(left[k])
        split(left, first, mid)
        split(held - left, mid, last)

    split(np.asarray(quotas, dtype=np.int64), 0, shards)
    return out


def mix(docs: DataFrame, shards: int = 8, seed: int = 1, weights=WEIGHTS, repeats: int = REPEATS, block_words: int = BLOCK_WORDS, carry: bool = False) -> DataFrame:
    """Each row of docs with size, source_size, target, taken, and draws: array of (pass, shard, position, words).

    Null text: size 0. A null source is a source, last in order. A source without words has target 0 and takes none.
    Repeated rows are documents of their own. Empty table: no rows. The last document a source takes may be taken in
    part, so that taken sums to the rounded target. position orders a shard's rows; it isn't gapless.
    Columns other than doc_id, text and source are dropped, or with carry all are kept as "carried 0", "carried 1", ...
    """
    carried = [F.col(f"`{c}`").alias(f"carried {k}") for k, c in enumerate(docs.columns)] if carry else []
    more = [f"carried {k}" for k in range(len(carried))]
    rows = written(
        docs.select(
            "doc_id",
            F.col("source").cast("string").alias("source"),
            F.regexp_count(empty_text(), F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64("doc_id", "text", F.lit(seed), F.lit("rows")).alias("draw"),
            *carried,
        ),
        "mixing-rows",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("words")).orderBy(F.col("source").asc_nulls_last()).limit(MOST_SOURCES + 1).collect()
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: their weights are set on the driver")
    sources = [(r[0], r[1]) for r in sizes]
    goal = targets(sources, weights, repeats)
    want = [min(repeats * n, round(t)) for t, (_, n) in zip(goal, sources, strict=True)]
    block_words = max(block_words, -(-sum(n for _, n in sources) // MOST_BLOCKS))
    blocks = [max(1, n // block_words) for _, n in sources]
    facts = [{"source": s, "source_size": n, "target": t, "want": w, "blocks": b} for (s, n), t, w, b in zip(sources, goal, want, blocks, strict=True)]
    known = _frame(rows.sparkSession, facts, "source string, source_size long, target double, want long, blocks long")
    rows = rows.join(known, rows["source"].eqNullSafe(known["source"])).drop(known["source"]).withColumn("block", F.pmod("draw", "blocks"))

    # One row per source, block and pass, in the order in which the source gives them: by pass, then by hash. A task
    # sums within a part of that order; the parts' sums, PARTS a source and pass at most, are then added up.
    key = ["source", "block"]
    sums = written(rows.groupBy(*key, "want", "blocks").agg(F.sum("size").alias("words")), "mixing-blocks")
    hashed = F.xxhash64("block", "pass", F.lit(seed))
    part = F.shiftrightunsigned(hashed, 64 - (PARTS - 1).bit_length())
    each = sums.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("hashed", hashed).withColumn("part", part)
    turn = Window.partitionBy("source").orderBy("pass", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = each.groupBy("source", "pass", "part").agg(F.sum("words").alias("words"), F.count("*").alias("units"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    parts = parts.select(F.col("source").alias("s"), F.col("pass").alias("p"), F.col("part").alias("q"), before("words", turn).alias("words_before"), before("units", turn).alias("units_before"))
    # parts are in the order of unsigned numbers, and within one part hashes are in the same order signed or not
    within = Window.partitionBy("source", "pass", "part").orderBy("hashed", "block")
    units = (
        each.join(parts, each["source"].eqNullSafe(parts["s"]) & (each["pass"] == parts["p"]) & (each["part"] == parts["q"])).drop("s", "p", "q")
        .withColumn("start", F.col("words_before") + before("words", within.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("nth", F.col("units_before") + F.row_number().over(within) - 1)
        .where(F.col("start") < F.col("want"))
        .select("source", "block", "pass", "start", "nth")
    )
    units = written(units, "mixing-units")
    quota = {r[0]: r[1] for r in units.groupBy("source").count().collect()}
    split = tree([quota.get(s, 0) for s, _ in sources], shards, seed)
    ends = [{"source": s, "ends": split[:, k].cumsum().tolist()} for k, (s, _) in enumerate(sources)]
    ends = _frame(rows.sparkSession, ends, "source string, ends array<long>")
    drawn = (
        units.join(ends, units["source"].eqNullSafe(ends["source"])).drop(ends["source"])
        .withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("nth"))))
        .groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pass", "shard", "start"))).alias("units"))
    )
    first = Window.partitionBy(*key).orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(first), F.lit(0)))
    same = rows["source"].eqNullSafe(drawn["source"]) & (rows["block"] == drawn["block"])
    draws = F.filter(
        F.transform(
            F.coalesce("units", F.array().cast("array<struct<pass:int,shard:int,start:long>>")),
            lambda u: F.struct(
                u["pass"].alias("pass"),
                u["shard"].alias("shard"),
                F.xxhash64("doc_id", u["pass"], u["shard"], F.lit(seed), F.lit("place")).alias("position"),
                F.greatest(F.lit(0), F.least("size", F.col("want") - u["start"] - F.col("before"))).alias("words"),
            ),
        ),
        lambda d: d["words"] > 0,
    )
    return (
        rows.join(drawn, same, "left").select(rows["source"], "doc_id", "size", "source_size", "target", draws.alias("draws"), *more)
        .withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]))
        .select("doc_id", "size", "source_size", "target", "taken", "draws", "source", *more)
    )


def mixed(docs: DataFrame, shards: int = 8, seed: int = 1) -> DataFrame:
    """The mix of docs (documents): a row for each time a document is drawn, with all its columns.

    Documents that aren't drawn go. One that is drawn in part keeps its text up to the last word drawn, and n_chars
    follows. Repeated rows are documents of their own.
    """
    drawn = mix(docs, shards, seed, carry=True).withColumn("draw", F.explode("draws"))
    column = {c: F.col(f"carried {k}") for k, c in enumerate(docs.columns)}
    taken, part = F.col("draw")["words"], F.col("draw")["words"] < F.col("size")
    first = F.array_join(F.slice(F.regexp_extract_all(column["text"], F.lit(rf"([\x20\x09-\x0D]*{WORD})")), 1, taken.cast("int")), "")
    made = column | {"text": F.when(part, first).otherwise(column["text"])}
    if "n_chars" in column:
        made["n_chars"] = F.when(part, F.length(first)).otherwise(column["n_chars"])
    return drawn.select(*[made[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def _frame(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Rows of sums per source as a frame, without Python on the executors."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")).alias("r")).select("r.*")


def op7_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")
