"""Minimax contiguous partition: groups of equal texts in shards of nearly equal bytes.

The groups stand in the order of a hash of their text. The smallest capacity at which a greedy walk over that order
needs no more than the given shards is found by binary search; the shards are cut where that walk cuts. The walk runs
over sums of ranges of the order, finer only where a cut can fall, so that the driver sees a bounded number of sums.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import empty_text, table, written

#: Bits of the order that one refinement resolves, and those there are.
STEP, BITS = 12, 60
#: Rows that one numbering task is given, about; the most such tasks in a shard.
RUN_ROWS, MOST_RUNS = 200_000, 4096


class _Known:
    """Sums of ranges of the order: list of (start, bits left below, sum), sorted, gapless for what has rows."""

    def __init__(self, cells: list[tuple[int, int, int]]):
        self.cells = sorted(cells)
        self.ends, at = [], 0
        for _, _, size in self.cells:
            at += size
            self.ends.append(at)
        self.total = at

    def walk(self, capacity: int, shards: int) -> tuple[list[int], list[int]]:
        """The least and the greatest places at which each greedy cut can fall."""
        low, high, lows, highs = 0, 0, [], []
        for _ in range(shards):
            low, high = self._reach(low + capacity)[0], self._reach(high + capacity)[1]
            lows.append(low)
            highs.append(high)
        return lows, highs

    def _reach(self, to: int) -> tuple[int, int]:
        k = bisect_right(self.ends, to)
        start = self.ends[k - 1] if k else 0
        if k == len(self.cells):
            return self.total, self.total
        return start, to if self.cells[k][1] else start

    def least(self, shards: int, which: int) -> int:
        low, high = 0, self.total
        while low < high:
            mid = (low + high) // 2
            if self.walk(mid, shards)[which][-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def open(self, lows: list[int], highs: list[int]) -> list[int]:
        """Cells that aren't resolved and in which a cut may fall."""
        found = set()
        for a, b in zip(lows, highs, strict=True):
            for k in range(bisect_right(self.ends, a), len(self.cells)):
                if (self.ends[k - 1] if k else 0) > b:
                    break
                if self.cells[k][1]:
                    found.add(k)
        return sorted(found)


def plan(groups: DataFrame, shards: int, step: int = STEP) -> tuple[int, list[int]]:
    """The least capacity, and the order's value at which each shard after the first begins.

    groups: columns place (0 to 2^BITS - 1) and size; rows of the same place are one atom.
    """

    def sums(frame: DataFrame, left: int) -> list[tuple[int, int, int]]:
        cut = F.shiftleft(F.shiftright("place", left), left)
        return [(r[0], left, r[1]) for r in frame.groupBy(cut.alias("at")).agg(F.sum("size")).collect()]

    known = _Known(sums(groups, BITS - step))
    while True:
        low, high = known.least(shards, 1), known.least(shards, 0)
        a, b = known.walk(low, shards)[0], known.walk(high, shards)[1]
        if not (todo := known.open(a, b)):
            break
        parts = []
        for left in sorted({known.cells[k][1] for k in todo}):
            starts = [known.cells[k][0] for k in todo if known.cells[k][1] == left]
            here = groups.where(F.shiftleft(F.shiftright("place", left), left).isin(starts))
            parts += sums(here, max(0, left - step))
        known = _Known([c for k, c in enumerate(known.cells) if k not in set(todo)] + parts)
    cuts = known.walk(high, shards)[0][:-1]
    return high, [known.cells[k][0] if (k := bisect_right(known.ends, c)) < len(known.cells) else 1 << BITS for c in cuts]


def shard(docs: DataFrame, shards: int = 8, step: int = STEP) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, place, capacity, for each row of docs.

    Null text: size 1, CRC 0; all null texts are one group. Rows of the same text, repeated rows too, share a shard.
    Order of slots: by hash of doc_id and place, then doc_id. Empty table: no rows. Other columns are ignored.
    """
    rows = written(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.encode(empty_text(), "UTF-8")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64("text", F.lit(7)), 64 - BITS).alias("place"),
        ),
        "sharding-rows",
    )
    capacity, cuts = plan(rows.select("place", "size"), shards, step)
    at = F.lit(0)
    for c in cuts:
        at = at + (F.col("place") >= F.lit(c).cast("long")).cast("int")
    runs = max(1, min(MOST_RUNS, rows.count() // RUN_ROWS))
    rows = rows.withColumn("shard", at.cast("int")).withColumn("run", F.pmod(F.xxhash64("doc_id", "place"), F.lit(runs)))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "run").agg(F.count("*").alias("n")).select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "run").orderBy("doc_id", "place", "text_crc32")
    return (
        rows.withColumn("nth", F.row_number().over(within) - 1)
        .join(starts, ["shard", "run"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "place", F.lit(capacity).cast("long").alias("capacity"))
    )


def op2_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 8)
