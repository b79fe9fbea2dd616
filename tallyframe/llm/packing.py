"""Best-fit packing planned on the histogram of lengths.

Documents become pieces of at most `limit` tokens. Only how many pieces each length has goes to the driver, at most
`limit` numbers. Best fit, longest first, runs over these counts: runs of equal sequences take runs of equal pieces.
Each piece then finds its planned slot by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import empty_text, table, written
from .wordpieces import encode

LIMIT, END = 2048, 0
#: Texts that a task encodes at a time: so many, or of so many characters.
GROUP, GROUP_CHARS = 1024, 2 << 20
#: Pieces that one numbering task is given, about; the most such tasks for a length.
RUN_ROWS, MOST_RUNS = 200_000, 1024


def best_fit(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces, first sequence, offset): the pieces of these ranks go to sequences that count up alike.

    A length splits at most one run for each free space, so the plan is bounded by limit and not by the pieces.
    """
    plan, free, spaces, made = [], {}, [], 0

    def give(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in free:
                free[space] = []
                insort(spaces, space)
            runs = free[space]
            if runs and runs[-1][0] + runs[-1][1] == first:
                runs[-1] = (runs[-1][0], runs[-1][1] + n)
            else:
                runs.append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect_left(spaces, length)
            if k == len(spaces):
                break
            space = spaces[k]
            first, n = free[space].pop()
            take = min(left, n)
            plan.append((length, rank, take, first, limit - space))
            left, rank = left - take, rank + take
            if take < n:
                free[space].append((first + take, n - take))
            elif not free[space]:
                del free[space]
                spaces.pop(k)
            give(space - length, first, take)
        if left:
            each = limit // length
            for n, stack in ((left // each, each), (1 if left % each else 0, left % each)):
                if n:
                    plan.extend((length, rank + j * n, n, made, j * length) for j in range(stack))
                    give(limit - stack * length, made, n)
                    rank, made = rank + n * stack, made + n
    return plan


def pieces(docs: DataFrame, path: str, limit: int = LIMIT, end: int = END, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for) of each piece of each row of docs."""

    def cut(doc_id: list, texts: list[str]) -> pa.RecordBatch:
        rows: list[tuple] = []
        for d, raw in zip(doc_id, encode(texts, path), strict=True):
            raw += int(end).to_bytes(4, "little")
            for k, at in enumerate(range(0, len(raw), 4 * limit)):
                part = raw[at : at + 4 * limit]
                rows.append((d, k, at // 4, len(part) // 4, zlib.crc32(part), part))
        cols = list(zip(*rows, strict=True))
        arrays = [pa.array(cols[0], kind), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
        if ids:
            arrays.append(pa.ListArray.from_arrays(np.cumsum([0, *cols[3]]).astype(np.int32), np.frombuffer(b"".join(cols[5]), "<u4").astype(np.int64)))
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, held = [], 0
            for start in range(batch.num_rows):
                some.append(batch.column(1)[start].as_py())
                held += len(some[-1])
                if len(some) == GROUP or held > GROUP_CHARS or start == batch.num_rows - 1:
                    yield cut(batch.column(0).slice(start + 1 - len(some), len(some)).to_pylist(), some)
                    some, held = [], 0

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    key = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(key)
    schema = f"doc_id {key.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * ids
    return docs.select("doc_id", empty_text().alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, limit: int = LIMIT, end: int = END, ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset.

    Null and empty texts are one piece, the end token. Repeated rows are documents of their own. Ranks follow a hash of
    doc_id and piece, so equal pieces may trade slots. Other columns are ignored. Empty table: no rows.
    """
    rows = written(pieces(docs, path, limit, end, ids), "packing-pieces")
    counts = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}
    plan = np.array(best_fit(counts, limit), np.int64).reshape(-1, 5)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    runs = max(1, min(MOST_RUNS, sum(counts.values()) // RUN_ROWS))
    numbered = rows.withColumn("run", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(runs)))
    before = Window.partitionBy("length").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = numbered.groupBy("length", "run").agg(F.count("*").alias("n")).select("length", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "run").orderBy(F.xxhash64("doc_id", "piece"), "doc_id", "piece", "ids_crc32")
    ranked = numbered.withColumn("nth", F.row_number().over(within) - 1).join(starts, ["length", "run"])
    ranked = ranked.select(*rows.columns, (F.col("before") + F.col("nth")).cast("long").alias("rank"))
    base = int(plan[:, 1].max() + plan[:, 2].max() + 1) if len(plan) else 1
    keys = plan[:, 0] * base + plan[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * base + rank, "right") - 1
            found = [plan[at, 3] + rank - plan[at, 1], plan[at, 4]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, found)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
