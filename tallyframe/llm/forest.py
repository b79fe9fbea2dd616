"""Approximate nearest neighbours from a forest of random-projection trees.

The trees are fitted on a bounded sample and every vector is put into a leaf of each. A search keeps one priority queue
for all trees: it takes the branch whose hyperplanes are nearest to the query on the wrong side, goes down to a leaf,
and queues the branches it passed, until the leaves hold the share of the vectors that it is to see. Leaf and queries
meet in the cluster, in parts of bounded size, and candidates are reranked by their exact distance.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Vectors the trees are fitted on at most; trees; splits above a leaf at most; vectors of the sample in a leaf at least.
SAMPLE, TREES, DEPTH, LEAF = 20_000, 8, 6, 8
#: Share of all vectors, a vector in two trees counted twice, that a search sees.
SEEN = 1.5
#: Lengths of vectors that are searched.
LENGTHS = 16
#: Vectors and queries that meet in one task at most, about.
ROWS, QUERIES = 16_384, 2_048


class Forest:
    """directions and offsets of the nodes of complete binary trees, and the sample's share in each leaf."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, seed: int = 11):
        dice = np.random.Generator(np.random.PCG64(seed))
        n, dim = sample.shape
        self.depth = max(0, min(depth, int(np.log2(max(1, n // leaf)))))
        inner = 2**self.depth - 1
        self.directions = dice.standard_normal((trees, inner, dim))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.offsets = np.zeros((trees, inner))
        self.shares = np.zeros((trees, 2**self.depth))
        for t in range(trees):
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                for at in range(2**level - 1, 2 ** (level + 1) - 1):
                    own = np.flatnonzero(node == at)
                    side = sample[own] @ self.directions[t, at]
                    self.offsets[t, at] = np.median(side) if len(own) else 0.0
                    node[own] = 2 * at + 1 + (side > self.offsets[t, at])
            self.shares[t] = np.bincount(node - inner, minlength=2**self.depth) / max(1, n)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.zeros((len(vectors), len(self.offsets)), np.int64)
        for t in range(len(self.offsets)):
            node = out[:, t]
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", vectors, self.directions[t, node])
                node = 2 * node + 1 + (side > self.offsets[t, node])
            out[:, t] = node - (2**self.depth - 1)
        return out

    def search(self, query: np.ndarray, seen: float) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue, until the leaves hold `seen` of the sample."""
        margin = self.directions @ query - self.offsets if self.depth else np.zeros((len(self.offsets), 0))
        queue = [(0.0, t, 0) for t in range(len(margin))]
        inner, held, out = margin.shape[1], 0.0, []
        while queue and held < seen:
            far, t, at = heapq.heappop(queue)
            while at < inner:
                right = margin[t, at] > 0
                heapq.heappush(queue, (max(far, abs(margin[t, at])), t, 2 * at + 2 - right))
                at = 2 * at + 1 + right
            out.append((t, int(at - inner)))
            held += self.shares[t, at - inner]
        return out


def _fine(vectors: DataFrame, key: str, value: str) -> DataFrame:
    """id and value (doubles) of each row, without null ids and vectors that are null, empty, zero or hold a null or
    non-finite component."""
    numbers = F.transform(value, lambda x: x.cast("double"))
    fine = F.col(key).isNotNull() & F.col(value).isNotNull() & F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(numbers, lambda x: x != 0)
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(key).cast("long").alias("id"), numbers.alias("value"))


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", value: str = "embedding", trees: int = TREES, depth: int = DEPTH, seen: float = SEEN, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found for each row of queries, which are rows of vectors.

    Nearness: Euclidean distance in double precision, ties to the smaller id, the query's own id left out. Equal
    vectors are searched as one, so any number of copies costs what k + 1 do. Vectors that are null, empty, zero or
    hold null or non-finite components take no part, nor do null ids. Vectors of different lengths have no distance:
    each length has a forest of its own, up to LENGTHS of them; more are refused. The result does not depend on
    partitioning. Rows repeating an id and vector count as one. Empty: no rows.
    """
    there, asked = _fine(vectors, key, value), _fine(queries, key, value)
    lengths = sorted(r[0] for r in there.select(F.size("value")).distinct().limit(LENGTHS + 1).collect())
    if len(lengths) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} lengths")
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for n in lengths:
        of = F.size("value") == n
        out = out.unionByName(_searched(there.where(of), asked.where(of), k, trees, depth, seen, sample))
    return out


def _searched(vectors: DataFrame, queries: DataFrame, k: int, trees: int, depth: int, seen: float, sample: int) -> DataFrame:
    """neighbours() for vectors (id, value) of one length."""
    spark = vectors.sparkSession
    # the k + 1 least ids of each distinct vector
    place = F.row_number().over(Window.partitionBy("value").orderBy("id"))
    kept = written(vectors.withColumn("place", place).where(F.col("place") <= k + 1), "forest-classes")
    first = kept.where("place = 1").select(F.col("id").alias("first"), "value")
    fit = first.orderBy(F.xxhash64("first"), "first").limit(sample).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not fit:
        return spark.createDataFrame([], schema)
    forest = Forest(np.array([r["value"] for r in fit], np.float64), trees, depth)
    there = first.count()
    # copies that weren't kept are queries too, so these find their class by its vector
    asked = queries.select(F.col("id").alias("query_id"), "value").distinct()
    asked = written(asked.join(first, "value").select("query_id", "first"), "forest-queries")
    wanted = first.join(asked.select("first").distinct(), "first")

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(1)
            at = forest.leaves(own.flatten().to_numpy().reshape(len(own), -1)) if len(own) else np.zeros((0, trees), np.int64)
            where = (at + np.arange(at.shape[1]) * 2**forest.depth).ravel()
            yield pa.RecordBatch.from_arrays([batch.column(0), own, pa.ListArray.from_arrays(np.arange(0, len(where) + 1, max(1, at.shape[1]), dtype=np.int32), pa.array(where))], ["first", "value", "leaves"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(1)
            found = [[t * 2**forest.depth + at for t, at in forest.search(np.array(v.as_py()), seen)] for v in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), own, pa.array(found, pa.list_(pa.int64()))], ["first", "value", "leaves"])

    # every leaf in parts of bounded size, and the queries that come to it likewise
    per_leaf = there / 2**forest.depth
    row_parts = max(1, round(per_leaf / ROWS))
    query_parts = max(1, round(wanted.count() * min(1.0, seen / trees * 2) / QUERIES))
    kinds = "first long, value array<double>, leaves array<long>"
    part = lambda n: F.pmod(F.xxhash64("first"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = ["leaf", "row_part", "query_part"]
    index = first.mapInArrow(leaf, kinds).select("first", "value", F.explode("leaves").alias("leaf"), part(row_parts).cast("int").alias("row_part"))
    index = index.withColumn("query_part", every(query_parts))
    search = wanted.mapInArrow(route, kinds).select("first", "value", F.explode("leaves").alias("leaf"), part(query_parts).cast("int").alias("query_part"))
    search = search.withColumn("row_part", every(row_parts))
    near = search.groupBy(*place).cogroup(index.groupBy(*place)).applyInArrow(_meet(k + 1), "query long, found long, score double")
    best = near.distinct().withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy("score", "found"))).where(F.col("nth") <= k + 1)
    of = kept.join(first.select("first", F.col("value")), "value").select(F.col("first").alias("found"), F.col("id").alias("vec_id"))
    best = asked.join(best.select(F.col("query").alias("first"), "found", "score"), "first").join(of, "found").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").distinct().where(F.col("rank") <= k)


def _meet(k: int):
    """The k nearest of a leaf's part for each query that comes to it, by exact distance."""

    def run(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["query", "found", "score"]
        if not queries.num_rows or not rows.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names)
        matrix = lambda t: t["value"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        asked, there, ids = matrix(queries), matrix(rows), rows["first"].to_numpy()
        size = (there * there).sum(1)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for query, q in zip(queries["first"].to_pylist(), asked, strict=True):
            rough = size - 2 * (there @ q)
            some = np.arange(len(ids))
            if len(ids) > k:
                some = np.flatnonzero(rough <= np.partition(rough, k - 1)[k - 1] + 1e-9 * (size.max() + q @ q))
            score = np.sqrt(((there[some] - q) ** 2).sum(1))
            order = np.lexsort((ids[some], score))[:k]
            out.append((np.full(len(order), query), ids[some][order], score[order]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)

    return run


def op5_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours(vectors, vectors.where("vec_id % 100 = 0"))
