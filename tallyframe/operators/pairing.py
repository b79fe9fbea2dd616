"""Which rows of a repeated key belong together.

A key that one side has more than once cannot be joined by itself. Pairing gives each of its rows an occurrence, so
that (key, occurrence) is unique on both sides. Only rows of repeated keys go through it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..sources.inputs import settled

#: Candidate pairs of a key up to which they are listed and sorted; beyond, they are searched row by row, with the same result.
MOST_FOR_KEY = 10_000

#: Rows of a key up to which one task numbers them; beyond, runs of about as many are numbered each.
MOST_IN_RUN = 1 << 20

_PAIR = "array<struct<n:int,lo:bigint,ro:bigint,i:int,j:int>>"


def renamed(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows whose columns of these names begin with r_."""
    return rows.withColumnsRenamed({c: f"r_{c}" for c in names})


def same(names: list[str]) -> Column:
    """Null-safe equality of columns with those that renamed() made."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in names])


def look(left: DataFrame, right: DataFrame, keys: list[str]) -> Row:
    """Of the keys that a side has more than once: the most rows of a side (most), the most rows of one side times those of
    the other (product), how many each side repeats (many_l, many_r), and the pairs and single rows they make (many).

    One aggregation of nothing but keys; most is null where none repeats.
    """
    one, none = F.lit(1).cast("byte"), F.lit(None).cast("byte")
    tagged = left.select(*keys, one.alias("l"), none.alias("r")).unionByName(right.select(*keys, none.alias("l"), one.alias("r")))
    counts = tagged.groupBy(*keys).agg(F.count("l").alias("nl"), F.count("r").alias("nr")).where("nl > 1 or nr > 1")
    more = F.greatest("nl", "nr")
    return counts.agg(
        F.max(more).alias("most"),
        F.max(F.col("nl").cast("double") * F.col("nr")).alias("product"),
        F.count_if(F.col("nl") > 1).alias("many_l"),
        F.count_if(F.col("nr") > 1).alias("many_r"),
        F.coalesce(F.sum(more), F.lit(0)).alias("many"),
    ).first()


def key_counts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, nl and nr, lo and ro of the keys that a side has more than once: one aggregation over both sides.

    lo and ro: where, in the order of rows, a side has the key first.
    """
    at = F.monotonically_increasing_id()
    none = F.lit(None).cast("long")
    tagged = left.select(*keys, at.alias("lo"), none.alias("ro")).unionByName(right.select(*keys, none.alias("lo"), at.alias("ro")))
    counts = tagged.groupBy(*keys).agg(F.count("lo").alias("nl"), F.count("ro").alias("nr"), F.min("lo").alias("lo"), F.min("ro").alias("ro"))
    return counts.where("nl > 1 or nr > 1")


def numbered(rows: DataFrame, by: list[str], order: list[str], ordinal: str, name: str, hot: bool) -> DataFrame:
    """rows with their place among the rows equal in `by`, from 1: by `order`, nulls last, then by `ordinal`.

    hot: a group may be too large for one task. Runs of it are numbered each, and begin where the sizes of those before
    end: runs of ordinals, or, where columns order the rows, the ranges that a sort deals them to.
    """
    keys = [F.col(c).asc_nulls_last() for c in order]
    if not hot:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*keys, ordinal)).cast("long"))
    if order:
        rows = settled(rows.repartitionByRange(*by, *keys, ordinal).withColumn("run", F.spark_partition_id().cast("long")))
    else:
        rows = rows.withColumn("run", F.shiftright(ordinal, (MOST_IN_RUN - 1).bit_length()))
    within = rows.withColumn(name, F.row_number().over(Window.partitionBy(*by, "run").orderBy(*keys, ordinal)).cast("long"))
    sizes = rows.groupBy(*by, "run").agg(F.count("*").alias("size"))
    before = Window.partitionBy(*by).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).where("before > 0").drop("size")
    out = within.join(renamed(sizes, [*by, "run"]), same([*by, "run"]), "left").withColumn(name, F.col(name) + F.coalesce("before", F.lit(0)))
    return out.select(*[c for c in within.columns if c != "run"])


def matched(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], hot: bool, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """lo and ro of the rows that belong together.

    left, right: rows of repeated keys, with keys, values in comparable form, and an ordinal (lo, ro). Equal rows pair
    first, the n-th copy with the n-th. What both sides of a key have left pairs by similarity, the pair with the
    fewest different values first and then by ordinals.
    """
    both = left.select(*keys, *values, "lo", F.lit(None).cast("long").alias("ro")).unionByName(right.select(*keys, *values, F.lit(None).cast("long").alias("lo"), "ro"))
    both = both.withColumn("ordinal", F.coalesce("lo", "ro")).withColumn("side", F.col("lo").isNotNull())
    copies = numbered(both, [*keys, *values, "side"], [], "ordinal", "copy", hot)
    exact = keep(settled(copies.groupBy(*keys, *values, "copy").agg(F.max("lo").alias("lo"), F.max("ro").alias("ro"))))
    equal = exact.where("lo is not null and ro is not null").select("lo", "ro")
    rest_l = exact.where("ro is null").select(*keys, *values, "lo")
    rest_r = exact.where("lo is null").select(*keys, *values, "ro")

    count = lambda rows, n: rows.groupBy(*keys).agg(F.count("*").alias(n))
    sizes = count(rest_l, "a").join(renamed(count(rest_r, "b"), keys), same(keys))
    sizes = sizes.select(*keys, (F.col("a").cast("double") * F.col("b") <= MOST_FOR_KEY).alias("small"))

    def of(rows: DataFrame, flag: Column) -> DataFrame:
        return rows.join(renamed(sizes.where(flag).select(*keys), keys), same(keys), "left_semi")

    row = lambda ordinal: F.struct(ordinal, *values)
    lists = [of(rows, F.col("small")).groupBy(*keys).agg(F.collect_list(row(n)).alias(name)) for rows, n, name in ((rest_l, "lo", "a"), (rest_r, "ro", "b"))]
    small = lists[0].join(renamed(lists[1], keys), same(keys))
    similar = small.select(F.inline(alike(F.col("a"), F.col("b"), "lo", "ro", values))).select("lo", "ro")

    none = F.lit(None).cast("long")
    large = of(rest_l, ~F.col("small")).withColumn("ro", none).unionByName(of(rest_r, ~F.col("small")).withColumn("lo", none), allowMissingColumns=True)
    # codes by Spark's own order tell equal values in the worker, whatever their type
    codes = [F.dense_rank().over(Window.partitionBy(*keys).orderBy(c)).alias(c) for c in values]
    searched = large.select(*keys, *codes, "lo", "ro").groupBy(*keys).applyInPandas(lambda rows: _searched(rows, values), "lo long, ro long")
    return equal.unionByName(similar).unionByName(searched)


def alike(a: Column, b: Column, lo: str, ro: str, values: list[str]) -> Column:
    """Which of two lists of rows belong together, as structs n, lo, ro, i and j: the number of different values, ordinals, places.

    The pair with the fewest different values first, then by ordinals.
    """
    distance = lambda x, y: sum([F.when(x[c].eqNullSafe(y[c]), 0).otherwise(1) for c in values], F.lit(0)).cast("int")
    pair = lambda x, i, y, j: F.struct(distance(x, y).alias("n"), x[lo].alias("lo"), y[ro].alias("ro"), i.alias("i"), j.alias("j"))
    pairs = F.array_sort(F.flatten(F.transform(a, lambda x, i: F.transform(b, lambda y, j: pair(x, i, y, j)))))
    return F.aggregate(
        pairs,
        F.array().cast(_PAIR),
        lambda done, x: F.when(F.exists(done, lambda y: (y["lo"] == x["lo"]) | (y["ro"] == x["ro"])), done).otherwise(F.concat(done, F.array(x))),
    )


def _searched(rows: pd.DataFrame, values: list[str]) -> pd.DataFrame:
    """What alike() gives, as lo and ro, for one key with many rows; takes memory for its rows, not for its pairs.

    Rows go by ordinal through levels of 1, 2, .. different values. A row is compared with all that are free only when its least
    number of differences as last seen has come up, since that only grows.
    """
    a, b = (rows[rows[n].notna()].sort_values(n) for n in ("lo", "ro"))
    lo, ro = a["lo"].to_numpy("int64"), b["ro"].to_numpy("int64")
    x, y = (np.ascontiguousarray(side[values].to_numpy("int32").T) for side in (a, b))
    free, least, found = np.arange(len(ro)), np.zeros(len(lo), "int32"), []
    for level in range(len(values)):
        kept = []
        for i in np.flatnonzero(least == level) if len(free) else ():
            if not len(free):
                break
            n = np.zeros(len(free), "int16")
            for k in range(len(values)):
                n += y[k] != x[k, i]
            if (nearest := int(n.min())) > level:
                least[i] = nearest
                continue
            at = int(np.argmin(n))
            kept.append((i, free[at]))
            free, y = np.delete(free, at), np.delete(y, at, axis=1)
            least[i] = -1
        found += kept
    # rows that are left agree in nothing
    found += list(zip(np.flatnonzero(least >= 0), free, strict=False))
    return pd.DataFrame({"lo": [lo[i] for i, _ in found], "ro": [ro[j] for _, j in found]}, dtype="int64")
