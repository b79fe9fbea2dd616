"""Quality rules with thresholds that adapt to each language and source.

Every document is measured over its whole text. Per language and source, each measure gets a quantile sketch: counts in
bins whose width is 1/64 of the value or less, so sketches merge by adding counts and a quantile is right within that
width. A group's sketch is merged with PRIOR documents' worth of its language's, which itself is merged with as many of
the whole corpus's, so that small groups lean on their parents and large ones speak for themselves. Fences are set out
from high quantiles of the merged sketch, at a distance that follows its spread. Documents are then joined with the
fences of their group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Fixed rules: least words; most repeated words, in percent.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Documents' worth of its parent's sketch that a group's is merged with.
PRIOR = 30
#: Measures: name -> (value from the counts, events it counts, low, middle and high quantile in percent, reach). Values
#: are whole numbers: 1/100 of a letter, or parts in 10,000. Fences lie reach x (high - middle) above the high quantile,
#: and as far below the low one where there is one.
MEASURES = {
    "word_length": ("word_chars * 100 div n_words", "n_words", 10, 10, 90, 1.5),
    "symbols": ("n_symbols * 10000 div n_words", "n_symbols", None, 50, 90, 4),
    "dup_lines": ("n_dup_lines * 10000 div n_words", "n_dup_lines", None, 50, 95, 4),
    "repeats": ("n_repeat_words * 10000 div n_words", "n_repeat_words", None, 50, 95, 4),
}
#: A text with fewer events than this isn't judged by their share: one stray symbol says nothing.
LEAST_EVENTS = 3
#: Salt against groups that hold a large share of the documents.
SALT = 32
SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    chars = len(text) - sum(map(text.count, SPACE))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), _repeated(words)


def _repeated(words: list[bytes]) -> int:
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    at = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    base = len(number)
    pair = at[:-1] * base + at[1:]
    if base >= 1 << 20:  # else three numbers fit into 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    three = pair[:-1] * base + at[2:]
    _, which, often = np.unique(three, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(often[which] > 1)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[hit + k] = True
    return int(covered.sum())


def measure(docs: DataFrame) -> DataFrame:
    """The columns of docs as "carried 0", "carried 1", ..., and doc_id, lang, source and the counts of the text."""
    carried = [F.col(f"`{c}`").alias(f"carried {k}") for k, c in enumerate(docs.columns)]
    asked = docs.select(*carried, "doc_id", "lang", "source", F.col("text").alias("measured"))
    names = asked.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = [counts(x.as_py()) for x in part.column(len(names))]
                arrays = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *arrays], [*names, *COUNTS])

    return asked.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema[:-1]), *(f"{c} long" for c in COUNTS)]))


def _bin(value: str):
    """The bin of a whole number: exact below 128, then 64 bins for each doubling."""
    drop = f"greatest(0, length(bin({value})) - 7)"
    return F.expr(f"shiftleft(shiftright({value}, {drop}), {drop})")


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure, bin, n: the sketches of all groups, of documents that pass the fixed rules."""
    values = F.array(*[F.struct(F.lit(k).alias("measure"), F.expr(m[0]).alias("value")) for k, m in MEASURES.items()])
    return measured.where(~_failed()).select("lang", "source", F.inline(values)).groupBy("lang", "source", "measure", _bin("value").alias("bin")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame) -> DataFrame:
    """lang, source, measure, bin, mass, all: each group's sketch with its parents' share, in whole numbers.

    A group of t documents has t + PRIOR documents' worth; its mass is counted in parts so small that all is exact.
    """
    exact = lambda c: F.sum(c).cast("decimal(38,0)")
    parts = sketch.groupBy("measure", "bin").agg(exact("n").alias("whole_n"))
    wholes = sketch.groupBy("measure").agg(exact("n").alias("whole"))
    langs = sketch.groupBy("lang", "measure", "bin").agg(exact("n").alias("lang_n"))
    lang_all = sketch.groupBy("lang", "measure").agg(exact("n").alias("lang_all"))
    groups = sketch.groupBy("lang", "source", "measure").agg(exact("n").alias("own_all"))

    def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
        right = right.withColumnsRenamed({k: f"other {k}" for k in keys})
        on = [F.col(k).eqNullSafe(F.col(f"other {k}")) for k in keys]
        return left.join(right, on, how).drop(*[f"other {k}" for k in keys])

    prior = F.lit(PRIOR).cast("decimal(4,0)")
    lang = same(same(same(lang_all, wholes, ["measure"]), parts, ["measure"]), langs, ["lang", "measure", "bin"], "left")
    lang = lang.select("lang", "measure", "bin", (F.coalesce("lang_n", F.lit(0)) * F.col("whole") + prior * F.col("whole_n")).cast("decimal(38,0)").alias("lang_mass"), ((F.col("lang_all") + prior) * F.col("whole")).cast("decimal(38,0)").alias("lang_mass_all"))
    own = sketch.withColumn("n", F.col("n").cast("decimal(38,0)"))
    group = same(same(groups, lang, ["lang", "measure"]), own, ["lang", "source", "measure", "bin"], "left")
    mass = F.coalesce("n", F.lit(0)) * F.col("lang_mass_all") + prior * F.col("lang_mass")
    return group.select("lang", "source", "measure", "bin", mass.cast("decimal(38,0)").alias("mass"), ((F.col("own_all") + prior) * F.col("lang_mass_all")).cast("decimal(38,0)").alias("all")).where("mass > 0")


def fences(sketch: DataFrame) -> DataFrame:
    """lang, source, measure, low, high."""
    by = ["lang", "source", "measure"]
    ranked = merged(sketch).withColumn("upto", F.sum("mass").over(Window.partitionBy(*by).orderBy("bin")).cast("decimal(38,0)"))
    fact = lambda k: F.create_map(*[F.lit(x) for m, own in MEASURES.items() for x in (m, own[k])])[F.col("measure")]
    quantile = lambda k: F.min(F.when(F.col("upto") * 100 >= F.col("all") * fact(k), F.col("bin")))
    found = ranked.groupBy(*by).agg(quantile(2).alias("q_low"), quantile(3).alias("q_mid"), quantile(4).alias("q_high"))
    reach = fact(5) * (F.col("q_high") - F.col("q_mid"))
    low = F.coalesce(F.floor(F.col("q_low") - reach), F.lit(-1))
    return found.select(*by, low.cast("long").alias("low"), F.ceil(F.col("q_high") + reach).cast("long").alias("high"))


def _failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def verdicts(measured: DataFrame) -> DataFrame:
    """measured with base_failed and kept. Null languages and sources are groups like others."""
    wide = fences(sketches(measured)).groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct("low", "high")))).alias("fence"))
    wide = wide.select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), "fence", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("f_salt"))
    rows = measured.withColumn("salt", F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(SALT)).cast("int"))
    same = rows["lang"].eqNullSafe(wide["f_lang"]) & rows["source"].eqNullSafe(wide["f_source"]) & (rows["salt"] == wide["f_salt"])
    inside = F.lit(True)
    for k, (value, events, *_) in MEASURES.items():
        inside = inside & ((F.col(events) < LEAST_EVENTS) | F.expr(f"{value} between fence['{k}'].low and fence['{k}'].high"))
    joined = rows.join(wide, same, "left").withColumn("base_failed", _failed())
    return joined.withColumn("kept", ~F.col("base_failed") & F.when(F.col("base_failed"), F.lit(False)).otherwise(inside)).drop("f_lang", "f_source", "f_salt", "salt", "fence")


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, lang, source, the counts, base_failed, kept.

    Null and empty texts have no words and fail. Repeated rows are judged each. Other columns are ignored. Empty table: no rows.
    """
    return verdicts(written(measure(docs.select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", *COUNTS), "quality-counts"))


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns; each row has its own verdict, whatever rows equal it."""
    good = verdicts(written(measure(docs), "quality-counts")).where("kept")
    return good.select(*[F.col(f"carried {k}").alias(c) for k, c in enumerate(docs.columns)])


def op3_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")
