"""Comparison of two tables by key: checks first, then one plan with a single full outer join."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from functools import cached_property, reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import DtypeMismatchError, cast_hint, common_type, is_nested, type_name
from ..functions.values import comparable, differs
from ..plans.result import ColumnInfo, DiffResult, Layout
from ..sources.inputs import ordered, settled, to_spark
from . import pairing

#: Column names that begin so are the engine's.
RESERVED = "__fd_"  # a fixed value
MODES = ("match", "number", "raise")
#: Rows of a partition of the numbered result, about, and its partitions at most.
LAYOUT_ROWS, MOST_PARTITIONS = 250_000, 20_000


def compare(
    left: Any,
    right: Any,
    key: str | Sequence[str],
    *,
    left_name: str = "left",
    right_name: str = "right",
    ignore_columns: Iterable[str] = (),
    strict: bool = True,
    duplicates: str = "match",
    order_by: str | Sequence[str] | None = None,
    spark: SparkSession | None = None,
) -> DiffResult:
    """Matches the rows of two tables by key and marks every value that differs.

    Equality is exact; a missing value equals a missing value, and NaN counts as one. Types must be identical, or, with
    strict=False, have a common type that holds both without loss. Rows of a key that repeats are paired by content
    ("match"), by their order or by order_by ("number"), or refused ("raise"). Without order_by, order is the one in
    which Spark reads the rows. ignore_columns are left out; keys cannot be.
    """
    if left_name == right_name:
        raise ValueError(f"left_name and right_name must differ, both are {left_name!r}")
    sides = (to_spark(left, left_name, spark), to_spark(right, right_name, spark))
    names = (left_name, right_name)
    keys = (key,) if isinstance(key, str) else tuple(key)
    _check_keys(sides, names, keys)
    order = [] if order_by is None else [order_by] if isinstance(order_by, str) else list(order_by)
    with _as_value_error():
        _check_duplicates(sides, names, keys, duplicates, order)

    ignored = tuple(c for c in dict.fromkeys(ignore_columns) if c not in keys)
    skip = {*keys, *ignored}
    types = tuple({f.name: f.dataType for f in s.schema.fields} for s in sides)
    compared = [c for c in sides[0].columns if c in types[1] and c not in skip]
    only = ([c for c in sides[0].columns if c not in types[1] and c not in skip], [c for c in sides[1].columns if c not in types[0] and c not in skip])
    casts = _casts(types, names, [*keys, *compared], strict)
    for k in keys:
        if is_nested(casts[k] or types[0][k]) and isinstance(casts[k] or types[0][k], T.MapType):
            raise ValueError(f"{k}: a map cannot be a key; use map_entries() of it")

    layout = [Layout(ColumnInfo(k, "key", casts[k] or types[0][k], casts[k] or types[1][k]), f"k{i}", f"k{i}", None) for i, k in enumerate(keys)]
    layout += [Layout(ColumnInfo(c, "compared", types[0][c], types[1][c], 0, casts[c]), f"l{i}", f"r{i}", f"d{i}") for i, c in enumerate(compared)]
    n = len(compared)
    layout += [Layout(ColumnInfo(c, "left_only", types[0][c], None), f"l{n + i}", None, None) for i, c in enumerate(only[0])]
    layout += [Layout(ColumnInfo(c, "right_only", None, types[1][c]), None, f"r{n + i}", None) for i, c in enumerate(only[1])]
    mode = "match" if duplicates == "raise" else duplicates
    with _as_value_error():
        matcher = _Matcher(sides, types, keys, compared, only, casts, order, duplicates)
        matcher.plain()  # errors of the plan show here
    return DiffResult(matcher, layout, spark=sides[0].sparkSession, left_name=left_name, right_name=right_name, ignored=ignored, duplicates=mode)


@contextmanager
def _as_value_error() -> Iterator[None]:
    try:
        yield
    except AnalysisException as error:
        raise ValueError(f"Comparison failed: {error}") from error


class _Matcher:
    """Builds the joined plan, with or without row ids. Columns get names by position, so any input names will do."""

    def __init__(self, sides, types, keys, compared, only, casts, order, duplicates):
        self.sides, self.types, self.keys, self.compared, self.only = sides, types, keys, compared, only
        self.casts, self.order, self.duplicates = casts, order, duplicates
        self.key_names = [f"k{i}" for i in range(len(keys))]
        #: Frames that are persisted until the result lets go of them.
        self.held: list[DataFrame] = []

    def _plain_keys(self) -> list[DataFrame]:
        return [self._side(s, None).select(*self.key_names) for s in (0, 1)]

    @cached_property
    def look(self) -> Row | None:
        """What pairing.look() tells, None where no key repeats: the one early look at the data, which decides the plan."""
        if self.duplicates == "raise":
            return None
        found = pairing.look(*self._plain_keys(), self.key_names)
        return found if found["most"] else None

    @property
    def repeats(self) -> DataFrame:
        """The keys that repeat, with nl, nr and the order of their first rows, lo and ro."""
        return pairing.key_counts(*self._plain_keys(), self.key_names)

    @cached_property
    def _kept_repeats(self) -> DataFrame:
        return self.repeats.persist()

    def _keep(self, frame: DataFrame) -> DataFrame:
        self.held.append(frame)
        return frame

    def _side(self, side: int, ordinal: str | None, frame: DataFrame | None = None) -> DataFrame:
        """Keys, values, presence and order columns of a side."""
        frame = self.sides[side] if frame is None else frame
        own = self.types[side]
        at = {c: f"c{i}" for i, c in enumerate(self.sides[side].columns)}
        rows = frame.toDF(*at.values(), *([ordinal] if frame is not self.sides[side] else []))
        if ordinal and frame is self.sides[side]:
            rows = rows.withColumn(ordinal, F.monotonically_increasing_id())
        mark = "lr"[side]
        keys = [self._key(F.col(at[k]), own[k], self.casts[k]).alias(n) for k, n in zip(self.keys, self.key_names, strict=True)]
        values = [F.col(at[c]).alias(f"{mark}{i}") for i, c in enumerate(self.compared + self.only[side])]
        order = [F.col(at[c]).alias(f"o{i}") for i, c in enumerate(self.order)] if ordinal else []
        return rows.select(*keys, *values, *order, F.lit(True).alias(f"in_{mark}"), *([ordinal] if ordinal else []))

    @staticmethod
    def _key(value, kind: T.DataType, to: T.DataType | None):
        return value.cast(to) if to is not None else value

    def _values(self, rows: DataFrame, side: int) -> DataFrame:
        """rows with v0..: the compared values in comparable form."""
        mark = "lr"[side]
        return rows.select("*", *[comparable(F.col(f"{mark}{i}"), self.types[side][c], self.casts[c]).alias(f"v{i}") for i, c in enumerate(self.compared)])

    def _occurrences(self, left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Both sides with occ, nl and nr; occ is 0 for keys that don't repeat, else unique within the key."""
        keys = self.key_names
        counts = self._kept_repeats.select(*[F.col(k).alias(f"x{k}") for k in keys], "nl", "nr")
        match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"x{k}")) for k in keys])
        left, right = (rows.join(counts, match, "left").drop(*[f"x{k}" for k in keys]) for rows in (left, right))
        repeats = F.col("nl").isNotNull()
        hot = self.look["most"] > pairing.MOST_IN_RUN
        if self.duplicates == "number":
            order = [f"o{i}" for i in range(len(self.order))]
            number = lambda rows, ordinal: pairing.numbered(rows.where(repeats), keys, order, ordinal, "occ", hot).unionByName(rows.where(~repeats).withColumn("occ", F.lit(0).cast("long")))
            return number(left, "lo"), number(right, "ro")
        values = [f"v{i}" for i in range(len(self.compared))]
        of = lambda rows, side, ordinal: self._values(rows.where(repeats), side).select(*keys, *values, ordinal)
        pairs = pairing.matched(of(left, 0, "lo"), of(right, 1, "ro"), keys, values, hot, self._keep)
        pairs = self._keep(settled(pairs))
        left = left.withColumn("occ", F.when(repeats, F.col("lo") + 1).otherwise(F.lit(0).cast("long")))
        partner = pairs.select(F.col("lo").alias("partner"), F.col("ro").alias("of"))
        right = right.join(partner, F.col("ro") == F.col("of"), "left").drop("of")
        occ = F.when(F.col("partner").isNotNull(), F.col("partner") + 1).when(repeats, -1 - F.col("ro")).otherwise(F.lit(0).cast("long"))
        return left, right.withColumn("occ", occ).drop("partner")

    def _few(self) -> bool:
        """Whether every key's rows can be brought together in one task as lists; others take longer ways to the same pairs."""
        return self.look["most"] <= pairing.MOST_IN_RUN and (self.duplicates == "number" or self.look["product"] <= pairing.MOST_FOR_KEY)

    def _tagged(self, left: DataFrame, right: DataFrame, values: bool) -> DataFrame:
        """Rows of both sides with keys, in_l and the ordinal `at`, dealt by key.

        A column that both sides have with one type is one column c0..; of others each side has its own, null in the
        other's rows. values: with v0.., the compared values in comparable form.
        """
        n = len(self.compared)
        kind = [left.schema[f"l{i}"].dataType for i in range(n)], [right.schema[f"r{i}"].dataType for i in range(n)]
        one = [kind[0][i] == kind[1][i] and self.casts[c] is None for i, c in enumerate(self.compared)]
        sides = []
        for side, (rows, mark) in enumerate(((left, "l"), (right, "r"))):
            other = (right, left)[side]
            columns = [F.col(f"{mark}{i}").alias(f"c{i}") for i in range(n) if one[i]]
            for m, frame in (("l", left), ("r", right)):
                for i in range(n + len(self.only[0 if m == "l" else 1])):
                    if i >= n or not one[i]:
                        columns.append(F.col(f"{m}{i}") if frame is rows else F.lit(None).cast(frame.schema[f"{m}{i}"].dataType).alias(f"{m}{i}"))
            for i, c in enumerate(self.order):
                if not (c in self.keys or (c in self.compared and one[self.compared.index(c)])):
                    columns += [F.col(f"o{i}").alias(f"o{mark}{i}"), F.lit(None).cast(other.schema[f"o{i}"].dataType).alias(f"o{'rl'[side]}{i}")]
            sides.append(rows.select(*self.key_names, *columns, F.lit(side == 0).alias("in_l"), F.col(f"{mark}o").alias("at")))
        both = sides[0].unionByName(sides[1]).repartition(*self.key_names)
        if not values:
            return both
        own = lambda i, m, s: comparable(F.col(f"c{i}" if one[i] else f"{m}{i}"), self.types[s][self.compared[i]], self.casts[self.compared[i]])
        return both.select("*", *[(own(i, "l", 0) if one[i] else F.when(F.col("in_l"), own(i, "l", 0)).otherwise(own(i, "r", 1))).alias(f"v{i}") for i in range(n)])

    def _together(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Both sides brought together where no key has many rows: they are dealt by key once, and all else is in their task."""
        keys, n = self.key_names, len(self.compared)
        match = self.duplicates == "match"
        both = self._tagged(left, right, match)
        values = [f"v{i}" for i in range(n)] if match else []
        has = set(both.columns)
        order = []
        for i, c in enumerate([] if match else self.order):
            if c not in self.keys:
                order += [F.col(x).asc_nulls_last() for x in ([f"ol{i}", f"or{i}"] if f"ol{i}" in has else [f"c{self.compared.index(c)}"])]
        in_l, at = F.col("in_l"), F.col("at")
        # one sort serves all windows: each partitions by the first of its columns, and counts by the places the one before gave
        nth = F.row_number().over(Window.partitionBy(*keys, *values, "in_l").orderBy(*order, "at")).cast("long")
        both = both.withColumn("nth", nth)
        most = lambda side, by: F.coalesce(F.max(F.when(side, F.col("nth"))).over(Window.partitionBy(*by)), F.lit(0))
        zero, tiny = F.lit(0).cast("long"), lambda k: F.lit(k).cast("byte")
        if match:
            of = [*keys, *values]
            both = both.select("*", F.least(most(in_l, of), most(~in_l, of)).alias("equal"), F.min(F.when(in_l, at)).over(Window.partitionBy(*of)).alias("first"))
            key = Window.partitionBy(*keys)
            over = F.col("nth") > F.col("equal")
            count = lambda test: F.coalesce(F.sum(F.when(test & (F.col("equal") >= 0), 1).otherwise(0).cast("long")).over(key), zero)
            both = both.select("*", count(in_l).alias("nl"), count(~in_l).alias("nr"), count(in_l & over).alias("a"), count(~in_l & over).alias("b"))
            left_over = (F.col("a") > 0) & (F.col("b") > 0)
            # which rows come together: equal ones by their value's first row and place, all that both sides of a key have left, others alone
            p = F.when(~over, F.col("first")).when(left_over, zero).otherwise(at)
            q = F.when(over, zero).otherwise(F.col("nth"))
            group = F.when(~over, tiny(0)).when(left_over, tiny(3)).when(in_l, tiny(1)).otherwise(tiny(2))
            both = both.withColumns({"p": p, "q": q, "group": group})
        else:
            both = both.select("*", most(in_l, keys).alias("nl"), most(~in_l, keys).alias("nr"), F.col("nth").alias("p"), zero.alias("q"), tiny(0).alias("group"))
        own = lambda m, k: [(F.col(f"{m}{i}") if f"{m}{i}" in has else F.col(f"c{i}")).alias(f"{m}{i}") for i in range(n + len(self.only[k]))]
        row = F.struct(*own("l", 0), at.alias("lo"), *values), F.struct(*own("r", 1), at.alias("ro"), *values)
        by = [*keys, "group", "p", "q"]
        if match:
            lists = both.groupBy(*by).agg(F.max("nl").alias("nl"), F.max("nr").alias("nr"), F.collect_list(F.when(in_l, row[0])).alias("a"), F.collect_list(F.when(~in_l, row[1])).alias("b"))
            a, b = F.col("a"), F.col("b")
            lists = lists.withColumn("done", F.when(F.col("group") == 3, pairing.alike(a, b, "lo", "ro", values)))
            done = F.col("done")
            pair = lambda x, y: F.struct(x.alias("l"), y.alias("r"))
            none = [F.lit(None).cast(lists.schema[c].dataType.elementType) for c in "ab"]
            alone = F.when(F.size(a) > F.size(b), F.transform(F.filter(a, lambda x: ~F.exists(done, lambda d: d["lo"] == x["lo"])), lambda x: pair(x, none[1]))).otherwise(
                F.transform(F.filter(b, lambda x: ~F.exists(done, lambda d: d["ro"] == x["ro"])), lambda x: pair(none[0], x)))
            found = F.when(F.col("group") == 3, F.concat(F.transform(done, lambda d: pair(F.get(a, d["i"]), F.get(b, d["j"]))), alone)).otherwise(F.array(pair(F.get(a, F.lit(0)), F.get(b, F.lit(0)))))
            out = lists.select(*keys, "nl", "nr", F.inline(found))
        else:
            side = lambda test, x: F.first(F.when(test, x), ignorenulls=True)
            out = both.groupBy(*by).agg(F.max("nl").alias("nl"), F.max("nr").alias("nr"), side(in_l, row[0]).alias("l"), side(~in_l, row[1]).alias("r"))
        fields = lambda s: [F.col(f"{s}.{f}").alias(f) for f in out.schema[s].dataType.names if f not in values]
        return out.select(*keys, "nl", "nr", F.col("l").isNotNull().alias("in_l"), F.col("r").isNotNull().alias("in_r"), *fields("l"), *fields("r"))

    def status_counts(self) -> Row | None:
        """Rows of each status without pairing them: equal ones are the fewer of a value's copies, the others follow from the rows of a key."""
        if self.look is None or self.duplicates != "match":
            return None
        keys, values = self.key_names, [f"v{i}" for i in range(len(self.compared))]
        sides = [self._values(self._side(s, None), s).select(*keys, *values, F.lit(s == 0).alias("in_l")) for s in (0, 1)]
        both = sides[0].unionByName(sides[1])
        if self.look["most"] <= pairing.MOST_IN_RUN:
            both = both.repartition(*keys)
        copies = both.groupBy(*keys, *values).agg(F.count_if("in_l").alias("l"), F.count_if(~F.col("in_l")).alias("r"))
        each = copies.groupBy(*keys).agg(F.sum(F.least("l", "r")).alias("e"), F.sum("l").alias("l"), F.sum("r").alias("r"))
        total = lambda x, name: F.coalesce(F.sum(x), F.lit(0)).alias(name)
        l, r = F.col("l"), F.col("r")
        return each.agg(total(F.col("e"), "equal"), total(F.least(l, r) - F.col("e"), "mismatch"), total(F.greatest(r - l, F.lit(0)), "missing_left"), total(F.greatest(l - r, F.lit(0)), "missing_right")).first()

    def joined(self, numbered: bool, ordinals: bool = False) -> DataFrame:
        """One row per pair or single row. numbered: with row_id. ordinals: with lo and ro, whose order is that of row_id."""
        ordinal = numbered or ordinals or self.look is not None
        sizes = (0, 0)
        if numbered:
            found = [ordered(s, n) for s, n in zip(self.sides, ("lo", "ro"), strict=True)]
            left, right = (self._side(k, n, found[k][0]) for k, n in ((0, "lo"), (1, "ro")))
            sizes = tuple(x[1] for x in found)
            self.held += [x[2] for x in found]
        else:
            left, right = (self._side(s, n if ordinal else None) for s, n in ((0, "lo"), (1, "ro")))
        keys, extra = list(self.key_names), []
        if self.look is not None:
            if self._few():
                both = self._together(left, right)
                return self._finished(both, ["nl", "nr"], self.key_names, numbered, ordinals, sizes)
            if not numbered:
                left, right = (self._keep(settled(x)) for x in (left, right))  # ordinals must not change between uses
            left, right = self._occurrences(left, right)
            keys.append("occ")
            extra = [F.coalesce(n, f"r_{n}").alias(n) for n in ("nl", "nr")]
        return self._finished(self._full_join(left, right, keys), extra, [F.coalesce(k, f"r_{k}").alias(k) for k in self.key_names], numbered, ordinals, sizes)

    def plain(self) -> DataFrame:
        """joined() as if no key repeated."""
        left, right = (self._side(s, None) for s in (0, 1))
        return self._finished(self._full_join(left, right, self.key_names), [], [F.coalesce(k, f"r_{k}").alias(k) for k in self.key_names], False, False, (0, 0))

    @staticmethod
    def _full_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        shared = [c for c in right.columns if c in left.columns]
        right = right.withColumnsRenamed({c: f"r_{c}" for c in shared})
        return left.join(right, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys]), "full_outer")

    def _finished(self, both: DataFrame, extra: list, key_columns: list, numbered: bool, ordinals: bool, sizes: tuple[int, int]) -> DataFrame:
        """Flags and status of rows that have been brought together."""
        values = [f"l{i}" for i in range(len(self.compared + self.only[0]))] + [f"r{i}" for i in range(len(self.compared + self.only[1]))]
        in_l, in_r = F.coalesce("in_l", F.lit(False)), F.coalesce("in_r", F.lit(False))
        flags = []
        for i, c in enumerate(self.compared):
            l, r = (comparable(F.col(f"{m}{i}"), self.types[s][c], self.casts[c]) for s, m in ((0, "l"), (1, "r")))
            flags.append((in_l & in_r & differs(l, r)).alias(f"d{i}"))
        out = both.select(*key_columns, *values, *extra, in_l.alias("in_l"), in_r.alias("in_r"), *flags, *(["lo", "ro"] if numbered or ordinals else []))
        any_flag = F.lit(False)
        for i in range(len(self.compared)):
            any_flag = any_flag | F.col(f"d{i}")
        status = F.when(~F.col("in_r"), 2).when(~F.col("in_l"), 3).when(any_flag, 1).otherwise(0).cast("tinyint").alias("status")
        out = out.select("*", status).drop("in_l", "in_r")
        return self._with_ids(out, *sizes) if numbered else out

    def _with_ids(self, rows: DataFrame, left: int, right: int) -> DataFrame:
        """row_id: the left ordinal; after them, the rank of the right ordinal among rows that only the right side has.

        Rows are laid out by it, so that a page is found in few cached batches: dealt by ranges of left ordinals and, behind
        them, of right ones, and sorted there. Left ordinals are dense, so only right rows need counting.
        """
        parts = max(1, min(MOST_PARTITIONS, -(-(left + right) // LAYOUT_ROWS)))
        width = max(1, -(-(left + right) // parts))
        rows = rows.withColumn("place", F.coalesce("lo", F.lit(left) + F.col("ro"))).withColumn("range", F.floor(F.col("place") / width))
        rows = self._keep(settled(rows.repartition(parts, "range").sortWithinPartitions("range", "place")))
        starts, at = [], 0
        for k, n in sorted(map(tuple, rows.where("lo is null").groupBy("range").count().collect())):  # MOST_PARTITIONS rows at most
            starts.append((k, at))
            at += n
        starts = F.broadcast(rows.sparkSession.createDataFrame(starts or [(-1, 0)], "r long, start long"))
        before = F.greatest(F.lit(0), F.least(F.lit(left), (F.col("range") + 1) * width) - F.col("range") * width)  # left rows of the range
        nth = F.row_number().over(Window.partitionBy("range").orderBy("place")) - 1
        rows = rows.withColumn("nth", nth).join(starts, F.col("range") == F.col("r"), "left")
        row_id = F.coalesce("lo", F.lit(left) + F.col("start") + F.col("nth") - before)
        return rows.withColumn("row_id", row_id.cast("long")).drop("lo", "ro", "place", "range", "nth", "r", "start")

    def release(self) -> None:
        for frame in self.held:
            frame.unpersist()
        self.held = []

    def release_repeats(self) -> None:
        if "_kept_repeats" in self.__dict__:
            self._kept_repeats.unpersist()
            del self._kept_repeats


def _check_keys(sides, names, keys) -> None:
    if not keys:
        raise ValueError("Specify at least one key column.")
    if len(set(keys)) != len(keys):
        raise ValueError(f"Key columns must be distinct, got {list(keys)}.")
    for frame, name in zip(sides, names, strict=True):
        if missing := [k for k in keys if k not in frame.columns]:
            raise ValueError(f"Key column(s) {missing} missing in {name}.")
        if again := sorted({c for c in frame.columns if frame.columns.count(c) > 1}):
            raise ValueError(f"{name}: more than one column named {again}")
        if taken := [c for c in frame.columns if c.startswith(RESERVED)]:
            raise ValueError(f"{name}: column names starting with {RESERVED!r} are reserved: {taken}")


def _check_duplicates(sides, names, keys, duplicates, order) -> None:
    if duplicates not in MODES:
        raise ValueError(f"duplicates must be 'match', 'number' or 'raise', got {duplicates!r}")
    for frame, name in zip(sides, names, strict=True):
        if duplicates == "raise":
            _check_unique(frame, name, keys)
        if missing := [c for c in order if c not in frame.columns]:
            raise ValueError(f"order_by column(s) {missing} missing in {name}.")


def _check_unique(frame: DataFrame, name: str, keys: tuple[str, ...]) -> None:
    at = [frame.columns.index(k) for k in keys]
    rows = frame.toDF(*[f"c{i}" for i in range(len(frame.columns))])
    again = rows.groupBy(*[f"c{i}" for i in at]).agg(F.count("*").alias("n")).where("n > 1")
    if examples := again.limit(3).collect():
        many = again.agg(F.sum("n")).first()[0]
        said = ", ".join(str(tuple(r)[:-1] if len(keys) > 1 else r[0]) for r in examples)
        raise ValueError(f"{name}: {many} rows share a key {list(keys)} (e.g. {said})")


def _casts(types, names, columns, strict) -> dict[str, T.DataType | None]:
    """The common type of each column, None where both are the same. One error lists every column that has none."""
    casts, problems = {}, []
    for c in columns:
        l, r = types[0][c], types[1][c]
        try:
            casts[c] = common_type(l, r)
            if strict and casts[c] is not None:
                problems.append(f"{c}: {type_name(l)} in {names[0]}, {type_name(r)} in {names[1]} - {cast_hint(l, r).replace('"c"', repr(c))}, or pass strict=False to align it")
        except DtypeMismatchError as error:
            problems.append(f"{c}: {type_name(l)} in {names[0]}, {type_name(r)} in {names[1]} - {error.hint.replace('"c"', repr(c))}")
    if problems:
        raise ValueError("Columns have different dtypes; cast one side first:\n" + "\n".join(f"  {p}" for p in problems))
    return casts
