"""The result of a comparison: counts, columns and tables, all computed on demand."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from enum import StrEnum
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import filter_type, type_name
from ..functions.values import as_text


class Status(StrEnum):
    """What became of a row, in display order."""

    EQUAL = "equal"
    MISMATCH = "mismatch"
    MISSING_RIGHT = "missing_right"
    MISSING_LEFT = "missing_left"


STATUS_ORDER = tuple(Status)


@dataclass(frozen=True, slots=True)
class Summary:
    """Counts of rows and repeated keys. missing_right: rows that only the left side has."""

    equal: int
    mismatch: int
    missing_left: int
    missing_right: int
    left_rows: int
    right_rows: int
    duplicate_keys_left: int = 0
    duplicate_keys_right: int = 0
    duplicates: str = "match"

    @property
    def found(self) -> int:
        return self.equal + self.mismatch

    @property
    def not_found(self) -> int:
        return self.missing_left + self.missing_right

    @property
    def total(self) -> int:
        return self.found + self.not_found


@dataclass(frozen=True, slots=True)
class ColumnInfo:
    """A column of the result. kind: key, compared, left_only or right_only."""

    name: str
    kind: str
    dtype_left: T.DataType | None
    dtype_right: T.DataType | None
    mismatches: int = 0
    compare_dtype: T.DataType | None = None

    @property
    def dtype(self) -> T.DataType:
        return self.compare_dtype or self.dtype_left or self.dtype_right

    @property
    def filter_type(self) -> str:
        return filter_type(self.dtype)


@dataclass(frozen=True, slots=True)
class Layout:
    """A column of the result with the columns of the joined frame that hold it."""

    info: ColumnInfo
    left: str | None
    right: str | None
    flag: str | None


def status_code(status: Status | str) -> int:
    return STATUS_ORDER.index(Status(status))


def status_name(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s.value) for s in STATUS_ORDER]), code.cast("int") + 1)


class DiffResult:
    """Two tables matched by key.

    joined is the plan of the comparison, made when first asked for: one row per pair or single row, in no order: key columns k0.., values l0.. and
    r0.., flags d0.., status (a code in display order), and nl, nr, the rows of the key on each side, where a key repeats.
    Counts run it once. numbered() adds row ids, placed() what orders rows as these do.
    """

    def __init__(self, matcher, layout: Sequence[Layout], *, spark: SparkSession, left_name: str, right_name: str, ignored: Sequence[str], duplicates: str):
        self._matcher, self.layout, self.spark = matcher, tuple(layout), spark
        self.left_name, self.right_name, self.ignored = left_name, right_name, tuple(ignored)
        self._mode = duplicates

    def __repr__(self) -> str:
        s = self.summary
        return f"DiffResult(keys={list(self.keys)}, " + ", ".join(f"{n}={getattr(s, n)}" for n in ("equal", "mismatch", "missing_left", "missing_right")) + ")"

    @cached_property
    def joined(self) -> DataFrame:
        return self._matcher.joined(False)

    @cached_property
    def _counts(self) -> dict[str, int]:
        by_status = [F.count_if(F.col("status") == k).alias(s.value) for k, s in enumerate(STATUS_ORDER)]
        by_column = [F.count_if(x.flag).alias(x.flag) for x in self.layout if x.flag]
        return self.joined.agg(*by_status, *by_column).first().asDict()

    @cached_property
    def summary(self) -> Summary:
        n = self._counts if "_counts" in self.__dict__ else self._matcher.status_counts() or self._counts
        look = self._matcher.look
        repeats = (look["many_l"], look["many_r"]) if look else (0, 0)
        both = n["equal"] + n["mismatch"]
        return Summary(n["equal"], n["mismatch"], n["missing_left"], n["missing_right"], both + n["missing_right"], both + n["missing_left"], *repeats, self._mode)

    @cached_property
    def columns(self) -> tuple[ColumnInfo, ...]:
        out = []
        for x in self.layout:
            i = x.info
            out.append(ColumnInfo(i.name, i.kind, i.dtype_left, i.dtype_right, self._counts[x.flag], i.compare_dtype) if x.flag else i)
        return tuple(out)

    @property
    def keys(self) -> tuple[str, ...]:
        return tuple(x.info.name for x in self.layout if x.info.kind == "key")

    @property
    def compared(self) -> tuple[str, ...]:
        return tuple(x.info.name for x in self.layout if x.info.kind == "compared")

    @property
    def has_duplicates(self) -> bool:
        return self._matcher.look is not None

    @cached_property
    def duplicate_rows(self) -> int:
        # every row of the side that has fewer of the key's is paired
        return self._matcher.look["many"] if self.has_duplicates else 0

    def repeated(self) -> Column:
        """Whether a row's key repeats on a side."""
        return (F.coalesce("nl", F.lit(0)) > 1) | (F.coalesce("nr", F.lit(0)) > 1) if self.has_duplicates else F.lit(False)

    @property
    def duplicates(self) -> DataFrame:
        """Keys that repeat, with their rows on each side, in the order in which the result has them."""
        names = self._distinct([*self.keys, self.left_name, self.right_name])
        keys = [x.left for x in self.layout if x.info.kind == "key"]
        return self._matcher.repeats.orderBy(F.col("lo").asc_nulls_last(), "ro").select(*keys, "nl", "nr").toDF(*names)

    def side_label(self, name: str, side: str) -> str:
        return f"{name} [{self.left_name if side == 'l' else self.right_name}]"

    @cached_property
    def _numbered(self) -> DataFrame:
        rows = self._matcher.joined(True).persist()
        rows.count()
        if not self.has_duplicates:
            self._matcher.release()  # what numbering kept; where keys repeat, joined still reads it
        return rows

    def numbered(self) -> DataFrame:
        """joined with row_id: rows with a left side in its order from 0, then the others in the right side's. Persisted."""
        return self._numbered

    def placed(self) -> DataFrame:
        """joined with what orders its rows by row_id: numbered() if that is there, else with ordinals lo and ro, without ids."""
        return self._numbered if "_numbered" in self.__dict__ else self._matcher.joined(False, ordinals=True)

    def unpersist(self) -> None:
        """Lets go of everything that is kept for this result; asked again, it is made again."""
        self._matcher.release()
        self._matcher.release_repeats()
        for name in ("_numbered", "joined"):
            if name in self.__dict__:
                if name == "_numbered":
                    self._numbered.unpersist()
                del self.__dict__[name]

    @staticmethod
    def _distinct(names: list[str]) -> list[str]:
        if again := sorted({n for n in names if names.count(n) > 1}):
            raise ValueError(f"the table would have more than one column named {again}; rename a column or a side")
        return names

    def _wide(self, rows: DataFrame) -> DataFrame:
        keys = [x for x in self.layout if x.info.kind == "key"]
        differing = F.array_compact(F.array(*[F.when(F.col(x.flag), F.lit(x.info.name)) for x in self.layout if x.flag]).cast("array<string>"))
        values, names = [], [*(x.info.name for x in keys), "status", "differing"]
        for x in self.layout:
            if x.info.kind != "key":
                for column, side in ((x.left, "l"), (x.right, "r")):
                    if column:
                        values.append(F.col(column))
                        names.append(self.side_label(x.info.name, side))
        return rows.select(*[F.col(x.left) for x in keys], status_name(F.col("status")), differing, *values).toDF(*self._distinct(names))

    def frame(self, status: Status | str | Iterable[Status | str] | None = None, *, rows: Sequence[int] | None = None) -> DataFrame:
        """Keys, status, names of differing columns and both values of every column, one row per pair or single row.

        status keeps rows of this status or these. rows keeps these row ids, in this order, repeated as they are.
        """
        data = self.joined
        if rows is not None:
            data = self._picked(list(rows))
        if status is not None:
            wanted = [status] if isinstance(status, str) else list(status)
            data = data.where(F.col("status").isin([status_code(s) for s in wanted]))
        return self._wide(data.orderBy("at") if rows is not None else data)

    def _picked(self, ids: list[int]) -> DataFrame:
        total = self.summary.total
        if outside := [i for i in ids if not 0 <= i < total]:
            raise IndexError(f"row ids outside 0..{total - 1}: {outside[:3]}")
        asked = self.spark.createDataFrame([(k, int(i)) for k, i in enumerate(ids)], "at long, row_id long")
        return self.numbered().join(asked, "row_id")

    def mismatches(self) -> DataFrame:
        """Keys, column, and both values as text: one row per differing value, in one pass over the result."""
        keys = [x for x in self.layout if x.info.kind == "key"]
        names = self._distinct([*(x.info.name for x in keys), "column", self.left_name, self.right_name])
        cells = [
            F.when(F.col(x.flag), F.struct(F.lit(x.info.name).alias("c"), as_text(F.col(x.left), x.info.dtype_left).alias("l"), as_text(F.col(x.right), x.info.dtype_right).alias("r")))
            for x in self.layout
            if x.flag
        ]
        cells = F.array_compact(F.array(*cells)) if cells else F.array().cast("array<struct<c:string,l:string,r:string>>")
        return self.joined.where(F.col("status") == status_code("mismatch")).select(*[x.left for x in keys], F.inline(cells)).toDF(*names)

    def column_stats(self) -> DataFrame:
        """Types and share of equal and differing values of each compared column, most differences first."""
        found = self.summary.found
        rows = [
            (c.name, type_name(c.dtype_left), type_name(c.dtype_right), c.mismatches, (found - c.mismatches) / found if found else None, c.mismatches / found if found else None)
            for c in self.columns
            if c.kind == "compared"
        ]
        rows.sort(key=lambda r: -r[3])
        return self.spark.createDataFrame(rows, "column string, dtype_left string, dtype_right string, mismatches long, equal_share double, mismatch_share double")
