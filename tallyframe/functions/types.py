"""Which types can be compared: identical ones, and others that a third one holds without loss."""

from __future__ import annotations

from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOAT = (T.FloatType, T.DoubleType)
#: Digits a decimal can have.
MOST_DIGITS = 38


class DtypeMismatchError(ValueError):
    """Two types that no common type holds without loss; hint says how to cast one side."""

    def __init__(self, left: T.DataType, right: T.DataType, hint: str):
        super().__init__(f"{type_name(left)} and {type_name(right)} cannot be compared: {hint}")
        self.left, self.right, self.hint = left, right, hint


def type_name(kind: T.DataType | None) -> str:
    return "" if kind is None else kind.simpleString()


def is_text(kind: T.DataType) -> bool:
    """Text of any kind: strings of any collation, char and varchar."""
    return isinstance(kind, (T.StringType, T.CharType, T.VarcharType))


def is_float(kind: T.DataType | None) -> bool:
    return isinstance(kind, _FLOAT)


def is_nested(kind: T.DataType | None) -> bool:
    return isinstance(kind, (T.ArrayType, T.StructType, T.MapType))


def is_numeric(kind: T.DataType | None) -> bool:
    return isinstance(kind, T.NumericType)


def filter_type(kind: T.DataType | None) -> str:
    """boolean, number, datetime or string: which filters a column has."""
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if is_numeric(kind):
        return "number"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "string"


def incomparable(kind: T.DataType) -> str | None:
    """Why a type cannot be compared at all, with what to do; None if it can."""
    if isinstance(kind, T.CalendarIntervalType):
        return "calendar intervals have no equality; use a day-time or year-month interval"
    if isinstance(kind, T.VariantType):
        return "variants have no equality; compare to_json() of them"
    inner = (kind.elementType,) if isinstance(kind, T.ArrayType) else (kind.keyType, kind.valueType) if isinstance(kind, T.MapType) else tuple(f.dataType for f in kind.fields) if isinstance(kind, T.StructType) else ()
    for part in inner:
        if isinstance(part, T.MapType):
            return "maps inside other values have no equality; use map_entries() of them"
        if why := incomparable(part):
            return why
    return None


def common_type(left: T.DataType, right: T.DataType) -> T.DataType | None:
    """None for identical types, else the type that holds both without loss. Symmetric. Raises DtypeMismatchError."""
    for side in (left, right):
        if why := incomparable(side):
            raise DtypeMismatchError(left, right, why)
    if is_text(left) and is_text(right):
        plain = isinstance(left, T.StringType) and isinstance(right, T.StringType) and left == right and type_name(left) == "string"
        return None if plain else T.StringType()
    if _bare(left) == _bare(right):
        return None
    if isinstance(left, T.NullType):
        return right
    if isinstance(right, T.NullType):
        return left
    for family in (_WHOLE, _FLOAT):
        if isinstance(left, family) and isinstance(right, family):
            return max((left, right), key=lambda t: family.index(type(t)))
    if isinstance(left, T.DecimalType) and isinstance(right, T.DecimalType):
        scale = max(left.scale, right.scale)
        digits = scale + max(left.precision - left.scale, right.precision - right.scale)
        if digits <= MOST_DIGITS:
            return T.DecimalType(digits, scale)
    for family in (T.DayTimeIntervalType, T.YearMonthIntervalType):
        if isinstance(left, family) and isinstance(right, family):
            return family(min(left.startField, right.startField), max(left.endField, right.endField))
    raise DtypeMismatchError(left, right, cast_hint(left, right))


def _bare(kind: T.DataType):
    """A type without what does not bear on equality: whether values may be null, and metadata."""
    if isinstance(kind, T.ArrayType):
        return "array", _bare(kind.elementType)
    if isinstance(kind, T.MapType):
        return "map", _bare(kind.keyType), _bare(kind.valueType)
    if isinstance(kind, T.StructType):
        return "struct", tuple((f.name, _bare(f.dataType)) for f in kind.fields)
    return kind


def cast_hint(left: T.DataType, right: T.DataType) -> str:
    """How to cast one side, as code."""
    kinds = {type(left), type(right)}
    if kinds == {T.TimestampType, T.TimestampNTZType}:
        return 'F.to_utc_timestamp(F.col("c"), zone).cast("timestamp_ntz") on the side with a time zone'
    if T.DateType in kinds and kinds & {T.TimestampType, T.TimestampNTZType}:
        return 'F.to_date("c") on the side with a time of day'
    to = right if isinstance(left, T.StringType) else left if isinstance(right, T.StringType) else _wider(left, right)
    return f'F.col("c").cast("{type_name(to)}")'


def _wider(left: T.DataType, right: T.DataType) -> T.DataType:
    return left if is_float(left) or isinstance(left, T.DecimalType) else right
