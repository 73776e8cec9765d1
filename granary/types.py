"""The eight types, their Spark forms, casts between them, truth and text forms.

Every conversion is an expression of built-in functions, chosen by the static type, so
nothing leaves generated code. Casts that the matrix below doesn't have are refused
when a statement is bound.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import BindError

NULL, BOOLEAN, INTEGER, BIGINT, DOUBLE, TIMESTAMP, TEXT, BYTEA = "null", "boolean", "integer", "bigint", "double precision", "timestamp", "text", "bytea"
NUMERIC = (INTEGER, BIGINT, DOUBLE)
INTEGRAL = (INTEGER, BIGINT)

SPARK: dict[str, T.DataType] = {
    NULL: T.NullType(),
    BOOLEAN: T.BooleanType(),
    INTEGER: T.IntegerType(),
    BIGINT: T.LongType(),
    DOUBLE: T.DoubleType(),
    TIMESTAMP: T.TimestampNTZType(),
    TEXT: T.StringType(),
    BYTEA: T.BinaryType(),
}

_MISSING = object()


@dataclass(frozen=True)
class Value:
    """A bound expression: a column, its type, and what is known of it.

    ``predicate`` is a form that may give NULL for false, good where only true rows
    count, and simple enough to reach the scan; ``raises`` tells that evaluation can fail.
    """

    column: Column
    type: str
    constant: object = _MISSING
    nullable: bool = True
    predicate: Column | None = None
    falsified: Column | None = None
    raises: bool = False
    name: str | None = None  # of a bare column

    @property
    def is_constant(self) -> bool:
        return self.constant is not _MISSING


def of_spark(kind: T.DataType) -> str | None:
    """Our type for a Spark type; None if the dialect has none."""
    if isinstance(kind, T.BooleanType):
        return BOOLEAN
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return INTEGER
    if isinstance(kind, T.LongType):
        return BIGINT
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return DOUBLE
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return TIMESTAMP
    if isinstance(kind, T.StringType):
        return TEXT
    if isinstance(kind, T.BinaryType):
        return BYTEA
    return NULL if isinstance(kind, T.NullType) else None


def of_python(value: object) -> str:
    if value is None:
        return NULL
    if isinstance(value, bool):
        return BOOLEAN
    if isinstance(value, int):
        return INTEGER if -(1 << 31) <= value < 1 << 31 else BIGINT
    if isinstance(value, float):
        return DOUBLE
    if isinstance(value, str):
        return TEXT
    if isinstance(value, (bytes, bytearray)):
        return BYTEA
    if isinstance(value, datetime):
        return TIMESTAMP
    raise BindError(f"no type for {type(value).__name__}")


def literal(value: object, kind: str | None = None) -> Value:
    kind = kind or of_python(value)
    column = F.lit(bytes(value) if isinstance(value, bytearray) else value)
    if isinstance(value, datetime) and value.tzinfo is not None:
        raise BindError("a timestamp parameter has no time zone")
    return Value(column.cast(SPARK[kind]) if kind != NULL else F.lit(None), kind, value, value is None)


def null(kind: str = NULL) -> Value:
    return Value(F.lit(None).cast(SPARK[kind]), kind, None)


def text_of_double(x: Column) -> Column:
    """Shortest digits: plain between 1e-6 and 1e15, else with an exponent of two digits at least; no trailing ``.0``."""
    s = x.cast("string")
    plain = F.regexp_replace(s, r"\.0$", "")
    spread = F.regexp_replace(x.cast("decimal(38,23)").cast("string"), r"\.?0+$", "")
    digits = F.regexp_replace(F.regexp_extract(s, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    exponent = F.regexp_extract(s, r"E(-?[0-9]+)$", 1)
    sign = F.when(exponent.startswith("-"), "-").otherwise("+")
    bare = F.regexp_replace(exponent, "^-", "")
    far = F.concat(digits, F.lit("e"), sign, F.when(F.length(bare) < 2, F.lpad(bare, 2, "0")).otherwise(bare))
    near = (F.abs(x) >= 1e-6) & (F.abs(x) < 1e15)
    return F.when(~s.contains("E"), plain).when(near, spread).otherwise(far)


def text_of_timestamp(x: Column) -> Column:
    return F.concat(F.regexp_replace(x.cast("string"), " ", "T"), F.lit("Z"))



def _boolean_of_text(x: Column) -> Column:
    low = F.lower(x)
    bad = F.raise_error(F.concat(F.lit('invalid input syntax for type boolean: "'), x, F.lit('"')))
    return F.when(low.isin("1", "t", "true", "y", "yes", "on"), True).when(low.isin("0", "f", "false", "n", "no", "off"), False).when(x.isNull(), None).otherwise(bad.cast("boolean"))


def _timestamp_of_text(x: Column) -> Column:
    """ISO forms and bare years; with an offset, the moment in UTC."""
    return F.when(x.rlike(r"(?:Z|[+-]\d\d:?\d\d)$") & x.contains(":"), x.cast("timestamp").cast("timestamp_ntz")).otherwise(x.cast("timestamp_ntz"))


#: (from, to): expression, and whether it can fail. Equal types and NULL need no entry.
_CASTS = {
    (BOOLEAN, INTEGER): (lambda x: x.cast("int"), False),
    (BOOLEAN, TEXT): (lambda x: x.cast("string"), False),
    (INTEGER, BOOLEAN): (lambda x: x != 0, False),
    (INTEGER, BIGINT): (lambda x: x.cast("bigint"), False),
    (INTEGER, DOUBLE): (lambda x: x.cast("double"), False),
    (INTEGER, TEXT): (lambda x: x.cast("string"), False),
    (BIGINT, BOOLEAN): (lambda x: x != 0, False),
    (BIGINT, INTEGER): (lambda x: x.cast("int"), True),
    (BIGINT, DOUBLE): (lambda x: x.cast("double"), False),
    (BIGINT, TEXT): (lambda x: x.cast("string"), False),
    (DOUBLE, INTEGER): (lambda x: x.cast("int"), True),
    (DOUBLE, BIGINT): (lambda x: x.cast("bigint"), True),
    (DOUBLE, TEXT): (text_of_double, False),
    (TIMESTAMP, TEXT): (text_of_timestamp, False),
    (TEXT, BOOLEAN): (_boolean_of_text, True),
    (TEXT, INTEGER): (lambda x: F.coalesce(x.try_cast("int"), x.cast("double").cast("int")), True),
    (TEXT, BIGINT): (lambda x: F.coalesce(x.try_cast("bigint"), x.cast("double").cast("bigint")), True),
    (TEXT, DOUBLE): (lambda x: x.cast("double"), True),
    (TEXT, TIMESTAMP): (_timestamp_of_text, True),
    (TEXT, BYTEA): (lambda x: F.unbase64(x), True),
    (BYTEA, TEXT): (lambda x: F.base64(x), False),
}


def cast(v: Value, to: str) -> Value:
    """``v`` as another type, or an error if the matrix has no such cast."""
    if v.type == to:
        return v
    if v.type == NULL:
        return null(to)
    found = _CASTS.get((v.type, to))
    if found is None:
        raise BindError(f'cannot cast "{v.type}" as "{to}"')
    make, fails = found
    if v.type == TEXT and isinstance(v.constant, str):
        checked(v.constant, to)
    constant = float(v.constant) if to == DOUBLE and isinstance(v.constant, int) else v.constant if to == BIGINT and isinstance(v.constant, int) else _MISSING
    return Value(make(v.column), to, constant, v.nullable, raises=v.raises or fails and not v.is_constant)


def checked(text: str, to: str) -> None:
    """Refuses, when bound, a literal that is no value of the type."""
    fine = {
        INTEGER: lambda: -(1 << 31) <= int(float(text)) < 1 << 31,
        BIGINT: lambda: abs(float(text)) <= float(1 << 63),
        DOUBLE: lambda: float(text) is not None,
        BOOLEAN: lambda: text.lower() in ("1", "t", "true", "y", "yes", "on", "0", "f", "false", "n", "no", "off"),
        TIMESTAMP: lambda: bool(re.fullmatch(r"\s*[+-]?\d{4,6}(-\d{1,2}(-\d{1,2}([ T]\d{1,2}(:\d{1,2}(:\d{1,2}(\.\d{1,9})?)?)?\s*(Z|[A-Z]{2,4}|[+-]\d\d:?\d\d)?)?)?)?\s*", text)),
        BYTEA: lambda: bool(re.fullmatch(r"(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?", text)),
    }.get(to)
    try:
        if fine is None or fine():
            return
    except (ValueError, OverflowError):
        pass
    raise BindError(f"invalid input syntax for type {to}: {text!r}")


def truth(v: Value) -> Column:
    """Two-valued truth of a value of any type: 0, '', false and NULL are false."""
    c = v.column
    if v.type == BOOLEAN:
        return F.coalesce(c, F.lit(False)) if v.nullable else c
    if v.type in NUMERIC:
        return F.coalesce(c != 0, F.lit(False)) if v.nullable else c != 0
    if v.type == TEXT:
        return F.coalesce(c != "", F.lit(False)) if v.nullable else c != ""
    if v.type == BYTEA:
        return F.coalesce(F.octet_length(c) > 0, F.lit(False))
    return F.lit(False) if v.type == NULL else c.isNotNull()


def condition(v: Value) -> Column:
    """As ``truth`` where rows for which it is NULL are dropped anyway: simpler, so that it reaches the scan."""
    if v.predicate is not None:
        return v.predicate
    if v.type == BOOLEAN:
        return v.column
    if v.type in NUMERIC:
        return v.column != 0
    if v.type == TEXT:
        return v.column != ""
    return truth(v)


def wider(a: str, b: str) -> str:
    """The numeric type that holds both."""
    return DOUBLE if DOUBLE in (a, b) else BIGINT if BIGINT in (a, b) else INTEGER
