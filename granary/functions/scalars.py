"""The scalar functions: name, how many arguments, and the expression by static type."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BindError
from ..types import BIGINT, DOUBLE, INTEGER, INTEGRAL, NULL, NUMERIC, TEXT, Value, cast, literal, null


@dataclass(frozen=True)
class Scalar:
    low: int
    high: int | None
    make: Callable[..., Value]


def _typeof(x: Value) -> Value:
    if x.type == NULL or x.is_constant:
        return literal(NULL if x.constant is None else x.type)
    name = F.lit(x.type)
    return Value(F.when(x.column.isNull(), NULL).otherwise(name) if x.nullable else name, TEXT, nullable=False)


def _len(x: Value) -> Value:
    """Bytes of a text; NULL for what is no text."""
    return Value(F.octet_length(x.column).cast("bigint"), BIGINT, nullable=x.nullable) if x.type == TEXT else null(BIGINT)


def common(values: tuple[Value, ...]) -> str:
    """The type that holds all values: the widest number, one shared type, or else text."""
    kinds = {v.type for v in values} - {NULL}
    if not kinds:
        return NULL
    if len(kinds) == 1:
        return kinds.pop()
    if kinds <= set(NUMERIC):
        return DOUBLE if DOUBLE in kinds else BIGINT
    return TEXT


def _coalesce(*values: Value) -> Value:
    kind = common(values)
    if kind == NULL:
        return null()
    parts = [cast(v, kind) for v in values if v.type != NULL]
    return Value(F.coalesce(*(p.column for p in parts)), kind, nullable=all(p.nullable for p in parts), raises=any(p.raises for p in parts))


def _case(f: Callable[[Column], Column]) -> Callable[[Value], Value]:
    return lambda x: Value(f(x.column), TEXT, nullable=x.nullable) if x.type == TEXT else null(TEXT)


def _trim(side: str) -> Callable[..., Value]:
    """Takes characters of a set (one blank if none is given) off the ends."""
    f = {"both": F.btrim, "left": F.ltrim, "right": F.rtrim}[side]

    def make(x: Value, cut: Value | None = None) -> Value:
        if x.type != TEXT or cut is not None and cut.type != TEXT:
            return null(TEXT)
        return Value(f(x.column, cut.column if cut is not None else F.lit(" ")), TEXT)

    return make


def _floor(x: Value) -> Value:
    if x.type == DOUBLE:
        # floor() of a double is a bigint; large doubles are whole numbers already
        small = F.abs(x.column) < float(1 << 53)
        return Value(F.when(small, F.floor(x.column).cast("double")).otherwise(x.column), DOUBLE, nullable=x.nullable)
    if x.type in INTEGRAL:
        return x
    raise BindError(f"floor takes a number, not {x.type}")


def _abs(x: Value) -> Value:
    if x.type == TEXT:
        x = cast(x, DOUBLE)
    if x.type == NULL:
        return null(DOUBLE)
    if x.type not in NUMERIC:
        raise BindError(f"abs takes a number, not {x.type}")
    return Value(F.abs(x.column), x.type, nullable=x.nullable, raises=x.type != DOUBLE)


def _double(x: Value, name: str) -> Value:
    if x.type != NULL and x.type not in NUMERIC and x.type != TEXT:
        raise BindError(f"{name} takes a number, not {x.type}")
    return cast(x, DOUBLE)


def _math(name: str, f: Callable[..., Column], outside: Callable[[Column], Column] | None = None) -> Callable[..., Value]:
    def make(*values: Value) -> Value:
        parts = [_double(v, name).column for v in values]
        out = f(*parts)
        if outside is not None:
            out = F.when(outside(parts[0]), F.raise_error(F.lit(f"out of range value for {name}")).cast("double")).otherwise(out)
        return Value(out, DOUBLE, raises=outside is not None)

    return make


def _by_character(text: Column, whole: Callable[[Column], Column], one: Callable[[Column], Column]) -> Column:
    """``whole(text)``, but ``one`` of each character where some is beyond ASCII: no character becomes several, or looks at others."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(whole(text))


def _upper(text: Column) -> Column:
    single = lambda x: F.char_length(x) == 1
    return _by_character(text, F.upper, lambda c: F.when(single(F.upper(c)), F.upper(c)).when(single(F.initcap(c)), F.initcap(c)).otherwise(c))


def _lower(text: Column) -> Column:
    return _by_character(text, F.lower, lambda c: F.left(F.lower(c), F.lit(1)))


def _random() -> Value:
    """A whole number from 0 up, of 63 bits."""
    high, low = F.floor(F.rand() * (1 << 31)).cast("bigint"), F.floor(F.rand() * (1 << 32)).cast("bigint")
    return Value(F.shiftleft(high, 32).bitwiseOR(low), BIGINT, nullable=False)


def _sqrt(x: Value) -> Value:
    """Of INTEGER and DOUBLE; NULL for all else."""
    return Value(F.sqrt(x.column.cast("double")), DOUBLE, nullable=x.nullable) if x.type in (INTEGER, DOUBLE) else null(DOUBLE)


SCALARS: dict[str, Scalar] = {
    "typeof": Scalar(1, 1, _typeof),
    "len": Scalar(1, 1, _len),
    "coalesce": Scalar(1, None, _coalesce),
    "lower": Scalar(1, 1, _case(_lower)),
    "upper": Scalar(1, 1, _case(_upper)),
    "trim": Scalar(1, 2, _trim("both")),
    "ltrim": Scalar(1, 2, _trim("left")),
    "rtrim": Scalar(1, 2, _trim("right")),
    "floor": Scalar(1, 1, _floor),
    "abs": Scalar(1, 1, _abs),
    "acos": Scalar(1, 1, _math("acos", F.acos, lambda x: F.abs(x) > 1)),
    "acosh": Scalar(1, 1, _math("acosh", F.acosh, lambda x: x < 1)),
    "asin": Scalar(1, 1, _math("asin", F.asin, lambda x: F.abs(x) > 1)),
    "asinh": Scalar(1, 1, _math("asinh", F.asinh)),
    "atan": Scalar(1, 1, _math("atan", F.atan)),
    "atan2": Scalar(2, 2, _math("atan2", F.atan2)),
    "random": Scalar(0, 0, _random),
    "sqrt": Scalar(1, 1, _sqrt),
}  # now() and nextval() depend on the transaction and are bound with it


def call(name: str, values: list[Value]) -> Value:
    found = SCALARS.get(name)
    if found is None:
        raise BindError(f"no such function: {name}")
    if len(values) < found.low or found.high is not None and len(values) > found.high:
        raise BindError(f"{name} takes {found.low} to {found.high} arguments, not {len(values)}")
    return found.make(*values)
