"""Binds expressions: names and types are resolved here, and a Spark column comes out.

AND, OR and NOT are two-valued. Where only true rows count (``types.condition``) the
plain three-valued form does the same and reaches the Parquet scan, so each bound
boolean carries both, and a third form for what NOT of it keeps.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BindError
from ..functions.aggregates import AGGREGATES
from ..functions.scalars import call
from ..types import BIGINT, BOOLEAN, BYTEA, DOUBLE, INTEGER, INTEGRAL, NULL, NUMERIC, SPARK, TEXT, TIMESTAMP, Value, cast, checked, condition, literal, null, truth, wider
from . import nodes as n

ARITHMETIC = ("+", "-", "*", "/", "%", "&", "|", "^")
COMPARISON = ("=", "!=", "<", "<=", ">", ">=")
_FLIPPED = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
_OPPOSITE = {"=": "!=", "!=": "=", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}
_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


@dataclass
class Scope:
    """What an expression may refer to."""

    columns: dict[str, Value] = field(default_factory=dict)
    table: str | None = None
    params: tuple = ()
    now: datetime | None = None
    next_value: Callable[[str], Value] | None = None
    aggregates: bool = False

    def column(self, name: str) -> Value:
        if self.table is None:
            raise BindError("no table specified")
        found = self.columns.get(name)
        if found is None:
            raise BindError(f'column "{name}" does not exist in "{self.table}"')
        return found


def bind(e: n.Expr, scope: Scope) -> Value:
    if isinstance(e, n.Paren):
        return bind(e.inner, scope)
    if isinstance(e, n.Literal):
        return literal(e.value)
    if isinstance(e, n.Name):
        return scope.column(e.name)
    if isinstance(e, n.Param):
        if e.index > len(scope.params):
            raise BindError(f"no value for ${e.index}")
        value = scope.params[e.index - 1]
        return literal(value, BIGINT if isinstance(value, int) and not isinstance(value, bool) else None)
    if isinstance(e, n.Not):
        return _not(bind(e.inner, scope))
    if isinstance(e, n.Between):
        return _between(*(bind(x, scope) for x in (e.value, e.low, e.high)))
    if isinstance(e, n.In):
        return _in(bind(e.value, scope), [bind(x, scope) for x in e.items], e.negated)
    if isinstance(e, n.Cast):
        return cast(bind(e.value, scope), e.type)
    if isinstance(e, n.Call):
        return _call(e, scope)
    if isinstance(e, n.Binary):
        a, b = bind(e.left, scope), bind(e.right, scope)
        if e.op in ("and", "or"):
            return _logical(e.op, a, b)
        if e.op in COMPARISON:
            return compare(e.op, a, b)
        if e.op in ARITHMETIC:
            return arithmetic(e.op, a, b)
        if e.op in ("is", "is not"):
            return _is(a, b, e.op == "is not")
        if e.op in ("like", "not like"):
            return _like(a, b, e.op == "not like")
        if e.op == "||":
            return Value(F.concat(a.column, b.column), TEXT, nullable=a.nullable or b.nullable, raises=a.raises or b.raises) if a.type == b.type == TEXT else null(TEXT)
    raise BindError(f"{e} is not an expression here")


def _call(e: n.Call, scope: Scope) -> Value:
    if e.name in AGGREGATES:
        if not scope.aggregates:
            raise BindError(f"{e} is not allowed here")
        if len(e.args) != 1:
            raise BindError(f"{e.name} takes one argument")
        inner = replace(scope, aggregates=False)
        return AGGREGATES[e.name](None if isinstance(e.args[0], n.Star) else bind(e.args[0], inner))
    if e.name == "now":
        if e.args:
            raise BindError("now takes no arguments")
        return literal(scope.now or datetime.now(), TIMESTAMP)
    if e.name == "nextval":
        if len(e.args) != 1 or not isinstance(e.args[0], n.Literal) or not isinstance(e.args[0].value, str):
            raise BindError("nextval takes the name of a sequence")
        if scope.next_value is None:
            raise BindError("nextval is not allowed here")
        return scope.next_value(e.args[0].value)
    return call(e.name, [bind(x, scope) for x in e.args])


# -- logic


def _logical(op: str, a: Value, b: Value) -> Value:
    ta, tb, raises = truth(a), truth(b), a.raises or b.raises
    if op == "and":
        if b.raises:  # what stands to the right is looked at only where the left is true
            both = F.when(ta, tb).otherwise(False)
            return Value(both, BOOLEAN, nullable=False, predicate=condition(a) & both, raises=raises)
        return Value(ta & tb, BOOLEAN, nullable=False, predicate=condition(a) & condition(b), falsified=_false(a) | _false(b), raises=raises)
    if b.raises:
        either = F.when(ta, True).otherwise(tb)
        return Value(either, BOOLEAN, nullable=False, predicate=either, raises=raises)
    return Value(ta | tb, BOOLEAN, nullable=False, predicate=condition(a) | condition(b), falsified=_false(a) & _false(b), raises=raises)


def _false(v: Value) -> Column:
    """True exactly where the value is not true, in a form that may reach the scan; elsewhere false or NULL."""
    return v.falsified if v.falsified is not None else ~truth(v)


def _not(v: Value) -> Value:
    return Value(~truth(v), BOOLEAN, nullable=False, predicate=_false(v), falsified=condition(v), raises=v.raises)


# -- comparison


def _never(a: Value, b: Value, op: str) -> Value:
    """Values of types that are never equal nor ordered; NULL stays NULL."""
    out = F.lit(op == "!=")
    return Value(F.when(a.column.isNull() | b.column.isNull(), None).otherwise(out), BOOLEAN, raises=a.raises or b.raises)


def paired(a: Value, b: Value) -> tuple[Value, Value] | None:
    """Both as one type they compare in; None if they never compare. Goes by the left type."""
    if a.type == b.type:
        return a, b
    if a.type in NUMERIC and b.type in NUMERIC:
        kind = wider(a.type, b.type)
        if a.name and b.is_constant and kind != a.type and b.constant is not None and float(b.constant).is_integer() and abs(b.constant) < 1 << 31:
            return a, literal(int(b.constant), a.type)  # the column stays bare, so that the scan sees the comparison
        return cast(a, kind), cast(b, kind)
    if b.type == TEXT and isinstance(b.constant, str) and a.name:
        return a, cast(b, a.type)
    if a.type == TEXT and isinstance(a.constant, str) and b.name:
        return cast(a, b.type), b
    if b.type == TEXT and a.type in (INTEGER, BOOLEAN, TIMESTAMP):
        return a, cast(b, a.type)
    if a.type == TEXT and b.type == TIMESTAMP:
        return cast(a, b.type), b
    if a.type == BOOLEAN:
        raise BindError(f"cannot compare {a.type} with {b.type}")
    return None


def compare(op: str, a: Value, b: Value) -> Value:
    if NULL in (a.type, b.type):
        return null(BOOLEAN)
    both = paired(a, b)
    if both is None:
        return _never(a, b, op)
    x, y = both
    out = _COMPARE[op](x.column, y.column)
    absent = [v.column.isNull() for v in (x, y) if v.nullable]
    opposite = _COMPARE[_OPPOSITE[op]](x.column, y.column)
    for c in absent:
        opposite = c | opposite
    simple = x.type != DOUBLE  # the opposite of a comparison with NaN is none
    return Value(out, BOOLEAN, nullable=bool(absent), predicate=out, falsified=opposite if simple or op in ("=", "!=") else None, raises=x.raises or y.raises)


def _between(x: Value, low: Value, high: Value) -> Value:
    """NULL if any operand is."""
    if NULL in (x.type, low.type, high.type):
        return null(BOOLEAN)
    a, b = compare(">=", x, low), compare("<=", x, high)
    both = a.column & b.column
    absent = [v.column.isNull() for v in (x, low, high) if v.nullable]
    out = both
    if absent:
        some = absent[0]
        for c in absent[1:]:
            some = some | c
        out = F.when(some, None).otherwise(both)
    return Value(out, BOOLEAN, nullable=bool(absent), predicate=both, falsified=_false(a) | _false(b), raises=a.raises or b.raises)


def _in(x: Value, items: list[Value], negated: bool) -> Value:
    """NULL elements count for nothing; a NULL on the left gives NULL."""
    if x.type == NULL:
        return null(BOOLEAN)
    real = [i for i in items if i.type != NULL and not (i.is_constant and i.constant is None)]
    pairs = [paired(x, i) for i in real]
    fit = [p for p in pairs if p is not None]
    if fit and all(p[0] is x and p[1].is_constant for p in fit) or not fit:
        found = x.column.isin([p[1].constant for p in fit]) if fit else F.lit(False)
        if not fit and x.nullable:
            found = F.when(x.column.isNull(), None).otherwise(False)
        out = ~found if negated else found
        absent = x.column.isNull()
        rest = found if negated else ~found
        return Value(out, BOOLEAN, nullable=x.nullable, predicate=out, falsified=absent | rest if x.nullable else rest, raises=x.raises)
    found = F.lit(False)
    for a, b in fit:
        found = found | F.coalesce(a.column == b.column, F.lit(False))
    out = ~found if negated else found
    out = F.when(x.column.isNull(), None).otherwise(out) if x.nullable else out
    return Value(out, BOOLEAN, nullable=x.nullable, raises=x.raises or any(p[1].raises or p[0].raises for p in fit))


def _is(a: Value, b: Value, negated: bool) -> Value:
    """Equality that knows NULL: true or false, never NULL."""
    if b.type == NULL or a.type == NULL:
        other = a if b.type == NULL else b
        same = F.lit(True) if other.type == NULL else other.column.isNull()
    else:
        both = paired(a, b)
        same = F.lit(False) if both is None else both[0].column.eqNullSafe(both[1].column)
    out, opposite = (~same, same) if negated else (same, ~same)
    return Value(out, BOOLEAN, nullable=False, predicate=out, falsified=opposite, raises=a.raises or b.raises)


def _pattern(text: str) -> str:
    """A backslash makes any character stand for itself; only those before %, _ and backslash may stay."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 1
            c = text[i] if i < len(text) else "\\"
            out.append("\\" + c if c in "%_\\" else c)
        else:
            out.append(c)
        i += 1
    return "".join(out)


def _like(a: Value, b: Value, negated: bool) -> Value:
    """Upper and lower case are alike; NULL for what is no text."""
    if a.type != TEXT or b.type != TEXT:
        return null(BOOLEAN)
    pattern = F.lit(_pattern(b.constant)) if isinstance(b.constant, str) else F.regexp_replace(F.regexp_replace(b.column, r"\\([^%_\\])", "$1"), r"(?<!\\)((?:\\\\)*)\\$", r"$1\\\\")
    out = F.ilike(a.column, pattern)
    out = ~out if negated else out
    return Value(out, BOOLEAN, nullable=a.nullable or b.nullable, predicate=out, raises=a.raises or b.raises)


# -- arithmetic


def arithmetic(op: str, a: Value, b: Value) -> Value:
    if NULL in (a.type, b.type):
        return null(a.type if a.type != NULL else b.type if b.type in NUMERIC else INTEGER)
    if a.type not in NUMERIC or b.type not in NUMERIC or op in "&|^" and DOUBLE in (a.type, b.type):
        return null(a.type if a.type in NUMERIC else INTEGER)
    kind, nullable = wider(a.type, b.type), a.nullable or b.nullable
    x, y = (v.column.cast(SPARK[kind]) if v.type != kind else v.column for v in (a, b))
    raises = a.raises or b.raises
    if op == "/":
        return _divide(a, b, kind, raises)
    if op == "%":
        return Value(F.try_mod(x, y), kind, raises=raises)
    if op in "&|^":
        f = {"&": Column.bitwiseAND, "|": Column.bitwiseOR, "^": Column.bitwiseXOR}[op]
        return Value(f(x, y), kind, nullable=nullable, raises=raises)
    out = x + y if op == "+" else x - y if op == "-" else x * y
    return Value(out, kind, nullable=nullable, raises=raises or kind != DOUBLE and not (a.is_constant and b.is_constant))


def _divide(a: Value, b: Value, kind: str, raises: bool) -> Value:
    """Integers are cut off towards zero. A zero divisor: an error under an INTEGER, else NULL; NULL if the divisor is DOUBLE."""
    if kind == DOUBLE:
        if a.type == INTEGER and b.type in INTEGRAL:
            raise AssertionError("integers do not meet here")
        return Value(F.try_divide(a.column.cast("double"), b.column.cast("double")), DOUBLE, raises=raises)
    divisor = b.column if a.type == INTEGER else F.nullif(b.column, F.lit(0).cast(SPARK[b.type]))
    out = F.call_function("div", a.column.cast(SPARK[kind]), divisor.cast(SPARK[kind]))
    safe = b.is_constant and b.constant not in (0, None)
    return Value(out.cast(SPARK[kind]), kind, nullable=a.nullable or b.nullable or a.type != INTEGER, raises=raises or not safe and a.type == INTEGER)



def integral(v: Value, what: str) -> int:
    """A constant for LIMIT and OFFSET."""
    if v.type not in NUMERIC or v.constant is None:
        raise BindError(f"{what} takes a number")
    return int(v.constant)


