"""The five aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..types import BIGINT, DOUBLE, INTEGRAL, NUMERIC, Value, null

_ZERO = 0.0


def _count(v: Value | None) -> Value:
    """COUNT(*) without a value, else of the rows where it is not NULL."""
    return Value(F.count(F.lit(1) if v is None else v.column), BIGINT, nullable=False)


def _least(v: Value | None) -> Value:
    return Value(F.min(v.column), v.type)


def _greatest(v: Value | None) -> Value:
    return Value(F.max(v.column), v.type)


def _sum(v: Value | None) -> Value:
    """Integers give BIGINT and fail beyond it; what is no number is left out, so there may be nothing to add."""
    if v.type not in NUMERIC:
        return null(BIGINT)
    return Value(F.sum(v.column), BIGINT if v.type in INTEGRAL else DOUBLE)


def _average(v: Value | None) -> Value:
    """0 where there is no number."""
    if v.type not in NUMERIC:
        return Value(F.coalesce(F.avg(F.lit(None).cast("double")), F.lit(_ZERO)), DOUBLE, nullable=False)
    return Value(F.coalesce(F.avg(v.column), F.lit(_ZERO)), DOUBLE, nullable=False)


AGGREGATES: dict[str, Callable[[Value | None], Value]] = {"count": _count, "min": _least, "max": _greatest, "sum": _sum, "avg": _average}
