"""SELECT as one lazy DataFrame: scan, filter, aggregate, project, distinct or union, sort, skip, take."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BindError
from ..functions.aggregates import AGGREGATES
from ..functions.scalars import common
from ..operators import rows
from ..types import BIGINT, SPARK, Value, cast, condition
from . import nodes as n
from .expressions import Scope, bind, integral


@dataclass
class Context:
    """What a statement reads from its transaction."""

    spark: SparkSession
    table: Callable[[str], tuple[DataFrame, Scope, str]]  # rows, names and canonical name of a relation
    base: Scope  # parameters, time, sequences
    ordinals: Callable[[DataFrame], DataFrame]  # rows numbered in __ordinal, written so that numbers hold
    allocate: Callable[[str, int], Callable[[Column], Column]]  # takes values of a sequence; gives the i-th
    stored: Callable[[DataFrame], DataFrame]  # rows written, so that they are the same each time


@dataclass
class Planned:
    frame: DataFrame  # columns o0, o1, ... and what may be sorted by
    names: list[str]
    types: list[str]
    sortable: dict[str, Column]  # names of the first SELECT's table that ORDER BY may use


def aggregates_in(e: n.Expr) -> bool:
    if isinstance(e, n.Call):
        return e.name in AGGREGATES or any(map(aggregates_in, e.args))
    if isinstance(e, n.In):
        return any(map(aggregates_in, (e.value, *e.items)))
    return any(aggregates_in(getattr(e, k)) for k in ("inner", "left", "right", "value", "low", "high") if hasattr(e, k))


def names_in(e: n.Expr) -> set[str]:
    """Columns named outside aggregates."""
    if isinstance(e, n.Name):
        return {e.name}
    if isinstance(e, n.Call):
        return set() if e.name in AGGREGATES else set().union(*map(names_in, e.args))
    if isinstance(e, n.In):
        return set().union(*map(names_in, (e.value, *e.items)))
    return set().union(*(names_in(getattr(e, k)) for k in ("inner", "left", "right", "value", "low", "high") if hasattr(e, k)))


def calls_in(e: n.Expr, name: str) -> list[n.Call]:
    if isinstance(e, n.Call):
        return ([e] if e.name == name else []) + [c for a in e.args for c in calls_in(a, name)]
    if isinstance(e, n.In):
        return [c for a in (e.value, *e.items) for c in calls_in(a, name)]
    return [c for k in ("inner", "left", "right", "value", "low", "high") if hasattr(e, k) for c in calls_in(getattr(e, k), name)]


def _bare(e: n.Expr) -> n.Expr:
    return _bare(e.inner) if isinstance(e, n.Paren) else e


def core(c: n.Core, ctx: Context) -> Planned:
    if c.table is None:
        return _without_table(c, ctx)
    df, scope, _ = ctx.table(c.table)
    scope = replace(ctx.base, columns=scope.columns, table=scope.table)
    if c.where is not None:
        if aggregates_in(c.where):
            raise BindError("aggregates are not allowed in WHERE")
        df = rows.filtered(df, condition(bind(c.where, scope)))
    if c.group is not None or any(aggregates_in(o.expr) for o in c.outputs if not isinstance(o.expr, n.Star)):
        planned = _aggregated(c, df, scope)
    else:
        planned = _projected(c, df, scope, ctx)
    if c.distinct:
        kept = [f"o{i}" for i in range(len(planned.names))]
        planned = Planned(rows.union([planned.frame.select(*kept)]), planned.names, planned.types, _visible(planned))
    return planned


def _visible(p: Planned) -> dict[str, Column]:
    return {name: F.col(f"o{i}") for i, name in reversed(list(enumerate(p.names))) if name in p.sortable}


def _without_table(c: n.Core, ctx: Context) -> Planned:
    if any(isinstance(o.expr, n.Star) or aggregates_in(o.expr) for o in c.outputs) or c.where is not None or c.group is not None:
        raise BindError("no table specified")
    values = [bind(o.expr, replace(ctx.base, table=None, columns={})) for o in c.outputs]
    frame = rows.emit(ctx.spark, [[v.column for v in values]], [f"o{i}" for i in range(len(values))])
    return Planned(frame, [o.name for o in c.outputs], [v.type for v in values], {})


def _outputs(c: n.Core, scope: Scope) -> list[tuple[str, n.Expr]]:
    out = []
    for o in c.outputs:
        if isinstance(o.expr, n.Star):
            out += [(k, n.Name(k)) for k in scope.columns]
        else:
            out.append((o.name, o.expr))
    return out


def _projected(c: n.Core, df: DataFrame, scope: Scope, ctx: Context) -> Planned:
    outputs = _outputs(c, scope)
    drawn = [x for _, e in outputs for x in calls_in(e, "nextval")]
    if drawn:  # each row draws in the order of the outputs
        df = ctx.ordinals(df)
        columns = draws(drawn, df, ctx)
        scope = replace(scope, next_value=lambda name: Value(columns.pop(0), BIGINT, nullable=False))
    values = [(k, bind(e, scope)) for k, e in outputs]
    hidden = [k for k in scope.columns]
    made = [v.column.alias(f"o{i}") for i, (_, v) in enumerate(values)] + [scope.columns[k].column.alias(f"h{i}") for i, k in enumerate(hidden)]
    sortable = {k: F.col(f"h{i}") for i, k in enumerate(hidden)}
    sortable |= {k: F.col(f"o{i}") for i, (k, _) in reversed(list(enumerate(values))) if k in scope.columns}
    return Planned(df.select(*made), [k for k, _ in values], [v.type for _, v in values], sortable)


def draws(drawn: list[n.Call], df: DataFrame, ctx: Context) -> list[Column]:
    """For each nextval in a row, its value by the row's ordinal."""
    count, per = df.count(), {}
    for x in drawn:
        name = str(x.args[0].value).lower()
        per[name] = per.get(name, 0) + 1
    made, seen = {name: ctx.allocate(name, k * count) for name, k in per.items()}, dict.fromkeys(per, 0)
    out = []
    for x in drawn:
        name = str(x.args[0].value).lower()
        out.append(made[name](F.col("__ordinal") * per[name] + seen[name]))
        seen[name] += 1
    return out


def _aggregated(c: n.Core, df: DataFrame, scope: Scope) -> Planned:
    if any(isinstance(o.expr, n.Star) for o in c.outputs):
        raise BindError("* does not go with aggregates")
    inner = replace(scope, aggregates=True)
    if c.group is None:
        for o in c.outputs:
            if lost := names_in(o.expr):
                raise BindError(f'column "{sorted(lost)[0]}" is neither aggregated nor grouped')
        values = [bind(o.expr, inner) for o in c.outputs]
        frame = rows.group_aggregate(df, None, [v.column for v in values], [f"o{i}" for i in range(len(values))])
        return Planned(frame, [o.name for o in c.outputs], [v.type for v in values], {})
    if aggregates_in(c.group):
        raise BindError("aggregates are not allowed in GROUP BY")
    key = bind(c.group, scope)
    made: list[tuple[str, Value]] = []
    columns: list[Column] = []
    for o in c.outputs:
        e = _bare(o.expr)
        if e == _bare(c.group):
            columns.append(F.col("__key"))
            made.append((o.name, key))
        elif isinstance(e, n.Call) and e.name in AGGREGATES:
            v = bind(e, inner)
            columns.append(F.col(f"a{len(made)}"))
            made.append((o.name, v))
        else:
            raise BindError(f"{o.expr} is neither an aggregate nor the GROUP BY expression")
    used = [(f"a{i}", v.column) for i, (_, v) in enumerate(made) if v is not key]
    frame = rows.group_aggregate(df, key.column, [x for _, x in used], [k for k, _ in used])
    hidden = [F.col("__key").alias("h0")] if isinstance(_bare(c.group), n.Name) else []
    frame = frame.select(*(x.alias(f"o{i}") for i, x in enumerate(columns)), *hidden)
    sortable = {str(_bare(c.group)): F.col("h0")} if hidden else {}
    sortable |= {k: F.col(f"o{i}") for i, (k, _) in reversed(list(enumerate(made))) if k in scope.columns}
    return Planned(frame, [k for k, _ in made], [v.type for _, v in made], sortable)


def _combined(left: Planned, right: Planned, how: str) -> Planned:
    if len(left.names) != len(right.names):
        raise BindError(f"UNION of {len(left.names)} and {len(right.names)} columns")
    kinds = [common((Value(F.lit(None), a), Value(F.lit(None), b))) for a, b in zip(left.types, right.types, strict=True)]
    frames = [
        p.frame.select(*(cast(Value(F.col(f"o{i}"), a), kind).column.cast(SPARK[kind]).alias(f"o{i}") for i, (a, kind) in enumerate(zip(p.types, kinds, strict=True))))
        for p in (left, right)
    ]
    made = rows.concat(frames) if how == "all" else rows.union(frames)
    return Planned(made, left.names, kinds, _visible(left))


def plan(s: n.Select, ctx: Context) -> Planned:
    out = core(s.cores[0], ctx)
    for how, c in zip(s.unions, s.cores[1:], strict=True):
        out = _combined(out, core(c, ctx), how)
    frame, key, descending = out.frame, None, False
    if s.order is not None:
        column, descending = s.order
        if column not in out.sortable:
            raise BindError(f'ORDER BY "{column}": no such column here')
        key = out.sortable[column]
    skipped = 0 if s.offset is None else _number(s.offset, ctx, "OFFSET")
    limit = None if s.limit is None else _number(s.limit, ctx, "LIMIT")
    if skipped > 0 and (limit is None or skipped + limit > rows.FEW):
        frame, skipped = _skipped(s, frame, key, descending, skipped, ctx), 0
    if key is not None:
        frame = rows.sort(frame, key, descending)
    frame = rows.skip(frame, skipped)
    if limit is not None:
        frame = rows.take(frame, limit)
    return Planned(frame.select(*(f"o{i}" for i in range(len(out.names)))), out.names, out.types, {})


def _skipped(s: n.Select, frame: DataFrame, key: Column | None, descending: bool, count: int, ctx: Context) -> DataFrame:
    """Without the first rows of the order, or of the rows as they come."""
    if key is None or frame.select(key).dtypes[0][1] == "void":
        place = "__place"
        return rows.skip_sorted(ctx.stored(frame.withColumn(place, F.monotonically_increasing_id())), F.col(place), count)
    return rows.skip_sorted(frame if _repeatable(frame) else ctx.stored(frame), key, count, descending)


#: A node of a plan that gives the same rows each time if its children do: unlike sums of doubles, whose order counts.
_SAME = re.compile(r"[\s:+|-]*'?(?:Project|Filter|SubqueryAlias|Relation|LocalRelation|Range|Union|Distinct|Sort|OneRowRelation)\b")


def _repeatable(frame: DataFrame) -> bool:
    analyzed = frame._jdf.queryExecution().analyzed()
    return analyzed.deterministic() and all(_SAME.match(x) for x in analyzed.treeString().splitlines() if x.strip())


def _number(e: n.Expr, ctx: Context, what: str) -> int:
    if aggregates_in(e):
        raise BindError(f"aggregates are not allowed in {what}")
    v = bind(e, replace(ctx.base, table=None, columns={}))
    if not v.is_constant:  # an expression of literals, such as 10 - 5
        got = ctx.spark.range(1).select(cast(v, BIGINT).column).head()[0]
        return int(got or 0)
    return integral(v, what)


def named(p: Planned) -> DataFrame:
    """The result under its own names, equal ones included."""
    return p.frame.toDF(*p.names)
