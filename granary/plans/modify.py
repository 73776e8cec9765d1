"""INSERT, UPDATE and DELETE: new parts are staged, checked, and named by the transaction's manifest.

Rows that change are rewritten with the parts that hold them; other parts stay as they
are. A batch is written before it is checked, so that checks and result see the same
rows whatever its expressions give when run again.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types as t
from ..catalog import Table
from ..errors import BindError, ConstraintViolation
from ..operators import keys as k
from ..operators import rows
from ..types import Value, cast, condition, truth
from . import nodes as n
from .expressions import Scope, bind
from .parser import parse_expr
from .select import Context, Planned, aggregates_in, calls_in, draws, plan


class Target:
    """A table of a transaction that is being changed."""

    def __init__(self, tx, name: str):
        self.tx, self.table = tx, Table(tx.entry(name))
        if self.table.read_only:
            raise BindError(f'"{name}" is read-only')
        self.keys = self.table.keys(tx.manifest["indexes"])

    @property
    def parts(self) -> list[dict]:
        return self.table.entry["parts"]

    def read(self) -> DataFrame:
        return self.tx.storage.read(self.parts, self.table.schema)

    def stage(self, df: DataFrame) -> tuple[dict, DataFrame]:
        part = self.tx.stage(df, self.table.primary)
        return part, self.tx.storage.read([part], df.schema)

    def replace(self, parts: list[dict]) -> None:
        self.table.entry["parts"] = [p for p in parts if p["rows"]]
        self.tx.changed = True

    # -- rules of single rows

    def check(self, df: DataFrame) -> None:
        """NOT NULL and CHECK, in one pass."""
        scope = self.table.scope()
        rules = [((f'NOT NULL constraint error: [{c["name"]}]', "not null", c["name"]), F.col(f"`{c['name']}`").isNull()) for c in self.table.columns if c.get("not_null")]
        for c in self.table.entry["checks"]:
            rules.append(((f'row violates check constraint "{c["name"]}"', "check", ""), _broken(bind(parse_expr(c["expr"]), scope))))
        found = k.violations(df, rules)
        if found is not None:
            raise ConstraintViolation(found[0], found[1], tuple(x for x in found[2:] if x))

    def check_keys(self, new: DataFrame, old: DataFrame | None, count: int | None, touched: set[str] | None = None) -> None:
        """No two rows of ``new``, and none of ``new`` and ``old``, share a key."""
        for what, columns in self.keys:
            if touched is not None and not touched & set(columns):
                continue
            if count != 1 and k.repeated(new, columns) or old is not None and k.within(old, new, columns, count).limit(1).count():
                raise ConstraintViolation(f"{what} constraint error: [{', '.join(columns)}]", what.lower(), tuple(columns))

    # -- parts

    def holding(self, wanted: DataFrame) -> list[dict]:
        """Parts in which some row of ``wanted`` (made from ``read`` by filters) lies."""
        at = F.regexp_extract(F.input_file_name(), "parts/([0-9a-f]+)/", 1)
        names = {f"parts/{r[0]}" for r in wanted.select(at.alias("at")).distinct().collect()}  # as many as parts
        return [p for p in self.parts if p["path"] in names]

    def holding_keys(self, batch: DataFrame, keys: list[list[str]], count: int | None) -> list[dict]:
        """Parts in which some row shares a key with ``batch``."""
        at = f"{k.ORDER}at"
        old = self.read().withColumn(at, F.regexp_extract(F.input_file_name(), "parts/([0-9a-f]+)/", 1))
        names = set()
        for c in keys:
            own = old.select(*(F.col(f"`{x}`") for x in c), at)
            names |= {f"parts/{r[0]}" for r in k.within(own, batch, c, count).select(at).distinct().collect()}  # as many as parts
        return [p for p in self.parts if p["path"] in names]

    def without(self, held: list[dict], batch: DataFrame, keys: list[list[str]], count: int | None) -> DataFrame:
        """The rows of ``held`` that share no key with ``batch``."""
        own, lost = self.tx.storage.read(held, self.table.schema), None
        for c in keys:
            found = k.within(own, batch, c, count).select(*(F.col(f"`{x}`") for x in self.table.primary))
            lost = found if lost is None else lost.union(found)
        return k.without(own, lost, self.table.primary)

    def rewritten(self, held: list[dict], keep: DataFrame) -> list[dict]:
        """The table's parts with ``keep`` in place of ``held``."""
        rest = [p for p in self.parts if p not in held]
        return [*rest, self.tx.stage(keep, self.table.primary)] if held else rest


def _broken(v: Value) -> Column:
    """Where a CHECK fails: false or zero; NULL passes, and a text never does."""
    if v.type == t.TEXT:
        return v.column.isNotNull()
    if v.type in (t.BOOLEAN, *t.NUMERIC):
        return v.column.isNotNull() & ~truth(v)
    return F.lit(False)


# -- INSERT


def insert(s: n.Insert, tx, ctx: Context) -> Planned | None:
    target = Target(tx, s.table)
    table = target.table
    given = list(s.columns) or (table.names if s.select is None else [])
    for c in given:
        table.type_of(c)
    if s.select is None:
        batch, count = _values(s, table, given, ctx), len(s.rows)
    else:
        if any(c.table is not None and c.table.lower() == s.table.lower() for c in s.select.cores):
            raise BindError("a table cannot be read and written by one INSERT")
        batch, count = _selected(s.select, table, given, ctx), None
    part, staged = target.stage(batch)
    target.check(staged)
    conflict = s.conflict
    if conflict is None:
        target.check_keys(staged, target.read() if target.parts else None, count)
        kept, parts = staged.select(*table.names), [*target.parts, part]  # the ordinals in the part's files are never read
    else:
        columns = [c for _, c in target.keys]
        numbered = staged if k.ORDER in staged.columns else rows.with_ordinals(staged, k.ORDER)
        if conflict == "nothing":
            for c in columns if target.parts else []:  # only the table's keys that the batch has
                numbered = k.without(numbered, k.within(target.read().select(*(F.col(f"`{x}`") for x in c)), numbered, c, count), c)
            numbered = k.first_wins(tx.save(numbered), columns, tx.save)
            parts = list(target.parts)
        else:
            parts = list(target.parts)
            held = target.holding_keys(numbered, columns, count) if parts else []
            if held:
                parts = target.rewritten(held, target.without(held, numbered, columns, count))
            numbered = k.last_wins(numbered, columns)
        final = tx.stage(numbered.select(*table.names), table.primary)
        tx.drop_later([part])
        parts.append(final)
        kept = tx.storage.read([final], table.schema)
    target.replace(parts)
    if not s.returning:
        return None
    return _returned(s, table, kept, ctx)


def _returned(s: n.Insert, table: Table, kept: DataFrame, ctx: Context) -> Planned:
    asked = n.Select((n.Core(s.returning, s.table),))
    return plan(asked, replace(ctx, table=lambda name: (kept, table.scope(), table.name)))


def _complete(table: Table, given: dict[str, Value], ctx: Context, scope: Scope) -> list[Column]:
    """All columns of the table in order: given ones cast, others by default or NULL."""
    out = []
    for c in table.columns:
        v = given.get(c["name"])
        if v is None:
            default = table.default_of(c["name"])
            v = t.null(c["type"]) if default is None else bind(default, scope)
        out.append(cast(v, c["type"]).column.cast(t.SPARK[c["type"]]))
    return out


def _values(s: n.Insert, table: Table, given: list[str], ctx: Context) -> DataFrame:
    scope = replace(ctx.base, table=None, columns={})
    for row in s.rows:
        if len(row) != len(given):
            raise BindError(f"{len(row)} values for {len(given)} columns")
    bound = [{c: bind(e, scope) for c, e in zip(given, row, strict=True)} for row in s.rows]
    literal = [c for c in given if all(r[c].is_constant for r in bound)]
    if len(literal) == len(given) and len(bound) > 8:
        return _literals(table, given, bound, ctx, scope)
    made = [[*_complete(table, r, ctx, scope), F.lit(i).cast("long")] for i, r in enumerate(bound)]
    return rows.emit(ctx.spark, made, [*table.names, k.ORDER])


def _literals(table: Table, given: list[str], bound: list[dict[str, Value]], ctx: Context, scope: Scope) -> DataFrame:
    """Many rows of literals as one local table per mix of types, cast by column."""
    by: dict[tuple[str, ...], list[tuple]] = {}
    for i, r in enumerate(bound):
        by.setdefault(tuple(r[c].type for c in given), []).append((i, *(r[c].constant for c in given)))
    frames = []
    for kinds, part in sorted(by.items()):
        schema = T.StructType([T.StructField(k.ORDER, T.LongType())] + [T.StructField(f"v{j}", t.SPARK[x]) for j, x in enumerate(kinds)])
        local = ctx.spark.createDataFrame(part, schema)
        values = {c: Value(F.col(f"v{j}"), x) for j, (c, x) in enumerate(zip(given, kinds, strict=True))}
        drawn = [x for c in table.names if c not in given and (d := table.default_of(c)) is not None for x in calls_in(d, "nextval")]
        if drawn:
            columns = {i: [scope.next_value(str(x.args[0].value)).column for x in drawn] for i, *_ in part}
            structs = F.create_map(*(y for i, cs in columns.items() for y in (F.lit(i).cast("long"), F.array(*cs))))
            local = local.withColumn("__draws", structs[F.col(k.ORDER)])
            order = iter(range(len(drawn)))
            own = replace(scope, next_value=lambda name, order=order: Value(F.col("__draws")[next(order)], t.BIGINT, nullable=False))
        else:
            own = scope
        frames.append(local.select(*(x.alias(c) for x, c in zip(_complete(table, values, ctx, own), table.names, strict=True)), k.ORDER))
    return rows.concat(frames)


def _selected(select: n.Select, table: Table, given: list[str], ctx: Context) -> DataFrame:
    p = plan(select, ctx)
    if given:
        if len(given) != len(p.names):
            raise BindError(f"{len(p.names)} values for {len(given)} columns")
        names = given
    else:
        names = p.names
        for c in names:
            table.type_of(c)
        if len(set(names)) < len(names):
            raise BindError("a column is given twice")
    frame, scope = p.frame, replace(ctx.base, table=None, columns={})
    drawn = [x for c in table.names if c not in names and (d := table.default_of(c)) is not None for x in calls_in(d, "nextval")]
    if drawn:
        frame = ctx.ordinals(frame)
        columns = draws(drawn, frame, ctx)
        scope = replace(scope, next_value=lambda name: Value(columns.pop(0), t.BIGINT, nullable=False))
    values = {c: Value(F.col(f"o{i}"), kind) for i, (c, kind) in enumerate(zip(names, p.types, strict=True))}
    return frame.select(*(x.alias(c) for x, c in zip(_complete(table, values, ctx, scope), table.names, strict=True)))


# -- UPDATE and DELETE


def _scope(target: Target, ctx: Context) -> Scope:
    own = target.table.scope()
    return replace(ctx.base, columns=own.columns, table=own.table, next_value=None)


def update(s: n.Update, tx, ctx: Context) -> None:
    target = Target(tx, s.table)
    scope = _scope(target, ctx)
    for c, e in s.sets:
        target.table.type_of(c)
        if aggregates_in(e):
            raise BindError("aggregates are not allowed in SET")
    where = None if s.where is None else bind(s.where, scope)
    for _, e in s.sets:
        bind(e, scope)
    if not target.parts:
        return
    table = target.read()
    chosen = table if where is None else rows.filtered(table, condition(where))
    held = target.holding(chosen)
    if not held:
        return
    own = tx.storage.read(held, target.table.schema)
    chosen = own if where is None else rows.filtered(own, condition(where))
    for c, e in s.sets:
        chosen = rows.set_column(chosen, c, cast(bind(e, scope), target.table.type_of(c)).column.cast(t.SPARK[target.table.type_of(c)]))
    part, new = target.stage(chosen.select(*target.table.names))
    target.check(new)
    touched = {c for c, _ in s.sets}
    keep = own.limit(0) if where is None else own.filter(~truth(where))
    rest = [p for p in target.parts if p not in held]
    if any(touched & set(columns) for _, columns in target.keys):
        others = tx.storage.read(rest, target.table.schema).union(keep) if rest else keep
        target.check_keys(new, others, part["rows"], touched)
    parts = rest + [part] if where is None else [*target.rewritten(held, keep), part]
    target.replace(parts)


def delete(s: n.Delete, tx, ctx: Context) -> None:
    target = Target(tx, s.table)
    scope = _scope(target, ctx)
    where = None if s.where is None else bind(s.where, scope)
    if s.order is not None:
        target.table.type_of(s.order[0])
    bounded = s.limit is not None or s.offset is not None
    if not target.parts:
        return
    table = target.read()
    if where is None and not bounded:
        target.replace([])
        return
    if not bounded:
        held = target.holding(rows.filtered(table, condition(where)))
        own = tx.storage.read(held, target.table.schema) if held else None
        if held:
            target.replace(target.rewritten(held, own.filter(~truth(where))))
        return
    select = n.Select((n.Core(tuple(n.Output(n.Name(c), None) for c in target.table.primary), s.table, s.where),), (), s.order, s.limit, s.offset)
    chosen = tx.save(plan(select, ctx).frame.toDF(*target.table.primary))
    if not chosen.limit(1).count():
        return
    count, keys = chosen.count(), [target.table.primary]
    held = target.holding_keys(chosen, keys, count)
    target.replace(target.rewritten(held, target.without(held, chosen, keys, count)))
