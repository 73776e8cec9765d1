"""Databases, connections, transactions and results."""

from __future__ import annotations

import copy
import threading
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import catalog, types
from .errors import BindError, EngineError, NotFound, TransactionError, translated
from .operators import rows
from .operators.keys import repeated
from .plans import nodes as n
from .plans.explain import pipeline
from .plans.expressions import Scope, bind
from .plans.modify import Target, delete, insert, update
from .plans.parser import parse
from .plans.select import Context, Planned, calls_in, named, plan
from .sources.storage import PARTS, SMALL_PART, Storage, located, own_root

_SETTINGS = {"spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC"}


class Database:
    """Tables under one root. ``:memory:`` is a root of its own that goes when the database is closed."""

    def __init__(self, spark: SparkSession, path: str = ":memory:"):
        for key, value in _SETTINGS.items():
            spark.conf.set(key, value)
        self.spark, self.temporary = spark, path == ":memory:"
        self.storage = Storage(spark, own_root(spark) if self.temporary else located(spark, path))
        self.manifest = self.storage.load()
        self.external: dict[str, dict] = {}
        self.frames: dict[str, DataFrame] = {}
        self.writer = threading.Lock()

    def register(self, name: str, source: str | DataFrame, partly: bool = False) -> None:
        """A read-only table over Parquet files or a DataFrame.

        Columns of types outside the dialect are an error, or left out with ``partly``. Dates are timestamps.
        """
        df = self.spark.read.parquet(source) if isinstance(source, str) else source
        known = [(f, types.of_spark(f.dataType)) for f in df.schema.fields]
        columns = [{"name": f.name, "type": kind} for f, kind in known if kind is not None]
        other = [f"{f.name} ({f.dataType.simpleString()})" for f, kind in known if kind is None]
        if other and not partly:
            raise BindError(f"the dialect has no type for {', '.join(other)}")
        self.frames[name.lower()] = df.select(*(F.col(f"`{c['name']}`").cast(types.SPARK[c["type"]]) if types.SPARK[c["type"]] != df.schema[c["name"]].dataType else F.col(f"`{c['name']}`") for c in columns))
        self.external[name.lower()] = {"name": name, "columns": columns, "primary": [], "checks": [], "parts": [], "external": True}

    def connect(self) -> Connection:
        return Connection(self)

    def vacuum(self) -> int:
        """Removes parts that the current manifest doesn't name; no reader may hold an older one."""
        with self.writer:
            used = {p["path"] for t in self.manifest["tables"].values() for p in t["parts"]}
            lost = [{"path": f"parts/{x}"} for x in self.storage._names("parts") if f"parts/{x}" not in used]
            self.storage.remove(lost)
            return len(lost)

    def close(self) -> None:
        if self.temporary:
            self.storage.drop()


class Transaction:
    """A manifest of its own, the last when it begins. A writer holds the database's one write lock until it ends."""

    def __init__(self, db: Database, write: bool):
        if write:
            db.writer.acquire()
        self.db, self.spark, self.storage, self.write = db, db.spark, db.storage, write
        try:
            db.manifest = db.storage.load(db.manifest)  # other processes may have committed
        except BaseException:
            if write:
                db.writer.release()
            raise
        self.manifest = copy.deepcopy(db.manifest)
        self.now = datetime.now(timezone.utc).replace(tzinfo=None)
        self.changed, self.staged, self.unused = False, [], []

    def entry(self, name: str) -> dict:
        low = name.lower()
        found = self.manifest["tables"].get(low) or self.db.external.get(low)
        if found is None:
            if low == catalog.CATALOG:
                return {"name": catalog.CATALOG, "columns": [{"name": f.split()[0], "type": types.TEXT if f.split()[1] == "string" else types.BIGINT} for f in catalog.SCHEMA.split(", ")], "primary": [], "checks": [], "parts": [], "frame": True}
            raise NotFound(f'table "{name}" does not exist')
        return found

    def table(self, name: str) -> tuple[DataFrame, Scope, str]:
        table = catalog.Table(self.entry(name))
        if name.lower() == catalog.CATALOG:
            df = catalog.listing(self.spark, self.manifest)
        elif "external" in table.entry:
            df = self.db.frames[name.lower()]
        else:
            df = self.storage.read(table.entry["parts"], table.schema)
        return df, table.scope(), table.name

    # -- staged rows

    def stage(self, df: DataFrame, cluster: list[str] | None) -> dict:
        part = self.storage.write(df, cluster)
        self.staged.append(part)
        return part

    def save(self, df: DataFrame) -> DataFrame:
        part = self.stage(df, None)
        self.unused.append(part)
        return self.storage.read([part], df.schema)

    def drop_later(self, parts: list[dict]) -> None:
        self.unused += parts

    # -- sequences

    def allocate(self, name: str, count: int) -> Callable[[Column], Column]:
        s = catalog.find(self.manifest, "sequences", name)
        first, step, cycle = catalog.next_values(s, count)
        self.changed = True
        end = s["max"] if step > 0 else s["min"]
        room, begin = abs(end - first) // abs(step) + 1, s["min"] if step > 0 else s["max"]
        if count <= room:
            return lambda i: F.lit(first).cast("bigint") + F.lit(step).cast("bigint") * i
        return lambda i: F.when(i < room, F.lit(first).cast("bigint") + F.lit(step).cast("bigint") * i).otherwise(F.lit(begin).cast("bigint") + F.lit(step).cast("bigint") * F.pmod(i - room, F.lit(cycle)))

    def next_value(self, name: str) -> types.Value:
        s = catalog.find(self.manifest, "sequences", name)
        first, _, _ = catalog.next_values(s, 1)
        self.changed = True
        return types.literal(first, types.BIGINT)

    # -- end

    def compact(self) -> None:
        """Tables with many parts get their small ones written as one."""
        for entry in self.manifest["tables"].values():
            if len(entry["parts"]) > PARTS:
                self.merge(entry, [p for p in entry["parts"] if p["rows"] < SMALL_PART])

    def merge(self, entry: dict, parts: list[dict]) -> None:
        table = catalog.Table(entry)
        if len(parts) > 1:
            entry["parts"] = [*(p for p in entry["parts"] if p not in parts), self.stage(self.storage.read(parts, table.schema), table.primary)]
            self.changed = True

    def commit(self) -> None:
        lost = self.staged
        try:
            if self.changed:
                self.compact()
                self.db.manifest = self.storage.commit(self.manifest)
            lost = self.unused
        finally:
            self._end({p["path"] for p in lost})

    def rollback(self) -> None:
        self._end({p["path"] for p in self.staged})

    def _end(self, lost: set[str]) -> None:
        used = {p["path"] for t in self.db.manifest["tables"].values() for p in t["parts"]}
        self.storage.remove([{"path": x} for x in lost - used])
        if self.write:
            self.write = False
            self.db.writer.release()


@dataclass
class Result:
    """What a statement returns: a lazy DataFrame, or nothing."""

    frame: DataFrame | None = None
    types: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [] if self.frame is None else self.frame.columns

    def rows(self) -> list[Row]:
        try:
            return [] if self.frame is None else self.frame.collect()
        except PySparkException as e:
            raise translated(e) from e


class Prepared:
    """A parsed script, run with other parameters each time."""

    def __init__(self, connection: Connection, sql: str):
        self.connection, self.statements = connection, parse(sql)

    def execute(self, *params: object) -> Result:
        return self.connection._run(self.statements, params)


class Connection:
    """One transaction at a time; statements outside of one commit by themselves."""

    def __init__(self, db: Database):
        self.db, self.tx = db, None

    def prepare(self, sql: str) -> Prepared:
        return Prepared(self, sql)

    def execute(self, sql: str, *params: object) -> Result:
        """Runs a script; gives the result of its last statement."""
        return self._run(parse(sql), params)

    def query(self, sql: str, *params: object) -> DataFrame:
        """The lazy result of a script that ends with a statement that has one."""
        found = self.execute(sql, *params)
        if found.frame is None:
            raise BindError("the statement has no result")
        return found.frame

    def close(self) -> None:
        if self.tx is not None:
            self._end(False)

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()

    # -- statements

    def _run(self, statements: list[object], params: tuple) -> Result:
        out = Result()
        for s in statements:
            out = self._one(s, params)
        return out

    def _end(self, commit: bool) -> None:
        if self.tx is None:
            raise TransactionError("no transaction has begun")
        tx, self.tx = self.tx, None
        (tx.commit if commit else tx.rollback)()

    def _one(self, s: object, params: tuple) -> Result:
        if isinstance(s, n.Begin):
            if self.tx is not None:
                raise TransactionError("a transaction has already begun")
            self.tx = Transaction(self.db, s.write)
            return Result()
        if isinstance(s, (n.Commit, n.Rollback)):
            self._end(isinstance(s, n.Commit))
            return Result()
        own = self.tx is None
        tx = Transaction(self.db, _writes(s)) if own else self.tx
        if not own and _writes(s) and not tx.write:
            raise TransactionError("cannot write in a read-only transaction")
        before, changed = copy.deepcopy(tx.manifest) if _writes(s) else None, tx.changed
        try:
            out = _execute(s, tx, params)
        except Exception as e:
            if own:
                tx.rollback()
            elif before is not None:
                tx.manifest, tx.changed = before, changed
            if isinstance(e, PySparkException) and (known := translated(e)) is not e:
                raise known from e
            raise
        if own:
            tx.commit()
        return out


def _writes(s: object) -> bool:
    if isinstance(s, n.Explain):
        return False
    if isinstance(s, n.Select):
        return any(calls_in(o.expr, "nextval") for c in s.cores for o in c.outputs if not isinstance(o.expr, n.Star))
    return True


def _context(tx: Transaction, params: tuple) -> Context:
    base = Scope(params=params, now=tx.now, next_value=tx.next_value if tx.write else None)

    def ordinals(df: DataFrame) -> DataFrame:
        return rows.with_ordinals(tx.storage.read([tx.stage(df, None)], df.schema), "__ordinal")

    def stored(df: DataFrame) -> DataFrame:
        void = [c for c, kind in df.dtypes if kind == "void"]  # Parquet has no such columns
        kept = df.drop(*void)
        return tx.storage.read([tx.stage(kept, None)], kept.schema).withColumns({c: F.lit(None) for c in void}).select(*df.columns)

    return Context(tx.spark, tx.table, base, ordinals, tx.allocate, stored)


def _result(p: Planned | None) -> Result:
    return Result() if p is None else Result(named(p), tuple(p.types))


def _execute(s: object, tx: Transaction, params: tuple) -> Result:
    ctx, m = _context(tx, params), tx.manifest
    if isinstance(s, n.Select):
        return _result(plan(s, ctx))
    if isinstance(s, n.Insert):
        return _result(insert(s, tx, ctx))
    if isinstance(s, n.Update):
        update(s, tx, ctx)
    elif isinstance(s, n.Delete):
        delete(s, tx, ctx)
    elif isinstance(s, n.Explain):
        return Result(tx.spark.createDataFrame([(pipeline(s.statement, m, tx.entry),)], "plan string"), (types.TEXT,))
    else:
        tx.changed |= _define(s, tx, m)
    return Result()


def _define(s: object, tx: Transaction, m: dict) -> bool:
    """Data definition on a transaction's manifest; tells whether it changed."""
    if isinstance(s, n.CreateTable):
        if s.if_not_exists and s.table.name.lower() in m["tables"]:
            return False
        if s.table.name.lower() in tx.db.external:
            raise catalog.AlreadyExists(f'"{s.table.name}" already exists')
        catalog.create_table(m, s.table)
    elif isinstance(s, n.CreateIndex):
        if s.if_not_exists and s.name and s.name.lower() in m["indexes"]:
            return False
        made = catalog.create_index(m, s)
        if s.unique:
            _check_unique(Target(tx, s.table), made)
    elif isinstance(s, n.CreateSequence):
        if s.if_not_exists and s.name.lower() in m["sequences"]:
            return False
        catalog.create_sequence(m, s)
    elif isinstance(s, n.Drop):
        kind = {"table": "tables", "index": "indexes", "sequence": "sequences"}[s.kind]
        if s.if_exists and s.name.lower() not in m[kind]:
            return False
        catalog.drop(m, s.kind, s.name)
    elif isinstance(s, n.AlterRename):
        catalog.rename_table(m, s.table, s.to)
    elif isinstance(s, n.AlterAdd):
        _add_column(s, tx, m)
    elif isinstance(s, n.Reindex):
        _reindex(s, tx, m)
    else:
        raise EngineError(f"unknown statement {type(s).__name__}")
    return True


def _check_unique(target: Target, index: dict) -> None:
    columns = [c for c, _ in index["columns"]]
    if target.parts and repeated(target.read(), columns):
        raise catalog.ConstraintViolation(f"UNIQUE constraint error: [{', '.join(columns)}]", "unique", tuple(columns))


def _add_column(s: n.AlterAdd, tx: Transaction, m: dict) -> None:
    entry, column = catalog.find(m, "tables", s.table), s.part.columns[0]
    target = Target(tx, s.table)
    if s.part.primary is not None:
        raise BindError(f'multiple primary keys for table "{entry["name"]}" are not allowed')
    if column.name.lower() in {c["name"].lower() for c in entry["columns"]}:
        raise catalog.AlreadyExists(f'column "{column.name}" already exists')
    old = target.read() if target.parts else None
    made = {"name": column.name, "type": column.type, "not_null": column.not_null}
    if column.default is not None:
        catalog.check_default(m, column)
        made["default"] = str(column.default)
    entry["columns"].append(made)
    for name, expr in s.part.checks:
        catalog.add_check(entry, name, expr)
    indexes = [catalog.add_unique(m, entry, key) for key in s.part.uniques]
    if old is None:
        return
    target = Target(tx, s.table)
    if column.default is not None:
        ctx = _context(tx, ())
        drawn = calls_in(column.default, "nextval")
        scope = Scope(now=tx.now, next_value=tx.next_value)
        if drawn:
            from .plans.select import draws

            old = ctx.ordinals(old)
            columns = draws(drawn, old, ctx)
            scope = Scope(now=tx.now, next_value=lambda name: types.Value(columns.pop(0), types.BIGINT, nullable=False))
        value = types.cast(bind(column.default, scope), column.type).column.cast(types.SPARK[column.type])
        filled = old.withColumn(column.name, value).select(*(f"`{c}`" for c in target.table.names))
        target.replace([tx.stage(filled, target.table.primary)])
    target.check(target.read())
    for x in indexes:
        _check_unique(target, x)


def _reindex(s: n.Reindex, tx: Transaction, m: dict) -> None:
    """Writes tables anew as one part, sorted by primary key."""
    if s.name is None:
        names = list(m["tables"])
    elif s.name.lower() in m["tables"]:
        names = [s.name.lower()]
    else:
        names = [catalog.find(m, "indexes", s.name)["table"]]
    for name in names:
        tx.merge(m["tables"][name], list(m["tables"][name]["parts"]))


def connect(spark: SparkSession, path: str = ":memory:") -> Connection:
    """A connection to the database at ``path``."""
    return Database(spark, path).connect()
