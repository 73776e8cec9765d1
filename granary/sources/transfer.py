"""In and out of a database: CSV files, SQL scripts, copies.

Rows become text or are read from it by Spark; only a dump's lines pass through the
driver, one partition or one statement at a time, since a script is one stream.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from typing import TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog, types
from ..errors import BindError, EngineError
from ..plans.lexer import KEYWORDS, tokens
from ..session import Connection, Database

#: Rows of one INSERT in a dump.
BATCH = 500


def import_csv(connection: Connection, path: str, table: str) -> None:
    """Rows of a CSV file with a header. A table that does not exist is made of TEXT columns, with a numbered key."""
    spark = connection.db.spark
    # a file can be split at its lines unless a quoted field holds the end of one: then some line has an odd number of quotes
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
    broken = spark.read.text(path).where(quotes % 2 == 1).limit(1).count() > 0
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=broken, escape='"')
    names = list(df.columns)
    held = connection.db.manifest if connection.tx is None else connection.tx.manifest
    if table.lower() not in held["tables"]:
        columns = ", ".join(f"{_quoted(c)} TEXT" for c in names)
        key = "row_number"
        while key in {c.lower() for c in names}:
            key = f"_{key}"
        sequence = f"{table}_{key}_seq"
        connection.execute(f"CREATE SEQUENCE {_quoted(sequence)}; CREATE TABLE {_quoted(table)} ({key} BIGINT PRIMARY KEY DEFAULT nextval('{sequence}'), {columns})")
    source = "__csv"
    connection.db.register(source, df)
    try:
        listed = ", ".join(map(_quoted, names))
        connection.execute(f"INSERT INTO {_quoted(table)} ({listed}) SELECT {listed} FROM {source}")
    finally:
        del connection.db.external[source], connection.db.frames[source]


def _quoted(name: str) -> str:
    plain = name.isidentifier() and name.isascii() and name.lower() not in KEYWORDS
    return name if plain else '"' + name.replace("\\", "\\\\").replace('"', '\\"') + '"'


# -- dump


def _literal(column: Column, kind: str) -> Column:
    if kind == types.TEXT:
        out = column
        for a, b in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            out = F.replace(out, F.lit(a), F.lit(b))
        out = F.concat(F.lit("'"), out, F.lit("'"))
    elif kind == types.BYTEA:
        out = F.concat(F.lit("'\\x"), F.lower(F.hex(column)), F.lit("'"))
    elif kind == types.TIMESTAMP:
        out = F.concat(F.lit("'"), types.text_of_timestamp(column), F.lit("'"))
    elif kind == types.DOUBLE:
        out = types.text_of_double(column)
    else:
        out = column.cast("string")
    return F.coalesce(out, F.lit("NULL"))


def schema_lines(connection: Connection, tables: Iterable[str] = ()) -> Iterator[str]:
    """The statements that make the sequences, tables and indexes; each sequence once."""
    m = connection.db.manifest if connection.tx is None else connection.tx.manifest
    wanted = {t.lower() for t in tables}
    for t in wanted:
        catalog.find(m, "tables", t)
    chosen = {k: e for k, e in m["tables"].items() if not wanted or k in wanted}
    text = " ".join(c.get("default") or "" for e in chosen.values() for c in e["columns"])
    for s in m["sequences"].values():
        if not wanted or f"nextval('{s['name']}')" in text:
            following = dict(s, start=s["start"] if s["last"] is None else s["last"] + s["step"])
            if not s["min"] <= following["start"] <= s["max"]:
                following["start"] = s["min"] if s["step"] > 0 else s["max"]
            yield catalog.sequence_sql(following) + ";"
    for k, e in chosen.items():
        yield catalog.table_sql(e) + ";"
        for x in m["indexes"].values():
            if x["table"] == k:
                yield catalog.index_sql(m, x) + ";"


def data_lines(df: DataFrame, table: catalog.Table) -> Iterator[str]:
    row = F.concat(F.lit("("), F.concat_ws(", ", *(_literal(F.col(f"`{c['name']}`"), c["type"]) for c in table.columns)), F.lit(")"))
    head = f"INSERT INTO {_quoted(table.name)} VALUES "
    held: list[str] = []
    for r in df.select(row.alias("line")).toLocalIterator(prefetchPartitions=True):
        held.append(r["line"])
        if len(held) == BATCH:
            yield head + ", ".join(held) + ";"
            held = []
    if held:
        yield head + ", ".join(held) + ";"


def dump(connection: Connection, out: TextIO, tables: Iterable[str] = ()) -> None:
    """Writes a script that makes the tables (all, if none is named) and their rows anew."""
    m = connection.db.manifest if connection.tx is None else connection.tx.manifest
    wanted = [t.lower() for t in tables] or list(m["tables"])
    out.write("BEGIN;\n")
    for line in schema_lines(connection, tables):
        out.write(line + "\n")
    for name in wanted:
        table = catalog.Table(catalog.find(m, "tables", name))
        for line in data_lines(connection.db.storage.read(table.entry["parts"], table.schema), table):
            out.write(line + "\n")
    out.write("COMMIT;\n")


#: What a line may hold: texts, quoted names and comments, in which a semicolon ends nothing; a semicolon; anything else.
_PART = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|(?P<open>['"`].*|/\*.*)|(?P<end>;)|[^'"`;/-]+|[/-]""", re.S)


def statements(source: TextIO) -> Iterator[str]:
    """The statements of a script, read line by line: no more than one is held."""
    held, at = "", 0
    for line in source:
        held += line
        while at < len(held):
            m = _PART.match(held, at)
            if m["open"] is not None:  # goes on in the next line
                break
            at = m.end()
            if m["end"]:
                yield held[:at]
                held, at = held[at:], 0
    if held.strip():
        yield held


#: The literals that ``dump`` writes, by type, as both Python and Java read them. Others are left to the parser.
_LITERALS = {
    types.BOOLEAN: "true|false",
    types.INTEGER: "-?[0-9]{1,10}",
    types.BIGINT: "-?[0-9]{1,19}",
    types.DOUBLE: r"-?[0-9]++(?:\.[0-9]*+(?:[eE][-+]?[0-9]++)?|[eE][-+]?[0-9]++)|-?[0-9]{1,15}",
    types.TEXT: r"""'(?:[^'\\\r\n]++|\\[nrt'"\\])*+'""",
    types.TIMESTAMP: r"'[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?Z'",
    types.BYTEA: r"'\\x(?:[0-9a-fA-F]{2})*+'",
}
_ANY_LITERAL = r"""'(?:[^'\\]++|\\.)*+'|[^'(), ]++"""
_HEAD = re.compile(r"""INSERT INTO ([A-Za-z_][A-Za-z0-9_]*|"(?:[^"\\]|\\.)*") VALUES (?=\()""")


def _row(table: catalog.Table) -> str:
    """A pattern of one row of literals of the table's types."""
    return r"\(" + ", ".join(f"(?:NULL|{_LITERALS[c['type']]})" for c in table.columns) + r"\)"


def _value(literal: Column, kind: str) -> Column:
    """The value of a literal of ``_LITERALS``; that of a timestamp stays a text, which INSERT casts."""
    body = F.substring(literal, F.lit(2), F.char_length(literal) - 2)
    if kind in (types.TEXT, types.TIMESTAMP):

        def plain(piece: Column) -> Column:  # between escaped backslashes, any other one begins an escape
            for a, b in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\'", "'"), ('\\"', '"')):
                piece = F.replace(piece, F.lit(a), F.lit(b))
            return piece

        out = F.when(body.contains("\\"), F.array_join(F.transform(F.split(body, r"\\\\"), plain), "\\")).otherwise(body)
    elif kind == types.BYTEA:
        out = F.unhex(F.substring(body, F.lit(3), F.char_length(body)))
    elif kind == types.DOUBLE:
        out = F.when(literal.rlike("^-?[0-9]+$"), literal.try_cast("bigint").cast("double")).otherwise(literal.try_cast("double"))
    else:
        out = literal.cast(types.SPARK[kind])
    return F.when(literal != "NULL", out)


class _Script:
    """Statements of a script, of which the next can be looked at."""

    def __init__(self, source: TextIO):
        self.left = statements(source)
        self.next = next(self.left, None)

    def take(self) -> str:
        out, self.next = self.next, next(self.left, None)
        return out

    def rows(self, head: str, fits: re.Pattern) -> Iterator[str]:
        """The rows of the INSERTs that come next, as long as they have this head and fit."""
        while self.next is not None and (body := _body(self.next, head, fits)) is not None:
            self.take()
            yield body


def _body(sql: str, head: str, fits: re.Pattern) -> str | None:
    sql = sql.strip()
    return sql[len(head) : -1] if sql.startswith(head) and fits.fullmatch(sql, len(head)) else None


def restore(connection: Connection, source: TextIO) -> None:
    """Runs a script statement by statement. INSERTs of a transaction that follow each other as ``dump`` writes them are one batch, whose literals tasks read."""
    script = _Script(source)
    while script.next is not None:
        m = _HEAD.match(script.next.strip())
        table = _written(connection, m[1]) if m else None
        if table is not None:
            row = _row(table)
            fits = re.compile(f"{row}(?:, {row})*+;")
            if _body(script.next, m[0], fits) is not None:
                _restore_rows(connection, table, row, m[0], script.rows(m[0], fits))
                continue
        connection.execute(script.take())


def _written(connection: Connection, name: str) -> catalog.Table | None:
    """The table of a transaction's manifest, if INSERTs into it may be joined: outside of one each would be a commit."""
    token = tokens(name)[0]
    if connection.tx is None or token.kind != "name":
        return None
    entry = connection.tx.manifest["tables"].get(str(token.value).lower())
    return None if entry is None else catalog.Table(entry)


def _restore_rows(connection: Connection, table: catalog.Table, row: str, head: str, bodies: Iterator[str]) -> None:
    storage, db, source = connection.db.storage, connection.db, f"__{uuid.uuid4().hex}"
    spool = storage.spool(bodies)
    try:
        each = storage.spooled(spool).select(F.explode(F.regexp_extract_all("value", F.lit(row), F.lit(0))).alias("row"))
        each = each.select(F.regexp_extract_all("row", F.lit(_ANY_LITERAL), F.lit(0)).alias("literals"))
        db.register(source, each.select(*(_value(F.col("literals")[i], c["type"]).alias(c["name"]) for i, c in enumerate(table.columns))))
        listed = ", ".join(map(_quoted, table.names))
        try:
            connection.execute(f"INSERT INTO {_quoted(table.name)} ({listed}) SELECT {listed} FROM {_quoted(source)}")
        except EngineError:  # some statement is refused: those before it count, and its own error is told
            for body in storage.unspool(spool):
                connection.execute(f"{head}{body};")
    finally:
        db.external.pop(source, None)
        db.frames.pop(source, None)
        storage.forget(spool)


def save(connection: Connection, path: str) -> Database:
    """Copies the committed tables, indexes and sequences to a new database at ``path``."""
    import copy

    target = Database(connection.db.spark, path)
    if target.manifest["tables"] or target.manifest["sequences"]:
        raise BindError(f"there is a database at {path} already")
    m = copy.deepcopy(connection.db.manifest) | {"number": target.manifest["number"]}
    for entry in m["tables"].values():
        table = catalog.Table(entry)
        if entry["parts"]:
            entry["parts"] = [target.storage.write(connection.db.storage.read(entry["parts"], table.schema), table.primary)]
    target.manifest = target.storage.commit(m)
    return target
