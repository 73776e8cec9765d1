"""The command line: run SQL from standard input, dump, restore, time queries, or an interactive shell."""

from __future__ import annotations

import argparse
import sys
import time
from typing import TextIO

from pyspark.sql import SparkSession

from . import __version__, types
from .errors import EngineError
from .plans.parser import Parser
from .session import Connection, Result, connect
from .sources import transfer

HELP = {
    ".exit": "leave the shell",
    ".help": "this list",
    ".tables": "names of the tables",
    ".indexes [TABLE]": "names of the indexes",
    ".dump [TABLE ...]": "the script that makes the tables and rows",
    ".schema [TABLE ...]": "the script that makes the tables",
    ".save PATH": "copy the database to a new place",
    ".import csv FILE TABLE": "rows of a CSV file into a table",
    ".timer on|off": "tell how long statements take",
    ".restore FILE": "run a script",
}


def session() -> SparkSession:
    spark = SparkSession.builder.appName("granary").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shown(value: object, kind: str) -> str:
    if value is None:
        return "NULL"
    if kind == types.BOOLEAN:
        return str(value).lower()
    if kind == types.DOUBLE:
        near = value == 0 or 1e-6 <= abs(value) < 1e15
        text = f"{value:.17f}" if near and "e" in repr(value) else repr(value)
        return text if not near or "." not in text else text.rstrip("0").rstrip(".") + (".0" if float(value).is_integer() else "")
    if kind == types.TIMESTAMP:
        return f'"{value.isoformat()}Z"'
    if kind == types.BYTEA:
        return f"\"\\x{bytes(value).hex()}\""
    return f'"{value}"' if kind == types.TEXT else str(value)


def show(result: Result, out: TextIO) -> bool:
    """Writes a result as lines of fields; tells whether there was a row."""
    head = False
    if result.frame is None:
        return head
    for row in result.frame.toLocalIterator():
        if not head:
            out.write("|".join(result.columns) + "\n")
            head = True
        out.write("|".join(shown(v, k) for v, k in zip(row, result.types, strict=True)) + "\n")
    return head


def run_script(connection: Connection, sql: str, out: TextIO) -> None:
    """Runs statements one by one; results are set apart by an empty line."""
    before = False
    for statement in Parser(sql).script():
        result = connection._one(statement, ())
        if result.frame is not None and before:
            out.write("\n")
        before = show(result, out) or before


class Shell:
    def __init__(self, connection: Connection, out: TextIO):
        self.connection, self.out, self.timer = connection, out, False

    def command(self, line: str) -> bool:
        """Runs a dot command; False ends the shell."""
        name, *args = line.split()
        c, out = self.connection, self.out
        m = c.db.manifest
        if name in (".exit", "exit"):
            return False
        if name in (".help", "help"):
            out.writelines(f"{k:<26}{v}\n" for k, v in HELP.items())
        elif name == ".tables":
            out.writelines(f"{t}\n" for t in sorted(e["name"] for e in m["tables"].values()))
        elif name == ".indexes":
            if args:
                c.prepare(f"SELECT * FROM {args[0]}").execute()
            out.writelines(f"{x['name']}\n" for x in m["indexes"].values() if not args or x["table"] == args[0].lower())
        elif name == ".dump":
            transfer.dump(c, out, args)
        elif name == ".schema":
            out.writelines(f"{x}\n" for x in transfer.schema_lines(c, args))
        elif name == ".save" and len(args) == 1:
            transfer.save(c, args[0])
        elif name == ".import" and len(args) == 3 and args[0].lower() == "csv":
            transfer.import_csv(c, args[1], args[2])
        elif name == ".timer" and args in (["on"], ["off"]):
            self.timer = args == ["on"]
        elif name == ".restore" and len(args) == 1:
            with open(args[0], encoding="utf-8") as f:
                transfer.restore(c, f)
        else:
            raise EngineError(f"unknown command {line!r}; see .help")
        return True

    def run(self, lines: TextIO) -> None:
        held = ""
        for line in lines:
            try:
                if not held and line.strip() in ("exit", "help") or not held and line.startswith("."):
                    if not self.command(line.strip()):
                        return
                    continue
                held += line
                if not held.rstrip().endswith(";"):
                    continue
                sql, held = held, ""
                began = time.time()
                run_script(self.connection, sql, self.out)
                if self.timer:
                    self.out.write(f"Time: {time.time() - began:.3f}s\n")
            except Exception as e:
                held = ""
                self.out.write(f"error: {e}\n")


def bench(connection: Connection, sql: str, number: int, sample: int, init: str = "", transaction: bool = False, prepare: bool = False) -> list[dict]:
    """Average time of ``sample`` runs at a time, ``number`` in all."""
    if init:
        connection.execute(init)
    if transaction:
        connection.execute("BEGIN")
    ready, out, began = connection.prepare(sql) if prepare else None, [], time.time()
    for first in range(0, number, sample):
        at, n = time.time(), min(sample, number - first)
        for _ in range(n):
            (ready.execute() if ready else connection.execute(sql)).rows()
        took = time.time() - at
        out.append({"totalQueries": first + n, "averageDuration": took / n, "queriesPerSecond": n / took, "totalDuration": time.time() - began})
    if transaction:
        connection.execute("COMMIT")
    return out


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser("granary", description=__doc__)
    commands = top.add_subparsers(dest="command")
    run = commands.add_parser("run", help="run SQL from standard input, or a shell on a terminal")
    run.add_argument("path", nargs="?", default=":memory:")
    commands.add_parser("version", help="the version")
    d = commands.add_parser("dump", help="write a database as a script")
    d.add_argument("path")
    d.add_argument("-f", "--file")
    d.add_argument("-t", "--table", action="append", default=[])
    r = commands.add_parser("restore", help="make a database from a script")
    r.add_argument("file")
    r.add_argument("path")
    b = commands.add_parser("bench", help="time a query")
    b.add_argument("sql")
    b.add_argument("-p", "--path", default=":memory:")
    b.add_argument("-i", "--init", default="")
    b.add_argument("-n", "--number", type=int, default=100)
    b.add_argument("-s", "--sample", type=int, default=10)
    b.add_argument("-t", "--tx", action="store_true")
    b.add_argument("--prepare", action="store_true")
    b.add_argument("--csv", action="store_true")
    a = top.parse_args(argv)
    if a.command == "version":
        print(__version__)
        return 0
    connection = connect(session(), getattr(a, "path", ":memory:"))
    try:
        if a.command == "dump":
            with open(a.file, "w", encoding="utf-8") if a.file else sys.stdout as out:
                transfer.dump(connection, out, a.table)
        elif a.command == "restore":
            with open(a.file, encoding="utf-8") as f:
                transfer.restore(connection, f)
        elif a.command == "bench":
            for i, x in enumerate(bench(connection, a.sql, a.number, a.sample, a.init, a.tx, a.prepare)):
                if a.csv and not i:
                    print(",".join(x))
                print(",".join(map(str, x.values())) if a.csv else x)
        elif sys.stdin.isatty():
            Shell(connection, sys.stdout).run(sys.stdin)
        else:
            run_script(connection, sys.stdin.read(), sys.stdout)
        return 0
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    finally:
        connection.close()
        connection.db.close()
