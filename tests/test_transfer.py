"""CSV, dump and restore, copies, and the command line."""

from __future__ import annotations

import io

import pytest

import granary
from granary import cli
from granary.sources import transfer


@pytest.fixture
def c(spark):
    connection = granary.connect(spark)
    connection.execute(
        "CREATE SEQUENCE q START WITH 3 INCREMENT BY 2; CREATE TABLE t (k BIGINT PRIMARY KEY DEFAULT nextval('q'), i INT UNIQUE CHECK (i < 1000), d DOUBLE PRECISION NOT NULL DEFAULT 1.5, b BOOL, s TEXT, ts TIMESTAMP, y BYTEA);"
        "CREATE INDEX ix ON t (s, i DESC); INSERT INTO t (i, d, b, s, ts, y) VALUES (1, 2.25, true, 'it\\'s\\n\\\\ \"q\"', '2021-02-03T04:05:06.5Z', '\\x00FF'), (NULL, 1e300, NULL, NULL, NULL, NULL), (2, -0.0000001, false, '', '1999', '\\x')"
    )
    yield connection
    connection.close()


def rows(c, sql):
    return [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in c.execute(sql).rows()]


def test_dump_and_restore(c, spark):
    out = io.StringIO()
    transfer.dump(c, out)
    again = granary.connect(spark)
    transfer.restore(again, io.StringIO(out.getvalue()))
    assert rows(again, "SELECT * FROM t ORDER BY k") == rows(c, "SELECT * FROM t ORDER BY k")
    assert sorted(rows(again, "SELECT name, type, owner_table_name FROM __catalog"), key=str) == sorted(rows(c, "SELECT name, type, owner_table_name FROM __catalog"), key=str)
    assert rows(again, "INSERT INTO t (i) VALUES (50) RETURNING k") == rows(c, "INSERT INTO t (i) VALUES (50) RETURNING k")
    with pytest.raises(granary.ConstraintViolation):
        again.execute("INSERT INTO t (i) VALUES (50)")
    second = io.StringIO()
    transfer.dump(again, second, ["t"])
    assert "CREATE TABLE t" in second.getvalue()


def test_save(c, spark, tmp_path):
    transfer.save(c, str(tmp_path / "copy"))
    again = granary.connect(spark, str(tmp_path / "copy"))
    assert rows(again, "SELECT * FROM t ORDER BY k") == rows(c, "SELECT * FROM t ORDER BY k")
    with pytest.raises(granary.BindError):
        transfer.save(c, str(tmp_path / "copy"))


def test_csv(c, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('a,b,c d\n1,"x, ""y""",z\n2,,"two\nlines"\n')
    transfer.import_csv(c, str(path), "fresh")
    assert rows(c, 'SELECT a, b, "c d" FROM fresh ORDER BY a') == [("1", 'x, "y"', "z"), ("2", None, "two\nlines")]
    c.execute("CREATE TABLE typed (a INT PRIMARY KEY, b TEXT, \"c d\" TEXT)")
    transfer.import_csv(c, str(path), "typed")
    assert rows(c, "SELECT a FROM typed ORDER BY a") == [(1,), (2,)]


def test_script_output(c):
    out = io.StringIO()
    cli.run_script(c, "SELECT k, d, b, s, y FROM t WHERE i = 1; CREATE TABLE u (a INT PRIMARY KEY); SELECT 1 AS a, NULL AS b, 3.0 AS c", out)
    assert out.getvalue() == 'k|d|b|s|y\n3|2.25|true|"it\'s\n\\ "q""|"\\x00ff"\n\na|b|c\n1|NULL|3.0\n'


def test_shell(c, tmp_path):
    out = io.StringIO()
    script = ".tables\n.indexes t\n.schema\n.timer on\nSELECT 1\nAS a;\n.nope\nSELECT nope;\n.help\n.dump t\n.exit\nSELECT 2;\n"
    cli.Shell(c, out).run(io.StringIO(script))
    text = out.getvalue()
    for part in ("t\n", "ix\n", "CREATE TABLE t (", "a\n1\n", "Time: ", "error: unknown command", "error: no table specified", ".import csv", "INSERT INTO t VALUES"):
        assert part in text
    assert "\n2\n" not in text


def test_bench(spark):
    got = cli.bench(granary.connect(spark), "SELECT * FROM t", 4, 2, "CREATE TABLE t (a INT PRIMARY KEY)", True, True)
    assert [x["totalQueries"] for x in got] == [2, 4]


def test_scripts_are_read_by_statement():
    import io

    from granary.sources.transfer import statements

    script = "SELECT 'a;b\nc'; -- not; this\nSELECT \"x;\" /* ;\n; */, 1 - 2 / 3;\n\nSELECT `q;`\n"
    got = [x.strip() for x in statements(io.StringIO(script))]
    assert got == ["SELECT 'a;b\nc';", "-- not; this\nSELECT \"x;\" /* ;\n; */, 1 - 2 / 3;", "SELECT `q;`"]


def test_unknown_types_are_refused(spark):
    from decimal import Decimal

    import granary

    db = granary.Database(spark)
    df = spark.createDataFrame([(1, Decimal("1.5"))], "k int, d decimal(4, 2)").selectExpr("*", "DATE '2024-02-03' AS day")
    with pytest.raises(granary.EngineError, match="d \\(decimal"):
        db.register("t", df)
    db.register("t", df, partly=True)
    with db.connect() as c:
        assert c.query("SELECT k, day::TEXT AS day FROM t").collect()[0]["day"] == "2024-02-03T00:00:00Z"
    db.close()


def test_inserts_of_a_dump_are_restored_as_one_batch(spark, monkeypatch):
    import random

    c = granary.connect(spark)
    texts = ["", "NULL", "a, b), (1, 'x", "it's", "\\", "\\\\n", "\\'", "tab\there", "line\nend\r", '"q"', "\\x00", " é😀", "x" * 300_000 + "\\" * 5001, "');--"]
    values = [(i, texts[i % len(texts)], -0.0 if i == 7 else random.Random(i).uniform(-1, 1) * 10 ** (i % 40 - 20), i % 3 == 0 if i % 5 else None, None if i % 7 == 0 else f"19{i % 90 + 10}-02-03T04:05:06.{i:06d}Z", bytes([i % 256, 0]) if i % 4 else b"") for i in range(1300)]
    db = c.db
    db.register("given", spark.createDataFrame(values, "k long, s string, d double, b boolean, ts string, y binary"))
    c.execute('CREATE TABLE t (k BIGINT PRIMARY KEY, s TEXT, d DOUBLE PRECISION, b BOOL, ts TIMESTAMP, y BYTEA); INSERT INTO t (k, s, d, b, ts, y) SELECT k, s, d, b, ts, y FROM given')
    out = io.StringIO()
    transfer.dump(c, out)
    again, written = granary.connect(spark), []
    stage = granary.session.Transaction.stage
    monkeypatch.setattr(granary.session.Transaction, "stage", lambda tx, *a: written.append(stage(tx, *a)) or written[-1])
    transfer.restore(again, io.StringIO(out.getvalue()))
    assert [p["rows"] for p in written] == [1300]  # three statements of 500 rows at most
    assert rows(again, 'SELECT * FROM t ORDER BY k') == rows(c, 'SELECT * FROM t ORDER BY k')
    assert not again.db.external and not again.db.storage._names("spool")


def test_restore_stops_at_the_statement_that_is_refused(spark):
    c = granary.connect(spark)
    script = "BEGIN;\nCREATE TABLE t (k INT PRIMARY KEY, s TEXT);\nINSERT INTO t VALUES (1, 'a'), (2, NULL);\nINSERT INTO t VALUES (3, 'b'), (4, 'NULL');\nINSERT INTO t VALUES (2, 'c');\nINSERT INTO t VALUES (9, 'd');\nCOMMIT;\n"
    with pytest.raises(granary.ConstraintViolation):
        transfer.restore(c, io.StringIO(script))
    assert rows(c, "SELECT * FROM t ORDER BY k") == [(1, "a"), (2, None), (3, "b"), (4, "NULL")]
    c.execute("ROLLBACK")
    with pytest.raises(granary.EngineError):  # a number beyond the type
        transfer.restore(c, io.StringIO("BEGIN;\nCREATE TABLE t (k INT PRIMARY KEY);\nINSERT INTO t VALUES (7);\nINSERT INTO t VALUES (2999999999);\n"))
    assert rows(c, "SELECT * FROM t") == [(7,)]
    c.execute("ROLLBACK")
    transfer.restore(c, io.StringIO("BEGIN;\nCREATE TABLE t (k INT PRIMARY KEY, s TEXT);\nINSERT INTO t VALUES (1, 'a');\nINSERT INTO t VALUES (1 + 1, 'it\\'s');\nINSERT INTO t VALUES ('3', 4), (4, 'x;y');\nCOMMIT;\n"))
    assert rows(c, "SELECT * FROM t ORDER BY k") == [(1, "a"), (2, "it's"), (3, "4"), (4, "x;y")]
