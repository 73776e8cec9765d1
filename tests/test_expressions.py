"""Expressions: every operator, the cast matrix, functions, errors; many at a time in one query each."""

from __future__ import annotations

import math
from datetime import datetime

import pytest

import granary

GOOD = {
    # literals and their types
    "1": 1, "-1": -1, "typeof(1)": "integer", "typeof(-2147483648)": "integer", "typeof(2147483648)": "bigint", "typeof(9223372036854775808)": "double precision",
    "1.5": 1.5, "typeof(1.0)": "double precision", "typeof('a')": "text", "typeof('\\xAF')": "bytea", "typeof(true)": "boolean", "typeof(NULL)": "null",
    "typeof(now())": "timestamp", "'a\\'b\\n'": "a'b\n", ".5": 0.5, "1e3": 1000.0, "1.234567890123456e-15": 1.234567890123456e-15,
    # arithmetic
    "1 + 1 * 2 / 4": 1, "10 / 6": 1, "-7 / 2": -3, "10 % 6": 4, "-7 % 3": -1, "10 & 6": 2, "10 | 6": 14, "10 ^ 6": 12, "1 + 1.5": 2.5, "10 * -10": -100,
    "1 + NULL": None, "1 / NULL": None, "1 + '2'": None, "1 + true": None, "1.5 & 1": None, "1 / 0.0": None, "2147483648 / 0": None, "1 % 0": None, "5.0 / 2": 2.5,
    "typeof(1 + 2147483648)": "bigint", "typeof(1 + 1.0)": "double precision", "1 + 2 * 3 - 4": 3, "(1 + 2) * 3": 9, "7 | 8 & 3": 3, "typeof(7 / 2)": "integer",
    # comparison
    "1 = 1": True, "1 == 1": True, "1 <> 2": True, "1 != 1": False, "1 < 1.0": False, "2 > 1.5": True, "1 = '1'": True, "'1' = 1": False, "2147483648 = '2147483648'": False,
    "1.5 = '1.5'": False, "1.5 != 'x'": True, "true = 't'": True, "true > 't'": False, "true > false": True, "'a' < 'b'": True, "'a' < 'B'": False, "1 = NULL": None, "NULL = NULL": None,
    "'\\xAF' = '\\xAF'": True, "1 BETWEEN 1 AND 2": True, "3 BETWEEN 1 AND 2": False, "5 BETWEEN NULL AND 1": None, "5 BETWEEN 1 AND NULL": None,
    "1 IN (1, 2)": True, "1 IN (2, NULL)": False, "1 NOT IN (2, NULL)": True, "NULL IN (1)": None, "1 IN (1.0, 5)": True, "'a' IN ('b', 'a')": True, "1 NOT IN (1, NULL)": False,
    "NULL IS NULL": True, "1 IS NULL": False, "1 IS NOT NULL": True, "1 IS 1": True, "1 IS NOT 2": True, "NULL IS NOT NULL": False,
    "'Hello' LIKE 'h_LL%'": True, "'50%' LIKE '50\\\\%'": True, "'505' LIKE '50\\\\%'": False, "'abc' NOT LIKE 'B%'": True, "1 LIKE '1'": None, "'a' LIKE NULL": None, "'É' LIKE 'é'": True, "'ab' LIKE 'a\\\\b'": True,
    # logic
    "NOT NULL": True, "NULL AND true": False, "NULL OR true": True, "NULL OR false": False, "NOT 1": False, "NOT 0": True, "1 AND 'a'": True, "1 AND ''": False, "0.0 OR 0": False,
    "NOT true AND false": True, "false AND 1 / 0 = 1": False, "true OR 1 / 0 = 1": True, "NOT '\\xAF'": False,
    # concatenation
    "'a' || 'b'": "ab", "'a' || 1": None, "'a' || NULL": None, "'a'::TEXT || 'B'": "aB",
    # casts
    "CAST(1 AS BOOL)": True, "CAST(0 AS BOOLEAN)": False, "CAST(1 AS DOUBLE PRECISION)": 1.0, "CAST(1 AS TEXT)": "1", "CAST(1.9 AS INTEGER)": 1, "CAST(-1.9 AS INT)": -1, "CAST(1.1 AS TEXT)": "1.1",
    "CAST(true AS INTEGER)": 1, "CAST(true AS TEXT)": "true", "CAST('100' AS INTEGER)": 100, "CAST('100.5' AS INTEGER)": 100, "CAST('3' AS DOUBLE PRECISION)": 3.0, "'oFF'::BOOL": False, "'y'::BOOL": True,
    "'Z3JhaW4g/w=='::BYTEA": b"grain \xff", "'\\x677261696e20ff'::TEXT": "Z3JhaW4g/w==", "3.0::TEXT": "3", "100::INTEGER::DOUBLE PRECISION": 100.0, "NULL::INT": None, "5::SMALLINT": 5, "typeof(5::INT8)": "bigint",
    "12345678.5::TEXT": "12345678.5", "123456789012345.0::TEXT": "123456789012345", "1234567890123456.0::TEXT": "1.234567890123456e+15", "0.000001::TEXT": "0.000001", "0.00000012::TEXT": "1.2e-07", "1e20::TEXT": "1e+20", "-0.5::TEXT": "-0.5",
    "'2023'::TIMESTAMP": datetime(2023, 1, 1), "'2021-03-04T05:06:07Z'::TIMESTAMP": datetime(2021, 3, 4, 5, 6, 7), "'2021-03-04 05:06:07.25'::TIMESTAMP": datetime(2021, 3, 4, 5, 6, 7, 250000),
    "'2021-03-04T05:06:07+02:00'::TIMESTAMP": datetime(2021, 3, 4, 3, 6, 7), "'2021-03-04'::TIMESTAMP::TEXT": "2021-03-04T00:00:00Z", "'x'::VARCHAR(3)": "x",
    # functions
    "len('é')": 2, "len(1)": None, "lower('HeLLo')": "hello", "upper('a1')": "A1", "upper('straße ﬁn ᾀé')": "STRAßE ﬁN ᾈÉ", "lower('ΟΔΟΣ İÉ')": "οδοσ ié", "lower(42)": None, "trim('  a ')": "a", "trim('!a!', '!')": "a", "ltrim('xxa', 'x')": "a", "rtrim('axy', 'yx')": "a", "trim(1)": None, "trim('a', 1)": None,
    "coalesce(NULL, 1, 2)": 1, "coalesce(NULL, 'a')": "a", "coalesce(NULL, 1, 2.5)": 1.0, "COALESCE(NULL)": None, "floor(1.7)": 1.0, "floor(-1.2)": -2.0, "floor(3)": 3, "abs(-3)": 3, "abs(-3.5)": 3.5, "abs('-2')": 2.0, "abs(NULL)": None,
    "acos(1)": 0.0, "acosh(1)": 0.0, "asin(0)": 0.0, "asinh(0)": 0.0, "atan(0)": 0.0, "atan2(0, 1)": 0.0, "atan2(1.0, 1.0)": math.pi / 4, "sqrt(4)": 2.0, "sqrt(2.25)": 1.5, "sqrt(2147483648)": None, "sqrt('4')": None, "sqrt(NULL)": None,
    "typeof(random())": "bigint",
}

BAD = [
    "1 / 0", "a", "1 + a", "1000000000 * 1000000000", "true > 1", "true = 1", "1 = 'a'", "CAST(1 AS BYTEA)", "CAST(1.1 AS BOOL)", "CAST(true AS DOUBLE PRECISION)", "CAST('a' AS INTEGER)", "CAST('10.5wd' AS DOUBLE PRECISION)",
    "CAST('\\xAF' AS INT)", "CAST(1e20 AS BIGINT)", "'maybe'::BOOL", "'x'::TIMESTAMP", "'!'::BYTEA", "acos(2)", "asin(-1.5)", "acosh(0.5)", "floor('a')", "floor(NULL)", "abs(true)", "nosuch(1)", "len()", "trim('a', 'b', 'c')", "now(1)",
    "nextval('none')", "COUNT(1)", "MAX(3)", "*", "1 NOT BETWEEN 1 AND 2", "(1 + 1) IN (2)", "-'a'", "'a\\q'", "1 IS", "CAST(1 AS JSON)", "$1", "1 2", "'open", "abs(-2147483648)", "1::TIMESTAMP",
]


@pytest.fixture(scope="module")
def connection(spark):
    with granary.connect(spark) as c:
        yield c


def same(a, b):
    if isinstance(b, float) and a is not None:
        return isinstance(a, float) and math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-15)
    return (bytes(a) if isinstance(a, bytearray) else a) == b and type(a) in (type(b), bytearray)


def test_values(connection):
    items = list(GOOD.items())
    for i in range(0, len(items), 60):
        part = items[i : i + 60]
        row = connection.execute("SELECT " + ", ".join(f"{e} AS c{k}" for k, (e, _) in enumerate(part))).rows()[0]
        wrong = [(e, row[k], want) for k, (e, want) in enumerate(part) if not same(row[k], want)]
        assert not wrong


@pytest.mark.parametrize("expression", BAD)
def test_errors(connection, expression):
    with pytest.raises(granary.EngineError):
        connection.execute(f"SELECT {expression}").rows()


#: The same expressions over a column, where nothing is known before the rows are read.
COLUMN = {
    "i + 1": [2, None], "i / 2": [0, None], "i = '1'": [True, None], "NOT i = 1": [False, True], "i IN (1, NULL)": [True, None], "i NOT IN (5, NULL)": [True, None], "i IS 1": [True, False], "i BETWEEN 0 AND 2": [True, None],
    "t LIKE 'A%'": [True, None], "t || 'x'": ["abcx", None], "i AND t": [True, False], "i OR t": [True, False], "typeof(i)": ["integer", "null"], "coalesce(i, 9)": [1, 9], "d::TEXT": ["2.5", None], "d::INT": [2, None],
    "b::TEXT": ["true", None], "b::INT": [1, None], "ts::TEXT": ["2020-01-02T03:04:05Z", None], "ts = '2020-01-02T03:04:05Z'": [True, None], "ts > '2019'": [True, None], "y::TEXT": ["/w==", None], "len(t)": [3, None], "upper(t)": ["ABC", None],
    "big = '5'": [True, None], "big / 0": [None, None], "d / 0": [None, None], "i % 0": [None, None], "sqrt(big)": [None, None], "i < d": [True, None], "i IN (1.0)": [True, None], "d IN (2.5, 7)": [True, None], "t > 'abb'": [True, None], "b = 'yes'": [True, None],
    "floor(d)": [2.0, None], "abs(i - 5)": [4, None], "NOT (i = 1 AND d > 2)": [False, True], "NOT (i = 7 OR d > 20)": [True, True], "i != 1": [False, None], "NOT i != 1": [True, True], "NOT (i BETWEEN 5 AND 6)": [True, True],
}


def test_columns(connection):
    connection.execute("CREATE TABLE v (k INT PRIMARY KEY, i INT, big BIGINT, d DOUBLE PRECISION, b BOOL, t TEXT, ts TIMESTAMP, y BYTEA)")
    connection.execute("INSERT INTO v VALUES (1, 1, 5, 2.5, true, 'abc', '2020-01-02T03:04:05Z', '\\xFF'), (2, NULL, NULL, NULL, NULL, NULL, NULL, NULL)")
    rows = connection.execute("SELECT " + ", ".join(f"{e} AS c{k}" for k, e in enumerate(COLUMN)) + " FROM v ORDER BY k").rows()
    wrong = [(e, [r[k] for r in rows], want) for k, (e, want) in enumerate(COLUMN.items()) if not all(same(r[k], w) for r, w in zip(rows, want, strict=True))]
    assert not wrong
    for e in COLUMN:  # as a filter, where NULL and false are alike
        want = [k for k, (r, v) in enumerate(zip(rows, COLUMN[e], strict=True), 1) if v is not None and v not in (False, 0, "", 0.0)]
        assert [r["k"] for r in connection.execute(f"SELECT k FROM v WHERE {e} ORDER BY k").rows()] == want, e
    for e in ("i / 0", "i = 'x'", "z", "b = 1", "i::BYTEA", "v.i"):
        with pytest.raises(granary.EngineError):
            connection.execute(f"SELECT {e} FROM v").rows()


def test_filters_reach_the_scan(connection, spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    df = connection.query("SELECT k FROM v WHERE i <= 4 AND d > 1 AND NOT t = 'x' AND k IN (1, 2) AND NOT (i > 3 OR d < 0)")
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    for part in ("LessThanOrEqual(i,4)", "GreaterThan(d,1.0)", "In(k, [1,2])", "EqualTo(t,x)"):
        assert part in pushed, pushed
    assert "ReadSchema: struct<k:int,i:int,d:double,t:string>" in plan
