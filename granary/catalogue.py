"""The registered queries of the engine, each with the SQL that DuckDB runs over the same tables.

A query is a script of the dialect over whole tables; its last statement is the result.
``CASES`` maps a name to (script, oracle); ``PROGRAMS`` are what takes more than one script.
"""

from __future__ import annotations

import io
import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EngineError
from .session import Connection, Database
from .sources import transfer
from .sources.storage import own_root

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels", "pages", "conversations")


def open_tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> Connection:
    """A connection that sees the Parquet tables of ``sf_dir``."""
    db = Database(spark)
    for name in names:
        db.register(name, f"{sf_dir}/{name}.parquet")
    return db.connect()


def run(spark: SparkSession, sf_dir: str, script: str, *params: object) -> DataFrame:
    used = tuple(t for t in TABLES if re.search(rf"\b{t}\b", script))
    return open_tables(spark, sf_dir, used).query(script, *params)


#: A nullable column for queries that need one: NULL where the key is even.
_ODD = "o_custkey / (o_custkey % 2)"
_ODD_SQL = "CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE o_custkey END"

_NULLABLE = f"""
CREATE TABLE t (k BIGINT PRIMARY KEY, a BIGINT, s TEXT, p DOUBLE PRECISION);
INSERT INTO t (k, a, s, p) SELECT o_orderkey, {_ODD}, o_orderpriority, o_totalprice FROM orders;
"""
_NULLABLE_SQL = f"(SELECT o_orderkey AS k, {_ODD_SQL} AS a, o_orderpriority AS s, o_totalprice AS p FROM orders)"

_COPY = """
CREATE TABLE t (k BIGINT PRIMARY KEY, c BIGINT, s TEXT, p DOUBLE PRECISION);
INSERT INTO t (k, c, s, p) SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders;
"""
_COPY_SQL = "SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_totalprice AS p FROM orders"

CASES: dict[str, tuple[str, str | None]] = {
    # -- scans, filters
    "scan_all": ("SELECT * FROM nation", "SELECT * FROM nation"),
    "scan_columns": ("SELECT l_orderkey, l_shipdate FROM lineitem", "SELECT l_orderkey, l_shipdate FROM lineitem"),
    "filter_eq": ("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"),
    "filter_neq": ("SELECT o_orderkey FROM orders WHERE o_orderstatus != 'F'", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'"),
    "filter_lt": ("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity < 10", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity < 10"),
    "filter_lte": ("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity <= 10", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity <= 10"),
    "filter_gt": ("SELECT p_partkey FROM part WHERE p_size > 25", "SELECT p_partkey FROM part WHERE p_size > 25"),
    "filter_gte": ("SELECT p_partkey FROM part WHERE p_size >= 25", "SELECT p_partkey FROM part WHERE p_size >= 25"),
    "filter_between": ("SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 10 AND 50", "SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 10 AND 50"),
    "filter_in": ("SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 2, 3, NULL)", "SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 2, 3)"),
    "filter_not_in_null": ("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (1, 2, 3, NULL)", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (1, 2, 3)"),
    "filter_is_null": (f"{_NULLABLE} SELECT k FROM t WHERE a IS NULL", f"SELECT k FROM {_NULLABLE_SQL} WHERE a IS NULL"),
    "filter_is_not": (f"{_NULLABLE} SELECT k FROM t WHERE a IS NOT 7", f"SELECT k FROM {_NULLABLE_SQL} WHERE a IS DISTINCT FROM 7"),
    "filter_is_value": (f"{_NULLABLE} SELECT k FROM t WHERE a IS 7", f"SELECT k FROM {_NULLABLE_SQL} WHERE a IS NOT DISTINCT FROM 7"),
    "filter_like_ci": ("SELECT p_partkey, p_name FROM part WHERE p_brand LIKE 'BRAND#1%'", "SELECT p_partkey, p_name FROM part WHERE p_brand ILIKE 'brand#1%'"),
    "filter_not_like": ("SELECT p_partkey FROM part WHERE p_type NOT LIKE '%\\\\_A%'", "SELECT p_partkey FROM part WHERE p_type NOT ILIKE '%\\_a%' ESCAPE '\\'"),
    "filter_and_or_not": (
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 4 AND (l_quantity > 40 OR NOT l_returnflag = 'N')",
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 4 AND (l_quantity > 40 OR NOT l_returnflag = 'N')",
    ),
    "filter_not_two_valued": (f"{_NULLABLE} SELECT k FROM t WHERE NOT a = 7", f"SELECT k FROM {_NULLABLE_SQL} WHERE NOT coalesce(a = 7, false)"),
    "filter_not_takes_all": ("SELECT o_orderkey FROM orders WHERE NOT o_custkey > 10 AND o_orderstatus = 'F'", "SELECT o_orderkey FROM orders WHERE NOT (o_custkey > 10 AND o_orderstatus = 'F')"),
    "filter_truthy_int": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber % 2", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber % 2 <> 0"),
    "filter_truthy_text": ("SELECT c_custkey FROM customer WHERE TRIM(c_mktsegment, 'BUILDNG')", "SELECT c_custkey FROM customer WHERE trim(c_mktsegment, 'BUILDNG') <> ''"),
    "filter_timestamp_text": ("SELECT o_orderkey FROM orders WHERE o_orderdate >= '1996-01-01'", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'"),
    "filter_mixed_types": ("SELECT COUNT(*) AS n FROM orders WHERE o_custkey = '7' OR o_orderstatus = 'F'", "SELECT count(*) AS n FROM orders WHERE o_custkey = 7 OR o_orderstatus = 'F'"),
    "filter_guarded_division": ("SELECT l_orderkey FROM lineitem WHERE l_linenumber - 1 != 0 AND 10 / (l_linenumber - 1) > 3", "SELECT l_orderkey FROM lineitem WHERE l_linenumber <> 1 AND 10 // (CASE WHEN l_linenumber = 1 THEN 1 ELSE l_linenumber - 1 END) > 3"),
    # -- projection, operators
    "project_arith": ("SELECT l_orderkey, l_linenumber + 1 AS a, l_linenumber - 10 AS b, l_quantity * 2 AS c FROM lineitem", "SELECT l_orderkey, l_linenumber + 1 AS a, l_linenumber - 10 AS b, l_quantity * 2 AS c FROM lineitem"),
    "project_intdiv": ("SELECT l_orderkey, (l_linenumber - 4) / 2 AS a, l_orderkey / 7 AS b FROM lineitem", "SELECT l_orderkey, (l_linenumber - 4) // 2 AS a, l_orderkey // 7 AS b FROM lineitem"),
    "project_double_div": ("SELECT l_orderkey, l_quantity / 4 AS a, l_quantity / (l_linenumber - 1) AS b FROM lineitem", "SELECT l_orderkey, l_quantity / 4 AS a, l_quantity / nullif(l_linenumber - 1, 0) AS b FROM lineitem"),
    "project_mod_zero": ("SELECT o_orderkey, o_custkey % (o_custkey % 2) AS a, o_custkey % 7 AS b FROM orders", "SELECT o_orderkey, o_custkey % nullif(o_custkey % 2, 0) AS a, o_custkey % 7 AS b FROM orders"),
    "project_bitwise": ("SELECT o_orderkey, o_custkey & 12 AS a, o_custkey | 3 AS b, o_custkey ^ 5 AS c FROM orders", "SELECT o_orderkey, o_custkey & 12 AS a, o_custkey | 3 AS b, xor(o_custkey, 5) AS c FROM orders"),
    "project_concat": ("SELECT p_partkey, p_brand || '/' || p_type AS a, p_brand || p_size AS b FROM part", "SELECT p_partkey, p_brand || '/' || p_type AS a, CAST(NULL AS VARCHAR) AS b FROM part"),
    "project_comparisons": (f"{_NULLABLE} SELECT k, a > 50 AS x, a = 7 AND p > 10 AS y, a BETWEEN 1 AND 9 AS z FROM t", f"SELECT k, a > 50 AS x, coalesce(a = 7, false) AND p > 10 AS y, a BETWEEN 1 AND 9 AS z FROM {_NULLABLE_SQL}"),
    "project_between_null": ("SELECT o_orderkey, o_custkey BETWEEN NULL AND 5 AS a FROM orders", "SELECT o_orderkey, CAST(NULL AS BOOLEAN) AS a FROM orders"),
    "project_in_null": (f"{_NULLABLE} SELECT k, a IN (1, 3, NULL) AS x, a NOT IN (1, NULL) AS y FROM t", f"SELECT k, a IN (1, 3) AS x, a NOT IN (1) AS y FROM {_NULLABLE_SQL}"),
    "project_like": ("SELECT p_partkey, p_name LIKE '%A%' AS a, p_size LIKE '1%' AS b FROM part", "SELECT p_partkey, p_name ILIKE '%a%' AS a, CAST(NULL AS BOOLEAN) AS b FROM part"),
    "project_no_from": ("SELECT 1 + 1 * 2 / 4 AS a, 'x' || 'y' AS b, 10 % 6 AS c, NOT NULL AS d", "SELECT 1 AS a, 'xy' AS b, 4 AS c, true AS d"),
    "project_names": ("SELECT n_nationkey    +   1, n_name FROM nation", 'SELECT n_nationkey + 1 AS "n_nationkey + 1", n_name FROM nation'),
    "project_star_and_more": ("SELECT *, r_regionkey * 10 AS x FROM region", "SELECT *, r_regionkey * 10 AS x FROM region"),
    # -- casts
    "cast_int": ("SELECT l_orderkey, l_linenumber::BIGINT AS a, l_linenumber::DOUBLE PRECISION AS b, l_linenumber::TEXT AS c, (l_linenumber - 1)::BOOL AS d FROM lineitem", "SELECT l_orderkey, l_linenumber::BIGINT AS a, l_linenumber::DOUBLE AS b, l_linenumber::VARCHAR AS c, l_linenumber <> 1 AS d FROM lineitem"),
    "cast_bigint": ("SELECT o_custkey::INTEGER AS a, o_custkey::DOUBLE PRECISION AS b, o_custkey::TEXT AS c, o_custkey::BOOLEAN AS d FROM orders", "SELECT o_custkey::INTEGER AS a, o_custkey::DOUBLE AS b, o_custkey::VARCHAR AS c, o_custkey <> 0 AS d FROM orders"),
    "cast_double": ("SELECT l_extendedprice::INTEGER AS a, l_extendedprice::BIGINT AS b, l_quantity::TEXT AS c FROM lineitem", "SELECT trunc(l_extendedprice)::INTEGER AS a, trunc(l_extendedprice)::BIGINT AS b, l_quantity::BIGINT::VARCHAR AS c FROM lineitem"),
    "cast_bool": ("SELECT (p_size > 10)::INTEGER AS a, (p_size > 10)::TEXT AS b FROM part", "SELECT (p_size > 10)::INTEGER AS a, (p_size > 10)::VARCHAR AS b FROM part"),
    "cast_text": ("SELECT (p_size::TEXT || '.75')::INTEGER AS a, (p_size::TEXT || '.5')::DOUBLE PRECISION AS b, CAST(p_size::TEXT AS BIGINT) AS c, 'oN'::BOOL AS d FROM part", "SELECT p_size AS a, p_size + 0.5::DOUBLE AS b, p_size::BIGINT AS c, true AS d FROM part"),
    "cast_timestamp": ("SELECT ts::TEXT AS a, '2021-03-04T05:06:07Z'::TIMESTAMP AS b FROM events", "SELECT regexp_replace(replace(ts::VARCHAR, ' ', 'T'), '(\\.\\d*?)0+$', '\\1') || 'Z' AS a, TIMESTAMP '2021-03-04 05:06:07' AS b FROM events"),
    "cast_bytea": ("SELECT p_partkey, CAST(CAST('Z3JhaW5z' AS BYTEA) AS TEXT) AS a FROM part", "SELECT p_partkey, base64(from_base64('Z3JhaW5z')) AS a FROM part"),
    "cast_null": ("SELECT NULL::INT AS a, NULL::TEXT AS b, NULL::BOOL AS c FROM region", "SELECT NULL::INT AS a, NULL::VARCHAR AS b, NULL::BOOLEAN AS c FROM region"),
    # -- functions
    "fn_typeof": (f"{_NULLABLE} SELECT k, typeof(a) AS x, typeof(p) AS y, typeof(s) AS z FROM t", f"SELECT k, CASE WHEN a IS NULL THEN 'null' ELSE 'bigint' END AS x, 'double precision' AS y, 'text' AS z FROM {_NULLABLE_SQL}"),
    "fn_len": ("SELECT doc_id, len(text) AS a, len(n_chars) AS b FROM documents", "SELECT doc_id, octet_length(encode(text))::BIGINT AS a, CAST(NULL AS BIGINT) AS b FROM documents"),
    "fn_coalesce": (f"{_NULLABLE} SELECT k, coalesce(a, k) AS x, coalesce(NULL, a, 1.5) AS y FROM t", f"SELECT k, coalesce(a, k) AS x, coalesce(a::DOUBLE, 1.5::DOUBLE) AS y FROM {_NULLABLE_SQL}"),
    "fn_lower": ("SELECT lower(p_brand) AS a, lower(p_size) AS b FROM part", "SELECT lower(p_brand) AS a, CAST(NULL AS VARCHAR) AS b FROM part"),
    "fn_upper": ("SELECT upper(p_name) AS a, upper(p_size) AS b FROM part", "SELECT upper(p_name) AS a, CAST(NULL AS VARCHAR) AS b FROM part"),
    "fn_trim": ("SELECT trim('  ' || p_name || ' ') AS a, trim(p_brand, 'Brand#1') AS b FROM part", "SELECT trim('  ' || p_name || ' ', ' ') AS a, trim(p_brand, 'Brand#1') AS b FROM part"),
    "fn_ltrim": ("SELECT ltrim('  ' || p_name || ' ') AS a, ltrim(p_brand, 'Brand#') AS b FROM part", "SELECT ltrim('  ' || p_name || ' ', ' ') AS a, ltrim(p_brand, 'Brand#') AS b FROM part"),
    "fn_rtrim": ("SELECT rtrim('  ' || p_name || ' ') AS a, rtrim(p_brand, '12345') AS b FROM part", "SELECT rtrim('  ' || p_name || ' ', ' ') AS a, rtrim(p_brand, '12345') AS b FROM part"),
    "fn_floor": ("SELECT floor(c_acctbal) AS a, floor(c_nationkey) AS b FROM customer", "SELECT floor(c_acctbal) AS a, c_nationkey AS b FROM customer"),
    "fn_abs": ("SELECT abs(c_acctbal) AS a, abs(c_nationkey - 10) AS b FROM customer", "SELECT abs(c_acctbal) AS a, abs(c_nationkey - 10) AS b FROM customer"),
    "fn_acos": ("SELECT floor(acos(l_discount) * 1000000) AS a FROM lineitem", "SELECT floor(acos(l_discount) * 1000000) AS a FROM lineitem"),
    "fn_acosh": ("SELECT floor(acosh(l_quantity) * 1000000) AS a FROM lineitem", "SELECT floor(acosh(l_quantity) * 1000000) AS a FROM lineitem"),
    "fn_asin": ("SELECT floor(asin(l_discount) * 1000000) AS a FROM lineitem", "SELECT floor(asin(l_discount) * 1000000) AS a FROM lineitem"),
    "fn_asinh": ("SELECT floor(asinh(l_quantity) * 1000000) AS a FROM lineitem", "SELECT floor(asinh(l_quantity) * 1000000) AS a FROM lineitem"),
    "fn_atan": ("SELECT floor(atan(l_quantity) * 1000000) AS a FROM lineitem", "SELECT floor(atan(l_quantity) * 1000000) AS a FROM lineitem"),
    "fn_atan2": ("SELECT floor(atan2(l_quantity, l_linenumber) * 1000000) AS a FROM lineitem", "SELECT floor(atan2(l_quantity, l_linenumber) * 1000000) AS a FROM lineitem"),
    "fn_sqrt": ("SELECT sqrt(l_quantity) AS a, sqrt(l_linenumber) AS b, sqrt(l_orderkey) AS c FROM lineitem", "SELECT sqrt(l_quantity) AS a, sqrt(l_linenumber) AS b, CAST(NULL AS DOUBLE) AS c FROM lineitem"),
    "fn_random": ("SELECT r_regionkey, random() >= 0 AS a, typeof(random()) AS b FROM region", "SELECT r_regionkey, true AS a, 'bigint' AS b FROM region"),
    "fn_now": ("SELECT r_regionkey, now() = now() AS a, typeof(now()) AS b FROM region", "SELECT r_regionkey, true AS a, 'timestamp' AS b FROM region"),
    "fn_nextval": ("CREATE SEQUENCE q START WITH 5 INCREMENT BY 10; SELECT nextval('q') AS a, nextval('q') AS b", "SELECT 5::BIGINT AS a, 15::BIGINT AS b"),
    # -- aggregates, groups
    "agg_flagship": (
        "SELECT l_returnflag, COUNT(*) AS n, SUM(l_quantity) AS q, AVG(l_quantity) AS m, MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM lineitem WHERE l_linenumber <= 4 GROUP BY l_returnflag",
        "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q, avg(l_quantity) AS m, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem WHERE l_linenumber <= 4 GROUP BY l_returnflag",
    ),
    "agg_global": ("SELECT COUNT(*) AS n, SUM(l_linenumber) AS s, AVG(l_linenumber) AS m, COUNT(*) + 1 AS o FROM lineitem", "SELECT count(*) AS n, sum(l_linenumber)::BIGINT AS s, avg(l_linenumber) AS m, count(*) + 1 AS o FROM lineitem"),
    "agg_empty": ("SELECT COUNT(*) AS n, AVG(l_quantity) AS m, SUM(l_quantity) AS s, MIN(l_quantity) AS lo FROM lineitem WHERE l_quantity < 0", "SELECT 0::BIGINT AS n, 0::DOUBLE AS m, CAST(NULL AS DOUBLE) AS s, CAST(NULL AS DOUBLE) AS lo"),
    "agg_count_column": (f"{_NULLABLE} SELECT COUNT(a) AS n, COUNT(*) AS m FROM t", f"SELECT count(a) AS n, count(*) AS m FROM {_NULLABLE_SQL}"),
    "agg_sum": (f"{_NULLABLE} SELECT SUM(a) AS x, SUM(k) AS y, SUM(s) AS z FROM t", f"SELECT sum(a)::BIGINT AS x, sum(k)::BIGINT AS y, CAST(NULL AS BIGINT) AS z FROM {_NULLABLE_SQL}"),
    "agg_min_max": ("SELECT MIN(o_orderpriority) AS a, MAX(o_orderpriority) AS b, MIN(o_orderdate) AS c, MAX(o_orderdate) AS d FROM orders", "SELECT min(o_orderpriority) AS a, max(o_orderpriority) AS b, min(o_orderdate) AS c, max(o_orderdate) AS d FROM orders"),
    "agg_avg_text": ("SELECT AVG(o_orderpriority) AS a FROM orders", "SELECT 0::DOUBLE AS a"),
    "group_column": ("SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY c_mktsegment", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1"),
    "group_expr": ("SELECT l_orderkey / 100 AS g, COUNT(*) AS n, MAX(l_quantity) AS q FROM lineitem GROUP BY l_orderkey / 100", "SELECT l_orderkey // 100 AS g, count(*) AS n, max(l_quantity) AS q FROM lineitem GROUP BY 1"),
    "group_null_key": (f"{_NULLABLE} SELECT a, COUNT(*) AS n FROM t GROUP BY a", f"SELECT a, count(*) AS n FROM {_NULLABLE_SQL} GROUP BY a"),
    "group_aggregate_only": ("SELECT COUNT(*) AS n FROM events GROUP BY event_type", "SELECT count(*) AS n FROM events GROUP BY event_type"),
    "group_empty": ("SELECT l_returnflag, COUNT(*) AS n FROM lineitem WHERE l_quantity < 0 GROUP BY l_returnflag", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity < 0 GROUP BY l_returnflag"),
    # -- distinct, union, order, limit
    "distinct_one": ("SELECT DISTINCT l_returnflag FROM lineitem", "SELECT DISTINCT l_returnflag FROM lineitem"),
    "distinct_several": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "distinct_star": ("SELECT DISTINCT * FROM nation", "SELECT DISTINCT * FROM nation"),
    "distinct_null": (f"{_NULLABLE} SELECT DISTINCT a FROM t", f"SELECT DISTINCT a FROM {_NULLABLE_SQL}"),
    "union_all": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT n_nationkey FROM nation", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT n_nationkey FROM nation"),
    "union_distinct": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "union_chain": ("SELECT r_regionkey AS k FROM region UNION SELECT n_regionkey FROM nation UNION ALL SELECT r_regionkey FROM region", "(SELECT r_regionkey AS k FROM region UNION SELECT n_regionkey FROM nation) UNION ALL SELECT r_regionkey FROM region"),
    "union_promoted": ("SELECT n_nationkey AS k FROM nation UNION ALL SELECT c_acctbal FROM customer", "SELECT n_nationkey::DOUBLE AS k FROM nation UNION ALL SELECT c_acctbal FROM customer"),
    "order_asc": ("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_custkey", "SELECT c_custkey, c_acctbal FROM customer"),
    "order_desc_nulls_last": (f"{_NULLABLE} SELECT a FROM t ORDER BY a DESC", f"SELECT a FROM {_NULLABLE_SQL} ORDER BY a DESC NULLS LAST"),
    "order_asc_nulls_first": (f"{_NULLABLE} SELECT a FROM t ORDER BY a", f"SELECT a FROM {_NULLABLE_SQL} ORDER BY a NULLS FIRST"),
    "order_hidden_column": ("SELECT c_name FROM customer ORDER BY c_custkey DESC", "SELECT c_name FROM customer ORDER BY c_custkey DESC"),
    "order_timestamp": ("SELECT event_id, ts FROM events ORDER BY ts", "SELECT event_id, ts FROM events ORDER BY ts"),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20"),
    "offset_only": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 100", "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 100"),
    "scan_reverse": (f"{_COPY} SELECT k FROM t ORDER BY k DESC", "SELECT o_orderkey AS k FROM orders ORDER BY o_orderkey DESC"),
    "scan_range": (f"{_COPY} CREATE INDEX ON t (c, p DESC); SELECT k, c FROM t WHERE c >= 10 AND c < 20 AND p > 1000", "SELECT o_orderkey AS k, o_custkey AS c FROM orders WHERE o_custkey >= 10 AND o_custkey < 20 AND o_totalprice > 1000"),
    # -- changes
    "insert_values": ("CREATE TABLE t (a INT PRIMARY KEY, b TEXT, c DOUBLE PRECISION); INSERT INTO t VALUES (1, 'x', 1), (2, 'y', 2.5), (3, NULL, NULL); SELECT * FROM t", "SELECT * FROM (VALUES (1, 'x', 1::DOUBLE), (2, 'y', 2.5), (3, NULL, NULL)) v(a, b, c)"),
    "insert_select": (f"{_COPY} SELECT * FROM t", _COPY_SQL),
    "insert_by_name": ("CREATE TABLE t (x TEXT, k INT PRIMARY KEY); INSERT INTO t SELECT n_nationkey AS k, n_name AS x FROM nation; SELECT * FROM t", "SELECT n_name AS x, n_nationkey AS k FROM nation"),
    "insert_conflict_nothing": (
        f"{_COPY} INSERT INTO t (k, c, s, p) SELECT o_orderkey * 2, 0, 'new', 0 FROM orders ON CONFLICT DO NOTHING; SELECT * FROM t",
        f"{_COPY_SQL} UNION ALL SELECT o_orderkey * 2, 0, 'new', 0 FROM orders WHERE o_orderkey * 2 NOT IN (SELECT o_orderkey FROM orders)",
    ),
    "insert_conflict_replace": (
        f"{_COPY} INSERT INTO t (k, c, s, p) SELECT o_orderkey * 2, 0, 'new', 0 FROM orders ON CONFLICT DO REPLACE; SELECT * FROM t",
        f"SELECT * FROM ({_COPY_SQL}) WHERE k NOT IN (SELECT o_orderkey * 2 FROM orders) UNION ALL SELECT o_orderkey * 2, 0, 'new', 0 FROM orders",
    ),
    "insert_conflict_unique": (
        "CREATE TABLE t (a INT UNIQUE, b INT PRIMARY KEY, c INT UNIQUE DEFAULT 10); INSERT INTO t (a, b, c) VALUES (1, 1, 1); INSERT INTO t (a, b, c) VALUES (1, 2, 3), (2, 1, 4), (2, 2, 1), (5, 5, 5) ON CONFLICT DO NOTHING; INSERT INTO t (a, b) VALUES (7, 7); INSERT INTO t (a, b) VALUES (8, 8) ON CONFLICT DO NOTHING; SELECT * FROM t",
        "SELECT * FROM (VALUES (1, 1, 1), (5, 5, 5), (7, 7, 10)) v(a, b, c)",
    ),
    "insert_returning": ("CREATE TABLE t (a INT PRIMARY KEY, b INT DEFAULT 5); INSERT INTO t (a) VALUES (1), (2) RETURNING a + b AS x, *", "SELECT * FROM (VALUES (6, 1, 5), (7, 2, 5)) v(x, a, b)"),
    "insert_default_check": (
        "CREATE TABLE t (k BIGINT PRIMARY KEY, q DOUBLE PRECISION DEFAULT 1.5 CHECK (q > 0), s TEXT NOT NULL DEFAULT 'none'); INSERT INTO t (k) SELECT o_orderkey FROM orders; SELECT * FROM t",
        "SELECT o_orderkey AS k, 1.5::DOUBLE AS q, 'none' AS s FROM orders",
    ),
    "insert_casts": ("CREATE TABLE t (a INT PRIMARY KEY, b BOOL, c TEXT, d DOUBLE PRECISION, e BIGINT); INSERT INTO t VALUES (1.9, 0, 2.0, '3.5', '7'); SELECT * FROM t", "SELECT 1 AS a, false AS b, '2' AS c, 3.5::DOUBLE AS d, 7::BIGINT AS e"),
    "update_set": (f"{_COPY} UPDATE t SET p = p * 2, s = 'done' WHERE c % 3 = 0; SELECT * FROM t", f"SELECT k, c, CASE WHEN c % 3 = 0 THEN 'done' ELSE s END AS s, CASE WHEN c % 3 = 0 THEN p * 2 ELSE p END AS p FROM ({_COPY_SQL})"),
    "update_in_turn": (f"{_COPY} UPDATE t SET c = c + 1, p = c; SELECT * FROM t", f"SELECT k, c + 1 AS c, s, (c + 1)::DOUBLE AS p FROM ({_COPY_SQL})"),
    "update_key": (f"{_COPY} UPDATE t SET k = k + 1000000 WHERE s = 'F'; SELECT * FROM t", f"SELECT CASE WHEN s = 'F' THEN k + 1000000 ELSE k END AS k, c, s, p FROM ({_COPY_SQL})"),
    "delete_where": (f"{_COPY} DELETE FROM t WHERE s = 'F' OR c < 20; SELECT * FROM t", f"SELECT * FROM ({_COPY_SQL}) WHERE NOT (s = 'F' OR c < 20)"),
    "delete_order_limit": (f"{_COPY} DELETE FROM t WHERE s = 'O' ORDER BY k DESC LIMIT 100 OFFSET 10; SELECT * FROM t", f"SELECT * FROM ({_COPY_SQL}) WHERE k NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey DESC LIMIT 100 OFFSET 10)"),
    "delete_all": (f"{_COPY} DELETE FROM t; SELECT COUNT(*) AS n FROM t", "SELECT 0::BIGINT AS n"),
    # -- definitions
    "alter_add_column": (f"{_COPY} ALTER TABLE t ADD COLUMN x INTEGER NOT NULL DEFAULT 9; ALTER TABLE t ADD COLUMN y TEXT; SELECT k, x, y FROM t", "SELECT o_orderkey AS k, 9 AS x, CAST(NULL AS VARCHAR) AS y FROM orders"),
    "alter_rename": (f"{_COPY} ALTER TABLE t RENAME TO u; SELECT COUNT(*) AS n FROM u", "SELECT count(*) AS n FROM orders"),
    "sequence_nextval": (
        "CREATE SEQUENCE q; CREATE TABLE t (i BIGINT PRIMARY KEY DEFAULT nextval('q'), n INT); INSERT INTO t (n) SELECT n_nationkey FROM nation; SELECT COUNT(*) AS n, MIN(i) AS lo, MAX(i) AS hi, SUM(i) AS s FROM t",
        "SELECT count(*) AS n, 1::BIGINT AS lo, count(*) AS hi, (count(*) * (count(*) + 1) // 2)::BIGINT AS s FROM nation",
    ),
    "sequence_cycle": ("CREATE SEQUENCE q MINVALUE 1 MAXVALUE 3 CYCLE; CREATE TABLE t (k INT PRIMARY KEY, v BIGINT DEFAULT nextval('q')); INSERT INTO t (k) VALUES (1), (2), (3), (4), (5); SELECT * FROM t", "SELECT * FROM (VALUES (1, 1::BIGINT), (2, 2), (3, 3), (4, 1), (5, 2)) v(k, v)"),
    "catalog_scan": ("CREATE TABLE t (a INT PRIMARY KEY, b INT UNIQUE); CREATE INDEX i ON t (b); CREATE SEQUENCE q; SELECT name, type FROM __catalog", "SELECT * FROM (VALUES ('t', 'table'), ('t_b_unique', 'index'), ('i', 'index'), ('q', 'sequence')) v(name, type)"),
    "reindex": (f"{_COPY} CREATE UNIQUE INDEX u ON t (k, c); REINDEX t; SELECT COUNT(*) AS n FROM t", "SELECT count(*) AS n FROM orders"),
    "transaction_rollback": (f"{_COPY} BEGIN; DELETE FROM t; ROLLBACK; SELECT COUNT(*) AS n FROM t", "SELECT count(*) AS n FROM orders"),
    "transaction_commit": (f"{_COPY} BEGIN TRANSACTION; DELETE FROM t WHERE s = 'F'; UPDATE t SET p = 0; COMMIT; SELECT * FROM t", f"SELECT k, c, s, 0::DOUBLE AS p FROM ({_COPY_SQL}) WHERE s <> 'F'"),
    "drop_table": ("CREATE TABLE t (a INT PRIMARY KEY); CREATE TABLE u (a INT PRIMARY KEY, b INT); CREATE INDEX i ON u (b); CREATE SEQUENCE q; DROP TABLE t; DROP INDEX i; DROP SEQUENCE q; DROP TABLE IF EXISTS none; SELECT name, type FROM __catalog", "SELECT 'u' AS name, 'table' AS type"),
    "scan_range_composite": ("CREATE TABLE t (a BIGINT, b BIGINT, q DOUBLE PRECISION, PRIMARY KEY (a, b)); INSERT INTO t (a, b, q) SELECT o_custkey, o_orderkey, o_totalprice FROM orders; SELECT * FROM t WHERE a = 7 AND b > 100", "SELECT o_custkey AS a, o_orderkey AS b, o_totalprice AS q FROM orders WHERE o_custkey = 7 AND o_orderkey > 100"),
    "insert_from_rows": ("CREATE TABLE t (a INT PRIMARY KEY, b INT); INSERT INTO t VALUES (1, 2), (3, 4); INSERT INTO t VALUES (1, 5), (6, 7) ON CONFLICT DO NOTHING; INSERT INTO t VALUES (3, 8), (9, 9) ON CONFLICT DO REPLACE; SELECT * FROM t", "SELECT * FROM (VALUES (1, 2), (3, 8), (6, 7), (9, 9)) v(a, b)"),
    "fn_case_by_character": ("SELECT p_partkey, upper('straße ' || p_name) AS a, lower('ÉÑ ' || p_name) AS b FROM part", "SELECT p_partkey, 'STRAßE ' || upper(p_name) AS a, 'éñ ' || lower(p_name) AS b FROM part"),
    "explain_select": ("EXPLAIN SELECT l_returnflag, COUNT(*) FROM lineitem WHERE l_linenumber <= 2 + 2 AND l_quantity > 10 GROUP BY l_returnflag", "SELECT 'table.Scan(\"lineitem\") | rows.Filter(l_linenumber <= 4) | rows.Filter(l_quantity > 10) | rows.GroupAggregate(l_returnflag, COUNT(*)) | rows.Project(l_returnflag, COUNT(*))' AS plan"),
    "explain_insert": ("CREATE TABLE t (a INT PRIMARY KEY); EXPLAIN INSERT INTO t (a) VALUES (1)", "SELECT 'rows.Emit((1)) | table.Validate(\"t\") | table.GenerateKey(\"t\") | table.Insert(\"t\") | discard()' AS plan"),
}

#: Queries with parameters: script, values, oracle.
PARAMETERS: dict[str, tuple[str, tuple, str]] = {
    "param_positional": ("SELECT o_orderkey FROM orders WHERE o_custkey = $2 OR o_orderstatus = $1", ("F", 7), "SELECT o_orderkey FROM orders WHERE o_custkey = 7 OR o_orderstatus = 'F'"),
    "param_limit": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT $1 OFFSET $2", (5, 10), "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 10"),
}


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as CSV (one field with quotes and a line end) and imported."""
    path = f"{own_root(spark)}/nation.csv"
    name = F.concat(F.lit('"'), F.col("n_name"), F.lit(',\n"'))
    spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", name.alias("n_name")).write.csv(path, header=True, escape='"')
    c = Database(spark).connect()
    transfer.import_csv(c, path, "t")
    return c.query("SELECT n_nationkey, n_name FROM t")


_PEOPLE = "CREATE SEQUENCE q; CREATE TABLE t (k BIGINT PRIMARY KEY, s TEXT UNIQUE, d DOUBLE PRECISION, b BOOL); CREATE INDEX i ON t (d); INSERT INTO t (k, s, d, b) SELECT c_custkey, c_name, c_acctbal, c_acctbal > 0 FROM customer;"
_PEOPLE_SQL = "SELECT c_custkey AS k, c_name AS s, c_acctbal AS d, c_acctbal > 0 AS b FROM customer"


def _dumped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table dumped as a script and restored from it elsewhere."""
    c, other = open_tables(spark, sf_dir, ("customer",)), Database(spark).connect()
    c.execute(_PEOPLE)
    with tempfile.TemporaryFile("w+", encoding="utf-8", newline="\n") as script:
        transfer.dump(c, script)
        script.seek(0)
        transfer.restore(other, script)
    return other.query("SELECT * FROM t")


def _saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database copied to a path and opened from it."""
    c, path = open_tables(spark, sf_dir, ("customer",)), own_root(spark)
    c.execute(_PEOPLE)
    transfer.save(c, path)
    return Database(spark, path).connect().query("SELECT * FROM t")


def _reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence goes on where it was when its database is opened again."""
    path = own_root(spark)
    for first in (0, 10):
        db = Database(spark, path)
        c = db.connect()
        if not first:
            c.execute("CREATE SEQUENCE q START WITH 5 INCREMENT BY 2; CREATE TABLE t (k INT PRIMARY KEY, v BIGINT DEFAULT nextval('q'))")
        c.execute(f"INSERT INTO t (k) VALUES ({first}), ({first + 1})")
        db.close()
    return Database(spark, path).connect().query("SELECT COUNT(*) AS n, COUNT(v) AS given, MIN(v) AS lo FROM t")


def _isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader counts before a writer begins, while it writes, and after its commit."""
    db = open_tables(spark, sf_dir, ("nation",)).db
    writer, reader = db.connect(), db.connect()
    count = lambda: reader.query("SELECT COUNT(*) AS n FROM t").head()["n"]
    writer.execute("CREATE TABLE t (k INT PRIMARY KEY)")
    seen = [count()]
    writer.execute("BEGIN; INSERT INTO t (k) SELECT n_nationkey FROM nation")
    seen.append(count())
    writer.execute("COMMIT")
    seen.append(count())
    return spark.createDataFrame([(i, n) for i, n in enumerate(seen)], "step int, n long")


#: Statements that are refused, and the kind of error.
REFUSED = {
    "SELECT none FROM nation": "BindError", "SELECT n_name FROM nowhere": "NotFound", "SELECT": "ParseError", "SELECT * FROM nation UNION SELECT r_name FROM region": "BindError",
    "SELECT DISTINCT n_name FROM nation ORDER BY n_nationkey": "BindError", "SELECT n_name, COUNT(*) FROM nation": "BindError", "CREATE TABLE nation2 (a INT)": "BindError",
    "INSERT INTO u VALUES (1, 1)": "ConstraintViolation", "INSERT INTO u VALUES (NULL, 1)": "ConstraintViolation", "INSERT INTO u VALUES (2, -1)": "ConstraintViolation", "CREATE TABLE u (a INT PRIMARY KEY)": "AlreadyExists",
    "INSERT INTO u (none) VALUES (1)": "BindError", "DROP TABLE nowhere": "NotFound", "COMMIT": "TransactionError", "SELECT nextval('none')": "NotFound",
}


def _refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = open_tables(spark, sf_dir, ("nation", "region"))
    c.execute("CREATE TABLE u (a INT PRIMARY KEY, b INT CHECK (b > 0)); INSERT INTO u VALUES (1, 1)")
    out = []
    for sql in REFUSED:
        try:
            result = c.execute(sql)
            if result.frame is not None:
                result.frame.collect()
            out.append((sql, "none"))
        except EngineError as e:
            out.append((sql, type(e).__name__))
    return spark.createDataFrame(out, "statement string, error string")


def _shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a script of statements, as from standard input, and of shell commands."""
    from .cli import Shell, run_script

    c, out = open_tables(spark, sf_dir, ("region",)), io.StringIO()
    run_script(c, "CREATE TABLE t (k INT PRIMARY KEY, s TEXT); CREATE INDEX i ON t (s); INSERT INTO t (k, s) SELECT r_regionkey, r_name FROM region; SELECT k, s FROM t ORDER BY k; SELECT COUNT(*) AS n FROM t", out)
    shell = Shell(c, out)
    for line in (".tables", ".indexes t"):
        shell.command(line)
    return spark.createDataFrame(list(enumerate(out.getvalue().split("\n"))), "at int, line string")


#: What takes more than one script: function and oracle.
PROGRAMS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "csv_import": (_csv, "SELECT n_nationkey::VARCHAR AS n_nationkey, '\"' || n_name || ',' || chr(10) || '\"' AS n_name FROM nation"),
    "dump_restore": (_dumped, _PEOPLE_SQL),
    "save_copy": (_saved, _PEOPLE_SQL),
    "sequence_reopened": (_reopened, "SELECT 4::BIGINT AS n, 4::BIGINT AS given, 5::BIGINT AS lo"),
    "snapshot_readers": (_isolated, "SELECT * FROM (VALUES (0, 0::BIGINT), (1, 0), (2, (SELECT count(*) FROM nation))) v(step, n)"),
    "typed_errors": (_refused, "SELECT * FROM (VALUES " + ", ".join(f"('{k.replace(chr(39), chr(39) * 2)}', '{v}')" for k, v in REFUSED.items()) + ") v(statement, error)"),
    "shell_script": (_shell, """
        WITH body AS (SELECT row_number() OVER (ORDER BY r_regionkey) AS i, r_regionkey || '|"' || r_name || '"' AS line FROM region), n AS (SELECT count(*) AS n FROM region)
        SELECT 0 AS at, 'k|s' AS line UNION ALL SELECT i::INTEGER, line FROM body UNION ALL SELECT (n + 1 + x.i)::INTEGER, replace(x.line, '#', n::VARCHAR) FROM n, (VALUES (0, ''), (1, 'n'), (2, '#'), (3, 't'), (4, 'i'), (5, '')) x(i, line)"""),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = lambda script, params: lambda spark, sf_dir: run(spark, sf_dir, script, *params)
    out = {name: made(script, ()) for name, (script, _) in CASES.items()}
    out |= {name: made(script, params) for name, (script, params, _) in PARAMETERS.items()}
    return out | {name: program for name, (program, _) in PROGRAMS.items()}


def oracle_sql() -> dict[str, str]:
    out = {k: o for k, (_, o) in CASES.items() if o is not None} | {k: o for k, (_, _, o) in PARAMETERS.items()}
    return out | {k: o for k, (_, o) in PROGRAMS.items()}
