"""The DataFrame operators by themselves."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary import operators as o
from granary.operators import keys
from granary.operators import rows as row_operators


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(1, "a", 5.0), (2, "b", None), (3, None, 1.0), (4, "a", 2.0)], "k long, s string, d double").repartition(3)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_scan_of_a_stored_and_of_an_empty_table(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "p"))
    assert rows(o.scan(spark, [str(tmp_path / "p")], df.schema)) == rows(df)
    assert [r["k"] for r in o.scan_reverse(spark, [str(tmp_path / "p")], df.schema, ["k"]).collect()] == [4, 3, 2, 1]
    assert o.scan(spark, [], df.schema).count() == 0


def test_emit(spark):
    assert rows(o.emit(spark, [[F.lit(1), F.lit("x")]], ["a", "b"])) == [(1, "x")]
    assert rows(o.emit(spark, [[F.lit(1)], [F.lit(2)]], ["a"])) == [(1,), (2,)]


def test_filter_project_sort_take_skip(df):
    assert rows(o.filtered(df, F.col("d") > 1)) == [(1, "a", 5.0), (4, "a", 2.0)]
    assert rows(o.project(df, [F.col("k") * 2], ["x"])) == [(2,), (4,), (6,), (8,)]
    assert [r["d"] for r in o.sort(df, F.col("d")).collect()] == [None, 1.0, 2.0, 5.0]
    assert [r["d"] for r in o.sort(df, F.col("d"), True).collect()] == [5.0, 2.0, 1.0, None]
    assert [r["k"] for r in o.take(o.skip(o.sort(df, F.col("k")), 1), 2).collect()] == [2, 3]
    assert o.take(df, -1).count() == 0 and o.take(df, 1 << 40).count() == 4


def test_groups(df):
    assert rows(o.group_aggregate(df, F.col("s"), [F.count(F.lit(1))], ["n"])) == [("a", 2), ("b", 1), (None, 1)]
    assert rows(o.group_aggregate(df, None, [F.sum("k")], ["n"])) == [(10,)]
    assert rows(o.group_aggregate(df, F.col("s"), [], [])) == [("a",), ("b",), (None,)]


def test_union_concat_set_rename_discard(df):
    s = df.select("s")
    assert rows(o.union([s, s])) == [("a",), ("b",), (None,)] and o.concat([s, s]).count() == 8
    changed = o.set_column(o.set_column(df, "k", F.col("k") + 1), "d", F.col("k").cast("double"))
    assert rows(changed.select("k", "d")) == [(2, 2.0), (3, 3.0), (4, 4.0), (5, 5.0)]
    assert o.rename(df, ["x", "y", "z"]).columns == ["x", "y", "z"]
    with pytest.raises(ValueError):
        o.rename(df, ["x"])
    assert o.discard(df) is None


def test_ordinals(df, spark):
    assert sorted(r["n"] for r in o.with_ordinals(df, "n").collect()) == [0, 1, 2, 3]
    assert o.with_ordinals(spark.createDataFrame([], T.StructType([T.StructField("a", T.LongType())])), "n").count() == 0


def test_keys(df):
    assert o.repeated(df, ["s"]) and not o.repeated(df, ["k"]) and not o.repeated(df.where("k > 1"), ["s"])
    assert o.violations(df, [("k", F.col("k") > 10), ("s", F.col("s").isNull())]) == "s"
    assert o.violations(df, []) is None
    some = df.where("k = 1")
    assert rows(o.within(df, some, ["s"], 1)) == rows(o.within(df, some, ["s"], None)) == [(1, "a", 5.0), (4, "a", 2.0)]
    assert rows(o.without(df, some, ["s"])) == [(2, "b", None), (3, None, 1.0)]
    assert o.within(df, df.where("s is null"), ["s"], 1).count() == 0


def test_who_stays(spark):
    batch = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 2, 2), (3, 3, 3), (3, None, 4)], f"a int, b int, `{keys.ORDER}` long")
    save = lambda df: df
    assert [r[2] for r in rows(o.first_wins(batch, [["a"]], save))] == [0, 2, 3]
    assert [r[2] for r in rows(o.first_wins(batch, [["a"], ["b"]], save))] == [0, 2, 3]
    assert sorted(r[2] for r in rows(o.last_wins(batch, [["a"], ["b"]]))) == [2, 4]


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("kind", ["long", "double", "string", "boolean", "timestamp_ntz", "binary"])
def test_skip_sorted_keeps_what_a_sort_puts_last(spark, monkeypatch, kind, descending):
    monkeypatch.setattr(row_operators, "FEW", 3)
    monkeypatch.setattr(row_operators, "RANGES", 5)
    i = F.col("id")
    made = {"long": i * 7919 % 211, "double": F.when(i % 50 == 0, float("nan")).otherwise((i * 7919 % 211 - 100) / 8), "string": F.concat(F.lit("k"), i * 7919 % 211), "boolean": i % 2 == 0, "timestamp_ntz": F.expr("timestamp_ntz'2021-03-28 02:30:00.000001' + make_interval(0, 0, 0, 0, 0, 0, id * 7919 % 211)"), "binary": F.concat(F.lit("k"), i * 7919 % 211).cast("binary")}[kind]
    df = spark.range(0, 600, 1, 4).select("id", F.when(i % 17 != 0, made).alias("k"))
    ordered = [r["k"] for r in o.sort(df, F.col("k"), descending).collect()]
    for n in (1, 40, 298, 600):
        kept = row_operators.skip_sorted(df, F.col("k"), n, descending)
        got = o.sort(kept, F.col("k"), descending).collect()
        assert [str(r["k"]) for r in got] == [str(x) for x in ordered[n:]]  # a NaN is not equal to itself
        assert len({r["id"] for r in got}) == len(got)


def test_skip_sorted_among_ties(spark, monkeypatch):
    monkeypatch.setattr(row_operators, "FEW", 3)
    df = spark.range(0, 3000, 1, 4).select(F.when(F.col("id") == 1, 0).when(F.col("id") == 2999, 2).otherwise(1).alias("k"))
    for n, counts in ((1, {1: 2998, 2: 1}), (1000, {1: 1999, 2: 1}), (2999, {2: 1}), (3000, {})):
        assert {r["k"]: r["count"] for r in row_operators.skip_sorted(df, F.col("k"), n).groupBy("k").count().collect()} == counts


def test_offset_sends_no_table_through_one_task(spark):
    import granary

    db = granary.Database(spark)
    db.register("t", spark.range(0, 5000, 1, 8).select(F.col("id").alias("k"), (F.col("id") % 7 / 10).alias("p")))
    with db.connect() as c:
        for sql in ("SELECT k FROM t ORDER BY k OFFSET 100", "SELECT k FROM t ORDER BY k LIMIT 3000 OFFSET 1500", "SELECT k FROM t OFFSET 10"):
            got = c.query(sql)
            assert "Offset" not in got._jdf.queryExecution().optimizedPlan().toString()
            n = len(got.collect())
            assert n == {"100": 4900, "1500": 3000, "10": 4990}[sql.split()[-1]]
        assert [r["k"] for r in c.query("SELECT k FROM t ORDER BY k OFFSET 2500").collect()] == list(range(2500, 5000))
        assert c.query("SELECT k, SUM(p) AS q, COUNT(*) AS n FROM t GROUP BY k ORDER BY k OFFSET 1200").count() == 3800
        assert c.query("SELECT NULL AS x, random() AS k FROM t ORDER BY k OFFSET 1200").count() == 3800
    db.close()
