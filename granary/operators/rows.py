"""Row operators: each takes DataFrames and bound columns and gives a DataFrame.

They only declare; Catalyst picks scans, joins and sorts. A filter right above a scan is
pushed into Parquet, a sort under a limit becomes a top-k, and aggregates are partial
before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql import types as T

_MOST = (1 << 31) - 1
#: Rows of a sort under a limit that a task holds; beyond, the place of a row is found by counting ranges, so many at once.
FEW, RANGES = 1000, 64


def scan(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """Rows of a stored table; an empty table has no paths."""
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def scan_reverse(spark: SparkSession, paths: Sequence[str], schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    return scan(spark, paths, schema).orderBy(*(F.col(k).desc() for k in keys))


def emit(spark: SparkSession, rows: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """A few rows of expressions, as one inline table."""
    structs = [F.struct(*(c.alias(k) for c, k in zip(row, names, strict=True))) for row in rows]
    if len(structs) == 1:
        return spark.range(1).select(*(c.alias(k) for c, k in zip(rows[0], names, strict=True)))
    return spark.range(1).select(F.inline(F.array(*structs)))


def filtered(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition)


def project(df: DataFrame, columns: Sequence[Column], names: Sequence[str]) -> DataFrame:
    return df.select(*(c.alias(k) for c, k in zip(columns, names, strict=True)))


def sort(df: DataFrame, key: Column, descending: bool = False) -> DataFrame:
    """NULL is smallest."""
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first())


def group_aggregate(df: DataFrame, key: Column | None, aggregates: Sequence[Column], names: Sequence[str], key_name: str = "__key") -> DataFrame:
    """One row per value of ``key`` (NULL is one), or one row in all without a key."""
    made = [a.alias(k) for a, k in zip(aggregates, names, strict=True)]
    if key is None:
        return df.agg(*made)
    grouped = df.groupBy(key.alias(key_name))
    return grouped.agg(*made) if made else df.select(key.alias(key_name)).distinct()


def take(df: DataFrame, n: int) -> DataFrame:
    return df.limit(min(max(n, 0), _MOST))


def skip(df: DataFrame, n: int) -> DataFrame:
    """Passes all rows through one task: for a few, as under a limit."""
    return df.offset(min(n, _MOST)) if n > 0 else df


def skip_sorted(df: DataFrame, key: Column, n: int, descending: bool = False) -> DataFrame:
    """The rows of ``df``, in no order, that a sort by ``key`` would put after the first ``n``.

    Runs jobs over the key to find that of row ``n``; what is left is a filter. Only rows
    that tie with row ``n``, where some are skipped and some are not, go through one task.
    ``df`` must give the same rows each time.
    """
    found = key_at(df.select(key.alias("k")), n, descending)
    if found is None:
        return df.limit(0)
    at, skipped = found
    if not skipped:
        return df.filter(_from(key, at, descending))
    return df.filter(_past(key, at, descending)).union(df.filter(key.eqNullSafe(at)).offset(skipped))


def _past(key: Column, at: Column, descending: bool) -> Column:
    """Whether a key comes after ``at``, NULL for no where that is enough; NULL is smallest."""
    if descending:
        return (key < at) | (key.isNull() & at.isNotNull())
    return (key > at) | (key.isNotNull() & at.isNull())


def _from(key: Column, at: Column, descending: bool) -> Column:
    return _past(key, at, descending) | key.eqNullSafe(at)


def key_at(df: DataFrame, n: int, descending: bool = False) -> tuple[Column, int] | None:
    """The value of the only column in row ``n`` (from 0) of its order, and how many rows before that one have the same; None if there are not as many rows."""
    (name,), kind = df.columns, df.schema.fields[0].dataType
    k = F.col(name)
    order = k.desc_nulls_last() if descending else k.asc_nulls_first()
    first, last = (F.max, F.min) if descending else (F.min, F.max)
    ranked = F.struct(k.isNotNull().alias("there"), k.alias("k"))
    # timestamps go by their text, since Python's have the machine's time zone
    told = (lambda c: c.cast("string")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else (lambda c: c)
    known = lambda x: F.lit(bytes(x) if isinstance(x, bytearray) else x).cast(kind)
    left = df
    while n >= FEW:
        parts = left.repartitionByRange(RANGES, order).select(k, F.spark_partition_id().alias("part")).groupBy("part")
        ends = parts.agg(F.count(F.lit(1)).alias("n"), first(ranked).alias("a"), last(ranked).alias("b"))
        ranges = sorted(ends.select("part", "n", told(F.col("a.k")).alias("a"), told(F.col("b.k")).alias("b"), F.col("a").eqNullSafe(F.col("b")).alias("one")).collect(), key=lambda r: r["part"])  # RANGES rows
        before = 0
        for r in ranges:
            if n < before + r["n"]:
                break
            before += r["n"]
        else:
            return None
        n -= before
        if r["one"]:
            return known(r["a"]), n
        if len(ranges) > 1:
            left = left.filter(_from(k, known(r["a"]), descending) & ~F.coalesce(_past(k, known(r["b"]), descending), F.lit(False)))
            continue
        # one value among few is so frequent that no range ends at it: any row's, most likely this one's, parts the rest
        at = known(left.select(told(k).alias("k")).orderBy(F.rand()).limit(1).head()["k"])
        same, past = k.eqNullSafe(at), F.coalesce(_past(k, at, descending), F.lit(False))
        counts = left.agg(F.count_if(~same & ~past).alias("before"), F.count_if(same).alias("same")).head()
        if n < counts["before"]:
            left = left.filter(~same & ~past)
        elif n < counts["before"] + counts["same"]:
            return at, n - counts["before"]
        else:
            left, n = left.filter(past), n - counts["before"] - counts["same"]
    counted = left.orderBy(order).limit(n + 1).groupBy(k).agg(F.count(F.lit(1)).alias("n"))
    r = counted.agg(F.sum("n").alias("all"), last(F.struct(k.isNotNull().alias("there"), k.alias("k"), "n")).alias("at")).select("all", told(F.col("at.k")).alias("k"), F.col("at.n").alias("n")).head()
    return (known(r["k"]), r["n"] - 1) if r["all"] == n + 1 else None


def union(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all, each once; of a single one, its distinct rows."""
    return concat(frames).distinct()


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def set_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Assignments follow each other, so a later one sees the earlier."""
    return df.withColumn(name, value)


def rename(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if len(names) != len(df.columns):
        raise ValueError(f"{len(df.columns)} columns for {len(names)} names")
    return df.toDF(*names)


def discard(df: DataFrame) -> None:
    """Runs to the end and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()


def with_ordinals(df: DataFrame, name: str) -> DataFrame:
    """Adds 0, 1, 2, ... without a sort: counts of partitions, then places in them.

    ``df`` must give the same partitions each time, as a stored table does.
    """
    part, place, begin = (f"{name}\u2063{k}" for k in ("part", "place", "begin"))
    placed = df.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias(place))
    begins, at = [], 0
    for r in placed.groupBy(part).count().orderBy(part).collect():  # one row per partition
        begins.append((r[part], at))
        at += r["count"]
    known = df.sparkSession.createDataFrame(begins, StructType([StructField(part, IntegerType()), StructField(begin, LongType())]))
    return placed.join(F.broadcast(known), part).withColumn(name, F.col(begin) + F.col(place)).drop(part, place, begin)
