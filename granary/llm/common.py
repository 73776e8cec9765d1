"""Helpers shared by the corpus operators: let-binding, shared scratch tables, sizes."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Java regex for the bytes that separate words in the contracts.
SPACE = r"[\x20\x09-\x0D]"

_OWN_ROOT = "/tmp/granary-checkpoints"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, whatever the body does with it.

    A plain reference would be inlined by the optimizer and, inside a lambda, be
    evaluated anew for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Bytes of a table up to which its rows are dealt to all cores: a small file is often one row group, thus one task.
SMALL = 24 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL
    return df.repartition(max(1, spark.sparkContext.defaultParallelism)) if small else df


def column(name: str) -> Column:
    """The column of this name, whatever is in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def widened(schema: StructType, more: str) -> StructType:
    """``schema`` with the fields of a DDL string after its own."""
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, upper and lower case being one, made from ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of one number each that may be broadcast: some 64 MB as a hash table.
BROADCAST_ROWS = 2_000_000


def chosen(df: DataFrame, key: str, rows: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of ``df`` with written ``rows`` (one column of longs): by broadcast up to a counted bound, else by shuffle."""
    other = rows.select(F.col(rows.columns[0]).alias(key))
    return df.join(F.broadcast(other) if rows.count() <= BROADCAST_ROWS else other, key, how)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local one only where all run on this machine (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not shared and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return shared or _OWN_ROOT


def ship(spark: SparkSession) -> None:
    """Gives Python workers this package, once per application: where they run it need not be installed."""
    context = spark.sparkContext
    if getattr(context, "_granary_shipped", False):
        return
    root = Path(__file__).parent.parent
    path = Path(tempfile.mkdtemp(prefix="granary-code-")) / "granary_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    context.addPyFile(str(path))
    context._granary_shipped = True


class Scratch:
    """Intermediate tables written to the shared folder; they survive the loss of executors.

    A table goes by ``drop``, or when the JVM has found that no plan refers to it any
    more (looked at whenever tables are begun or settled), or at the end of the process.
    """

    _held: list[tuple[SparkSession, object, str]] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_root(spark).rstrip('/')}/granary-{uuid.uuid4().hex}"
        self.sweep()
        atexit.register(self.drop)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        files = out._jdf.queryExecution().analyzed().relation().location()  # shared by all plans that read the table
        self._held.append((self.spark, self.spark.sparkContext._jvm.java.lang.ref.WeakReference(files), path))
        return out

    @classmethod
    def sweep(cls) -> None:
        """Drops the tables that no plan refers to."""
        still = []
        for spark, files, path in cls._held:
            if spark.sparkContext._jsc is None:
                continue
            if files.get() is None:
                _delete(spark, path)
            else:
                still.append((spark, files, path))
        cls._held[:] = still

    def settle(self) -> None:
        """Lets go of shuffle files and tables of steps whose results are written: Spark deletes them with the objects that own them."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        self.sweep()

    def drop(self, name: str = "") -> None:
        if self.spark.sparkContext._jsc is not None and self.spark.sparkContext._jvm is not None:
            try:
                _delete(self.spark, f"{self.root}/{name}".rstrip("/"))
            except Exception:  # the JVM may be gone already at interpreter exit
                return


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
