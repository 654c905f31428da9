"""What every operator shares: table access, written intermediate tables and joins that survive hot keys."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds more than one part in HOT_PARTS of the rows; by counting, at most HOT_PARTS keys can.
HOT_PARTS = 256

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The columns of one of the Parquet tables in a folder."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_tsumugi_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="tsumugi-code-")
    target = os.path.join(folder, "tsumugi.zip")
    with zipfile.ZipFile(target, "w") as z:
        for at, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.join("tsumugi", os.path.relpath(full, root)))
    sc.addPyFile(target)
    sc._tsumugi_shipped = True
    atexit.register(shutil.rmtree, folder, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset, as in tests on one machine, a folder of our own is made and set.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        held = sc._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tsumugi-shared-")
        sc.setCheckpointDir(base)
        atexit.register(shutil.rmtree, base[len("file://") :], True)
    return base.rstrip("/")


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the executions inside are removed when each ends; Spark makes them again if they are needed."""
    old = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")
    except Exception:  # another version of Spark
        yield
        return
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, old)


class Scratch:
    """Intermediate tables of one run, as Parquet in the shared folder.

    A written table cuts the lineage and outlives a lost executor. Tables that nothing reads any more are dropped at once.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.clear)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        with _shuffles_dropped(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            if path := getattr(df, "_scratch_path", None):
                self._delete(path)

    def clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session has ended
            pass


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, total: int | None = None, apart: bool = False) -> DataFrame:
    """Inner join of many rows to one row a key, not slowed by hot keys.

    ``right`` has one row a key, and in ``weight`` how many rows of ``left`` the key has, of ``total`` in all (their sum if it isn't given). Keys with more
    than one part in HOT_PARTS of the rows are at most HOT_PARTS many, so they are broadcast; all other rows are joined by shuffle.

    Both happen in one pass: a row served by the broadcast goes through the shuffle under a hash of itself, so that hot keys' rows
    spread evenly and alike whenever a lost task is run again; what it may meet there is not looked at. With ``apart``, for a
    left side that is cheap to read twice and mostly hot, rows of hot keys stay out of the shuffle instead.
    """
    values = [c for c in right.columns if c not in (key, weight)]
    if total is None:
        right = right.crossJoin(F.broadcast(right.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("_total"))))  # one row
        is_hot = F.col(weight) * HOT_PARTS > F.col("_total")
    else:
        is_hot = F.col(weight) * HOT_PARTS > F.lit(total)
    if apart:
        hot, cold = F.broadcast(right.filter(is_hot).drop(weight, "_total")), right.filter(~is_hot).drop(weight, "_total")
        rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
        return left.join(hot, key).unionByName(rest.join(cold, key)).select(*left.columns, *values)
    packed = F.struct(*values)
    hot = F.broadcast(right.filter(is_hot).select(F.col(key), packed.alias("_hot")))
    cold = right.filter(~is_hot).select(F.col(key).alias("_key"), packed.alias("_cold"))
    spread = F.xxhash64(*left.columns)
    if left.schema[key].dataType.simpleString() == "string":
        spread = F.concat(F.lit("\x00"), spread.cast("string"))
    served = left.join(hot, key, "left").withColumn("_to", F.when(F.col("_hot").isNotNull(), spread).otherwise(F.col(key)))
    met = served.join(cold, F.col("_to") == F.col("_key"), "left").withColumn("_found", F.coalesce("_hot", "_cold")).filter("_found is not null")
    return met.select(*left.columns, *[F.col(f"_found.{v}").alias(v) for v in values])


def meet(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of many rows to many on a key, not slowed by keys that are hot on the left.

    A key with more than one part in HOT_PARTS of the left rows gets a salt for each such part: its left rows are dealt out by a hash of themselves, its right rows
    are repeated for each salt. There are at most HOT_PARTS hot keys, and they alone are broadcast. The left side is read twice.
    """
    n = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    n = n.crossJoin(F.broadcast(n.agg(F.sum("_n").alias("_total")))).filter(F.col("_n") * HOT_PARTS > F.col("_total"))  # one row
    hot = F.broadcast(n.filter(F.col(key).isNotNull()).select(key, F.ceil(F.col("_n") * HOT_PARTS / F.col("_total")).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("_parts")
    repeated = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(repeated, [key, "_salt"]).drop("_salt")


def shuffled(df: DataFrame) -> DataFrame:
    """The table as a side of a join that isn't sent whole to the driver and every executor.

    Spark plans by the bytes of files. Written tables and repeated rows are compressed to a small part of what they take in memory, so for tables that
    grow with the data that choice isn't left to it.
    """
    return df.hint("merge")


def filled(c: str | Column) -> Column:
    """Neither null nor empty."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (c != "")
