"""Reading the input tables and finding the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The session setting that names the folder which all executors share.
SHARED_DIR_CONF = "spark.checkpoint.dir"


def load(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The table ``name`` below ``base``; column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read. A temporary one is set only where none is configured (tests, local mode)."""
    found = spark.conf.get(SHARED_DIR_CONF, None) or spark.sparkContext.getConf().get(SHARED_DIR_CONF)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {SHARED_DIR_CONF} to a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"ctxloom-{os.getpid()}")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
        spark.conf.set(SHARED_DIR_CONF, found)
    return found


#: What this process has written below the shared folder and not yet removed.
_WRITTEN: list[str] = []


def release(spark: SparkSession) -> int:
    """Removes all that ``cut`` and ``scratch`` wrote in this process; call it when no result is read any more."""
    n = 0
    while _WRITTEN:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))
    return n


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Writes ``df`` once below the shared folder and reads it back: lineage ends in files that outlive executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def current_files(files: DataFrame, *more: str) -> DataFrame:
    """One row per (project_id, path): the version with the greatest indexed_at, ties by the greater content_hash.

    A null indexed_at loses against any time. Exact duplicate rows fall together. The aggregate is combined on the map
    side, so a path with very many versions costs one row per map task.
    """
    keep = ["content_hash", "indexed_at", *more]
    first = F.max(F.struct(F.col("indexed_at").alias("_t"), F.col("content_hash").alias("_h"), F.struct(*keep).alias("_r")))
    return files.groupBy("project_id", "path").agg(first.alias("_m")).select("project_id", "path", *[F.col(f"_m._r.{c}").alias(c) for c in keep])


def newest(df: DataFrame, keys: list[str], order: list, keep: list[str]) -> DataFrame:
    """Per ``keys`` the row that comes last under ``order``, as a hash aggregate."""
    top = F.max_by(F.struct(*keep), F.struct(*order))
    return df.groupBy(*keys).agg(top.alias("_m")).select(*keys, *[F.col(f"_m.{c}").alias(c) for c in keep])


def top_n(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per key; Spark plans a WindowGroupLimit below the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
