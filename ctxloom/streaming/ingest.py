"""Uploads as a stream: micro-batches of files into project indexes, at least once and idempotent."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ctxloom.engine import ContextEngine
from ctxloom.functions.classify import is_safe_path
from ctxloom.functions.text import blob_hash

#: Projects of one batch that are ingested at once.
AT_ONCE = 8
UPLOADS = T.StructType([T.StructField("project_id", T.StringType()), T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("blob_hash", T.StringType()), T.StructField("deleted", T.BooleanType())])
#: Uploads that tell their order; files without the column read as null.
ORDERED = T.StructType([*UPLOADS.fields, T.StructField("seq", T.LongType())])


def read_uploads(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Parquet files of uploads as they appear in a folder."""
    return spark.readStream.schema(ORDERED).option("maxFilesPerTrigger", max_files).parquet(folder)


def valid_uploads(uploads: DataFrame) -> DataFrame:
    """Uploads with a safe path, and for files a hash that fits the content."""
    good = F.coalesce(F.col("deleted"), F.lit(False)) | (blob_hash(F.col("path"), F.col("content")) == F.col("blob_hash"))
    return uploads.where(is_safe_path(F.col("path")) & good)


def ingest_stream(engine: ContextEngine, uploads: DataFrame, checkpoint: str, *, on_batch: Callable[[int, str], None] | None = None) -> StreamingQuery:
    """Runs until the present uploads are ingested. Of the uploads of a path the one with the greatest ``seq`` counts (null
    is least; equal ones: a deletion, then the greater hash). A batch that is run again after a failure finds unchanged hashes
    and changes nothing. Projects of a batch are independent and are taken in side by side."""

    def take(batch: DataFrame, number: int) -> None:
        order = F.struct(F.coalesce("seq", F.lit(-1)), F.coalesce("deleted", F.lit(False)), "blob_hash")
        last = valid_uploads(batch).groupBy("project_id", "path").agg(F.max_by(F.struct("content", "deleted"), order).alias("m")).persist()

        def one(project: str) -> None:
            mine = last.where(F.col("project_id") == project)
            files = mine.where("not coalesce(m.deleted, false)").select("project_id", "path", "m.content")
            engine.apply_changes(project, files, mine.where("m.deleted").select("path"))
            if on_batch:
                on_batch(number, project)

        projects = [r.project_id for r in last.select("project_id").distinct().collect()]
        with ThreadPoolExecutor(AT_ONCE) as pool:
            list(pool.map(one, projects))
        last.unpersist()

    return uploads.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_counts(changes: DataFrame, watermark: str = "1 hour", window: str = "1 day") -> DataFrame:
    """An extension: changes per project and window of ``indexed_at`` (timestamp), late rows beyond the watermark left out."""
    return changes.withWatermark("indexed_at", watermark).groupBy("project_id", F.window("indexed_at", window)).agg(F.count(F.lit(1)).alias("changes"))
