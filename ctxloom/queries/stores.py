"""Stores and uploads: validation, reuse, upserts, unreferenced blobs, visibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctxloom.operators import graph, store
from ctxloom.queries import Registry
from ctxloom.queries.search import CH, ED, SY
from ctxloom.queries.usage import CUTOFF
from ctxloom.sources import repo
from ctxloom.tables import load


def uploads(spark: SparkSession, d: str) -> DataFrame:
    """Every blob as an upload of its project, batches held against 20,000 bytes."""
    b = load(spark, d, "blobs")
    at = F.row_number().over(Window.partitionBy("project_id").orderBy("path"))
    items = b.select(F.col("project_id").alias("batch"), at.alias("position"), "path", "blob_hash", F.base64("content").alias("content_b64"))
    return repo.check_uploads(items, 20_000).groupBy("batch", F.coalesce("error", F.lit("ok")).alias("result")).agg(F.count(F.lit(1)).alias("uploads"))


UPLOAD_SQL = """WITH b AS (SELECT project_id AS batch, path, blob_hash, content, sum(octet_length(content)) OVER (PARTITION BY project_id ORDER BY path ROWS UNBOUNDED PRECEDING) AS total FROM blobs)
SELECT batch, CASE WHEN total > 20000 THEN 'batch_size' WHEN regexp_matches(path, '^/|\\\\|(^|/)(\\.{1,2})?(/|$)') THEN 'path' WHEN sha256(encode(path) || '\\x00'::BLOB || content) <> blob_hash THEN 'hash' ELSE 'ok' END AS result, count(*) AS uploads FROM b GROUP BY ALL"""


def vector_reuse(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks reuse a vector when every content that runs wrote before July has one (its embedding of four trigrams)."""
    c = load(spark, d, "chunks").dropDuplicates(["project_id", "id"])
    held = load(spark, d, "processed_items").where(F.col("item_kind") == "chunk").where(F.col("processed_at") < F.lit(CUTOFF).cast("timestamp_ntz"))
    vectors = held.select("content_hash").distinct().select("content_hash", F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.ascii(F.substr("content_hash", k, F.lit(1))).cast("float")).alias("vector"))
    reused, left = store.reuse_vectors(c, vectors)
    return reused.groupBy("project_id").agg(F.count(F.lit(1)).alias("chunks")).withColumn("state", F.lit("reused")).unionByName(left.groupBy("project_id").agg(F.count(F.lit(1)).alias("chunks")).withColumn("state", F.lit("embed")))


REUSE_SQL = f"""WITH c AS (SELECT * FROM {CH}) SELECT project_id, count(*) AS chunks, CASE WHEN content_hash IN (SELECT content_hash FROM processed_items WHERE item_kind = 'chunk' AND processed_at < TIMESTAMP '{CUTOFF}' AND content_hash IS NOT NULL) THEN 'reused' ELSE 'embed' END AS state FROM c GROUP BY ALL"""


def upserted(spark: SparkSession, d: str) -> DataFrame:
    """Symbols after exported ones were written again under the kind 'seen'."""
    s = load(spark, d, "symbols").dropDuplicates(["project_id", "id"]).select("project_id", "id", "kind")
    fresh = load(spark, d, "symbols").where("is_exported").select("project_id", "id", F.lit("seen").alias("kind")).distinct()
    return store.upsert(s, fresh, ["project_id", "id"]).groupBy("project_id", "kind").agg(F.count(F.lit(1)).alias("symbols"))


UPSERT_SQL = f"SELECT project_id, CASE WHEN is_exported THEN 'seen' ELSE kind END AS kind, count(*) AS symbols FROM {SY} GROUP BY ALL"


def orphan_blobs(spark: SparkSession, d: str) -> DataFrame:
    """Blobs whose content no row of a file names that was indexed before July."""
    ledger = load(spark, d, "files").where(F.col("indexed_at") < F.lit(CUTOFF).cast("timestamp_ntz")).select(F.col("content_hash").alias("blob_hash")).distinct()
    b = load(spark, d, "blobs").select("project_id", "path", F.sha2("content", 256).alias("blob_hash"))
    return repo.unreferenced(b, ledger).select("project_id", "path")


def visible(spark: SparkSession, d: str) -> DataFrame:
    """Symbols that each project's first file can name."""
    s = load(spark, d, "symbols").dropDuplicates(["project_id", "id"])
    first = load(spark, d, "files").groupBy("project_id").agg(F.min("path").alias("from_path"))
    return graph.visible_symbols(s.join(first, "project_id"), F.col("from_path")).select("project_id", "id")


def clear_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges outside the spans of class skeletons, taken as spans of errors."""
    e = load(spark, d, "edges").dropDuplicates(["edge_id"]).where("line is not null").select("edge_id", "project_id", "file_path", F.col("line").alias("start_line"), F.col("line").alias("end_line"))
    spans = load(spark, d, "chunks").where("symbol_kind = 'class_skeleton'").select("project_id", "file_path", "start_line", "end_line").distinct()
    return graph.drop_inside(e, spans).select("edge_id")


CLEAR_SQL = f"SELECT edge_id FROM {ED} e WHERE line IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.symbol_kind = 'class_skeleton' AND c.project_id = e.project_id AND c.file_path = e.file_path AND e.line BETWEEN c.start_line AND c.end_line)"


def register(reg: Registry) -> None:
    reg.query("upload_checks", UPLOAD_SQL)(uploads)
    reg.query("vector_reuse", REUSE_SQL)(vector_reuse)
    reg.query("upsert", UPSERT_SQL)(upserted)
    reg.query("unreferenced_blobs", f"SELECT project_id, path FROM blobs WHERE sha256(content) NOT IN (SELECT content_hash FROM files WHERE indexed_at < TIMESTAMP '{CUTOFF}' AND content_hash IS NOT NULL)")(orphan_blobs)
    reg.query("visible_symbols", f"SELECT s.project_id, s.id FROM {SY} s JOIN (SELECT project_id, min(path) AS p FROM files GROUP BY 1) f USING (project_id) WHERE coalesce(s.is_exported, false) OR s.file_path = f.p")(visible)
    reg.query("facts_outside_errors", CLEAR_SQL)(clear_edges)
