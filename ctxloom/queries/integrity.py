"""Incremental runs (p3) and orphan references (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxloom.operators.changes import ChangeFeed, latest_handled
from ctxloom.operators.orphans import orphan_references, parent_intervals
from ctxloom.queries import Registry
from ctxloom.tables import current_files, load, scratch

ITEM_KEYS = {"project_id": T.StringType(), "item_kind": T.StringType(), "item_key": T.StringType()}

P3_SQL = """
WITH done AS (SELECT DISTINCT id FROM index_runs WHERE state = 'done'),
led AS (SELECT project_id, item_kind, item_key, content_hash,
          row_number() OVER (PARTITION BY project_id, item_kind, item_key ORDER BY processed_at DESC, run_id DESC, content_hash DESC) AS rn
        FROM processed_items WHERE run_id IN (SELECT id FROM done)),
fil AS (SELECT project_id, path, content_hash, row_number() OVER (PARTITION BY project_id, path ORDER BY indexed_at DESC, content_hash DESC) AS rn FROM files),
cur AS (SELECT project_id, 'file' AS item_kind, path AS item_key, content_hash FROM fil WHERE rn = 1
        UNION ALL SELECT project_id, 'chunk', id, max(content_hash) FROM chunks GROUP BY project_id, id)
SELECT c.project_id, c.item_kind, c.item_key{more} FROM cur c
LEFT JOIN (SELECT * FROM led WHERE rn = 1) l ON c.project_id = l.project_id AND c.item_kind = l.item_kind AND c.item_key = l.item_key
WHERE l.item_key IS NULL OR l.content_hash IS DISTINCT FROM c.content_hash
"""

P6_SQL = """
WITH nm AS (SELECT DISTINCT project_id, name AS n FROM symbols WHERE name IS NOT NULL UNION SELECT DISTINCT project_id, fqn FROM symbols WHERE fqn IS NOT NULL),
r AS (SELECT DISTINCT project_id, 'edges' AS ref_table, CAST(edge_id AS VARCHAR) AS ref_key, trim(target_name) AS n, file_path FROM edges
      UNION ALL SELECT DISTINCT project_id, 'unresolved_refs', CAST(id AS VARCHAR), trim(name), file_path FROM unresolved_refs),
bad AS (SELECT r.* FROM r WHERE n IS NOT NULL AND n NOT IN (SELECT name FROM known_names WHERE name IS NOT NULL)
          AND NOT EXISTS (SELECT 1 FROM nm WHERE nm.project_id = r.project_id AND nm.n = r.n)
        UNION ALL
        SELECT DISTINCT s.project_id, 'symbols', s.id, s.chunk_id, s.file_path FROM symbols s WHERE s.chunk_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.project_id = s.project_id AND c.id = s.chunk_id))
"""


def current_items(spark: SparkSession, d: str) -> DataFrame:
    """Every current file and chunk with its key and content hash."""
    files = current_files(load(spark, d, "files")).select("project_id", F.lit("file").alias("item_kind"), F.col("path").alias("item_key"), "content_hash")
    chunks = load(spark, d, "chunks").select("project_id", F.lit("chunk").alias("item_kind"), F.col("id").alias("item_key"), "content_hash")
    return files.unionByName(chunks)


def _feed(spark: SparkSession, d: str) -> ChangeFeed:
    feed = ChangeFeed(spark, scratch(spark, "p3"), ITEM_KEYS)
    feed.seed(latest_handled(load(spark, d, "processed_items"), load(spark, d, "index_runs"), list(ITEM_KEYS)))
    return feed


def changed_items(spark: SparkSession, d: str) -> DataFrame:
    return _feed(spark, d).pending(current_items(spark, d)).select(*ITEM_KEYS)


def changed_by_project(spark: SparkSession, d: str) -> DataFrame:
    """Per project and kind how many items are new and how many changed."""
    rows = _feed(spark, d).pending(current_items(spark, d), with_status=True)
    return rows.groupBy("project_id", "item_kind", "status").agg(F.count(F.lit(1)).alias("items"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Every name and fqn a project's symbols define, and every chunk id, in one key space."""
    s = load(spark, d, "symbols")
    named = s.select("project_id", F.explode(F.array_distinct(F.array("name", "fqn"))).alias("key"), "file_path").where("key is not null")
    chunk = load(spark, d, "chunks").select("project_id", F.concat(F.lit("c:"), "id").alias("key"), "file_path")
    return named.withColumn("key", F.concat(F.lit("n:"), "key")).unionByName(chunk)


def _references(spark: SparkSession, d: str) -> DataFrame:
    """All references of the three tables, without names that never have a symbol row."""
    edges = load(spark, d, "edges").select("project_id", F.lit("edges").alias("ref_table"), F.col("edge_id").cast("string").alias("ref_key"), F.trim("target_name").alias("name"), "file_path")
    refs = load(spark, d, "unresolved_refs").select("project_id", F.lit("unresolved_refs").alias("ref_table"), F.col("id").cast("string").alias("ref_key"), F.trim("name").alias("name"), "file_path")
    known = load(spark, d, "known_names").where("name is not null").select("name").distinct()
    named = edges.unionByName(refs).join(known, "name", "left_anti")
    symbols = load(spark, d, "symbols").where("chunk_id is not null").select("project_id", F.lit("symbols").alias("ref_table"), F.col("id").alias("ref_key"), F.concat(F.lit("c:"), "chunk_id").alias("key"), "file_path")
    return named.select("project_id", "ref_table", "ref_key", F.concat(F.lit("n:"), "name").alias("key"), "file_path").unionByName(symbols)


#: The time at which all rows of the tables are read, after everything that they record.
NOW = "9998-12-31"


def _parents(spark: SparkSession, d: str) -> DataFrame:
    """Validity intervals of all keys: from when they were first seen (null: unknown) to when they went (open: still there).

    Names and chunks that the tables hold are valid to this day, from the first time their file was indexed. Chunks that only
    the runs' ledger knows were last valid when a run last wrote them."""
    files = load(spark, d, "files").groupBy("project_id", F.col("path").alias("file_path")).agg(F.min("indexed_at").alias("first_at"))
    held = _names(spark, d).join(files, ["project_id", "file_path"], "left").select("project_id", "key", "first_at", F.lit(None).cast("timestamp_ntz").alias("gone_at"))
    wrote = load(spark, d, "processed_items").where("item_kind = 'chunk'").groupBy("project_id", F.concat(F.lit("c:"), "item_key").alias("key")).agg(F.min("processed_at").alias("first_at"), F.max("processed_at").alias("gone_at"))
    return parent_intervals(held.unionByName(wrote.where("key is not null and gone_at is not null")), valid_from="first_at", valid_to="gone_at")


def orphans(spark: SparkSession, d: str) -> DataFrame:
    """References whose target is gone or never was, as of now."""
    refs = _references(spark, d).withColumn("ref_at", F.lit(NOW).cast("timestamp_ntz"))
    return orphan_references(refs, _parents(spark, d), ref_time="ref_at").select("ref_table", "ref_key").distinct()


def orphans_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table and month in which the referring file was last indexed; the month is null for unknown files."""
    refs = _references(spark, d).withColumn("ref_at", F.lit(NOW).cast("timestamp_ntz"))
    bad = orphan_references(refs, _parents(spark, d), ref_time="ref_at").select("project_id", "ref_table", "ref_key", "file_path").distinct()
    files = current_files(load(spark, d, "files")).select("project_id", F.col("path").alias("file_path"), F.date_format("indexed_at", "yyyy-MM").alias("month"))
    return bad.join(files, ["project_id", "file_path"], "left").groupBy("ref_table", "month").agg(F.count(F.lit(1)).alias("orphans"))


def reference_status(spark: SparkSession, d: str) -> DataFrame:
    """References by table and status: missing, deleted (a run once wrote the chunk, which went before the referring file was
    last indexed), or late (the target was first seen after that). References of unknown files count as made now."""
    files = load(spark, d, "files").groupBy("project_id", F.col("path").alias("file_path")).agg(F.max("indexed_at").alias("ref_at"))
    refs = _references(spark, d).join(files, ["project_id", "file_path"], "left").withColumn("ref_at", F.coalesce("ref_at", F.lit(NOW).cast("timestamp_ntz")))
    bad = orphan_references(refs, _parents(spark, d), ref_time="ref_at").select("project_id", "ref_table", "ref_key", "status").distinct()
    return bad.groupBy("ref_table", "status").agg(F.count(F.lit(1)).alias("references_found"))


P6_STATUS_SQL = """
WITH f AS (SELECT project_id, path, min(indexed_at) AS first_at, max(indexed_at) AS last_at FROM files GROUP BY ALL),
held AS (SELECT s.project_id, 'n:' || n AS key, first_at, NULL AS gone_at FROM (SELECT project_id, file_path, name AS n FROM symbols UNION SELECT project_id, file_path, fqn FROM symbols) s
           LEFT JOIN f ON f.project_id = s.project_id AND f.path = s.file_path WHERE n IS NOT NULL
         UNION ALL SELECT c.project_id, 'c:' || id, first_at, NULL FROM chunks c LEFT JOIN f ON f.project_id = c.project_id AND f.path = c.file_path WHERE id IS NOT NULL
         UNION ALL SELECT project_id, 'c:' || item_key, min(processed_at), max(processed_at) FROM processed_items WHERE item_kind = 'chunk' AND item_key IS NOT NULL GROUP BY ALL HAVING max(processed_at) IS NOT NULL),
par AS (SELECT project_id, key, min(first_at) AS valid_from, max(coalesce(gone_at, TIMESTAMP '9999-12-31')) AS valid_to FROM held GROUP BY ALL),
r AS (SELECT DISTINCT project_id, 'edges' AS ref_table, CAST(edge_id AS VARCHAR) AS ref_key, 'n:' || trim(target_name) AS key, file_path FROM edges WHERE trim(target_name) NOT IN (SELECT name FROM known_names WHERE name IS NOT NULL)
      UNION ALL SELECT DISTINCT project_id, 'unresolved_refs', CAST(id AS VARCHAR), 'n:' || trim(name), file_path FROM unresolved_refs WHERE trim(name) NOT IN (SELECT name FROM known_names WHERE name IS NOT NULL)
      UNION ALL SELECT DISTINCT project_id, 'symbols', id, 'c:' || chunk_id, file_path FROM symbols WHERE chunk_id IS NOT NULL),
st AS (SELECT DISTINCT r.project_id, ref_table, ref_key, CASE WHEN par.key IS NULL THEN 'missing' WHEN valid_to <= coalesce(last_at, TIMESTAMP '9998-12-31') THEN 'deleted' WHEN valid_from > coalesce(last_at, TIMESTAMP '9998-12-31') THEN 'late' END AS status
       FROM r LEFT JOIN par ON par.project_id = r.project_id AND par.key = r.key LEFT JOIN f ON f.project_id = r.project_id AND f.path = r.file_path)
SELECT ref_table, status, count(*) AS references_found FROM st WHERE status IS NOT NULL GROUP BY ALL
"""


def register(reg: Registry) -> None:
    reg.query("p3_found", P3_SQL.format(more=""))(changed_items)
    reg.query(
        "p3_changed_by_project",
        "SELECT project_id, item_kind, status, count(*) AS items FROM (" + P3_SQL.format(more=", CASE WHEN l.item_key IS NULL THEN 'new' ELSE 'changed' END AS status") + ") GROUP BY ALL",
    )(changed_by_project)
    reg.query("p6_found", P6_SQL + "SELECT DISTINCT ref_table, ref_key FROM bad")(orphans)
    reg.query(
        "p6_by_month",
        P6_SQL
        + """SELECT ref_table, strftime(indexed_at, '%Y-%m') AS month, count(*) AS orphans FROM (SELECT DISTINCT project_id, ref_table, ref_key, file_path FROM bad) b
        LEFT JOIN (SELECT project_id, path, max(indexed_at) AS indexed_at FROM files GROUP BY ALL) f ON f.project_id = b.project_id AND f.path = b.file_path GROUP BY ALL""",
    )(orphans_by_month)
    reg.query("p6_reference_status", P6_STATUS_SQL)(reference_status)
