"""Change detection, stores, retention, usage and quality over the recorded runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.operators import store, usage
from ctxloom.operators.changes import latest_handled
from ctxloom.operators.lexical import inverted_index
from ctxloom.operators.parse import explode, parse_files
from ctxloom.operators.resolve import link_mentions, resolve_pending, retarget_edges
from ctxloom.operators.vector import HashedTrigrams, embed_distinct
from ctxloom.queries import Registry
from ctxloom.sources import repo
from ctxloom.tables import current_files, cut, load

CUTOFF = "2025-07-01"


def _manifests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    files = load(spark, d, "files").select("project_id", "path", "content_hash", "indexed_at")
    return current_files(files), current_files(files.where(F.col("indexed_at") < F.lit(CUTOFF).cast("timestamp_ntz")))


def scan_plan(spark: SparkSession, d: str) -> DataFrame:
    """What changed in the current files since the successful runs last wrote them; the ledger knows files that are gone."""
    now, _ = _manifests(spark, d)
    wrote = latest_handled(load(spark, d, "processed_items").where("item_kind = 'file'"), load(spark, d, "index_runs"), ["project_id", "item_key"])
    return repo.plan_scan(now, wrote.select("project_id", F.col("item_key").alias("path"), F.col("handled_hash").alias("content_hash")))


LEDGER_SQL = """led AS (SELECT project_id, item_key, content_hash, row_number() OVER (PARTITION BY project_id, item_key ORDER BY processed_at DESC, run_id DESC, content_hash DESC) AS rn
FROM processed_items WHERE item_kind = '{kind}' AND run_id IN (SELECT id FROM index_runs WHERE state = 'done'))"""
PLAN_SQL = f"""WITH {LEDGER_SQL.format(kind="file")}, n AS (SELECT project_id, path, max((indexed_at, content_hash))[2] AS h FROM files GROUP BY ALL), w AS (SELECT project_id, item_key AS path, content_hash AS h FROM led WHERE rn = 1)
SELECT project_id, path, CASE WHEN w.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM n FULL JOIN w USING (project_id, path) WHERE n.h IS DISTINCT FROM w.h"""


def _ledger_chunks(spark: SparkSession, d: str) -> DataFrame:
    """project_id, id, file_path, content_hash of the chunks as successful runs last wrote them."""
    wrote = latest_handled(load(spark, d, "processed_items").where("item_kind = 'chunk'"), load(spark, d, "index_runs"), ["project_id", "item_key"])
    return wrote.select("project_id", F.col("item_key").alias("id"), F.regexp_extract("item_key", "^[^:]*", 0).alias("file_path"), F.col("handled_hash").alias("content_hash"))


def replaced(spark: SparkSession, d: str) -> DataFrame:
    """The ledger's chunks after those of files that changed since were replaced by the present ones, row by row."""
    changed = scan_plan(spark, d)
    chunks = load(spark, d, "chunks").groupBy("project_id", "id").agg(F.max("file_path").alias("file_path"), F.max("content_hash").alias("content_hash"))
    fresh = chunks.join(changed.select("project_id", F.col("path").alias("file_path")), ["project_id", "file_path"], "left_semi")
    return store.replace_files(_ledger_chunks(spark, d), fresh, changed).select("project_id", "id", "content_hash")


REPLACED_SQL = f"""WITH l AS (WITH {LEDGER_SQL.format(kind="chunk")} SELECT project_id, item_key AS id, regexp_extract(item_key, '^[^:]*') AS file_path, content_hash FROM led WHERE rn = 1), ch AS ({PLAN_SQL})
SELECT project_id, id, content_hash FROM l WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.project_id = l.project_id AND ch.path = l.file_path)
UNION ALL SELECT project_id, id, max(content_hash) FROM chunks c WHERE EXISTS (SELECT 1 FROM ch WHERE ch.project_id = c.project_id AND ch.path = c.file_path) GROUP BY project_id, id"""


def deltas(spark: SparkSession, d: str) -> DataFrame:
    """New, reused and removed contents of every file between the ledger's chunks and the present ones."""
    c = load(spark, d, "chunks").dropDuplicates(["project_id", "id"]).select("project_id", "id", "file_path", "content_hash")
    return store.file_delta(_ledger_chunks(spark, d), c).groupBy("project_id", "state").agg(F.count(F.lit(1)).alias("contents"))


DELTA_SQL = f"""WITH {LEDGER_SQL.format(kind="chunk")}, o AS (SELECT DISTINCT project_id, regexp_extract(item_key, '^[^:]*') AS file_path, content_hash, 1 AS o FROM led WHERE rn = 1), n AS (SELECT DISTINCT project_id, file_path, content_hash, 1 AS n FROM chunks)
SELECT project_id, CASE WHEN o IS NULL THEN 'new' WHEN n IS NULL THEN 'removed' ELSE 'reused' END AS state, count(*) AS contents FROM o FULL JOIN n USING (project_id, file_path, content_hash) GROUP BY ALL"""


def deleted(spark: SparkSession, d: str) -> DataFrame:
    now, was = _manifests(spark, d)
    gone = was.where("path like 'docs/%'").select("project_id", "path")
    tables = {n: load(spark, d, n) for n in ("chunks", "symbols", "edges", "files")}
    left = store.delete_files(tables, gone)
    out = None
    for n, t in left.items():
        row = t.agg(F.count(F.lit(1)).alias("rows")).withColumn("table_name", F.lit(n))
        out = row if out is None else out.unionByName(row)
    return out


DELETED_SQL = f"""WITH g AS (SELECT DISTINCT project_id, path FROM files WHERE indexed_at < TIMESTAMP '{CUTOFF}' AND path LIKE 'docs/%')
SELECT count(*) AS rows, 'chunks' AS table_name FROM chunks t WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.project_id = t.project_id AND g.path = t.file_path)
UNION ALL SELECT count(*), 'symbols' FROM symbols t WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.project_id = t.project_id AND g.path = t.file_path)
UNION ALL SELECT count(*), 'edges' FROM edges t WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.project_id = t.project_id AND g.path = t.file_path)
UNION ALL SELECT count(*), 'files' FROM files t WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.project_id = t.project_id AND g.path = t.path)"""


def checkpoint_ids(spark: SparkSession, d: str) -> DataFrame:
    return repo.checkpoints(load(spark, d, "blobs"))


def blob_usage(spark: SparkSession, d: str) -> DataFrame:
    return repo.store_usage(load(spark, d, "blobs"))


def run_stats(spark: SparkSession, d: str) -> DataFrame:
    return usage.index_stats(load(spark, d, "index_runs").dropDuplicates(), ["project_id"])


STATS_SQL = """SELECT project_id, count(*) AS total, count(*) FILTER (state = 'done') AS succeeded, count(*) FILTER (state IS DISTINCT FROM 'done') AS failed, floor(avg(duration_ms) FILTER (state = 'done'))::BIGINT AS avg_duration_ms,
min(duration_ms) FILTER (state = 'done') AS min_duration_ms, max(duration_ms) FILTER (state = 'done') AS max_duration_ms, max(finished_at) AS last_run_at FROM (SELECT DISTINCT * FROM index_runs) GROUP BY 1"""


def all_stats(spark: SparkSession, d: str) -> DataFrame:
    return usage.index_stats(load(spark, d, "index_runs").dropDuplicates())


def kept_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = load(spark, d, "index_runs").groupBy("id").agg(F.max(F.struct(F.coalesce("finished_at", F.lit(0)).alias("at"), "project_id")).alias("m")).select("id", "m.project_id", "m.at")
    return store.keep_newest(runs, ["project_id"], [F.desc("at"), F.desc("id")], 5).select("project_id", "id")


KEEP_SQL = """SELECT project_id, id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY fin DESC, id DESC) AS r FROM (SELECT id, max((coalesce(finished_at, 0), project_id))[2] AS project_id, max((coalesce(finished_at, 0), project_id))[1] AS fin FROM index_runs GROUP BY id)) WHERE r <= 5"""


def _audits(spark: SparkSession, d: str) -> DataFrame:
    """Events read as an audit of queries."""
    e = load(spark, d, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("p"), F.pmod("user_id", F.lit(7)).cast("string")).alias("project_id"), kind.alias("query"), F.when(kind == "click", 1).when(kind == "view", 0).alias("answerable"), F.when(kind == "error", 1).otherwise(0).alias("degraded"),
        F.when(kind == "purchase", "high").when(kind == "click", "medium").alias("confidence"), F.floor("value").cast("int").alias("latency_ms"), F.pmod("event_id", F.lit(500)).cast("int").alias("used_tokens"), F.lit(None).cast("double").alias("citation_coverage"), F.col("event_id").alias("created_at"),
    )


AUDIT_SQL = """a AS (SELECT event_id AS id, 'p' || CAST(user_id % 7 AS VARCHAR) AS project_id, event_type AS query, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 0 END AS answerable, (event_type = 'error')::INT AS degraded,
CASE event_type WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'medium' END AS confidence, floor(value)::INT AS latency_ms, (event_id % 500)::INT AS used_tokens, event_id AS created_at FROM events)"""


def summary(spark: SparkSession, d: str) -> DataFrame:
    return usage.usage_summary(_audits(spark, d), 0, 30, ["project_id"]).drop("citation_coverage_avg")


SUMMARY_SQL = f"""WITH {AUDIT_SQL}, n AS (SELECT project_id, latency_ms, row_number() OVER (PARTITION BY project_id ORDER BY latency_ms) AS r, count(*) OVER (PARTITION BY project_id) AS n FROM a WHERE latency_ms IS NOT NULL)
SELECT a.project_id, count(*) AS total, count(*) FILTER (answerable = 1) AS succeeded, count(*) FILTER (answerable = 0) AS insufficient, count(*) FILTER (degraded = 1 AND answerable IS NULL) AS failed, floor(avg(latency_ms))::BIGINT AS avg_latency_ms, sum(used_tokens) AS used_tokens,
any_value(p.v) AS p95_latency_ms FROM a LEFT JOIN (SELECT project_id, max(latency_ms) AS v FROM n WHERE r = least(n, greatest(1, round_even(0.95 * n, 0)::BIGINT)) GROUP BY 1) p ON p.project_id = a.project_id GROUP BY 1"""


def frequent(spark: SparkSession, d: str) -> DataFrame:
    return usage.top_queries(_audits(spark, d))


def confidences(spark: SparkSession, d: str) -> DataFrame:
    return usage.confidence_counts(_audits(spark, d))


def timeline(spark: SparkSession, d: str) -> DataFrame:
    runs = load(spark, d, "index_runs").dropDuplicates(["id", "state"])
    return usage.recent_calls(usage.call_timeline(runs), 50)


TIMELINE_SQL = '''SELECT call_id, max(started_at) AS "at", count(*) AS events FROM (SELECT DISTINCT ON (id, state) * FROM index_runs) WHERE call_id IS NOT NULL GROUP BY 1 ORDER BY "at" DESC, call_id LIMIT 50'''


def counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the index tables, copies out."""
    keys = {"files": ["project_id", "path"], "chunks": ["project_id", "id"], "symbols": ["project_id", "id"], "edges": ["edge_id"], "unresolved_refs": ["id"]}
    out = None
    for n, k in keys.items():
        row = load(spark, d, n).select(*k).distinct().agg(F.count(F.lit(1)).alias("rows")).withColumn("table_name", F.lit(n))
        out = row if out is None else out.unionByName(row)
    return out


COUNT_SQL = " UNION ALL ".join(f"SELECT count(*) AS rows, '{n}' AS table_name FROM (SELECT DISTINCT {k} FROM {n})" for n, k in (("files", "project_id, path"), ("chunks", "project_id, id"), ("symbols", "project_id, id"), ("edges", "edge_id"), ("unresolved_refs", "id")))


def freshness(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "files").groupBy("project_id").agg(F.max("indexed_at").alias("indexed_at"))


def quotas(spark: SparkSession, d: str) -> DataFrame:
    b = load(spark, d, "blobs").select(F.substring("project_id", 1, 1).alias("user_id"), "project_id", F.octet_length("content").alias("bytes"))
    return usage.quota_status(b, 60_000, 200_000).select("user_id", "project_id", "bytes", "user_bytes", "status")


QUOTA_SQL = """WITH p AS (SELECT substr(project_id, 1, 1) AS user_id, project_id, sum(octet_length(content)) AS bytes FROM blobs GROUP BY ALL), u AS (SELECT *, sum(bytes) OVER (PARTITION BY user_id) AS user_bytes FROM p)
SELECT *, CASE WHEN greatest(bytes / 60000.0, user_bytes / 200000.0) > 1 THEN 'exceeded' WHEN greatest(bytes / 60000.0, user_bytes / 200000.0) >= 0.8 THEN 'warning' ELSE 'ok' END AS status FROM u"""


def parsed(spark: SparkSession, d: str) -> DataFrame:
    """What parsing the uploaded files yields, per language."""
    p = parse_files(load(spark, d, "blobs"))
    return p.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum(F.size("symbols")).alias("symbols"), F.sum(F.size("edges")).alias("edges"), F.sum(F.size("chunks")).alias("chunks"), F.sum(F.size("spec_blocks")).alias("spec_blocks"))


def parsed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return explode(parse_files(load(spark, d, "blobs")), "chunks").select("project_id", "id", "symbol_kind", "start_line", "end_line", "content_hash")


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """Symbols that document blocks of the uploads mention."""
    blocks = explode(parse_files(load(spark, d, "blobs")), "spec_blocks").select("project_id", F.col("id").alias("block_id"), "mentioned")
    symbols = load(spark, d, "symbols").dropDuplicates(["project_id", "id"])
    return link_mentions(blocks, symbols).select("project_id", "spec_block_id", "symbol_id")


def index_build(spark: SparkSession, d: str) -> DataFrame:
    """A whole index from the uploads: parsing, tables, resolution, inverted index and vectors; rows per table."""
    parsed = cut(parse_files(load(spark, d, "blobs")), "parsed")
    chunks, symbols = explode(parsed, "chunks"), explode(parsed, "symbols")
    key = F.xxhash64("project_id", "file_path", "source_fqn", "target_name", "kind", F.coalesce("line", F.lit(-1)))
    refs = explode(parsed, "unresolved").withColumns({"status": F.lit("pending"), "id": F.xxhash64("project_id", "file_path", "from_fqn", "name", "kind", F.coalesce("line", F.lit(-1)))})
    made, failed = resolve_pending(refs, symbols)
    tf, lengths = inverted_index(chunks)
    built = {"chunks": chunks, "symbols": symbols, "edges": retarget_edges(explode(parsed, "edges").withColumn("edge_id", key), symbols), "resolved": made, "failed": failed, "postings": tf, "lengths": lengths, "vectors": embed_distinct(chunks, "content", "content_hash", HashedTrigrams())}
    out = None
    for name, table in built.items():
        row = cut(table, name).agg(F.count(F.lit(1)).alias("rows")).withColumn("table_name", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def register(reg: Registry) -> None:
    reg.query("index_build")(index_build)
    reg.query("plan_scan", PLAN_SQL)(scan_plan)
    reg.query("replace_files", REPLACED_SQL)(replaced)
    reg.query("file_delta", DELTA_SQL)(deltas)
    reg.query("delete_files", DELETED_SQL)(deleted)
    reg.query("checkpoints", "SELECT project_id, 'cp_' || substr(sha256(string_agg(DISTINCT blob_hash, chr(10) ORDER BY blob_hash)), 1, 16) AS checkpoint_id FROM blobs GROUP BY 1")(checkpoint_ids)
    reg.query("blob_usage", "SELECT count(*) AS blobs, sum(octet_length(content))::BIGINT AS bytes FROM (SELECT DISTINCT ON (blob_hash) * FROM blobs)")(blob_usage)
    reg.query("index_stats", STATS_SQL)(run_stats)
    reg.query("all_index_stats", STATS_SQL.replace("SELECT project_id, count", "SELECT count").replace(" GROUP BY 1", ""))(all_stats)
    reg.query("keep_newest", KEEP_SQL)(kept_runs)
    reg.query("usage_summary", SUMMARY_SQL)(summary)
    reg.query("top_queries", f"WITH {AUDIT_SQL} SELECT query, count(*) AS times FROM a GROUP BY 1 ORDER BY times DESC, query LIMIT 10")(frequent)
    reg.query("confidence_counts", f"WITH {AUDIT_SQL} SELECT coalesce(confidence, 'unknown') AS confidence, count(*) AS queries FROM a GROUP BY 1")(confidences)
    reg.query("recent_calls", TIMELINE_SQL)(timeline)
    reg.query("table_counts", COUNT_SQL)(counts)
    reg.query("freshness", "SELECT project_id, max(indexed_at) AS indexed_at FROM files GROUP BY 1")(freshness)
    reg.query("quota_status", QUOTA_SQL)(quotas)
    reg.query("parse_files")(parsed)
    reg.query("parsed_chunks")(parsed_chunks)
    reg.query("link_mentions")(mentions)
