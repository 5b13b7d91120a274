"""Token budgets (p5) and mixing (p9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.functions.text import ESTIMATE_SQL, estimate_tokens
from ctxloom.llm.mixing import Mixture
from ctxloom.llm.tokens import Tokenizer, TokenLedger
from ctxloom.tables import current_files, cut, load, scratch

CHUNK_TOKENS = f"(SELECT project_id, id, max(file_path) AS file_path, max({ESTIMATE_SQL.format(t='content')}) AS tokens FROM chunks GROUP BY project_id, id)"
DOC_SOURCE = "replace(lower(trim(source)), '_', '-')"


def wrong_totals(spark: SparkSession, d: str) -> DataFrame:
    """Projects whose recorded total is off by more than a factor of two.

    The ledger stands as the successful runs left it (chunks that one of them wrote in their present state) and is then
    brought to all present chunks by the signed deltas of what they lack."""
    ledger = TokenLedger(spark, scratch(spark, "p5"), ["project_id", "id"], ["project_id"])
    done = load(spark, d, "index_runs").where("state = 'done'").select(F.col("id").alias("run_id")).distinct()
    written = load(spark, d, "processed_items").where("item_kind = 'chunk'").join(done, "run_id", "left_semi").select("project_id", F.col("item_key").alias("id"), "content_hash")
    sized = cut(ledger.size(load(spark, d, "chunks").select("project_id", "id", "content"), "content"), "p5")
    ledger.merge(sized.join(written, ["project_id", "id", "content_hash"], "left_semi"))
    cube = ledger.merge(sized)
    recorded = load(spark, d, "index_manifest").where("tokens_bge_m3 is not null").select("project_id", "tokens_bge_m3")
    both = recorded.join(cube.select("project_id", "tokens"), "project_id", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    return both.where((F.col("tokens_bge_m3") * 2 < F.col("tokens")) | (F.col("tokens_bge_m3") > F.col("tokens") * 2)).select("project_id").distinct()


def chunk_cube(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of chunks by repository, language and domain."""
    manifest = load(spark, d, "index_manifest").groupBy("project_id").agg(F.max(F.struct("repo", "domain")).alias("m"))
    files = current_files(load(spark, d, "files"), "language").select("project_id", F.col("path").alias("file_path"), "language")
    ledger = TokenLedger(spark, scratch(spark, "p5c"), ["project_id", "id"], ["project_id", "file_path"])
    cube = ledger.update(load(spark, d, "chunks").select("project_id", "id", "file_path", "content"), "content")
    wide = cube.join(files, ["project_id", "file_path"], "left").join(manifest, "project_id", "left")
    return wide.groupBy(F.col("m.repo").alias("repo"), "language", F.col("m.domain").alias("domain")).agg(F.sum("tokens").alias("tokens"), F.sum("documents").alias("chunks"))


def document_cube(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of documents by source, lang and doctype."""
    ledger = TokenLedger(spark, scratch(spark, "p5d"), ["doc_id"], ["source", "lang", "doctype"])
    docs = load(spark, d, "documents").select("doc_id", "source", "lang", "doctype", "text")
    return ledger.update(docs).select("source", "lang", "doctype", "tokens", "documents")


def vocabulary_cube(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of documents by source and lang under a public vocabulary."""
    ledger = TokenLedger(spark, scratch(spark, "p5v"), ["doc_id"], ["source", "lang"], Tokenizer("byte_bpe_multi_50k.tiktoken"))
    return ledger.update(load(spark, d, "documents").select("doc_id", "source", "lang", "text"))


def delta_cube(spark: SparkSession, d: str) -> DataFrame:
    """The document cube reached in two runs, the second adding and removing documents; equal to the cube of one run."""
    docs = load(spark, d, "documents").select("doc_id", "source", "lang", "doctype", "text", "ingested_at")
    ledger = TokenLedger(spark, scratch(spark, "p5i"), ["doc_id"], ["source", "lang", "doctype"])
    cutoff = F.lit("2025-10-01").cast("timestamp_ntz")
    first = docs.where(F.coalesce(F.col("ingested_at"), cutoff) <= cutoff).withColumn("lang", F.lower("lang"))
    ledger.update(first)
    return ledger.update(docs).select("source", "lang", "doctype", "tokens", "documents")


def _mixture(spark: SparkSession, d: str) -> Mixture:
    docs = load(spark, d, "documents").select("doc_id", "source", estimate_tokens(F.col("text")).alias("tokens"))
    return Mixture(docs, load(spark, d, "mix_targets"))


def short_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose blocks all stand in the shards as often as allowed and still give less than their share."""
    return _mixture(spark, d).shares().where("falls_short").select("source")


def shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares wanted and reached."""
    return _mixture(spark, d).shares()


def limits(spark: SparkSession, d: str) -> DataFrame:
    """What each target source holds, wants and can give at most."""
    m = _mixture(spark, d).shares()
    return m.select("source", "tokens", F.round("wanted", 3).alias("wanted"), "available", "falls_short")


def mixed_documents(spark: SparkSession, d: str) -> DataFrame:
    """The mix itself, laid out by shard and shuffled within."""
    return _mixture(spark, d).shuffled()


def mixed_totals(spark: SparkSession, d: str) -> DataFrame:
    """What the mix holds of each target source, counted on its rows."""
    m = _mixture(spark, d)
    held = m.mix().groupBy("source").agg(F.sum("tokens").alias("taken"), F.max("copy").alias("last_copy"))
    wide = m.shares().select("source", "falls_short", "available", "max_repeats").join(held, "source", "left")
    short = F.col("falls_short") & (F.coalesce("taken", F.lit(0)) == F.col("available"))
    return wide.select("source", short.alias("used_up"), (F.coalesce("last_copy", F.lit(-1)) < F.col("max_repeats")).alias("within_repeats"))


def register(reg) -> None:
    reg.query(
        "p5_found",
        f"""SELECT DISTINCT m.project_id FROM index_manifest m LEFT JOIN (SELECT project_id, sum(tokens) AS t FROM {CHUNK_TOKENS} GROUP BY 1) c ON c.project_id = m.project_id
        WHERE m.tokens_bge_m3 IS NOT NULL AND (m.tokens_bge_m3 * 2 < coalesce(t, 0) OR m.tokens_bge_m3 > coalesce(t, 0) * 2)""",
    )(wrong_totals)
    reg.query(
        "p5_chunk_cube",
        f"""SELECT repo, language, domain, sum(tokens) AS tokens, count(*) AS chunks FROM {CHUNK_TOKENS} c
        LEFT JOIN (SELECT project_id, path, language, row_number() OVER (PARTITION BY project_id, path ORDER BY indexed_at DESC, content_hash DESC) AS rn FROM files) f
          ON f.project_id = c.project_id AND f.path = c.file_path AND rn = 1
        LEFT JOIN (SELECT DISTINCT project_id, repo, domain FROM index_manifest) m ON m.project_id = c.project_id GROUP BY ALL""",
    )(chunk_cube)
    cube = f"SELECT source, lang, doctype, sum({ESTIMATE_SQL.format(t='text')}) AS tokens, count(*) AS documents FROM documents GROUP BY ALL"
    reg.query("p5_document_cube", cube)(document_cube)
    reg.query("p5_delta_cube", cube)(delta_cube)
    reg.query("p5_vocabulary_cube")(vocabulary_cube)
    sized = f"""WITH s AS (SELECT {DOC_SOURCE} AS source, sum({ESTIMATE_SQL.format(t='text')}) AS n FROM documents GROUP BY 1),
        t AS (SELECT m.source, m.target_share, m.max_repeats, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER () AS total FROM mix_targets m LEFT JOIN s ON s.source = m.source) """
    reg.query("p9_found", sized + "SELECT source FROM t WHERE max_repeats * n < target_share * total")(short_sources)
    reg.query("p9_limits", sized + "SELECT source, n AS tokens, round(target_share * total, 3) AS wanted, max_repeats * n AS available, max_repeats * n < target_share * total AS falls_short FROM t")(limits)
    reg.query("p9_shares")(shares)
    reg.query("p9_totals", sized + "SELECT source, max_repeats * n < target_share * total AS used_up, true AS within_repeats FROM t")(mixed_totals)
    reg.query("p9_mix")(mixed_documents)
