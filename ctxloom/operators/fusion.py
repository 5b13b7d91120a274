"""Rank fusion and feature reranking over pools of candidates."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.functions.classify import candidate_kind, doctype, is_generated_path, is_test_intent, is_test_path
from ctxloom.functions.text import symbol_names
from ctxloom.operators.lexical import POOL
from ctxloom.tables import top_n

#: Rank fusion constant and the scale of fused scores in the final score (fixed values).
RRF_K, BASE_SCALE = 60, 25.0
CHANNELS = ("exact", "literal", "inferred", "bm25", "vector")
VECTOR_TOP, VECTOR_NEAR = 8, 10
DEPRECATED_MARK = "@deprecat"
HIGH_VALUE_DOCTYPES = ("agent-instructions", "design", "adr", "readme", "api")
#: Feature weights (fixed values).
WEIGHTS: dict[str, float] = {
    "explicit symbol/path hit": 2.0,
    "literal hit": 1.0,
    "literal root name hit": 0.4,
    "query symbol == chunk symbol": 1.0,
    "3-channel consensus": 0.5,
    "vector top-8 (semantic relevance)": 1.5,
    "vector top-10 (semantic relevance)": 0.7,
    "graph connected to top-1 seed (1 hop)": 0.5,
    "high-value doctype": 0.8,
    "entry point / exported symbol": 0.2,
    "generated file": -1.0,
    "deprecated symbol": -0.35,
    "test fixture (suppressed; tests are reference only)": -1.5,
    "stale spec reference": -0.8,
    "fallback_block": -0.5,
    "graph distance 2 hops": -0.3,
    "synthesized edge": -0.2,
}


def weights_from(env: Mapping[str, str] | None = None, prefix: str = "CTXLOOM_W_") -> dict[str, float]:
    """The weights with ``LITERAL`` and ``LITERAL_ROOT`` taken from the environment where they are numbers."""
    env = os.environ if env is None else env
    out = dict(WEIGHTS)
    for name, key in (("literal hit", "LITERAL"), ("literal root name hit", "LITERAL_ROOT")):
        try:
            out[name] = float(env[prefix + key])
        except (KeyError, ValueError):
            continue
    return out


def reciprocal_rank(rank: Column) -> Column:
    return F.lit(1.0) / (F.lit(RRF_K) + rank)


def fuse(candidates: DataFrame, limit: int = POOL) -> DataFrame:
    """Channel candidates (query_id, project_id, chunk_id, channel, rank, tier, reason) as one pool per query.

    rrf_score sums 1 / (60 + rank) over channels, each with its best rank; order: score, more channels, better rank, id.
    tier is the least of all, channel_ranks maps channel to rank, reasons are distinct and in the order of channels.
    """
    place = F.array_position(F.array(*[F.lit(c) for c in CHANNELS]), F.col("channel"))
    best = candidates.groupBy("query_id", "project_id", "chunk_id", "channel").agg(F.min("rank").alias("rank"), F.min("tier").alias("tier"), F.min(F.struct("rank", "reason")).alias("r"))
    pooled = best.groupBy("query_id", "project_id", "chunk_id").agg(
        F.round(F.sum(reciprocal_rank(F.col("rank"))), 12).alias("rrf_score"),
        F.count(F.lit(1)).cast("int").alias("channels"),
        F.min("rank").alias("best_rank"),
        F.min("tier").alias("tier"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "rank")))).alias("channel_ranks"),
        F.array_sort(F.collect_list(F.struct(place.alias("p"), F.array(F.col("r.reason"), F.concat("channel", F.lit(" rank "), F.col("rank").cast("string"))).alias("why")))).alias("_why"),
    )
    reasons = F.array_distinct(F.filter(F.flatten(F.transform("_why", lambda w: w["why"])), lambda x: x.isNotNull()))
    pool = pooled.withColumn("reasons", reasons).drop("_why")
    return top_n(pool, ["query_id"], [F.desc("rrf_score"), F.desc("channels"), F.asc("best_rank"), F.asc("chunk_id")], limit, "pool_rank")


def enrich(pool: DataFrame, chunks: DataFrame) -> DataFrame:
    """The pool with path, lines, symbol and kind of each chunk; vanished chunks fall out."""
    meta = chunks.select("project_id", F.col("id").alias("chunk_id"), F.col("file_path").alias("path"), "symbol_fqn", "symbol_kind", "start_line", "end_line")
    return pool.join(meta, ["project_id", "chunk_id"]).withColumn("kind", candidate_kind(F.col("path"), F.col("symbol_kind")))


def promote_paths(pool: DataFrame, paths: DataFrame) -> DataFrame:
    """Candidates whose path a query names (query_id, paths) go to tier 0."""
    named = F.exists("paths", lambda p: (F.col("path") == p) | F.endswith(F.col("path"), F.concat(F.lit("/"), p)))
    out = pool.join(paths.select("query_id", "paths"), "query_id", "left").withColumn("_named", F.coalesce(named, F.lit(False)))
    return out.withColumn("tier", F.when(F.col("_named"), 0).otherwise(F.col("tier"))).withColumn("reasons", F.when(F.col("_named"), F.array_union("reasons", F.array(F.lit("explicit path")))).otherwise(F.col("reasons"))).drop("_named", "paths")


def signals(pool: DataFrame, queries: DataFrame, chunks: DataFrame, symbols: DataFrame, files: DataFrame, stale_specs: DataFrame | None = None) -> DataFrame:
    """The pool with the facts that features need, as boolean columns.

    ``queries``: query_id, project_id, text, symbols (array of names the query gives)."""
    exported = symbols.where("is_exported").select("project_id", F.col("fqn").alias("symbol_fqn"), F.lit(True).alias("_exported")).distinct()
    generated = files.where("generated").select("project_id", "path", F.lit(True).alias("_generated")).distinct()
    # an ingest keeps the mark as a column, so that no content is read for it
    deprecated_chunk = F.col("deprecated") if "deprecated" in chunks.columns else F.lower("content").contains(DEPRECATED_MARK)
    marked = chunks.where(deprecated_chunk).select("project_id", F.col("id").alias("chunk_id"), F.lit(True).alias("_marked")).distinct()
    asked = queries.select("query_id", "project_id", F.explode("symbols").alias("token"))
    tests = symbols.where(is_test_path(F.col("file_path"))).select("project_id", F.explode(F.array("name", "fqn")).alias("token")).distinct()
    names_test = asked.join(tests, ["project_id", "token"], "left_semi").select("query_id", F.lit(True).alias("_names_test")).distinct()
    out = pool.join(exported, ["project_id", "symbol_fqn"], "left").join(generated, ["project_id", "path"], "left").join(marked, ["project_id", "chunk_id"], "left")
    out = out.join(queries.select("query_id", F.col("symbols").alias("_asked"), is_test_intent(F.col("text")).alias("_intent")), "query_id", "left").join(names_test, "query_id", "left")
    if stale_specs is None:
        out = out.withColumn("stale", F.lit(False))
    else:
        out = out.join(stale_specs.select("project_id", "chunk_id", F.lit(True).alias("_stale")).distinct(), ["project_id", "chunk_id"], "left").withColumn("stale", F.coalesce("_stale", F.lit(False))).drop("_stale")
    same = Window.partitionBy("query_id", "path", "symbol_fqn")
    deprecated = F.coalesce("_marked", F.lit(False)) | (F.col("symbol_fqn").isNotNull() & F.coalesce(F.max("_marked").over(same), F.lit(False)))
    return (
        out.withColumn("exported", F.coalesce("_exported", F.lit(False)))
        .withColumn("generated", F.coalesce("_generated", F.lit(False)) | is_generated_path(F.col("path")))
        .withColumn("deprecated", deprecated)
        .withColumn("test_intent", F.coalesce("_intent", F.lit(False)) | F.coalesce("_names_test", F.lit(False)))
        .withColumn("asked_symbol", F.coalesce(F.arrays_overlap(symbol_names(F.col("symbol_fqn")), F.col("_asked")), F.lit(False)))
        .drop("_exported", "_generated", "_marked", "_asked", "_intent", "_names_test")
    )


def rerank(pool: DataFrame, weights: Mapping[str, float] | None = None, *, first: str = "rrf_score") -> DataFrame:
    """Adds score = 25 rrf + features, the reasons of features that hit, and rank (score, rrf_score, chunk id).

    Needs the columns of :func:`signals`; graph columns (graph_depth, graph_parent, synthesized) are optional. The top seed
    is the pool's first by ``first``.
    """
    w = dict(WEIGHTS if weights is None else weights)
    for name, default in (("graph_depth", F.lit(0)), ("graph_parent", F.lit(None).cast("string")), ("synthesized", F.lit(False))):
        if name not in pool.columns:
            pool = pool.withColumn(name, default)
    lead = Window.partitionBy("query_id").orderBy(F.desc(first), F.desc("rrf_score"), F.asc("chunk_id"))
    pool = pool.withColumn("_top", F.first("chunk_id").over(lead))
    vector = F.col("channel_ranks")["vector"]
    said = F.col("reasons")
    tests = {
        "explicit symbol/path hit": F.col("channel_ranks")["exact"].isNotNull() | F.array_contains(said, "explicit path"),
        "literal hit": F.exists(said, lambda r: r.startswith("explicit literal ")),
        "literal root name hit": F.exists(said, lambda r: r.startswith("literal root ")),
        "query symbol == chunk symbol": F.col("asked_symbol"),
        "3-channel consensus": F.coalesce(F.size("channel_ranks"), F.lit(0)) >= 3,
        "vector top-8 (semantic relevance)": vector <= VECTOR_TOP,
        "vector top-10 (semantic relevance)": (vector > VECTOR_TOP) & (vector <= VECTOR_NEAR),
        "graph connected to top-1 seed (1 hop)": (F.col("graph_depth") == 1) & (F.col("graph_parent") == F.col("_top")),
        "high-value doctype": (F.col("kind") == "spec") & doctype(F.col("path")).isin(*HIGH_VALUE_DOCTYPES),
        "entry point / exported symbol": F.col("exported"),
        "generated file": F.col("generated"),
        "deprecated symbol": F.col("deprecated"),
        "test fixture (suppressed; tests are reference only)": (F.col("kind") == "test") & ~F.col("test_intent"),
        "stale spec reference": F.col("stale"),
        "fallback_block": F.col("kind") == "fallback",
        "graph distance 2 hops": F.col("graph_depth") >= 2,
        "synthesized edge": F.col("synthesized"),
    }
    score = F.col("rrf_score") * BASE_SCALE
    hit: list[Column] = []
    for name, test in tests.items():
        holds = F.coalesce(test, F.lit(False))
        score = score + F.when(holds, F.lit(w[name])).otherwise(F.lit(0.0))
        hit.append(F.when(holds & F.lit(w[name] != 0.0), F.lit(f"{name} {w[name]:+.1f}")))
    why = F.array_union(said, F.filter(F.array(*hit), lambda x: x.isNotNull()))
    out = pool.withColumn("score", F.round(score, 9)).withColumn("reasons", why).drop("_top")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("rrf_score"), F.asc("chunk_id"))
    return out.withColumn("rank", F.row_number().over(order))
