"""The search pipeline as one plan over a batch of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.functions.querytext import query_parts
from ctxloom.operators import fusion, graph, lexical, vector
from ctxloom.operators.pack import Budget, pack
from ctxloom.tables import cut


@dataclass
class Index:
    """The tables of all indexed projects, copies taken out."""

    chunks: DataFrame
    symbols: DataFrame
    edges: DataFrame
    files: DataFrame
    spec_refs: DataFrame | None = None
    chunk_vectors: DataFrame | None = None
    failed_refs: DataFrame | None = None
    terms: tuple[DataFrame, DataFrame] | None = None


def read_queries(queries: DataFrame) -> DataFrame:
    """Queries (query_id, project_id, text) with what they name."""
    return queries.withColumn("_p", query_parts("text")).select("query_id", "project_id", "text", F.array_union("_p.symbols", "_p.inferred").alias("symbols"), F.col("_p.symbols").alias("explicit"), "_p.paths", "_p.inferred", "_p.phrases")


def recall(index: Index, asked: DataFrame, provider: vector.EmbeddingProvider | None = None) -> DataFrame:
    """Candidates of all channels; without vectors or provider the vector channel is empty."""

    def names(column: str) -> DataFrame:
        return asked.select("query_id", "project_id", F.posexplode(column).alias("pos", "name"))

    q = lexical.QUOTAS
    phrases = asked.select("query_id", "project_id", F.posexplode("phrases").alias("pos", "p")).select("query_id", "project_id", "pos", "p.text", "p.strong")
    channels = [
        lexical.recall_symbols(index.symbols, names("explicit"), "exact", 0, q["exact"]),
        lexical.recall_literal(index.chunks, index.symbols, phrases, q["literal"]),
        lexical.recall_symbols(index.symbols, names("inferred"), "inferred", 1, q["inferred"]),
        lexical.recall_bm25(index.chunks, asked, q["bm25"], index.terms),
    ]
    if index.chunk_vectors is not None and provider is not None:
        embedded = vector.embed_column(asked.select("query_id", "project_id", "text"), "text", provider, "query")
        channels.append(vector.recall_vector(index.chunk_vectors, embedded, q["vector"]))
    out = channels[0]
    for c in channels[1:]:
        out = out.unionByName(c)
    return out


def search_pool(index: Index, queries: DataFrame, provider: vector.EmbeddingProvider | None = None) -> tuple[DataFrame, DataFrame]:
    """The read queries and the final reranked pool: recall, fusion, one hop in the graph, features.

    The fused pool is written once: it feeds the expansion, the exclusion of known chunks and the reranking."""
    asked = cut(read_queries(queries), "queries")
    pool = fusion.promote_paths(fusion.enrich(fusion.fuse(recall(index, asked, provider)), index.chunks), asked)
    pool = cut(pool.withColumn("score", F.col("rrf_score")), "pool")
    hops = graph.expand(pool, index.symbols, index.edges, index.chunks, index.spec_refs)
    whole = pool.withColumns({"graph_depth": F.lit(0), "graph_parent": F.lit(None).cast("string"), "synthesized": F.lit(False)}).unionByName(hops.withColumn("channel_ranks", F.create_map().cast("map<string,int>")).drop("hop"), allowMissingColumns=True)
    stale = None
    if index.spec_refs is not None:
        stale = index.spec_refs.where("stale").select("project_id", F.col("spec_block_id").alias("chunk_id"))
    rich = fusion.signals(whole, asked, index.chunks, index.symbols, index.files, stale)
    return asked, fusion.rerank(rich)


def search(index: Index, queries: DataFrame, provider: vector.EmbeddingProvider | None = None, budget: Budget | None = None) -> DataFrame:
    """One evidence pack per query."""
    asked, ranked = search_pool(index, queries, provider)
    ranked = cut(ranked, "ranked")
    heads = ranked.where(F.col("rank") <= graph.FLOW_SEEDS).where("kind <> 'spec' and symbol_fqn is not null").select("query_id", "project_id", F.col("symbol_fqn").alias("fqn"), F.col("rank").alias("pos"))
    chains = graph.flows(heads, index.symbols, index.edges)
    calls = index.edges.where(F.col("kind") == "calls")
    return pack(ranked, index.chunks, asked, budget or Budget.of("fast"), chains, calls, index.spec_refs, index.failed_refs)
