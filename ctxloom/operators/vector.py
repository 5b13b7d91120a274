"""Exact cosine search in blocks, and embedding providers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxloom.tables import cut, top_n


class EmbeddingProvider(Protocol):
    """Turns texts into unit vectors; ``side`` is ``query`` or ``passage``."""

    model: str
    dim: int

    def embed(self, texts: Sequence[str], side: str) -> np.ndarray: ...


class HashedTrigrams:
    """A deterministic provider without a model: signed counts of hashed character trigrams, L2-normalised."""

    def __init__(self, dim: int = 64):
        self.dim, self.model = dim, f"trigrams-{dim}"

    def embed(self, texts: Sequence[str], side: str = "passage") -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, text in zip(out, texts):
            c = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
            if len(c) < 3:
                continue
            h = (c[:-2] * np.uint64(0x9E3779B1) ^ c[1:-1] * np.uint64(0x85EBCA77) ^ c[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
            place = (h >> np.uint64(33)) % np.uint64(self.dim)
            row += np.bincount(place.astype(np.int64), weights=np.where(h >> np.uint64(63), 1.0, -1.0), minlength=self.dim)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.maximum(norms, 1e-12)


def with_prefix(text: Column, side: str, prefixes: dict[str, str]) -> Column:
    """The text with the prefix its side has under a model, if it has one."""
    return F.concat(F.lit(prefixes.get(side, "")), text)


def embed_window(batch: int, concurrency: int, most: int = 4_000) -> int:
    """How many texts are in flight at once."""
    return min(batch * concurrency, most)


def cached_query_vectors(queries: DataFrame, provider: EmbeddingProvider, cache: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Query vectors (query_id, project_id, vector), and the cache (model, dim, text, vector) with the new ones added."""
    mine = None if cache is None else cache.where((F.col("model") == provider.model) & (F.col("dim") == provider.dim)).select("text", "vector")
    asked = queries.select("text").where("text is not null").distinct()
    fresh = embed_column(asked if mine is None else asked.join(mine, "text", "left_anti"), "text", provider, "query").select("text", "vector")
    known = fresh if mine is None else mine.unionByName(fresh)
    added = fresh.select(F.lit(provider.model).alias("model"), F.lit(provider.dim).alias("dim"), "text", "vector")
    return queries.select("query_id", "project_id", "text").join(known, "text").drop("text"), added if cache is None else cache.unionByName(added)


def embed_column(df: DataFrame, text: str, provider: EmbeddingProvider, side: str = "passage", out: str = "vector", batch: int = 256) -> DataFrame:
    """``df`` with the embedding of ``text``; one provider per worker, batches keep their order, null texts count as empty."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f[text].fillna("").tolist()
            parts = [provider.embed(texts[i : i + batch], side) for i in range(0, len(texts), batch)]
            f[out] = list(np.concatenate(parts)) if parts else []
            yield f

    return df.mapInPandas(run, schema)


def embed_distinct(df: DataFrame, text: str, hash_col: str, provider: EmbeddingProvider, cache: DataFrame | None = None) -> DataFrame:
    """(hash_col, vector) for every distinct content: cached vectors are reused, each other content is embedded once."""
    distinct = df.groupBy(hash_col).agg(F.min(text).alias(text))
    if cache is None:
        return embed_column(distinct, text, provider).select(hash_col, "vector")
    known = cache.where(F.col("model") == provider.model).groupBy(hash_col).agg(F.first("vector").alias("vector"))
    fresh = embed_column(distinct.join(known, hash_col, "left_anti"), text, provider).select(hash_col, "vector")
    return known.join(distinct, hash_col, "left_semi").select(hash_col, "vector").unionByName(fresh)


def token_batches(sizes: Sequence[int], most_items: int, most_tokens: int) -> list[list[int]]:
    """Indices in greedy batches by count and token sum; an item over the budget is a batch of its own."""
    out: list[list[int]] = []
    total = 0
    for i, n in enumerate(sizes):
        if out and len(out[-1]) < most_items and total + n <= most_tokens:
            out[-1].append(i)
            total += n
        else:
            out.append([i])
            total = n
    return out


def cosine_top_k(corpus: DataFrame, queries: DataFrame, k: int, *, corpus_id: str, query_id: str, vector: str = "vector", scope: str | None = None, block: int = 4096) -> DataFrame:
    """(query_id, corpus_id, score, rank): the k nearest corpus rows per query by cosine, exact.

    Queries go to the corpus in blocks of ``block`` vectors, so memory is bounded whatever their number; each Arrow batch
    of the corpus is multiplied with the block and only its k best per query leave the task. Vectors are compared in
    double precision; a zero vector has similarity 0 with all, ties go to the smaller id. With ``scope`` (a column of
    both sides) a query meets rows of its scope only. Null vectors take no part; unequal dimensions are an error.
    """
    fields = [T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(corpus_id, corpus.schema[corpus_id].dataType), T.StructField("score", T.DoubleType())]
    schema = T.StructType(fields)
    asked = queries.where(F.col(vector).isNotNull()).select(query_id, vector, *([scope] if scope else []))
    rows = corpus.where(F.col(vector).isNotNull()).select(corpus_id, vector, *([scope] if scope else []))
    spark = corpus.sparkSession
    parts: list[DataFrame] = []

    def flush(chunk: list) -> None:
        matrix = np.array([r[vector] for r in chunk], dtype=np.float64)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
        held = spark.sparkContext.broadcast(([r[query_id] for r in chunk], matrix, [r[scope] if scope else None for r in chunk]))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, q, scopes = held.value
            q_scopes = np.array(scopes, dtype=object)
            for f in frames:
                if not len(f):
                    continue
                m = np.array(f[vector].tolist(), dtype=np.float64)
                if m.ndim != 2 or m.shape[1] != q.shape[1]:
                    raise ValueError("vectors of different dimensions")
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                ids = f[corpus_id].to_numpy()
                for s in f[scope].unique() if scope else [None]:
                    mine = np.nonzero(q_scopes == s)[0] if scope else np.arange(len(names))
                    at = np.nonzero((f[scope] == s).to_numpy())[0] if scope else np.arange(len(ids))
                    if not len(mine):
                        continue
                    sims = np.round(q[mine] @ m[at].T, 12)
                    order = np.argsort(ids[at], kind="stable")
                    best = order[np.argsort(-sims[:, order], axis=1, kind="stable")[:, :k]]
                    yield pd.DataFrame({query_id: np.repeat(np.array(names, dtype=object)[mine], best.shape[1]), corpus_id: ids[at][best].ravel(), "score": np.take_along_axis(sims, best, axis=1).ravel()})

        parts.append(rows.mapInPandas(run, schema))

    chunk: list = []
    for r in asked.toLocalIterator():
        chunk.append(r)
        if len(chunk) == block:
            flush(chunk)
            chunk = []
    if chunk:
        flush(chunk)
    if not parts:
        return spark.createDataFrame([], T.StructType([*fields, T.StructField("rank", T.IntegerType())]))
    found = parts[0]
    if len(parts) > 8:  # keep plans short
        found = cut(found, "topk")
        for k0 in range(1, len(parts)):
            found = found.unionByName(cut(parts[k0], "topk"))
    else:
        for p in parts[1:]:
            found = found.unionByName(p)
    return top_n(found, [query_id], [F.desc("score"), F.asc(corpus_id)], k)


def recall_vector(chunk_vectors: DataFrame, query_vectors: DataFrame, limit: int = 50) -> DataFrame:
    """Candidates of the vector channel within each query's project; without query vectors there are none, and the caller degrades."""
    found = cosine_top_k(chunk_vectors, query_vectors, limit, corpus_id="chunk_id", query_id="query_id", scope="project_id")
    named = found.join(query_vectors.select("query_id", "project_id"), "query_id")
    return named.select("query_id", "project_id", "chunk_id", F.lit("vector").alias("channel"), "rank", F.lit(2).alias("tier"), F.format_string("vector %.6f", "score").alias("reason"))
