"""Writes as set operations: replace files, delete in cascade, upsert, keep the newest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.tables import top_n

#: How many rows are kept per project (fixed values).
KEEP_AUDITS, KEEP_RUNS, KEEP_CHECKPOINTS = 1000, 500, 3


def replace_files(table: DataFrame, fresh: DataFrame, changed: DataFrame, path: str = "file_path") -> DataFrame:
    """``table`` without rows of changed files (project_id, path), plus the fresh rows."""
    keys = changed.select("project_id", F.col("path").alias(path)).distinct()
    return table.join(keys, ["project_id", path], "left_anti").unionByName(fresh, allowMissingColumns=True)


def file_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks of changed files by state: new, reused (same file and content), removed. Both: project_id, file_path, id, content_hash."""
    o = old.groupBy("project_id", "file_path", "content_hash").agg(F.min("id").alias("old_id"))
    n = new.groupBy("project_id", "file_path", "content_hash").agg(F.min("id").alias("new_id"))
    state = F.when(F.col("old_id").isNull(), "new").when(F.col("new_id").isNull(), "removed").otherwise("reused")
    return n.join(o, ["project_id", "file_path", "content_hash"], "full_outer").withColumn("state", state)


def delete_files(tables: dict[str, DataFrame], deleted: DataFrame, spec_refs: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables without rows of deleted files (project_id, path); document links to their symbols become stale."""
    keys = deleted.select("project_id", F.col("path").alias("file_path")).distinct()
    out = {n: t.join(keys if "file_path" in t.columns else keys.withColumnRenamed("file_path", "path"), ["project_id", "file_path" if "file_path" in t.columns else "path"], "left_anti") for n, t in tables.items()}
    if spec_refs is not None and "symbols" in tables:
        gone = tables["symbols"].join(keys, ["project_id", "file_path"], "left_semi").select("project_id", F.col("id").alias("symbol_id"), F.lit(True).alias("_gone")).distinct()
        out["spec_refs"] = spec_refs.join(gone, ["project_id", "symbol_id"], "left").withColumn("stale", F.col("stale") | F.coalesce("_gone", F.lit(False))).drop("_gone")
    return out


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with the rows of ``source`` in place of those with equal keys; the source must hold a key once."""
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source, allowMissingColumns=True)


def insert_new(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with rows of ``source`` whose keys it lacks; what is there keeps its other columns."""
    return target.unionByName(source.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def upsert_unresolved(target: DataFrame, source: DataFrame) -> DataFrame:
    """Unresolved references not there yet by source, name, kind and line, null lines being equal."""
    key = F.xxhash64("project_id", "from_fqn", "name", "kind", F.coalesce("line", F.lit(-1)))
    t, s = target.withColumn("_k", key), source.withColumn("_k", key)
    return insert_new(t, s, ["_k"]).drop("_k")


def keep_newest(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The newest ``n`` rows per key."""
    return top_n(rows, keys, order, n, "_n").drop("_n")


def latest_config(rows: DataFrame) -> DataFrame:
    """(key, value): the value with the greatest version."""
    return rows.groupBy("key").agg(F.max_by("value", F.col("version")).alias("value"))


def reuse_vectors(chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors for chunks whose content already has one, and the chunks that need embedding. A content counts once."""
    held = vectors.groupBy("content_hash").agg(F.first("vector").alias("vector"))
    reused = chunks.join(held, "content_hash").select("project_id", F.col("id").alias("chunk_id"), "content_hash", "vector")
    return reused, chunks.join(held, "content_hash", "left_anti")


def check_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """The vectors, any of another dimension raising when it is read."""
    return vectors.withColumn("vector", F.when(F.size("vector") == dim, F.col("vector")).otherwise(F.raise_error(F.lit(f"a vector is not of dimension {dim}")).cast("array<float>")))


def fingerprint(config: dict) -> str:
    """sha-256 of a configuration as sorted compact JSON."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def invalidation(stored: dict[str, str], current: dict[str, str]) -> str:
    """none for an empty or equal store, full_reparse when the parser differs or is unknown, reembed when model or dimension do."""
    if not stored:
        return "none"
    if stored.get("parser_hash") != current.get("parser_hash"):
        return "full_reparse"
    return "reembed" if any(stored.get(k) != current.get(k) for k in ("model", "dim")) else "none"
