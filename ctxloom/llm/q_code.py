"""Files that do not parse (p1), foreign source files (p2), documentation pairs (p4) and credentials (p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.llm.docs import documented_functions
from ctxloom.llm.provenance import foreign_files
from ctxloom.llm.secrets import credential_lines, redacted
from ctxloom.llm.syntax import broken_files
from ctxloom.tables import current_files, load


def broken(spark: SparkSession, d: str) -> DataFrame:
    """Current files that do not parse, with line and message of the first error."""
    return broken_files(load(spark, d, "files"), load(spark, d, "blobs"))


def broken_paths(spark: SparkSession, d: str) -> DataFrame:
    return broken(spark, d).select("project_id", "path")


def broken_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per repository and language: files, files that do not parse, and the rate."""
    repos = load(spark, d, "index_manifest").groupBy("project_id").agg(F.max("repo").alias("repo"))
    files = current_files(load(spark, d, "files"), "language").groupBy("project_id", "language").agg(F.count(F.lit(1)).alias("files"))
    bad = broken(spark, d).groupBy("project_id", "language").agg(F.count(F.lit(1)).alias("broken"))
    on = (files.project_id == bad.project_id) & files.language.eqNullSafe(bad.language)
    both = files.join(bad, on, "left").select(files.project_id, files.language, "files", F.coalesce("broken", F.lit(0)).alias("broken"))
    total = both.join(repos, "project_id", "left").groupBy("repo", "language").agg(F.sum("files").alias("files"), F.sum("broken").alias("broken"))
    return total.withColumn("rate", F.col("broken") / F.col("files"))


def foreign(spark: SparkSession, d: str) -> DataFrame:
    """Current source files that are not hand-written code of the project, with the reasons."""
    return foreign_files(load(spark, d, "blobs"), load(spark, d, "files"), load(spark, d, "index_manifest"))


def foreign_paths(spark: SparkSession, d: str) -> DataFrame:
    return foreign(spark, d).select("project_id", "path")


def documented(spark: SparkSession, d: str) -> DataFrame:
    return documented_functions(load(spark, d, "chunks")).select("project_id", "chunk_id").distinct()


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of code and description."""
    return documented_functions(load(spark, d, "chunks")).distinct()


def credentials(spark: SparkSession, d: str) -> DataFrame:
    return credential_lines(load(spark, d, "chunks")).select("project_id", "chunk_id", "line_no")


def credentials_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """Per project and kind how many credentials were found."""
    return credential_lines(load(spark, d, "chunks")).groupBy("project_id", "kind").agg(F.count(F.lit(1)).alias("credentials"))


def masked(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with credentials, their values masked."""
    return redacted(load(spark, d, "chunks"))


def register(reg) -> None:
    reg.query("p1_found")(broken_paths)
    reg.query("p1_errors")(broken)
    reg.query("p1_rates")(broken_rates)
    reg.query("p2_found")(foreign_paths)
    reg.query("p2_reasons")(foreign)
    reg.query("p4_found")(documented)
    reg.query("p4_pairs")(pairs)
    reg.query("p7_found")(credentials)
    reg.query("p7_by_kind")(credentials_by_kind)
    reg.query("p7_masked")(masked)
