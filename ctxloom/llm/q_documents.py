"""Leaks of evaluation items (p8) and repetition (p10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.llm.leaks import leaked, leaked_by_runs
from ctxloom.llm.repetition import fertility, repetition
from ctxloom.llm.tokens import Tokenizer
from ctxloom.tables import load


def leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked(load(spark, d, "documents"), load(spark, d, "eval_items"))


def leaks_by_item(spark: SparkSession, d: str) -> DataFrame:
    """Per item how many documents give it away."""
    return leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


def complete_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Leaks by unedited runs, complete by proof, to hold the fingerprints' result against."""
    return leaked_by_runs(load(spark, d, "documents"), load(spark, d, "eval_items"))


def repetitive(spark: SparkSession, d: str) -> DataFrame:
    return repetition(load(spark, d, "documents")).where(F.col("repeated_share") >= 0.3).select("doc_id")


def shares(spark: SparkSession, d: str) -> DataFrame:
    """The repeated share of every document."""
    return repetition(load(spark, d, "documents")).withColumn("repeated_share", F.round("repeated_share", 9))


def fertilities(spark: SparkSession, d: str) -> DataFrame:
    """Tokenizer fertility of every document."""
    return fertility(load(spark, d, "documents"), Tokenizer("piece_bpe_32k.model"))


_D = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{AC00}-\x{D7AF}"
#: The repeated share by windows numbered in SQL: words are runs of letters, dense scripts count characters.
SHARES_SQL = f"""WITH u AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[{_D}]|[^\\P{{L}}{_D}]+') AS units, regexp_matches(coalesce(text, ''), '[{_D}]') AS dense FROM documents),
w AS (SELECT doc_id, i, 6 AS size, units[i:i + 5] AS win FROM (SELECT doc_id, units, dense, unnest(range(1, len(units) - 4)) AS i FROM u) WHERE NOT dense OR NOT regexp_matches(array_to_string(units[i:i + 5], ' '), '[{_D}]')
      UNION ALL SELECT doc_id, i, 10, units[i:i + 9] FROM (SELECT doc_id, units, unnest(range(1, len(units) - 8)) AS i FROM u WHERE dense)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, size, win ORDER BY i) AS n FROM w),
c AS (SELECT doc_id, count(DISTINCT pos) AS covered FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM r WHERE n > 1) GROUP BY 1),
s AS (SELECT u.doc_id, CASE WHEN len(units) <= 6 THEN 0.0 ELSE coalesce(covered, 0) / len(units) END AS repeated_share FROM u LEFT JOIN c USING (doc_id)) """


def register(reg) -> None:
    reg.query("p8_found")(leaks)
    reg.query("p8_by_item")(leaks_by_item)
    reg.query("p8_complete")(complete_leaks)
    reg.query("p10_found", SHARES_SQL + "SELECT doc_id FROM s WHERE repeated_share >= 0.3")(repetitive)
    reg.query("p10_shares", SHARES_SQL + "SELECT doc_id, round(repeated_share, 9) AS repeated_share FROM s")(shares)
    reg.query("p10_fertility")(fertilities)
