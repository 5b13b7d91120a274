"""Golden cases through the whole search, measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.operators.pack import Budget
from ctxloom.operators.usage import first_hits, metrics, negatives_passed
from ctxloom.operators.vector import EmbeddingProvider
from ctxloom.plans.search import Index, search
from ctxloom.tables import cut

_EVIDENCE = "array<struct<id:string,path:string,symbol:string,content:string>>"


def run_golden(index: Index, cases: DataFrame, project: str, provider: EmbeddingProvider | None = None, *, max_tokens: int = 10_000, top_k: int = 10) -> DataFrame:
    """One row per case (id, query, category, expected): rank of the first hit (null: none within ``top_k``), answerable,
    confidence, the number of gaps named and of evidence, and whether a case without expectations passed.

    Evidence ranks as it is packed. All cases are one batch of queries and are searched as one plan."""
    asked = cases.select(F.col("id").alias("query_id"), F.lit(project).alias("project_id"), F.col("query").alias("text"))
    packs = cut(search(index, asked, provider, Budget.of("fast", max_tokens)), "golden")
    read = packs.select(F.col("query_id").alias("case_id"), "answerable", "confidence", F.from_json(F.get_json_object("pack", "$.evidence"), _EVIDENCE).alias("e"), F.size(F.from_json(F.get_json_object("pack", "$.missingEvidence"), "array<struct<code:string>>")).alias("gaps"))
    evidence = read.select("case_id", F.posexplode("e").alias("pos", "x")).select("case_id", (F.col("pos") + 1).alias("rank"), "x.path", "x.symbol", "x.content")
    expected = cases.select(F.col("id").alias("case_id"), F.explode("expected").alias("x")).select("case_id", "x.path", "x.symbol")
    hits = first_hits(evidence, expected, top_k)
    negative = negatives_passed(read.join(cases.where(F.size(F.coalesce("expected", F.array())) == 0).select(F.col("id").alias("case_id")), "case_id", "left_semi"))
    out = cases.select(F.col("id").alias("case_id"), "category").join(read.select("case_id", "answerable", "confidence", "gaps", F.size("e").alias("evidence")), "case_id", "left")
    return out.join(hits, "case_id", "left").join(negative, "case_id", "left")


def quality(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Recall and mean reciprocal rank of the cases with expectations among rows of :func:`run_golden`."""
    positive = results.where("passed is null")
    return metrics(positive.select("case_id", *(by or [])), positive.where("rank is not null").select("case_id", "rank"), by)
