"""Usage, index statistics, timelines, quotas, and retrieval quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400


def nearest_rank(values: Column, share: float) -> Column:
    """The value at round(share * n) - 1 of the sorted values, halves rounded to even; null for none."""
    n = F.size(values)
    at = F.least(n, F.greatest(F.lit(1), F.bround(F.lit(share) * n, 0).cast("int")))
    return F.when(n > 0, F.element_at(F.array_sort(values), at))


def index_stats(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Runs, successes (state done) and failures, and durations of successes: whole average, least, greatest."""
    done = F.col("state") == "done"
    g = runs.groupBy(*(by or []))
    return g.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(done).alias("succeeded"), F.count_if(~F.coalesce(done, F.lit(False))).alias("failed"), F.floor(F.avg(F.when(done, F.col("duration_ms")))).cast("long").alias("avg_duration_ms"),
        F.min(F.when(done, F.col("duration_ms"))).alias("min_duration_ms"), F.max(F.when(done, F.col("duration_ms"))).alias("max_duration_ms"), F.max("finished_at").alias("last_run_at"),
    )


def usage_summary(audits: DataFrame, now: int, days: int = 30, by: list[str] | None = None) -> DataFrame:
    """Queries of the window: total, succeeded, insufficient, failed, latency (whole average and nearest-rank p95), tokens,
    citation coverage. Exact counts and moments are combined on the map side; p95 keeps one histogram entry per distinct
    latency, not one value per query."""
    held = audits.where(F.col("created_at") >= now - max(1, days) * DAY)
    keys = by or []
    total = held.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("answerable") == 1).alias("succeeded"), F.count_if(F.col("answerable") == 0).alias("insufficient"), F.count_if((F.col("degraded") == 1) & F.col("answerable").isNull()).alias("failed"),
        F.floor(F.avg("latency_ms")).cast("long").alias("avg_latency_ms"), F.round(F.avg("citation_coverage"), 4).alias("citation_coverage_avg"), F.coalesce(F.sum("used_tokens"), F.lit(0)).alias("used_tokens"),
    )
    p95 = percentile_by_histogram(held, keys, "latency_ms", 0.95, "p95_latency_ms")
    if not keys:
        return total.withColumn("_k", F.lit(1)).join(p95.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")
    return total.join(p95, keys, "left")


def percentile_by_histogram(rows: DataFrame, keys: list[str], value: str, share: float, out: str) -> DataFrame:
    """The nearest-rank percentile from counts per distinct value: a window over values, not over rows."""
    from pyspark.sql import Window

    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    part = keys or [F.lit(1)]
    up = Window.partitionBy(*part).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*part)
    ranked = counts.withColumn("_up", F.sum("_c").over(up)).withColumn("_n", F.sum("_c").over(whole))
    want = F.least(F.col("_n"), F.greatest(F.lit(1), F.bround(F.lit(share) * F.col("_n"), 0).cast("long")))
    return ranked.where(F.col("_up") >= want).groupBy(*keys).agg(F.min(value).alias(out))


def top_queries(audits: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent queries, ties by text."""
    return audits.groupBy("query").agg(F.count(F.lit(1)).alias("times")).orderBy(F.desc("times"), F.asc("query")).limit(n)


def confidence_counts(audits: DataFrame) -> DataFrame:
    return audits.groupBy(F.coalesce(F.nullif("confidence", F.lit("")), F.lit("unknown")).alias("confidence")).agg(F.count(F.lit(1)).alias("queries"))


def call_timeline(runs: DataFrame, audits: DataFrame | None = None) -> DataFrame:
    """(call_id, kind, project_id, at, id) of all runs and queries of calls, for ordering by at and id."""
    r = runs.where("call_id is not null").select("call_id", F.lit("index").alias("kind"), "project_id", F.col("started_at").alias("at"), "id")
    if audits is None:
        return r
    return r.unionByName(audits.where("request_id is not null").select(F.col("request_id").alias("call_id"), F.lit("query").alias("kind"), "project_id", F.col("created_at").alias("at"), "id"))


def recent_calls(timeline: DataFrame, limit: int = 50) -> DataFrame:
    """Calls by their latest event, newest first."""
    return timeline.groupBy("call_id").agg(F.max("at").alias("at"), F.count(F.lit(1)).alias("events")).orderBy(F.desc("at"), F.asc("call_id")).limit(limit)


def quota_status(sizes: DataFrame, project_limit: int, user_limit: int, warn: float = 0.8) -> DataFrame:
    """(user_id, project_id, bytes): every project and the user's sum held against the limits: ok, warning, exceeded."""
    from pyspark.sql import Window

    per = sizes.groupBy("user_id", "project_id").agg(F.sum("bytes").alias("bytes"))
    mine = F.sum("bytes").over(Window.partitionBy("user_id"))
    worst = F.greatest(F.col("bytes") / project_limit, F.col("user_bytes") / user_limit)
    return per.withColumn("user_bytes", mine).withColumn("status", F.when(worst > 1, "exceeded").when(worst >= warn, "warning").otherwise("ok"))


# ------------------------------------------------------------------------------------------------ retrieval quality


def first_hits(evidence: DataFrame, expected: DataFrame, top_k: int = 10) -> DataFrame:
    """(case_id, rank): the first rank up to ``top_k`` whose evidence (case_id, rank, path, symbol, content) fits an
    expectation (case_id, path, symbol): same path, and the symbol, where given, equal, the tail, or a word of the content."""
    e = expected.select("case_id", F.col("path").alias("_path"), F.col("symbol").alias("_symbol"))
    both = evidence.where(F.col("rank") <= top_k).join(e, "case_id").where(F.col("path") == F.col("_path"))
    said = F.col("_symbol").isNull() | (F.col("symbol") == F.col("_symbol")) | F.endswith("symbol", F.concat(F.lit("."), "_symbol")) | F.endswith("symbol", F.concat(F.lit("::"), "_symbol"))
    words = F.expr(r"content rlike concat('(?<![A-Za-z0-9_.])\\Q', _symbol, '\\E(?![A-Za-z0-9_])')")
    return both.where(F.coalesce(said, F.lit(False)) | F.coalesce(words, F.lit(False))).groupBy("case_id").agg(F.min("rank").alias("rank"))


def metrics(cases: DataFrame, hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """recall@5, recall@10 and mean reciprocal rank over cases with expectations; a case without a hit counts 0."""
    j = cases.join(hits, "case_id", "left")
    return j.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("cases"), F.avg(F.when(F.col("rank") <= 5, 1.0).otherwise(0.0)).alias("recall_at_5"), F.avg(F.when(F.col("rank") <= 10, 1.0).otherwise(0.0)).alias("recall_at_10"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr")
    )


def negatives_passed(results: DataFrame) -> DataFrame:
    """Cases without expectations (case_id, answerable, gaps) that were rightly called unanswerable with a gap named."""
    return results.select("case_id", (~F.col("answerable") & (F.col("gaps") > 0)).alias("passed"))


def report(rows: list, title: str) -> str:
    """Metrics rows as a Markdown table."""
    if not rows:
        return f"# {title}\n\nno cases\n"
    names = rows[0].__fields__
    body = ["| " + " | ".join(f"{v:.3f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]
    return "\n".join([f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names), *body, ""])
