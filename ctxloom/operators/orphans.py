"""References to records that no table holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.operators.skew import salted_join


def parent_intervals(parents: DataFrame, *, scope: str = "project_id", key: str = "key", valid_from: str | None = None, valid_to: str | None = None) -> DataFrame:
    """One row per (scope, key): the earliest start and the latest end of validity; an open end is null."""
    start = F.min(F.col(valid_from)) if valid_from else F.lit(None).cast("timestamp_ntz")
    end = F.max(F.coalesce(F.col(valid_to), F.lit("9999-12-31").cast("timestamp_ntz"))) if valid_to else F.lit("9999-12-31").cast("timestamp_ntz")
    return parents.where(F.col(key).isNotNull()).groupBy(scope, key).agg(start.alias("valid_from"), end.alias("valid_to"))


def orphan_references(refs: DataFrame, parents: DataFrame, *, scope: str = "project_id", key: str = "key", ref_id: str = "ref_key", ref_time: str | None = None, hot_rows: int = 200_000) -> DataFrame:
    """References without a valid parent, with ``status`` missing, deleted or late.

    ``refs``: scope, key, ref_id and any further columns, one row per reference (repeats are the caller's to remove).
    ``parents``: rows of :func:`parent_intervals`. Both sides are partitioned and sorted by (scope, key) and merged in
    one linear pass (a sort-merge join); keys that hold very many references are salted. A reference is

    * missing - no parent ever had the key,
    * deleted - the parent's validity ended at or before the reference was made,
    * late - the parent became valid only after the reference was made.

    References with a null key point at nothing and are no orphans. A null ``ref_time`` leaves only ``missing``. A null
    scope is a scope of its own. Empty ``refs`` give no rows, empty ``parents`` make every reference an orphan. Columns of
    ``refs`` that are named like a result column (valid_from, valid_to, status) give way to it.
    """
    asked = refs.where(F.col(key).isNotNull()).drop("valid_from", "valid_to", "status", "_parent")
    found = salted_join(asked, parents.withColumn("_parent", F.lit(True)), [scope, key], "left", salt_from=[ref_id], hot_rows=hot_rows)
    at = F.col(ref_time) if ref_time else F.lit(None).cast("timestamp_ntz")
    status = (
        F.when(F.col("_parent").isNull(), F.lit("missing"))
        .when(at.isNotNull() & (F.col("valid_to") <= at), F.lit("deleted"))
        .when(at.isNotNull() & F.col("valid_from").isNotNull() & (F.col("valid_from") > at), F.lit("late"))
    )
    return found.withColumn("status", status).where(F.col("status").isNotNull()).drop("_parent")
