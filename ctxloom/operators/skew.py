"""Joins that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, *, salt_from: Sequence[str], salts: int = 16, hot_rows: int = 200_000) -> DataFrame:
    """``left`` join ``right`` on ``keys`` (null-safe), the hot keys of ``left`` spread over ``salts`` tasks.

    A key is hot if more than ``hot_rows`` left rows carry it, so at most ``count(left) / hot_rows`` keys are hot and that
    list is the only thing broadcast. ``right`` must hold one row per key: only its rows of hot keys are repeated
    ``salts`` times. Rows of hot keys are spread by a hash of ``salt_from``. Left rows are never dropped or repeated.
    """
    hot = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.lit(True).alias("_hot"))
    hot = F.broadcast(hot)

    def mark(df: DataFrame) -> DataFrame:
        cond: Column = F.lit(True)
        for k in keys:
            cond = cond & df[k].eqNullSafe(hot[f"_hot_{k}"])
        return df.join(hot, cond, "left").drop(*[f"_hot_{k}" for k in keys])

    salted = mark(left).withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*salt_from), F.lit(salts)).cast("int")).otherwise(F.lit(0))).drop("_hot")
    spread = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    wide = mark(right).withColumn("_salt", F.explode(spread)).drop("_hot")
    other = wide.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("_salt").alias("_r_salt"), *[c for c in wide.columns if c not in {*keys, "_salt"}])
    cond = F.col("_salt") == F.col("_r_salt")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return salted.join(other.hint("merge"), cond, how).drop("_salt", "_r_salt", *[f"_r_{k}" for k in keys])
