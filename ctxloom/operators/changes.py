"""Incremental processing: only records that are new or changed since the last successful run."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxloom.operators.state import VersionedState


def content_hash(*columns: str):
    """sha-256 over the named columns; nulls and the empty string differ, and no two column splits collide."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)


def latest_handled(ledger: DataFrame, runs: DataFrame, keys: Sequence[str], *, run_keys: Sequence[str] = ("run_id",), hash_col: str = "content_hash", time_col: str = "processed_at") -> DataFrame:
    """Key and hash of the newest ledger row written by a successful run.

    A run counts as successful if any of its rows in ``runs`` has state ``done``; rows of failed, unfinished or unknown
    runs do not count. Equal times go to the greater run, then to the greater hash. Ledger rows with a null key part are
    kept under that null key, exact repeats fall together. Hash aggregates only, combined before the shuffle.
    """
    done = runs.where(F.col("state") == "done").select(F.col("id").alias("run_id"), *[c for c in run_keys if c != "run_id"]).distinct()
    good = ledger.join(done, list(run_keys), "left_semi")
    newest = F.max(F.struct(F.col(time_col).alias("t"), F.col("run_id").alias("r"), F.col(hash_col).alias("h")))
    return good.groupBy(*keys).agg(newest.alias("m")).select(*keys, F.col("m.h").alias("handled_hash"))


class ChangeFeed:
    """Selects new and changed records against a persisted key and hash state.

    ``pending(current)`` joins the current rows (``keys`` + ``hash``) with the state version in force; ``advance`` stages
    the state that includes what a run has handled and swaps it in by one atomic rename, after the run's own output is
    safe. A run that fails before ``advance`` sees the same records again; one that fails after it sees none of them. Of two
    runs that advance from one version the second gets ``ConcurrentRun`` and changes nothing.

    Null keys compare equal to null. A null current hash counts as changed unless the state holds null too. Repeated
    current rows count once; of rows with one key and several hashes the greatest hash is used. Empty tables give no
    rows; extra columns are ignored.
    """

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, T.DataType]):
        self.keys = list(keys)
        fields = [T.StructField(k, t) for k, t in keys.items()] + [T.StructField("handled_hash", T.StringType())]
        self.state = VersionedState(spark, path, T.StructType(fields))

    def seed(self, handled: DataFrame) -> DataFrame:
        """Replaces the state, for instance from a ledger of earlier runs."""
        return self.state.commit(handled)

    def pending(self, current: DataFrame, hash_col: str = "content_hash", *, with_status: bool = False) -> DataFrame:
        """Keys whose hash differs from the handled one (``changed``) or that the state lacks (``new``)."""
        handled = self.state.read().select(*[F.col(k).alias(f"_s_{k}") for k in self.keys], F.col("handled_hash"), F.lit(True).alias("_known"))
        now = current.groupBy(*self.keys).agg(F.max(F.col(hash_col)).alias("_h"))
        on = [now[k].eqNullSafe(handled[f"_s_{k}"]) for k in self.keys]
        joined = now.join(handled, on, "left").where(F.col("_known").isNull() | ~F.col("_h").eqNullSafe(F.col("handled_hash")))
        out = [F.col(k) for k in self.keys] + [F.col("_h").alias("content_hash")]
        if with_status:
            out.append(F.when(F.col("_known").isNull(), F.lit("new")).otherwise(F.lit("changed")).alias("status"))
        return joined.select(*out)

    def advance(self, done: DataFrame, gone: DataFrame | None = None) -> DataFrame:
        """Puts ``done`` (keys + content_hash) into the state, takes ``gone`` (keys) out, and publishes the new version."""
        fresh = done.groupBy(*self.keys).agg(F.max("content_hash").alias("handled_hash"))
        base = self.state.current()
        old = self.state.read(base)
        tagged = old.withColumn("_v", F.lit(0)).unionByName(fresh.withColumn("_v", F.lit(1)))
        if gone is not None:
            tagged = tagged.unionByName(gone.select(*self.keys).withColumn("handled_hash", F.lit(None).cast("string")).withColumn("_v", F.lit(2)))
        newest = F.max_by(F.struct("handled_hash", "_v"), F.col("_v"))
        merged = tagged.groupBy(*self.keys).agg(newest.alias("_m")).where(F.col("_m._v") < 2)
        return self.state.commit(merged.select(*self.keys, F.col("_m.handled_hash").alias("handled_hash")), base)

    def run(self, current: DataFrame, work: Callable[[DataFrame], None], hash_col: str = "content_hash") -> DataFrame:
        """One incremental run: select, let ``work`` write its output, then advance. ``work`` must be idempotent per key."""
        todo = self.pending(current, hash_col)
        staged = VersionedState(self.state.spark, f"{self.state.path}/todo", todo.schema)
        fixed = staged.commit(todo)  # the rows that work sees are the rows that advance records
        work(fixed)
        self.advance(fixed)
        return fixed
