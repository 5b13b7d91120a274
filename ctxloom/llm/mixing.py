"""Mixing sources to target shares by an exact splitting tree over block quotas."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def source_key(source: Column) -> Column:
    """A source name as targets spell it: trimmed, lower case, ``_`` read as ``-``."""
    return F.regexp_replace(F.lower(F.trim(source)), "_", "-")


class Mixture:
    """A plan that combines documents so that every source gets its share of the total tokens.

    ``docs``: ``doc_id``, ``source``, ``tokens``. ``targets``: ``source``, ``target_share``, ``max_repeats``.

    Each source is cut into at most ``max_blocks`` blocks by a hash of the document id; only block sums (sources in
    ``targets`` times ``max_blocks`` rows, whatever the corpus) reach the driver. A source contributes
    ``min(share * T, max_repeats * tokens)`` tokens, T being the sum over all sources in ``targets``: whole rounds of all
    blocks, then as many blocks of a seeded permutation as come nearest to the rest, never more than ``max_repeats`` uses of
    a block. A splitting tree parts the block copies among ``shards`` by multivariate hypergeometric draws, exact at
    every node; shards then receive disjoint runs of the permuted copies, and order their rows by a seeded hash.

    Null and unlisted sources and documents of null source take no part. Null tokens count 0. A source without documents
    contributes nothing and falls short. Repeated target rows are an error of the caller (the first by order of share
    and repeats would win: they are folded by max). Empty ``targets`` or ``docs`` give an empty mix and full shortfalls.
    """

    PLAN = T.StructType([T.StructField("source", T.StringType()), T.StructField("block", T.IntegerType()), T.StructField("copy", T.IntegerType()), T.StructField("shard", T.IntegerType())])
    SHARES = T.StructType(
        [T.StructField(n, t) for n, t in (("source", T.StringType()), ("target_share", T.DoubleType()), ("max_repeats", T.IntegerType()), ("tokens", T.LongType()), ("wanted", T.DoubleType()), ("available", T.LongType()), ("taken", T.LongType()), ("actual_share", T.DoubleType()), ("falls_short", T.BooleanType()))]
    )

    USES = T.StructType([PLAN["source"], PLAN["block"], T.StructField("uses", T.ArrayType(T.StructType([PLAN["copy"], PLAN["shard"]])))])

    def __init__(self, docs: DataFrame, targets: DataFrame, *, shards: int = 16, max_blocks: int = 512, seed: int = 42, most_held: int = 200_000):
        self.shards, self.max_blocks, self.seed, self.most_held = shards, max_blocks, seed, most_held
        self.spark = docs.sparkSession
        self.targets = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
        block = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(max_blocks)).cast("int")
        self.docs = docs.select("doc_id", source_key(F.col("source")).alias("source"), F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("tokens")).withColumn("block", block)
        self._plan()

    def _plan(self) -> None:
        sums = self.docs.groupBy("source", "block").agg(F.sum("tokens").alias("tokens"))
        listed = self.targets.join(sums, "source", "left").collect()
        goal: dict[str, tuple[float, int]] = {}
        blocks: dict[str, dict[int, int]] = {}
        for r in listed:
            goal[r.source] = (r.target_share or 0.0, r.max_repeats or 0)
            own = blocks.setdefault(r.source, {})
            if r.block is not None:
                own[r.block] = r.tokens
        self.sizes = {s: sum(b.values()) for s, b in blocks.items()}
        self.total = sum(self.sizes.values())
        copies: dict[str, list[tuple[int, int]]] = {}
        shares = []
        for k, s in enumerate(sorted(goal)):
            share, most = goal[s]
            size, want = self.sizes[s], share * self.total
            rng = np.random.default_rng([self.seed, k])
            order = [int(b) for b in rng.permutation(sorted(blocks[s]))]
            take = min(want, most * size)
            rounds = min(most, math.floor(take / size)) if size else 0
            uses = [(b, c) for c in range(rounds) for b in order]
            rest, got = take - rounds * size, 0
            if rounds < most:
                for b in order:
                    if got + blocks[s][b] / 2 > rest:
                        break
                    uses.append((b, rounds))
                    got += blocks[s][b]
            copies[s] = [uses[i] for i in rng.permutation(len(uses))]
            shares.append([s, float(share), int(most), int(size), float(want), int(most * size)])
        names = sorted(copies)
        quota = self._split(np.array([len(copies[s]) for s in names], dtype=np.int64), 0, self.shards, (self.seed, 1))
        self._copies = []
        for j, s in enumerate(names):
            at = 0
            for shard in range(self.shards):
                for b, c in copies[s][at : at + int(quota[shard][j])]:
                    self._copies.append((s, b, c, shard))
                at += int(quota[shard][j])
        self._shares = []
        given = {s: [0, 0] for s in names}
        for s, b, _, _ in self._copies:
            given[s][0] += 1
            given[s][1] += blocks[s][b]
        taken = sum(tokens for _, tokens in given.values())
        for s, share, most, size, want, available in shares:
            uses, tokens = given[s]
            # short: every block stands in the shards as often as allowed, and all of that is less than wanted
            short = uses == most * len(blocks[s]) and tokens < want
            self._shares.append((s, share, most, size, want, available, tokens, tokens / taken if taken else 0.0, short))

    def _split(self, counts: np.ndarray, lo: int, hi: int, path: tuple[int, ...]) -> dict[int, np.ndarray]:
        """Quotas per shard lo..hi-1. A node's draw depends on the seed and its place in the tree only."""
        if hi - lo == 1:
            return {lo: counts}
        mid = (lo + hi) // 2
        n = int(counts.sum())
        left = np.random.default_rng(path).multivariate_hypergeometric(counts, n * (mid - lo) // (hi - lo)) if n else counts
        return self._split(left, lo, mid, (*path, 0)) | self._split(counts - left, mid, hi, (*path, 1))

    def shares(self) -> DataFrame:
        """Per target source what was wanted, available and taken, the share reached, and whether it falls short."""
        return self.spark.createDataFrame(self._shares, self.SHARES)

    def quotas(self) -> DataFrame:
        """(source, block, copy, shard): at most sources x max_blocks x max_repeats rows."""
        return self.spark.createDataFrame(self._copies, self.PLAN)

    def mix(self) -> DataFrame:
        """The documents of the mix: doc_id, source, copy, shard and the key that orders a shard.

        One row per (source, block) holds all its copies, so what goes to the executors is bounded by sources x max_blocks
        rows; it is broadcast up to ``most_held`` copies and joined by hash beyond."""
        uses = {}
        for s, b, c, shard in self._copies:
            uses.setdefault((s, b), []).append((c, shard))
        held = self.spark.createDataFrame([(s, b, u) for (s, b), u in uses.items()], self.USES)
        if len(self._copies) <= self.most_held:
            held = F.broadcast(held)
        rows = self.docs.join(held, ["source", "block"]).select("doc_id", "source", "tokens", F.explode("uses").alias("u"))
        return rows.select("doc_id", "source", "u.copy", "u.shard", F.xxhash64(F.lit(self.seed), "doc_id", "u.copy").alias("order_key"), "tokens")

    def shuffled(self) -> DataFrame:
        """The mix laid out: every shard whole in one or more tasks by ranges of (shard, order_key), rows in that order.

        Ranges are sampled, so a shard of any size is spread over as many tasks as it needs and no task holds more than its
        part; written with ``partitionBy("shard")``, the files of a shard read one after the other are its shuffled rows."""
        return self.mix().repartitionByRange("shard", "order_key").sortWithinPartitions("shard", "order_key")

    def write(self, path: str) -> None:
        """Writes the shuffled mix as one folder per shard."""
        self.shuffled().write.partitionBy("shard").mode("overwrite").parquet(path)
