"""Token budgets: a count table per content and tokenizer, and cubes kept up to date by signed deltas."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxloom.functions.text import estimate_tokens
from ctxloom.operators.state import VersionedState

#: Where the public vocabulary files are looked for; a parameter everywhere, never copied.
VOCABULARY_DIR = "/opt/tokenizers"

#: The pre-tokenisation pattern of the byte-level vocabularies (fixed value).
BYTE_BPE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Tokenizer:
    """``estimate`` (the closed formula, computed in the JVM) or a vocabulary file: ``x.tiktoken``, ``x.json``, ``x.model``."""

    name: str = "estimate"
    folder: str = VOCABULARY_DIR

    @property
    def path(self) -> str:
        return f"{self.folder}/{self.name}"

    def fingerprint(self) -> str:
        """Changes whenever counts could: the hash of the vocabulary, or the name of the formula."""
        if self.name == "estimate":
            return hashlib.sha256(b"estimate-1.5-4").hexdigest()
        digest = hashlib.sha256(self.name.encode())
        with open(self.path, "rb") as f:
            digest.update(f.read())
        return digest.hexdigest()

    def encoder(self):
        """A function from a list of texts to their token ids; libraries load on first use, once per worker."""
        if self.name.endswith(".tiktoken"):
            import base64

            import tiktoken

            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            enc = tiktoken.Encoding("public", pat_str=BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
            return lambda texts: [enc.encode_ordinary(t) for t in texts]
        if self.name.endswith(".json"):
            from tokenizers import Tokenizer as Fast

            fast = Fast.from_file(self.path)
            fast.encode_special_tokens = True
            return lambda texts: [e.ids for e in fast.encode_batch(texts, add_special_tokens=False)]
        if self.name.endswith(".model"):
            import sentencepiece

            piece = sentencepiece.SentencePieceProcessor(model_file=self.path)
            return lambda texts: piece.encode(texts, num_threads=1)
        raise ValueError(f"no tokenizer reads {self.name}")


def count_tokens(docs: DataFrame, text: str, tokenizer: Tokenizer, out: str = "tokens") -> DataFrame:
    """``docs`` without ``text`` and with its token count; null and empty texts count 0.

    Nothing is shuffled. The formula stays in generated code; a vocabulary is applied to Arrow batches, and within a
    batch every distinct text is encoded once.
    """
    rest = [c for c in docs.columns if c != text]
    if tokenizer.name == "estimate":
        return docs.select(*rest, estimate_tokens(F.col(text)).alias(out))
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(out, T.LongType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = tokenizer.encoder()
        for b in batches:
            t = pa.Table.from_batches([b])
            column = t.column(text).combine_chunks().dictionary_encode()
            if isinstance(column, pa.ChunkedArray):
                column = column.combine_chunks()
            sizes = [len(ids) for ids in run(column.dictionary.to_pylist())]
            counts = [0 if i is None else sizes[i] for i in column.indices.to_pylist()]
            yield from t.select(rest).append_column(out, pa.array(counts, pa.int64())).to_batches()

    return docs.mapInArrow(encode, schema)


class TokenLedger:
    """Token counts per content and tokenizer, membership of documents, and a cube over ``dims``.

    ``update(current)`` takes the whole present set of documents (``key``, ``text``, ``dims``) and

    1. hashes texts and encodes only those whose (content hash, tokenizer hash) the count table lacks, each distinct text once,
    2. compares membership old and new and emits signed deltas: +tokens for added, -tokens for removed, both for a
       document whose content, slice or tokenizer changed,
    3. adds the deltas to the cube,

    and publishes counts, members and cube as one version by one pointer swap. Rows that repeat a key count once (the
    greatest content hash wins). A null key is one document; null dims form a slice of their own; null and empty texts
    have 0 tokens and count as documents. An empty ``current`` takes every document out.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], dims: Sequence[str], tokenizer: Tokenizer | None = None):
        self.spark, self.key, self.dims, self.tokenizer = spark, list(key), list(dims), tokenizer or Tokenizer()
        self.pointer = VersionedState(spark, path, T.StructType([]))

    def _table(self, name: str, version: str | None = None) -> DataFrame | None:
        version = version or self.pointer.current()
        return self.spark.read.parquet(f"{self.pointer.path}/{version}/{name}") if version else None

    def cube(self) -> DataFrame:
        """Per slice the number of documents and of tokens."""
        return self._table("cube")

    def update(self, current: DataFrame, text: str = "text") -> DataFrame:
        return self.merge(self.size(current, text))

    def size(self, current: DataFrame, text: str = "text") -> DataFrame:
        """``current`` with content hash and tokens in place of the text.

        Only contents that the count table lacks are encoded, each once. The closed formula costs less than a look-up: it is
        applied where the text is read, and no text is moved."""
        fp = self.tokenizer.fingerprint()
        docs = current.select(*self.key, *[d for d in self.dims if d not in self.key], F.col(text).alias("_text"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("content_hash"))
        if self.tokenizer.name == "estimate":
            return count_tokens(docs, "_text", self.tokenizer)
        counts = self._table("counts")
        unseen, known = docs.select("content_hash", "_text"), None
        if counts is not None:
            known = counts.where(F.col("tokenizer_hash") == fp).select("content_hash", "tokens")
            unseen = unseen.join(known, "content_hash", "left_anti")
        fresh = count_tokens(unseen.dropDuplicates(["content_hash"]), "_text", self.tokenizer)
        return docs.drop("_text").join(fresh if known is None else known.unionByName(fresh), "content_hash", "left")

    def merge(self, sized: DataFrame) -> DataFrame:
        """Brings members and cube to ``sized`` (rows of :meth:`size`, the whole present set) and publishes the version; of two
        runs that start from one version the second gets ``ConcurrentRun``."""
        fp = self.tokenizer.fingerprint()
        before = self.pointer.current()
        counts, members, cube = (self._table(t, before) if before else None for t in ("counts", "members", "cube"))
        columns = [*self.key, *[d for d in self.dims if d not in self.key], "content_hash"]
        if counts is not None:  # what the count table holds stands
            held = counts.where(F.col("tokenizer_hash") == fp).select("content_hash", F.col("tokens").alias("_held"))
            sized = sized.join(held, "content_hash", "left").withColumn("tokens", F.coalesce("_held", "tokens")).drop("_held")
        top = F.max(F.struct("content_hash", "tokens", *[F.col(d).alias(f"_d_{d}") for d in self.dims if d not in self.key]))
        now = sized.select(*columns, "tokens").groupBy(*self.key).agg(top.alias("_m"))
        now = now.select(*self.key, *[F.col(f"_m._d_{d}").alias(d) for d in self.dims if d not in self.key], F.col("_m.content_hash").alias("content_hash"), F.col("_m.tokens").alias("tokens"), F.lit(fp).alias("tokenizer_hash"))

        name = f"v-{uuid.uuid4().hex}"
        base = f"{self.pointer.path}/{name}"
        now.write.parquet(f"{base}/members")
        now = self._table("members", name)
        new_counts = now.groupBy("content_hash").agg(F.max("tokens").alias("tokens")).withColumn("tokenizer_hash", F.lit(fp))
        signed = now.select(*self.dims, F.col("tokens"), F.lit(1).cast("long").alias("documents"))
        if members is not None:
            same = [*self.key, *[d for d in self.dims if d not in self.key], "content_hash", "tokenizer_hash"]
            if "tokenizer_hash" not in members.columns:  # of a version written before members named it
                members = members.withColumn("tokenizer_hash", F.lit(None).cast("string"))
            both = now.select(*same, "tokens", F.lit(1).alias("_s")).unionByName(members.select(*same, "tokens", F.lit(-1).alias("_s")))
            net = both.groupBy(*same).agg(F.sum("_s").alias("_s"), F.max("tokens").alias("tokens")).where("_s <> 0")
            signed = net.select(*self.dims, (F.col("tokens") * F.col("_s")).alias("tokens"), F.col("_s").cast("long").alias("documents"))
            held = counts.unionByName(new_counts).groupBy("content_hash", "tokenizer_hash").agg(F.max("tokens").alias("tokens"))
            new_counts = held.select("content_hash", "tokens", "tokenizer_hash")
            signed = signed.unionByName(cube)
        new_counts.write.parquet(f"{base}/counts")
        total = signed.groupBy(*self.dims).agg(F.sum("tokens").alias("tokens"), F.sum("documents").alias("documents"))
        total.where("documents <> 0").write.parquet(f"{base}/cube")
        self.pointer.publish(name, before)
        return self.cube()
