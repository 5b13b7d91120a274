"""Reading repositories, uploads, golden cases and logs, and telling what changed."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxloom.functions.classify import MAX_FILE_BYTES, is_binary, is_safe_path
from ctxloom.functions.text import blob_hash, file_hash, id_of_project, visible
from ctxloom.sources.ignore import LOOK_THROUGH, IgnoreRules

GOLDEN = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "repo_hint", "commit", "query", "lang", "category")]
    + [T.StructField("expected", T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("symbol", T.StringType())]))), T.StructField("notes", T.StringType()), T.StructField("_bad", T.StringType())]
)
REQUEST = T.StructType([T.StructField(n, t) for n, t in (("ts", T.LongType()), ("request_id", T.StringType()), ("user_id", T.StringType()), ("method", T.StringType()), ("path", T.StringType()), ("status", T.IntegerType()), ("latency_ms", T.IntegerType()))])


def list_paths(root: str, rules: IgnoreRules) -> list[tuple[str, int]]:
    """(path, size) of the files below a local root, sorted: ignored folders are not entered, folder links not followed,
    file links are; unreadable folders are skipped. Metadata only, for the driver of a local ingest.

    An ignored folder is entered after all if something directly in it bears an allowed name, at most ``LOOK_THROUGH`` such
    folders in a row; built-in folders never are."""
    top = Path(root).resolve()
    out: list[tuple[str, int]] = []
    left = {str(top): LOOK_THROUGH}

    def enter(folder: str, lead: str, name: str) -> bool:
        full = os.path.join(folder, name)
        if os.path.islink(full):
            return False
        why = rules.reason(lead + name, True)
        if why is None:
            left[full] = LOOK_THROUGH
            return True
        budget = left[folder] - 1
        try:
            inside = why != "builtin" and budget >= 0 and any(rules.looks_allowed(e) for e in os.listdir(full))
        except OSError:
            return False
        left[full] = budget
        return inside

    for folder, names, files in os.walk(top, followlinks=False):
        here = os.path.relpath(folder, top).replace(os.sep, "/")
        lead = "" if here == "." else here + "/"
        names[:] = sorted(n for n in names if enter(folder, lead, n))
        for n in files:
            full = Path(folder, n)
            if rules.reason(lead + n) is None and full.is_file() and full.resolve().is_relative_to(top):
                out.append((lead + n, full.stat().st_size))
    return sorted(out)


def scan_directory(spark: SparkSession, root: str, rules: IgnoreRules | None = None, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """path, content, length, skip_reason of the files below ``root`` on any file system.

    Sizes are read before contents: files over the limit are never opened. Ignored paths are left out; oversize and binary
    files stay as rows with a reason and null content."""
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    marker = base.split("://")[-1].split(":")[-1].rstrip("/") + "/"
    path = F.element_at(F.split(F.col("path"), marker.replace(".", r"\."), 2), -1)
    named = found.select(path.alias("path"), "length", "modificationTime", "content")
    if rules is not None:
        from ctxloom.sources.ignore import ignore_reason

        named = named.where(ignore_reason(F.col("path"), rules).isNull())
    small = named.where(F.col("length") <= max_bytes).withColumn("skip_reason", F.when(is_binary("content"), "binary"))
    large = named.where(F.col("length") > max_bytes).withColumn("skip_reason", F.concat(F.lit("oversize:"), F.col("length").cast("string"))).withColumn("content", F.lit(None).cast("binary"))
    return small.withColumn("content", F.when(F.col("skip_reason").isNull(), F.col("content"))).unionByName(large)


def plan_scan(current: DataFrame, previous: DataFrame, keys: tuple[str, ...] = ("project_id", "path")) -> DataFrame:
    """keys and change: added, modified or deleted, by hashes (``content_hash``) of both manifests; equal files are left out."""
    now = current.groupBy(*keys).agg(F.max("content_hash").alias("_now"))
    was = previous.groupBy(*keys).agg(F.max("content_hash").alias("_was"))
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_now").isNull(), "deleted").when(F.col("_now") != F.col("_was"), "modified")
    return now.join(was, list(keys), "full_outer").withColumn("change", change).where("change is not null").select(*keys, "change")


def load_golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Cases of all ``*.jsonl`` below ``path`` with missing lang and category as unknown, and the lines that are no cases."""
    raw = spark.read.schema(GOLDEN).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("columnNameOfCorruptRecord", "_bad").json(path)
    held = raw.withColumn("file", F.col("_metadata.file_path"))
    good = F.col("_bad").isNull() & (F.trim(F.coalesce("id", F.lit(""))) != "") & (F.trim(F.coalesce("query", F.lit(""))) != "") & ~F.exists(F.coalesce("expected", F.array()), lambda e: e["path"].isNull())
    cases = held.where(good).drop("_bad").withColumns({"lang": F.coalesce("lang", F.lit("unknown")), "category": F.coalesce("category", F.lit("unknown"))})
    return cases, held.where(~good)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a request log and its rotated files, newest first; lines that are no JSON objects are skipped."""
    lines = spark.read.text(path).select(F.from_json("value", REQUEST, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    return lines.where("request_id is not null").orderBy(F.desc("ts"))


def requests_of(log: DataFrame, request_id: str, user_id: str | None = None, limit: int = 100) -> DataFrame:
    """All lines of a request, newest first, of the asking user only where one is given."""
    held = log.where(F.col("request_id") == request_id)
    if user_id is not None:
        held = held.where(F.col("user_id") == user_id)
    return held.orderBy(F.desc("ts")).limit(limit)


def read_ledger(lines: DataFrame) -> DataFrame:
    """(project_id, path, blob_hash, size) of JSON ledgers (project_id, value); malformed entries fall out one by one."""
    entry = T.StructType([T.StructField("blob_hash", T.StringType()), T.StructField("size", T.LongType())])
    ledger = T.StructType([T.StructField("files", T.MapType(T.StringType(), entry))])
    parsed = lines.select("project_id", F.from_json("value", ledger).alias("l")).select("project_id", F.explode("l.files").alias("path", "e"))
    return parsed.where("e.blob_hash is not null and e.size >= 0").select("project_id", "path", "e.blob_hash", "e.size")


def blob_source(ledger: DataFrame, blobs: DataFrame) -> DataFrame:
    """Files of a ledger with the bytes of the blob store."""
    return ledger.join(blobs.dropDuplicates(["blob_hash"]).select("blob_hash", "content"), "blob_hash")


def put_blobs(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """Blobs the store lacks; what it has is left alone."""
    return incoming.dropDuplicates(["blob_hash"]).join(store.select("blob_hash"), "blob_hash", "left_anti")


def store_usage(store: DataFrame) -> DataFrame:
    """Number and bytes of the stored blobs."""
    return store.dropDuplicates(["blob_hash"]).agg(F.count(F.lit(1)).alias("blobs"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"))


def unreferenced(store: DataFrame, ledger: DataFrame) -> DataFrame:
    """Blobs that no ledger entry names."""
    return store.join(ledger.select("blob_hash"), "blob_hash", "left_anti")


def check_uploads(items: DataFrame, max_batch: int = 1 << 20) -> DataFrame:
    """Uploads (batch, position, path, blob_hash, content_b64) decoded, each with its first error: encoding, batch_size,
    path or hash; null for good ones. The batch limit counts decoded bytes in order of position."""
    decoded = items.withColumn("content", F.expr("try_to_binary(content_b64, 'base64')"))
    w = Window.partitionBy("batch").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.coalesce(F.octet_length("content"), F.lit(0))).over(w)
    error = (
        F.when(F.col("content").isNull(), "encoding").when(total > max_batch, "batch_size").when(~is_safe_path(F.col("path")), "path").when(blob_hash(F.col("path"), F.col("content")) != F.col("blob_hash"), "hash")
    )
    return decoded.withColumn("error", error).drop("content_b64")


def prepare_text(content):
    """Bytes as clean text: UTF-8, wrong bytes replaced, control characters off."""
    return visible(F.make_valid_utf8(content.cast("string")))


def checkpoints(ledger: DataFrame) -> DataFrame:
    """(project_id, checkpoint_id): an id of the set of a project's blobs, the same whatever order they came in."""
    joined = F.array_join(F.array_sort(F.collect_set("blob_hash")), "\n")
    return ledger.groupBy("project_id").agg(F.concat(F.lit("cp_"), F.substring(F.sha2(joined, 256), 1, 16)).alias("checkpoint_id"))


def identify(repos: DataFrame) -> DataFrame:
    """project_id of repositories (remote, relative, branch, root): by remote, folder and branch, else by the root."""
    key = F.when(F.coalesce("remote", F.lit("")) != "", F.concat_ws("|", F.regexp_replace(F.lower("remote"), r"(\.git)?/?$", ""), F.coalesce("relative", F.lit("")), F.coalesce("branch", F.lit("")))).otherwise(F.col("root"))
    return repos.withColumn("project_id", id_of_project(key))


def displaced(projects: DataFrame) -> DataFrame:
    """Empty projects (project_id, remote, relative, branch, files) with a sibling branch that has an index: project_id, sibling."""
    full = projects.where("files > 0").groupBy("remote", "relative").agg(F.max_by("project_id", "files").alias("sibling"))
    return projects.where("coalesce(files, 0) = 0").join(full, ["remote", "relative"]).select("project_id", "sibling")


__all__ = ["displaced", "blob_source", "check_uploads", "checkpoints", "file_hash", "identify", "list_paths", "load_golden", "plan_scan", "prepare_text", "put_blobs", "read_ledger", "read_requests", "requests_of", "scan_directory", "store_usage", "unreferenced"]
