"""The engine: projects are ingested from folders or change sets and searched in batches of queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxloom.functions.classify import lift_headers
from ctxloom.operators import lexical, resolve, store, vector
from ctxloom.operators.fusion import DEPRECATED_MARK
from ctxloom.operators.pack import Budget, render
from ctxloom.operators.parse import PARSED, explode, parse_files
from ctxloom.operators.state import VersionedState
from ctxloom.plans.search import Index, search, search_pool
from ctxloom.session import ship
from ctxloom.sources import repo
from ctxloom.sources.ignore import IgnoreRules

#: Version of the stored tables; an index of another version is not opened.
SCHEMA_VERSION = "1"
_PARTS = {"symbols": "symbols", "edges": "edges", "unresolved": "unresolved", "spec_blocks": "spec_blocks", "chunks": "chunks"}
SPEC_REFS = T.StructType([T.StructField(n, t) for n, t in (("project_id", T.StringType()), ("spec_block_id", T.StringType()), ("symbol_id", T.StringType()), ("provenance", T.StringType()), ("stale", T.BooleanType()))])


@dataclass
class IngestReport:
    """Counters of a run."""

    added: int = 0
    modified: int = 0
    deleted: int = 0
    chunks: int = 0
    embedded: int = 0
    mode: str = "none"
    skipped: list[str] = field(default_factory=list)


class ContextEngine:
    """An index per project below ``root``: immutable version folders and a pointer that is swapped when all is written.

    Readers of a version never see a half-written one, and a run that dies leaves the last version in force. Only the
    projects a batch of queries asks for are read.
    """

    def __init__(self, spark: SparkSession, root: str, provider: vector.EmbeddingProvider | None = None, config: dict | None = None):
        self.spark, self.root = ship(spark), root.rstrip("/")
        self.provider = provider or vector.HashedTrigrams()
        self.fingerprint = {"parser_hash": store.fingerprint(config or {"parser": 1}), "model": self.provider.model, "dim": str(self.provider.dim), "schema": SCHEMA_VERSION}

    def _pointer(self, project: str) -> VersionedState:
        return VersionedState(self.spark, f"{self.root}/projects/{project}", T.StructType([]))

    def _read(self, project: str, table: str) -> DataFrame | None:
        at = self._pointer(project).current()
        return self.spark.read.parquet(f"{self.root}/projects/{project}/{at}/{table}") if at else None

    def config(self, project: str) -> dict[str, str]:
        found = self._read(project, "index_config")
        return {r.key: r.value for r in found.collect()} if found is not None else {}

    # -------------------------------------------------------------------------------------------- ingest

    def ingest_repo(self, project: str, folder: str, rules: IgnoreRules | None = None, full: bool = False) -> IngestReport:
        """Brings the index to the state of a folder: what changed since the last run is parsed, what is gone removed."""
        seen = repo.scan_directory(self.spark, folder, rules or IgnoreRules())
        files = seen.where("skip_reason is null").select(F.lit(project).alias("project_id"), "path", "content")
        report = self.apply_changes(project, files, complete=True, full=full)
        report.skipped = [f"{r.path}:{r.skip_reason}" for r in seen.where("skip_reason is not null").select("path", "skip_reason").collect()]
        return report

    def apply_changes(self, project: str, files: DataFrame, deleted: Sequence[str] | DataFrame = (), *, complete: bool = False, full: bool = False) -> IngestReport:
        """Takes in ``files`` (project_id, path, content) and takes out ``deleted``.

        ``complete`` says that ``files`` is the whole project, so paths it lacks are deleted too. Files with an unchanged
        hash are skipped unless the parser's fingerprint changed."""
        mode = store.invalidation(self.config(project), self.fingerprint)
        full = full or mode == "full_reparse"
        old = self._read(project, "files")
        hashed = files.withColumn("content_hash", F.sha2("content", 256))
        before = old.select("project_id", "path", "content_hash") if old is not None and not full else self.spark.createDataFrame([], "project_id string, path string, content_hash string")
        plan = repo.plan_scan(hashed.select("project_id", "path", "content_hash"), before)
        if not complete:
            gone = deleted if isinstance(deleted, DataFrame) else self.spark.createDataFrame([(p,) for p in deleted], "path string")
            plan = plan.where("change <> 'deleted'").unionByName(gone.select(F.lit(project).alias("project_id"), "path", F.lit("deleted").alias("change")).distinct())
        plan = plan.cache()
        counts = {r.change: r["count"] for r in plan.groupBy("change").count().collect()}
        report = IngestReport(counts.get("added", 0), counts.get("modified", 0), counts.get("deleted", 0), mode=mode)
        if not counts and mode == "none":
            plan.unpersist()
            return report
        name = f"v-{uuid.uuid4().hex}"
        base = f"{self.root}/projects/{project}/{name}"
        todo = plan.where("change <> 'deleted'").select("project_id", "path")
        parse_files(files.join(todo, ["project_id", "path"], "left_semi")).write.parquet(f"{base}/parsed")
        parsed = self.spark.read.schema(PARSED).parquet(f"{base}/parsed")
        tables = {t: explode(parsed, part) for t, part in _PARTS.items()}
        tables["chunks"] = tables["chunks"].withColumn("deprecated", F.lower("content").contains(DEPRECATED_MARK))
        tables["files"] = parsed.select("project_id", "path", "content_hash", "language", "generated", F.current_timestamp().cast("timestamp_ntz").alias("indexed_at"), "parse_errors")
        had_symbols = self._read(project, "symbols")
        for t in tables:
            was = self._read(project, t) if not (full and complete) else None
            if was is not None:
                was = was.drop("edge_id")
                tables[t] = store.replace_files(was, tables[t].select(*was.columns), plan, "path" if t == "files" else "file_path")
            tables[t].write.parquet(f"{base}/{t}0" if t in ("edges", "unresolved", "files") else f"{base}/{t}")
        self._finish(project, base, had_symbols, plan)
        report.chunks = self.spark.read.parquet(f"{base}/chunks").count()
        report.embedded = self._embed(project, base)
        tf, lengths = lexical.inverted_index(self.spark.read.parquet(f"{base}/chunks"))
        tf.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{base}/postings")
        lengths.write.parquet(f"{base}/lengths")
        rows = [(k, v) for k, v in {**self.fingerprint, "state": "ready", "chunks": str(report.chunks)}.items()]
        self.spark.createDataFrame(rows, "key string, value string").coalesce(1).write.parquet(f"{base}/index_config")
        self._pointer(project).publish(name)
        plan.unpersist()
        return report

    def _finish(self, project: str, base: str, old_symbols: DataFrame | None, plan: DataFrame) -> None:
        """Languages of headers, then the graph: pending references, edges with bare names, document links."""
        read = self.spark.read.parquet
        files = read(f"{base}/files0")
        cpp = files.groupBy("project_id").agg(F.max(F.col("language") == "cpp").alias("_cpp"))
        files.join(cpp, "project_id").withColumn("language", lift_headers(F.col("language"), F.col("path"), F.col("_cpp"))).drop("_cpp").write.parquet(f"{base}/files")
        symbols = read(f"{base}/symbols")
        key = F.xxhash64("project_id", "file_path", "source_fqn", "target_name", "kind", F.coalesce("line", F.lit(-1)))
        edges = read(f"{base}/edges0").withColumn("edge_id", key)
        edges = resolve.include_targets(edges, files)
        refs = read(f"{base}/unresolved0").withColumn("id", F.xxhash64("project_id", "file_path", "from_fqn", "name", "kind", F.coalesce("line", F.lit(-1))))
        # references of changed files are pending; those that failed before are tried again where a name has come that fits
        changed = plan.select("project_id", F.col("path").alias("file_path"), F.lit("pending").alias("_new")).distinct()
        refs = refs.join(changed, ["project_id", "file_path"], "left").withColumn("status", F.coalesce("_new", F.lit("failed"))).drop("_new")
        made, failed = resolve.resolve_pending(refs, symbols)
        come = symbols.join(changed, ["project_id", "file_path"], "left_semi")
        names = come.select("project_id", "name").unionByName(come.select("project_id", F.col("fqn").alias("name"))).where("name is not null").distinct()
        made_again, _ = resolve.retry_failed(refs, names, symbols)
        made = made.unionByName(made_again).dropDuplicates(["project_id", "ref_id", "target_name"])
        failed = refs.join(made.select("project_id", F.col("ref_id").alias("id")).distinct(), ["project_id", "id"], "left_anti")
        made = made.join(refs.select("project_id", F.col("id").alias("ref_id"), "file_path"), ["project_id", "ref_id"])
        made = made.select("project_id", "file_path", "source_fqn", "target_name", "kind", "line", "provenance", F.col("ref_id").alias("edge_id"))
        whole = resolve.retarget_edges(edges.unionByName(made, allowMissingColumns=True), symbols)
        whole.select("project_id", "file_path", "source_fqn", "target_name", "kind", "line", "provenance", "edge_id").write.parquet(f"{base}/edges")
        failed.select("project_id", "file_path", "from_fqn", "name", "kind", "line").write.parquet(f"{base}/unresolved")
        blocks = read(f"{base}/spec_blocks").select("project_id", F.col("id").alias("block_id"), "mentioned")
        links = resolve.link_mentions(blocks, symbols)
        old = self._read(project, "spec_refs")
        if old is not None and old_symbols is not None:
            changed = plan.select("project_id", F.col("path").alias("file_path"))
            before = old_symbols.join(changed, ["project_id", "file_path"], "left_semi")
            kept = resolve.cascade_spec_refs(old, before, symbols)
            alive = read(f"{base}/spec_blocks").select("project_id", F.col("id").alias("spec_block_id")).distinct()
            links = store.insert_new(kept.join(alive, ["project_id", "spec_block_id"], "left_semi"), links, ["project_id", "spec_block_id", "symbol_id"])
        links.select(*SPEC_REFS.fieldNames()).write.parquet(f"{base}/spec_refs")

    def _embed(self, project: str, base: str) -> int:
        """Vectors of all chunks: those of unchanged content are reused, every other content is embedded once."""
        chunks = self.spark.read.parquet(f"{base}/chunks").select("project_id", F.col("id").alias("chunk_id"), "content", "content_hash")
        old = self._read(project, "vectors")
        same = self.config(project).get("model") == self.provider.model
        cache = old.select("content_hash", "vector", F.lit(self.provider.model).alias("model")) if old is not None and same else None
        vectors = vector.embed_distinct(chunks, "content", "content_hash", self.provider, cache)
        chunks.drop("content").join(vectors, "content_hash").write.parquet(f"{base}/vectors")
        now = self.spark.read.parquet(f"{base}/vectors").select("content_hash").distinct()
        return (now.join(cache.select("content_hash"), "content_hash", "left_anti") if cache is not None else now).count()

    # -------------------------------------------------------------------------------------------- search

    def index(self, projects: Sequence[str]) -> Index:
        """The tables of the named projects that have an index."""
        held = [p for p in projects if self._pointer(p).current()]
        if not held:
            raise LookupError("none of the projects has an index")
        old = [p for p in held if self.config(p).get("schema") != SCHEMA_VERSION]
        if old:
            raise LookupError(f"indexes of another version: {', '.join(old)}")

        def whole(table: str) -> DataFrame:
            paths = [f"{self.root}/projects/{p}/{self._pointer(p).current()}/{table}" for p in held]
            return self.spark.read.parquet(*paths)

        return Index(whole("chunks"), whole("symbols"), whole("edges"), whole("files"), whole("spec_refs"), store.check_vectors(whole("vectors"), self.provider.dim), whole("unresolved"), (whole("postings"), whole("lengths")))

    def search(self, queries: DataFrame, *, max_tokens: int = 10_000, mode: str = "fast") -> DataFrame:
        """One evidence pack per query (query_id, project_id, text); queries on projects without an index get an empty pack."""
        projects = [r.project_id for r in queries.select("project_id").distinct().collect()]
        return search(self.index(projects), queries, self.provider, Budget.of(mode, max_tokens))

    def search_with_trace(self, queries: DataFrame) -> DataFrame:
        """The ranked pools behind the packs."""
        projects = [r.project_id for r in queries.select("project_id").distinct().collect()]
        return search_pool(self.index(projects), queries, self.provider)[1]

    def ask(self, queries: DataFrame, answer: Callable[[str], str] | None = None) -> list[dict]:
        """Packs with an answer where one can be given: insufficient_evidence, degraded (no provider, or it failed) or answered."""
        import json

        from ctxloom.operators.pack import prompt, verify_citations

        out = []
        for r in self.search(queries, mode="deep", max_tokens=16_000).join(queries.select("query_id", "text"), "query_id").collect():
            done = json.loads(r.pack)
            row = {"query_id": r.query_id, "status": "insufficient_evidence", "answer": None, "coverage": None, "markdown": render(done)}
            if r.answerable:
                row["status"] = "degraded"
                try:
                    text = answer(prompt(r.text, done)) if answer else None
                except Exception:  # a provider that fails leaves the evidence
                    text = None
                if text:
                    check = verify_citations(text, [e["id"] for e in done["evidence"]] + [f["id"] for f in done["flows"]])
                    row |= {"status": "answered", "answer": check["answer"], "coverage": check["coverage"]}
            out.append(row)
        return out

    def status(self, project: str) -> dict:
        """Counts, freshness and whether the index is whole."""
        if not self._pointer(project).current():
            return {"state": "missing"}
        counts = {t: self._read(project, t).count() for t in ("files", "chunks", "symbols", "edges", "vectors", "spec_refs")}
        config = self.config(project)
        gap = counts["chunks"] > 0 and counts["vectors"] == 0 or str(counts["chunks"]) != config.get("chunks")
        return {"state": "degraded" if gap else config.get("state"), "indexed_at": self._read(project, "files").agg(F.max("indexed_at")).first()[0], **counts}

    def delete_project(self, project: str) -> None:
        """Removes the project's folder."""
        pointer = self._pointer(project)
        pointer._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pointer.path), True)

    def list_projects(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.root}/projects")
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(top)) if fs.exists(top) else []
