"""The symbol graph: lookups, one-hop expansion with quotas, and call chains, for batches of queries.

Edges: project_id, file_path, source_fqn, target_name, kind, line, provenance. Every join carries project_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.functions.classify import candidate_kind
from ctxloom.functions.text import name_tail
from ctxloom.tables import top_n

#: Quotas (fixed values).
SEEDS, EXPANDED, CALLERS_MANY, CALLERS_KEPT, FLOW_SEEDS, FLOW_NODES = 20, 30, 200, 20, 3, 3
GRAPH_TIER = 3


def unique_edges(edges: DataFrame) -> DataFrame:
    """Edges distinct by source, target, kind and line (null is a line of its own), the smallest edge id kept."""
    keyed = edges.withColumn("line_key", F.coalesce("line", F.lit(-1)))
    keep = [c for c in edges.columns if c not in ("project_id", "source_fqn", "target_name", "kind")]
    top = F.min(F.struct(F.col("edge_id").alias("_o"), F.struct(*keep).alias("r"))).alias("m")
    out = keyed.groupBy("project_id", "source_fqn", "target_name", "kind", "line_key").agg(top)
    return out.select("project_id", "source_fqn", "target_name", "kind", *[F.col(f"m.r.{c}").alias(c) for c in keep])


def covering_chunks(points: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Per point (project_id, file_path, line) the chunk that covers the line, the shortest span first, then the id.

    The range condition stands beside the equality on project and file, so the join stays partitioned."""
    c = chunks.select("project_id", "file_path", F.col("id").alias("chunk_id"), "start_line", "end_line")
    found = points.join(c, ["project_id", "file_path"]).where((F.col("start_line") <= F.col("line")) & (F.col("line") <= F.col("end_line")))
    best = F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "chunk_id")).alias("m")
    return found.groupBy(*keys).agg(best).select(*keys, F.col("m.chunk_id").alias("chunk_id"))


def container_members(containers: DataFrame, symbols: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Symbols directly or deeper inside a container (project_id, container), by equality on every prefix of their fqn."""
    s = symbols if kinds is None else symbols.where(F.col("kind").isin(*kinds))
    parts = F.split(F.regexp_replace("fqn", "::", "."), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    inside = s.where(F.col("fqn").rlike(r"\.|::")).select("project_id", "id", "fqn", "kind", "chunk_id", "file_path", "start_line", F.explode(prefixes).alias("_prefix"))
    asked = containers.withColumn("_prefix", F.regexp_replace("container", "::", "."))
    return asked.join(inside, ["project_id", "_prefix"]).drop("_prefix")


def edges_of(symbols: DataFrame, edges: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Outgoing and incoming edges of (project_id, fqn); a loop counts once."""
    e = edges if kinds is None else edges.where(F.col("kind").isin(*kinds))
    cols = ["project_id", "fqn", "direction", "source_fqn", "target_name", "kind", "line", "provenance"]
    e = e.withColumnRenamed("project_id", "_ep")
    asked = symbols.select("project_id", "fqn")
    out = asked.join(e, (F.col("project_id") == F.col("_ep")) & (F.col("fqn") == F.col("source_fqn"))).withColumn("direction", F.lit("out"))
    into = asked.join(e, (F.col("project_id") == F.col("_ep")) & (F.col("fqn") == F.col("target_name")) & (F.col("source_fqn") != F.col("target_name"))).withColumn("direction", F.lit("in"))
    return out.select(*cols).unionByName(into.select(*cols))


def unresolved_edges(edges: DataFrame, symbols: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Edges whose target is no fqn of the project."""
    e = edges if kinds is None else edges.where(F.col("kind").isin(*kinds))
    known = symbols.where("fqn is not null").select("project_id", F.col("fqn").alias("target_name")).distinct()
    return e.join(known, ["project_id", "target_name"], "left_anti")


def reexport_sites(names: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, name, path): package files that import the name."""
    sites = edges.where((F.col("kind") == "imports") & F.col("source_fqn").endswith("__init__.py")).select("project_id", F.col("source_fqn").alias("path"), name_tail(F.col("target_name")).alias("name"))
    return names.select("project_id", "name").distinct().join(sites.distinct(), ["project_id", "name"])


def entry_points(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Exported symbols that nothing in the project calls."""
    called = edges.where(F.col("kind") == "calls").select("project_id", F.col("target_name").alias("fqn")).distinct()
    return symbols.where("is_exported").join(called, ["project_id", "fqn"], "left_anti")


def symbol_rows(symbols: DataFrame) -> DataFrame:
    """One row per (project_id, fqn): the symbol an fqn stands for, one with a chunk first."""
    order = F.struct(F.col("chunk_id").isNull(), ~F.coalesce("is_exported", F.lit(False)), F.coalesce("file_path", F.lit("")), F.coalesce("start_line", F.lit(0)), "id")
    keep = ["id", "name", "kind", "chunk_id", "file_path", "start_line", "is_exported"]
    best = F.min_by(F.struct(*keep), order).alias("m")
    return symbols.where("fqn is not null").groupBy("project_id", "fqn").agg(best).select("project_id", "fqn", *[F.col(f"m.{c}").alias(c) for c in keep])


def _callee_class(local: Column, target: Column) -> Column:
    tail = name_tail(target)
    hidden = tail.startswith("_") & ~(tail.startswith("__") & tail.endswith("__"))
    return F.when(~local, 2).when(hidden, 0).otherwise(1)


def expand(pool: DataFrame, symbols: DataFrame, edges: DataFrame, chunks: DataFrame, spec_refs: DataFrame | None = None, *, seeds: int = SEEDS, limit: int = EXPANDED) -> DataFrame:
    """Chunks one hop away from the best ``seeds`` candidates of every query, new ones only, at most ``limit`` per query.

    Order of the quota: seed, then package files that re-export it, what it calls (own private, own, external; then
    line), what calls it (when more than 200, the 20 best by entry point and export), documents about it; a document
    seed gives the code it refers to. Columns as the pool's, tier 3, graph_depth 1.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("rrf_score"), F.asc("chunk_id"))
    seed = pool.select("query_id", "project_id", F.col("chunk_id").alias("seed"), "symbol_fqn", "kind", F.row_number().over(order).alias("seed_pos")).where(F.col("seed_pos") <= seeds)
    code = seed.where((F.col("kind") != "spec") & F.col("symbol_fqn").isNotNull() & (F.col("symbol_fqn") != ""))
    rows = symbol_rows(symbols)
    calls = edges.where(F.col("kind") == "calls").select(F.col("project_id").alias("_ep"), "source_fqn", "target_name", "line", "provenance")
    local = rows.where("chunk_id is not null").select("project_id", F.col("fqn").alias("target_name"), F.lit(True).alias("_local"))

    called = code.join(calls, (F.col("project_id") == F.col("_ep")) & (F.col("symbol_fqn") == F.col("source_fqn"))).join(local, ["project_id", "target_name"], "left")
    callees = called.select("query_id", "project_id", "seed", "seed_pos", F.lit(1).alias("source"), F.struct(_callee_class(F.coalesce("_local", F.lit(False)), F.col("target_name")).alias("a"), F.coalesce("line", F.lit(0)).alias("b"), F.col("target_name").alias("c")).alias("place"), F.col("target_name").alias("fqn"), "provenance")

    entries = entry_points(symbols, edges).select("project_id", F.col("fqn").alias("source_fqn"), F.lit(0).alias("_entry")).distinct()
    exported = symbols.where("is_exported").select("project_id", F.col("fqn").alias("source_fqn"), F.lit(0).alias("_exp")).distinct()
    calling = code.join(calls, (F.col("project_id") == F.col("_ep")) & (F.col("symbol_fqn") == F.col("target_name")))
    calling = calling.join(entries, ["project_id", "source_fqn"], "left").join(exported, ["project_id", "source_fqn"], "left")
    per = Window.partitionBy("query_id", "seed")
    ranked = per.orderBy(F.coalesce("_entry", F.lit(1)), F.coalesce("_exp", F.lit(1)), "source_fqn", F.coalesce("line", F.lit(0)))
    calling = calling.withColumn("_n", F.count(F.lit(1)).over(per)).withColumn("_r", F.row_number().over(ranked)).where((F.col("_n") <= CALLERS_MANY) | (F.col("_r") <= CALLERS_KEPT))
    callers = calling.select("query_id", "project_id", "seed", "seed_pos", F.lit(2).alias("source"), F.struct(F.when(F.col("_n") > CALLERS_MANY, F.col("_r")).otherwise(0).alias("a"), F.coalesce("line", F.lit(0)).alias("b"), F.col("source_fqn").alias("c")).alias("place"), F.col("source_fqn").alias("fqn"), "provenance")

    near = callees.unionByName(callers).join(rows.select("project_id", "fqn", F.col("chunk_id").alias("_own"), "file_path", F.col("start_line").alias("line")), ["project_id", "fqn"])
    loose = near.where("_own is null").select("project_id", "file_path", "line").where("file_path is not null and line is not null").distinct()
    covered = covering_chunks(loose, chunks, ["project_id", "file_path", "line"]).withColumnRenamed("chunk_id", "_cover")
    near = near.join(covered, ["project_id", "file_path", "line"], "left").withColumn("chunk_id", F.coalesce("_own", "_cover"))
    common = ["query_id", "project_id", "seed", "seed_pos", "source", "place", "chunk_id", "provenance"]
    hops = near.select(*common)

    tails = code.withColumn("name", name_tail(F.col("symbol_fqn")))
    sites = reexport_sites(tails, edges)
    at = covering_chunks(sites.select("project_id", F.col("path").alias("file_path"), F.lit(1).alias("line")).distinct(), chunks, ["project_id", "file_path"]).withColumnRenamed("file_path", "path")
    exports = tails.join(sites, ["project_id", "name"]).join(at, ["project_id", "path"])
    none = F.lit(0)
    hops = hops.unionByName(exports.select("query_id", "project_id", "seed", "seed_pos", F.lit(0).alias("source"), F.struct(none.alias("a"), none.alias("b"), F.col("path").alias("c")).alias("place"), "chunk_id", F.lit("re-export site").alias("provenance")))
    if spec_refs is not None:
        refs = spec_refs.select(F.col("project_id").alias("_rp"), F.col("spec_block_id").alias("spec"), "symbol_id", "stale", "provenance")
        docs = code.join(refs.where("not stale"), (F.col("project_id") == F.col("_rp")) & (F.col("seed") == F.col("symbol_id")))
        hops = hops.unionByName(docs.select("query_id", "project_id", "seed", "seed_pos", F.lit(3).alias("source"), F.struct(none.alias("a"), none.alias("b"), F.col("spec").alias("c")).alias("place"), F.col("spec").alias("chunk_id"), "provenance"))
        specs = seed.where(F.col("kind") == "spec")
        impl = specs.join(refs, (F.col("project_id") == F.col("_rp")) & (F.col("seed") == F.col("spec")))
        hops = hops.unionByName(impl.select("query_id", "project_id", "seed", "seed_pos", F.lit(4).alias("source"), F.struct(none.alias("a"), none.alias("b"), F.col("symbol_id").alias("c")).alias("place"), F.col("symbol_id").alias("chunk_id"), "provenance"))

    fresh = hops.where("chunk_id is not null").join(pool.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    first = fresh.groupBy("query_id", "project_id", "chunk_id").agg(F.min(F.struct("seed_pos", "source", "place", "seed", "provenance")).alias("m"))
    meta = chunks.select("project_id", F.col("id").alias("chunk_id"), F.col("file_path").alias("path"), "symbol_fqn", "symbol_kind", "start_line", "end_line")
    kept = top_n(first.join(meta, ["project_id", "chunk_id"]), ["query_id"], [F.asc("m.seed_pos"), F.asc("m.source"), F.asc("m.place"), F.asc("chunk_id")], limit, "hop")
    made = F.col("m.provenance") == "synthesized"
    reasons = F.array(F.concat(F.lit("graph from "), "m.seed"), F.when(made, "synthesized edge"), F.when(F.col("m.provenance") == "re-export site", "re-export site"))
    return kept.select(
        "query_id", "project_id", "chunk_id", "path", "symbol_fqn", "symbol_kind", "start_line", "end_line", candidate_kind(F.col("path"), F.col("symbol_kind")).alias("kind"), F.lit(0.0).alias("rrf_score"), F.lit(0.0).alias("score"),
        F.lit(GRAPH_TIER).alias("tier"), F.lit(1).alias("graph_depth"), F.col("m.seed").alias("graph_parent"), F.coalesce(made, F.lit(False)).alias("synthesized"), F.filter(reasons, lambda x: x.isNotNull()).alias("reasons"), "hop",
    )


def flows(heads: DataFrame, symbols: DataFrame, edges: DataFrame, nodes: int = FLOW_NODES) -> DataFrame:
    """Call chains of up to ``nodes`` symbols from (query_id, project_id, fqn, pos): (query_id, pos, fqns, truncated).

    Every step takes the first callee that the project defines and the chain has not met, own private functions first,
    then by line and name. truncated tells that callees were left out: unknown, met before, further branches, or beyond
    the last node. Chains of one node are no flows."""
    rows = symbol_rows(symbols).where("file_path is not null and start_line is not null").select("project_id", "fqn", "chunk_id")
    local = rows.select("project_id", F.col("fqn").alias("target_name"), (F.col("chunk_id").isNotNull()).alias("_local"))
    calls = edges.where(F.col("kind") == "calls").select("project_id", "source_fqn", "target_name", F.coalesce("line", F.lit(0)).alias("line"))
    steps = calls.join(local, ["project_id", "target_name"], "left").withColumn("_known", F.col("_local").isNotNull())
    steps = steps.withColumn("_place", F.struct(_callee_class(F.coalesce("_local", F.lit(False)), F.col("target_name")).alias("a"), F.col("line").alias("b"), F.col("target_name").alias("c")))
    walk = heads.join(rows.select("project_id", "fqn"), ["project_id", "fqn"], "left_semi").select("query_id", "project_id", "pos", F.array("fqn").alias("fqns"), F.lit(False).alias("truncated"), F.lit(True).alias("going"))
    for _ in range(nodes - 1):
        at = walk.withColumn("source_fqn", F.element_at("fqns", -1))
        fan = at.where("going").join(steps, ["project_id", "source_fqn"])
        usable = F.col("_known") & ~F.array_contains("fqns", F.col("target_name"))
        open_ = ~F.array_contains("fqns", F.col("target_name"))
        best = fan.groupBy("query_id", "pos").agg(
            F.min(F.when(usable, F.struct("_place", "target_name"))).alias("b"), F.sum(F.when(usable, 1).otherwise(0)).alias("u"), F.sum(F.when(open_ & ~F.col("_known") | ~open_, 1).otherwise(0)).alias("lost")
        )
        walk = at.drop("source_fqn").join(best, ["query_id", "pos"], "left").select(
            "query_id", "project_id", "pos", F.when(F.col("b").isNotNull(), F.concat("fqns", F.array("b.target_name"))).otherwise(F.col("fqns")).alias("fqns"),
            (F.col("truncated") | F.coalesce((F.col("u") > 1) | (F.col("lost") > 0), F.lit(False))).alias("truncated"), F.col("b").isNotNull().alias("going"),
        )
    last = walk.where(F.size("fqns") >= nodes).withColumn("source_fqn", F.element_at("fqns", -1)).join(calls, ["project_id", "source_fqn"]).where(~F.array_contains("fqns", F.col("target_name")))
    more = last.select("query_id", "pos", F.lit(True).alias("_more")).distinct()
    return walk.where(F.size("fqns") >= 2).join(more, ["query_id", "pos"], "left").select("query_id", "project_id", "pos", "fqns", (F.col("truncated") | F.coalesce("_more", F.lit(False))).alias("truncated"))


def visible_symbols(symbols: DataFrame, from_path: Column) -> DataFrame:
    """Symbols that code in ``from_path`` can name: exported ones, and those of the same file."""
    return symbols.where(F.coalesce("is_exported", F.lit(False)) | (F.col("file_path") == from_path))


def drop_inside(facts: DataFrame, spans: DataFrame) -> DataFrame:
    """Facts (project_id, file_path, start_line, end_line) that touch no span of a syntax error in their file."""
    s = spans.select(F.col("project_id").alias("_sp"), F.col("file_path").alias("_sf"), F.col("start_line").alias("_a"), F.col("end_line").alias("_b"))
    touch = (F.col("project_id") == F.col("_sp")) & (F.col("file_path") == F.col("_sf")) & (F.col("start_line") <= F.col("_b")) & (F.col("end_line") >= F.col("_a"))
    return facts.join(s, touch, "left_anti")
