"""Name resolution: pending references, failed ones worth another try, bare edges, document mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.functions.classify import is_symbol_reference
from ctxloom.functions.text import hint_matches, import_hints, mention, name_tail

#: What a reference becomes as an edge (fixed values).
EDGE_KINDS = {"call": "calls", "import": "imports", "inherit": "extends", "implement": "implements", "extends": "extends"}


def edge_kind(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in EDGE_KINDS.items() for x in p])[kind], F.lit("references"))


def match(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """All matches of ``refs`` (project_id, ref_id, name, kind, file_path): ref_id, symbol id, fqn, and ``found`` how many.

    Names that cannot be symbols match nothing. An equal fqn wins over an equal tail. Imports match only in a file their
    module path hints at. More than one match is narrowed to the reference's own file, then to exported symbols. What is
    left over one is ambiguous and all of it returned.
    """
    usable = refs.where(is_symbol_reference(F.col("name")))
    s = symbols.select(F.col("project_id").alias("_sp"), "id", F.col("name").alias("s_name"), "fqn", F.col("file_path").alias("s_path"), "is_exported")
    full = usable.join(s, (F.col("project_id") == F.col("_sp")) & (F.col("name") == F.col("fqn"))).drop("_sp").withColumn("_by", F.lit(0))
    tailed = usable.withColumn("_tail", name_tail(F.col("name")))
    by_name = tailed.join(s, (F.col("project_id") == F.col("_sp")) & (F.col("_tail") == F.col("s_name"))).drop("_sp")
    by_fqn = tailed.join(s, (F.col("project_id") == F.col("_sp")) & (F.col("_tail") == F.col("fqn")) & (F.col("s_name") != F.col("fqn"))).drop("_sp")
    tail = by_name.unionByName(by_fqn).drop("_tail").withColumn("_by", F.lit(1))
    rows = full.unionByName(tail)
    w = Window.partitionBy("project_id", "ref_id")
    rows = rows.withColumn("_least", F.min("_by").over(w)).where("_by = _least")
    hints = import_hints(F.col("file_path"), F.col("name"))
    rows = rows.where((F.col("kind") != "import") & (F.col("kind") != "imports") | (F.size(hints) == 0) | hint_matches(F.col("s_path"), hints))
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(w))
    own = F.col("s_path") == F.col("file_path")
    rows = rows.withColumn("_own", F.sum(F.when(own, 1).otherwise(0)).over(w)).where((F.col("_n") == 1) | (F.col("_own") == 0) | own)
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(w))
    exported = F.coalesce("is_exported", F.lit(False))
    rows = rows.withColumn("_exp", F.sum(F.when(exported, 1).otherwise(0)).over(w)).where((F.col("_n") == 1) | (F.col("_exp") == 0) | exported)
    return rows.withColumn("found", F.count(F.lit(1)).over(w)).select("project_id", "ref_id", "name", "kind", "file_path", F.col("id").alias("symbol_id"), "fqn", "found")


def single_match(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(project_id, ref_id, fqn) of the references that :func:`match` gives exactly one symbol, without pairing any reference
    with all symbols of its name: per key, and per key and file, symbols are counted first and one of them is kept.

    For references that are no imports, whose module paths have to be held against every candidate."""
    s = symbols.select("project_id", F.struct("id", "fqn").alias("s"), "name", "fqn", F.col("file_path").alias("_path"), F.coalesce("is_exported", F.lit(False)).alias("_exp"))
    keyed = s.where("fqn is not null").select("project_id", F.lit(0).alias("_by"), F.col("fqn").alias("_key"), "s", "_path", "_exp")
    keyed = keyed.unionByName(s.where("name is not null").select("project_id", F.lit(1).alias("_by"), F.col("name").alias("_key"), "s", "_path", "_exp"))
    keyed = keyed.unionByName(s.where("name <> fqn").select("project_id", F.lit(1).alias("_by"), F.col("fqn").alias("_key"), "s", "_path", "_exp"))

    def counted(keys: list[str], lead: str) -> DataFrame:
        mine = F.when(F.col("_exp"), F.col("s"))
        return keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{lead}n"), F.max("s").alias(f"{lead}one"), F.count(mine).alias(f"{lead}exp"), F.max(mine).alias(f"{lead}exp_one"))

    usable = refs.where(is_symbol_reference(F.col("name"))).select("project_id", "ref_id", "name", "file_path")
    known = keyed.where("_by = 0").select("project_id", F.col("_key").alias("name"), F.lit(True).alias("_full")).distinct()
    asked = usable.join(known, ["project_id", "name"], "left").select("project_id", "ref_id", F.col("file_path").alias("_path"), F.when(F.col("_full"), 0).otherwise(1).alias("_by"), F.when(F.col("_full"), F.col("name")).otherwise(name_tail(F.col("name"))).alias("_key"))
    wide = asked.join(counted(["project_id", "_by", "_key"], "a_"), ["project_id", "_by", "_key"]).join(counted(["project_id", "_by", "_key", "_path"], "o_"), ["project_id", "_by", "_key", "_path"], "left")
    own = F.coalesce("o_n", F.lit(0))
    one = (
        F.when(F.col("a_n") == 1, F.col("a_one")).when(own == 1, F.col("o_one")).when((own > 1) & (F.col("o_exp") == 1), F.col("o_exp_one")).when((own == 0) & (F.col("a_exp") == 1), F.col("a_exp_one"))
    )
    return wide.select("project_id", "ref_id", one["fqn"].alias("fqn")).where("fqn is not null")


def resolve_pending(refs: DataFrame, symbols: DataFrame, status: str = "pending") -> tuple[DataFrame, DataFrame]:
    """New edges of references with ``status``, and the references that stay failed.

    A single match makes a resolved edge, ambiguous ones an edge each with provenance synthesized."""
    asked = refs.where(F.col("status") == status).withColumn("name", F.trim("name")).withColumnRenamed("id", "ref_id")
    hits = match(asked.select("project_id", "ref_id", "name", "kind", "file_path"), symbols)
    edges = hits.join(asked.select("project_id", "ref_id", "from_fqn", "line"), ["project_id", "ref_id"]).select(
        "project_id", "ref_id", F.col("from_fqn").alias("source_fqn"), F.col("fqn").alias("target_name"), edge_kind(F.col("kind")).alias("kind"), "line", F.when(F.col("found") == 1, "resolved").otherwise("synthesized").alias("provenance")
    )
    failed = asked.join(hits.select("project_id", "ref_id").distinct(), ["project_id", "ref_id"], "left_anti").withColumn("status", F.lit("failed")).withColumn("name_tail", name_tail(F.col("name")))
    return edges.dropDuplicates(["project_id", "source_fqn", "target_name", "kind", "line"]), failed


def retry_failed(refs: DataFrame, new_names: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Failed references whose tail or name is among ``new_names`` (project_id, name), resolved again."""
    failed = refs.where(F.col("status") == "failed")
    key = failed.select("*", F.explode(F.array_distinct(F.array(F.trim("name"), name_tail(F.trim("name"))))).alias("_key"))
    again = key.join(new_names.select("project_id", F.col("name").alias("_key")).distinct(), ["project_id", "_key"], "left_semi").drop("_key").dropDuplicates(["project_id", "id"])
    return resolve_pending(again, symbols, "failed")


def retarget_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges with targets that are no fqn but match one symbol, pointed at its fqn; all other edges as they are.

    Edges that become equal are folded, one with the smallest id kept."""
    from ctxloom.operators.graph import unique_edges, unresolved_edges

    bare = unresolved_edges(edges, symbols)
    asked = bare.select("project_id", F.col("edge_id").alias("ref_id"), F.trim("target_name").alias("name"), "kind", "file_path")
    module = F.coalesce(F.col("kind").isin("import", "imports"), F.lit(False))
    one = match(asked.where(module), symbols).where("found = 1").select("project_id", "ref_id", "fqn").unionByName(single_match(asked.where(~module), symbols))
    one = one.select("project_id", F.col("ref_id").alias("edge_id"), F.col("fqn").alias("_new"))
    out = edges.join(one, ["project_id", "edge_id"], "left").withColumn("target_name", F.coalesce("_new", "target_name")).drop("_new")
    return unique_edges(out)


def link_mentions(blocks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(project_id, spec_block_id, symbol_id, provenance, stale) for mentions of document blocks (project_id, block_id, mentioned).

    A mention equal to an fqn links to that symbol, else to all symbols with the name of its tail."""
    said = blocks.select("project_id", "block_id", F.explode("mentioned").alias("raw")).select("project_id", "block_id", mention(F.col("raw")).alias("m")).where("m is not null").distinct()
    s = symbols.select(F.col("project_id").alias("_sp"), "id", "name", "fqn")
    full = said.join(s, (F.col("project_id") == F.col("_sp")) & (F.col("m") == F.col("fqn"))).drop("_sp")
    rest = said.join(full.select("project_id", "block_id", "m").distinct(), ["project_id", "block_id", "m"], "left_anti").withColumn("_tail", name_tail(F.col("m")))
    tail = rest.join(s, (F.col("project_id") == F.col("_sp")) & (F.col("_tail") == F.col("name"))).drop("_sp")
    both = full.select("project_id", "block_id", "id").unionByName(tail.select("project_id", "block_id", "id")).distinct()
    return both.select("project_id", F.col("block_id").alias("spec_block_id"), F.col("id").alias("symbol_id"), F.lit("inferred").alias("provenance"), F.lit(False).alias("stale"))


def cascade_spec_refs(spec_refs: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Document links after files changed. ``old`` and ``new``: project_id, file_path, fqn, id of the changed files' symbols.

    A link to a symbol whose fqn is gone from its file becomes stale; one whose fqn is now under one other id is hung there."""
    now = new.groupBy("project_id", "file_path", "fqn").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_id"))
    o = old.select("project_id", "file_path", "fqn", F.col("id").alias("symbol_id"))
    moved = o.join(now, ["project_id", "file_path", "fqn"], "left").select("project_id", "symbol_id", F.col("_n").isNull().alias("_gone"), F.when(F.col("_n") == 1, F.col("_id")).alias("_new"), F.lit(True).alias("_was"))
    out = spec_refs.join(moved, ["project_id", "symbol_id"], "left")
    return out.select("project_id", "spec_block_id", F.when(~F.coalesce("_gone", F.lit(False)), F.coalesce("_new", "symbol_id")).otherwise(F.col("symbol_id")).alias("symbol_id"), "provenance", (F.col("stale") | F.coalesce("_gone", F.lit(False))).alias("stale"))


def include_targets(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges with the includes of C and C++ files, noted as folder and name, pointed at the files they mean."""
    from ctxloom.functions.classify import language_of

    asked = edges.where((F.col("kind") == "imports") & language_of(F.col("source_fqn")).isin("c", "cpp"))
    folder = F.regexp_replace("file_path", "[^/]*$", "")
    said = F.when(F.startswith("target_name", folder), F.substring("target_name", F.length(folder) + 1, F.lit(1 << 30))).otherwise(F.col("target_name"))
    found = resolve_includes(asked.select("project_id", F.col("edge_id").alias("include_id"), "file_path", said.alias("name")), files)
    there = found.groupBy("project_id", F.col("include_id").alias("edge_id")).agg(F.min("path").alias("_path"))
    return edges.join(there, ["project_id", "edge_id"], "left").withColumn("target_name", F.coalesce("_path", "target_name")).drop("_path")


def resolve_includes(includes: DataFrame, files: DataFrame) -> DataFrame:
    """(project_id, include_id, path): the file an include (project_id, include_id, file_path, name) means.

    The path relative to the including file comes first, then the one file of the project with that base name; includes
    that fit neither have no row. Both steps are equi-joins."""
    from ctxloom.functions.classify import base_name

    folder = F.regexp_replace("file_path", "[^/]*$", "")
    rel = F.regexp_replace(F.concat(folder, F.col("name")), r"(^|/)\./", "$1")
    for _ in range(4):  # a/b/../c is a/c
        rel = F.regexp_replace(rel, r"(^|/)[^/.][^/]*/\.\./", "$1")
    known = files.select("project_id", "path").distinct()
    asked = includes.withColumn("_rel", rel)
    near = asked.join(known.withColumnRenamed("path", "_rel"), ["project_id", "_rel"], "left_semi").select("project_id", "include_id", F.col("_rel").alias("path"))
    single = known.groupBy("project_id", base_name(F.col("path")).alias("_base")).agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("path")).where("_n = 1")
    rest = asked.join(near.select("project_id", "include_id"), ["project_id", "include_id"], "left_anti").withColumn("_base", base_name(F.col("name")))
    return near.unionByName(rest.join(single, ["project_id", "_base"]).select("project_id", "include_id", "path"))
