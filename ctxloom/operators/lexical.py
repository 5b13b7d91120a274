"""Lexical search for batches of queries: weighted BM25, substring search, exact symbol lookup.

Queries are rows (query_id, project_id, text); an index is the set of rows of one project.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxloom.functions.text import lexical_query, spellings, terms
from ctxloom.operators.skew import salted_join
from ctxloom.tables import top_n

#: BM25 constants and column weights (fixed values).
K1, B = 1.2, 0.75
WEIGHT_CONTENT, WEIGHT_SIGNATURE, WEIGHT_DOCSTRING = 1, 5, 1
#: Channel quotas (fixed values).
QUOTAS = {"exact": 20, "literal": 30, "inferred": 20, "bm25": 50, "vector": 50}
POOL = 120
#: Least length of a phrase for substring search, most chunks of a weak phrase (fixed values).
MIN_LITERAL, ROOT_LIMIT = 4, 20


def unique_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks without copies."""
    return chunks.dropDuplicates(["project_id", "id"])


def unique_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols without copies."""
    return symbols.dropDuplicates(["project_id", "id"])


def postings(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(project_id, chunk_id, term, weight) one row per occurrence, and (project_id, chunk_id, length) with the length over all columns."""
    split = chunks.select("project_id", F.col("id").alias("chunk_id"), terms(F.col("content")).alias("c"), terms(F.col("signature")).alias("s"), terms(F.col("docstring")).alias("d"))
    lengths = split.select("project_id", "chunk_id", (F.size("c") + F.size("s") + F.size("d")).alias("length"))

    def weighted(name: str, w: int):
        return F.transform(F.col(name), lambda t: F.struct(t.alias("term"), F.lit(w).alias("weight")))

    every = F.concat(weighted("c", WEIGHT_CONTENT), weighted("s", WEIGHT_SIGNATURE), weighted("d", WEIGHT_DOCSTRING))
    return split.select("project_id", "chunk_id", F.explode(every).alias("p")).select("project_id", "chunk_id", "p.term", "p.weight"), lengths


def inverted_index(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What an ingest keeps for BM25: (project_id, term, chunk_id, tf) with weighted frequencies, and the chunk lengths."""
    occurrences, lengths = postings(chunks)
    return occurrences.groupBy("project_id", "term", "chunk_id").agg(F.sum("weight").alias("tf")), lengths


def bm25(chunks: DataFrame, queries: DataFrame, limit: int = QUOTAS["bm25"], operator: str = "or", index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query_id, project_id, chunk_id, score, rank): the best chunks per query; higher scores are better, ties by chunk id.

    With ``index`` (of :func:`inverted_index`) only the postings of asked terms are read; else texts are tokenised here,
    occurrences cut down to asked terms before they are shuffled, and counted with partial aggregation. A term asked
    twice counts twice; document frequencies and mean lengths are those of the project. ``operator='and'`` keeps only
    chunks with all distinct terms. Queries without terms, and null texts, find nothing.
    """
    asked = queries.select("query_id", "project_id", F.explode(terms(lexical_query(F.col("text")))).alias("term"))
    asked = asked.groupBy("query_id", "project_id", "term").agg(F.count(F.lit(1)).alias("times"))
    wanted = asked.select("project_id", "term").distinct()
    if index is None:
        occurrences, lengths = postings(chunks)
        tf = occurrences.join(wanted, ["project_id", "term"], "left_semi").groupBy("project_id", "chunk_id", "term").agg(F.sum("weight").alias("tf"))
    else:
        held, lengths = index
        tf = held.join(wanted, ["project_id", "term"], "left_semi").select("project_id", "chunk_id", "term", "tf")
    df = tf.groupBy("project_id", "term").agg(F.count(F.lit(1)).alias("df"))
    totals = lengths.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean_length"))
    terms_asked = asked.join(df, ["project_id", "term"]).join(totals, "project_id")
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms_asked = terms_asked.select("query_id", "project_id", "term", "times", "mean_length", F.when(idf > 0, idf).otherwise(F.lit(1e-6)).alias("idf"))
    hits = tf.join(terms_asked, ["project_id", "term"]).join(lengths, ["project_id", "chunk_id"])
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    scored = hits.groupBy("query_id", "project_id", "chunk_id").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("matched"))
    if operator == "and":
        needs = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("needed"))
        scored = scored.join(needs, "query_id").where("matched = needed").drop("needed")
    scored = scored.withColumn("score", F.round("score", 9)).drop("matched")
    return top_n(scored, ["query_id"], [F.desc("score"), F.asc("chunk_id")], limit)


def _phrases_by_project(phrases: DataFrame) -> DataFrame:
    return phrases.groupBy("project_id").agg(F.collect_set(F.struct("query_id", "phrase")).alias("asked"))


#: Most distinct phrases of a batch that are held by every executor.
HELD_PHRASES = 100_000
_FOUND = T.StructType([T.StructField("project_id", T.StringType()), T.StructField("_p", T.StringType()), T.StructField("chunk_id", T.StringType()), T.StructField("hits", T.IntegerType()), T.StructField("_named", T.BooleanType()), T.StructField("_span", T.IntegerType())])


def _scan_literals(chunks: DataFrame, phrases: Sequence[Row]) -> DataFrame:
    """Per chunk and phrase (project_id, p: lower case) of its project that it holds: how often, and whether its name does."""
    held: dict[str, list[str]] = {}
    for r in phrases:
        held.setdefault(r.project_id, []).append(r.p)
    shared = chunks.sparkSession.sparkContext.broadcast(held)
    low = F.lower(F.concat_ws("\n", F.coalesce("symbol_fqn", F.lit("")), F.coalesce("signature", F.lit("")), "content"))
    mine = chunks.where(F.col("project_id").isin(*held)) if len(held) <= 1000 else chunks
    asked = mine.select("project_id", "id", F.lower("symbol_fqn"), low, (F.col("end_line") - F.col("start_line")).cast("int"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automata: dict[str, object] = {}
        for b in batches:
            rows: list[tuple] = []
            for project, chunk, name, text, span in zip(*(c.to_pylist() for c in b.columns)):
                if project not in shared.value or not text:
                    continue
                find = automata.get(project)
                if find is None:
                    find = automata[project] = ahocorasick.Automaton()
                    for p in shared.value[project]:
                        find.add_word(p, (p, len(p)))
                    find.make_automaton()
                hits: dict[str, list[int]] = {}
                for last, (p, n) in find.iter(text):
                    seen = hits.setdefault(p, [0, -1])
                    if last - n + 1 > seen[1]:
                        seen[0] += 1
                        seen[1] = last
                rows += [(project, p, chunk, times, name is not None and p in name, span) for p, (times, _) in hits.items()]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int32()))], names=_FOUND.fieldNames())

    return asked.mapInArrow(scan, _FOUND)


def literal_search(chunks: DataFrame, phrases: DataFrame, limit: int = QUOTAS["literal"]) -> DataFrame:
    """(query_id, phrase, project_id, chunk_id, hits, rank) for substring matches without regard to case.

    ``phrases``: query_id, project_id, phrase. The text searched is name, signature and content; hits are counted without
    overlap, at least 1. Order: a match in the name first, then more hits, shorter spans, the id. Phrases shorter than 4
    characters find nothing. Up to ``HELD_PHRASES`` distinct phrases go to the executors as one automaton per project, and
    every text is read once whatever their number; beyond that a project's phrases travel as one row, and chunks of very
    large projects are salted. Both ways give the same rows.
    """
    usable = phrases.where(F.length("phrase") >= MIN_LITERAL)
    distinct = usable.select("project_id", F.lower("phrase").alias("p")).distinct().limit(HELD_PHRASES + 1).collect()
    if len(distinct) <= HELD_PHRASES:
        counted = _scan_literals(chunks, distinct)
        asked = usable.select("query_id", "project_id", "phrase", F.lower("phrase").alias("_p")).distinct()
        rows = counted.join(asked, ["project_id", "_p"]).select("query_id", "phrase", "project_id", "chunk_id", "hits", "_named", "_span")
        return top_n(rows, ["query_id", "phrase"], [F.desc("_named"), F.desc("hits"), F.asc("_span"), F.asc("chunk_id")], limit).drop("_named", "_span")
    joined = salted_join(chunks, _phrases_by_project(usable), ["project_id"], "inner", salt_from=["id"])
    low = F.lower(F.concat_ws("\n", F.coalesce("symbol_fqn", F.lit("")), F.coalesce("signature", F.lit("")), "content"))
    each = joined.select("project_id", F.col("id").alias("chunk_id"), F.lower("symbol_fqn").alias("_f"), low.alias("_t"), (F.col("end_line") - F.col("start_line")).alias("_span"), F.explode("asked").alias("a"))
    found = each.withColumn("_p", F.lower("a.phrase")).where(F.col("_t").contains(F.col("_p")))
    hits = ((F.length("_t") - F.length(F.replace("_t", "_p", F.lit("")))) / F.length("_p")).cast("int")
    rows = found.select("a.query_id", "a.phrase", "project_id", "chunk_id", F.greatest(hits, F.lit(1)).alias("hits"), F.coalesce(F.col("_f").contains(F.col("_p")), F.lit(False)).alias("_named"), "_span")
    return top_n(rows, ["query_id", "phrase"], [F.desc("_named"), F.desc("hits"), F.asc("_span"), F.asc("chunk_id")], limit).drop("_named", "_span")


def symbol_literal_search(symbols: DataFrame, phrases: DataFrame, limit: int = ROOT_LIMIT) -> DataFrame:
    """(query_id, phrase, project_id, chunk_id, rank) for phrases inside symbol names, shortest names first; the limit cuts symbols before their chunks are made distinct."""
    held = symbols.where("chunk_id is not null")
    joined = salted_join(held, _phrases_by_project(phrases), ["project_id"], "inner", salt_from=["id"])
    each = joined.select("project_id", "id", "name", "chunk_id", F.explode("asked").alias("a"))
    found = each.where(F.lower("name").contains(F.lower("a.phrase"))).select("a.query_id", "a.phrase", "project_id", "id", "chunk_id", F.length("name").alias("_n"), "name")
    cut = top_n(found, ["query_id", "phrase"], [F.asc("_n"), F.asc("name"), F.asc("id")], limit, "_r")
    first = cut.groupBy("query_id", "phrase", "project_id", "chunk_id").agg(F.min("_r").alias("_r"))
    return top_n(first, ["query_id", "phrase"], [F.asc("_r")], limit).drop("_r")


def exact_symbols(symbols: DataFrame, tokens: DataFrame) -> DataFrame:
    """Symbols whose name or fqn equals a token: ``tokens`` columns, symbol columns, and ``order`` within the token.

    ``tokens``: query_id, project_id, token and others. Two equi-joins instead of one with OR; exported symbols first,
    then an equal fqn, path, line and id."""
    keep = [c for c in symbols.columns if c != "project_id"]
    held = symbols.withColumnRenamed("project_id", "_sp")
    named = tokens.join(held, (F.col("project_id") == F.col("_sp")) & (F.col("token") == held["name"]))
    scoped = tokens.join(held, (F.col("project_id") == F.col("_sp")) & (F.col("token") == held["fqn"]) & ~held["name"].eqNullSafe(held["fqn"]))
    both = named.select(*tokens.columns, *keep).unionByName(scoped.select(*tokens.columns, *keep))
    order = [F.desc("is_exported"), F.desc(F.col("fqn") == F.col("token")), F.asc_nulls_first("file_path"), F.asc_nulls_first("start_line"), F.asc("id")]
    return top_n(both, ["query_id", "token"], order, 2_147_483_647, "order")


def recall_symbols(symbols: DataFrame, names: DataFrame, channel: str, tier: int, limit: int) -> DataFrame:
    """Candidates of a symbol channel. ``names``: query_id, project_id, name, pos (the place of the name in the query)."""
    if channel == "exact":
        spelled = names.select("query_id", "project_id", "pos", F.posexplode(spellings(F.col("name"))).alias("variant", "token"))
    else:
        spelled = names.select("query_id", "project_id", "pos", F.lit(0).alias("variant"), F.col("name").alias("token"))
    hits = exact_symbols(symbols, spelled).where("chunk_id is not null")
    first = hits.groupBy("query_id", "project_id", "chunk_id").agg(F.min(F.struct("pos", "variant", "order", "token")).alias("m"))
    ranked = top_n(first, ["query_id"], [F.asc("m.pos"), F.asc("m.variant"), F.asc("m.order"), F.asc("chunk_id")], limit)
    label = "explicit symbol " if channel == "exact" else "inferred symbol "
    return ranked.select("query_id", "project_id", "chunk_id", F.lit(channel).alias("channel"), "rank", F.lit(tier).alias("tier"), F.concat(F.lit(label), "m.token").alias("reason"))


def recall_literal(chunks: DataFrame, symbols: DataFrame, phrases: DataFrame, limit: int = QUOTAS["literal"]) -> DataFrame:
    """Candidates of the literal channel: phrases in their order, strong ones search texts, weak ones symbol names."""
    asked = phrases.select("query_id", "project_id", F.col("text").alias("phrase"), "strong", "pos")
    strong = literal_search(chunks, asked.where("strong"), limit).select("query_id", "project_id", "phrase", "chunk_id", F.col("rank").alias("r"), F.concat(F.col("hits").cast("string"), F.lit(" hits")).alias("how"))
    weak = symbol_literal_search(symbols, asked.where("not strong")).select("query_id", "project_id", "phrase", "chunk_id", F.col("rank").alias("r"), F.lit("symbol name").alias("how"))
    found = strong.unionByName(weak).join(asked.select("query_id", "phrase", "strong", "pos"), ["query_id", "phrase"])
    first = found.groupBy("query_id", "project_id", "chunk_id").agg(F.min(F.struct("pos", "r", "phrase", "strong", "how")).alias("m"))
    ranked = top_n(first, ["query_id"], [F.asc("m.pos"), F.asc("m.r"), F.asc("chunk_id")], limit)
    reason = F.concat(F.when(F.col("m.strong"), "explicit literal ").otherwise("literal root "), F.col("m.phrase"), F.lit(" ("), F.col("m.how"), F.lit(")"))
    return ranked.select("query_id", "project_id", "chunk_id", F.lit("literal").alias("channel"), "rank", F.when(F.col("m.strong"), 0).otherwise(1).alias("tier"), reason.alias("reason"))


def recall_bm25(chunks: DataFrame, queries: DataFrame, limit: int = QUOTAS["bm25"], index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Candidates of the BM25 channel."""
    return bm25(chunks, queries, limit, index=index).select("query_id", "project_id", "chunk_id", F.lit("bm25").alias("channel"), "rank", F.lit(1).alias("tier"), F.format_string("bm25 %.6f", "score").alias("reason"))
