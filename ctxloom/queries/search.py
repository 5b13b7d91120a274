"""Search over the indexed projects: lexical, symbol, vector and graph operators, fusion and reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.operators import graph, lexical, resolve, vector
from ctxloom.operators.fusion import fuse
from ctxloom.operators.pack import merged_spans, uncovered_spans
from ctxloom.operators.parse import explode, parse_files
from ctxloom.operators.usage import metrics
from ctxloom.plans.search import Index, search, search_pool
from ctxloom.queries import Registry
from ctxloom.tables import current_files, cut, load

CH = "(SELECT DISTINCT ON (project_id, id) * FROM chunks)"
SY = "(SELECT DISTINCT ON (project_id, id) * FROM symbols)"
ED = "(SELECT DISTINCT ON (edge_id) * FROM edges)"
TERM_SQL = r"[A-Za-z0-9]+|[\x{4E00}-\x{9FFF}]"
PROBE = f"""q AS (SELECT project_id AS query_id, project_id, min(fqn) AS symbol, max(name) AS other,
  'How does `' || min(fqn) || '` use ' || replace(max(name), '_', ' ') || ' and the sparse score column?' AS text
  FROM {SY} WHERE is_exported AND kind IN ('function', 'method') AND name IS NOT NULL AND fqn IS NOT NULL GROUP BY project_id)"""


def probe(spark: SparkSession, d: str) -> DataFrame:
    """One query per project: about its first exported function, in words of another name."""
    s = load(spark, d, "symbols").where("is_exported and kind in ('function', 'method') and name is not null and fqn is not null")
    q = s.groupBy("project_id").agg(F.min("fqn").alias("symbol"), F.max("name").alias("other"))
    text = F.concat(F.lit("How does `"), "symbol", F.lit("` use "), F.regexp_replace("other", "_", " "), F.lit(" and the sparse score column?"))
    return q.select(F.col("project_id").alias("query_id"), "project_id", "symbol", "other", text.alias("text"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return lexical.unique_chunks(load(spark, d, "chunks"))


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    return lexical.unique_symbols(load(spark, d, "symbols"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "edges").dropDuplicates(["edge_id"])


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    found = lexical.bm25(_chunks(spark, d), probe(spark, d))
    return found.select("query_id", "chunk_id", F.round("score", 4).alias("score"))


def bm25_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The same from an inverted index that is written first, as an ingest keeps it."""
    tf, lengths = lexical.inverted_index(_chunks(spark, d))
    index = cut(tf.repartitionByRange("term").sortWithinPartitions("term"), "postings"), cut(lengths, "lengths")
    return lexical.bm25(_chunks(spark, d), probe(spark, d), index=index).select("query_id", "chunk_id", F.round("score", 4).alias("score"))


def _bm25_sql() -> str:
    def tokens(column: str, weight: int) -> str:
        return f"SELECT project_id, id, lower(unnest(regexp_extract_all(coalesce({column}, ''), '{TERM_SQL}'))) AS term, {weight} AS w FROM c"

    return f"""WITH {PROBE}, c AS {CH},
occ AS ({tokens("content", 1)} UNION ALL {tokens("signature", 5)} UNION ALL {tokens("docstring", 1)}),
len AS (SELECT c.project_id, c.id, coalesce(n, 0) AS length FROM c LEFT JOIN (SELECT project_id, id, count(*) AS n FROM occ GROUP BY ALL) o ON o.project_id = c.project_id AND o.id = c.id),
tot AS (SELECT project_id, count(*) AS n, avg(length) AS mean FROM len GROUP BY 1),
ask AS (SELECT query_id, project_id, term, count(*) AS times FROM (SELECT query_id, project_id, lower(unnest(regexp_extract_all(replace(replace(text, '`', ''), '::', ' '), '{TERM_SQL}'))) AS term FROM q) GROUP BY ALL),
tf AS (SELECT project_id, id, term, sum(w) AS tf FROM occ WHERE (project_id, term) IN (SELECT project_id, term FROM ask) GROUP BY ALL),
df AS (SELECT project_id, term, count(*) AS df FROM tf GROUP BY ALL),
s AS (SELECT a.query_id, tf.id AS chunk_id,
  sum(a.times * CASE WHEN ln((tot.n - df.df + 0.5) / (df.df + 0.5)) > 0 THEN ln((tot.n - df.df + 0.5) / (df.df + 0.5)) ELSE 1e-6 END * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * len.length / tot.mean))) AS score
  FROM ask a JOIN tf USING (project_id, term) JOIN df USING (project_id, term) JOIN tot USING (project_id) JOIN len ON len.project_id = a.project_id AND len.id = tf.id GROUP BY ALL)
SELECT query_id, chunk_id, round(round(score, 9), 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s) WHERE rank <= 50"""


def literals(spark: SparkSession, d: str) -> DataFrame:
    phrases = probe(spark, d).select("query_id", "project_id", F.col("other").alias("phrase"))
    return lexical.literal_search(_chunks(spark, d), phrases).select("query_id", "chunk_id", "hits", "rank")


LITERAL_SQL = f"""WITH {PROBE}, t AS (SELECT project_id, id, lower(symbol_fqn) AS f, lower(coalesce(symbol_fqn, '') || chr(10) || coalesce(signature, '') || chr(10) || content) AS b, end_line - start_line AS span FROM {CH}),
h AS (SELECT q.query_id, t.id AS chunk_id, greatest(1, (length(b) - length(replace(b, lower(other), ''))) // length(other))::INT AS hits, coalesce(contains(f, lower(other)), false) AS named, span
  FROM q JOIN t ON t.project_id = q.project_id WHERE length(other) >= 4 AND contains(b, lower(other)))
SELECT query_id, chunk_id, hits, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY named DESC, hits DESC, span, chunk_id)::INT AS rank FROM h) WHERE rank <= 30"""


def symbol_roots(spark: SparkSession, d: str) -> DataFrame:
    phrases = probe(spark, d).select("query_id", "project_id", F.element_at(F.split("other", "_"), -1).alias("phrase"))
    return lexical.symbol_literal_search(_symbols(spark, d), phrases).select("query_id", "chunk_id", "rank")


ROOT_SQL = f"""WITH {PROBE}, h AS (SELECT q.query_id, s.chunk_id, s.name, s.id, length(s.name) AS n FROM q JOIN {SY} s ON s.project_id = q.project_id AND s.chunk_id IS NOT NULL
  AND contains(lower(s.name), lower(string_split(other, '_')[-1]))),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n, name, id) AS r FROM h),
f AS (SELECT query_id, chunk_id, min(r) AS r FROM r WHERE r <= 20 GROUP BY ALL)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY r)::INT AS rank FROM f"""


def exact_lookup(spark: SparkSession, d: str) -> DataFrame:
    tokens = probe(spark, d).select("query_id", "project_id", F.explode(F.array("symbol", "other")).alias("token")).distinct()
    return lexical.exact_symbols(_symbols(spark, d), tokens).select("query_id", "token", "id", "order")


EXACT_SQL = f"""WITH {PROBE}, t AS (SELECT query_id, project_id, symbol AS token FROM q UNION SELECT query_id, project_id, other FROM q)
SELECT query_id, token, s.id, row_number() OVER (PARTITION BY query_id, token ORDER BY is_exported DESC, s.fqn = token DESC, file_path NULLS FIRST, start_line NULLS FIRST, s.id)::INT AS "order"
FROM t JOIN {SY} s ON s.project_id = t.project_id AND (s.name = token OR s.fqn = token)"""


def recall_exact(spark: SparkSession, d: str) -> DataFrame:
    names = probe(spark, d).select("query_id", "project_id", F.col("symbol").alias("name"), F.lit(0).alias("pos"))
    return lexical.recall_symbols(_symbols(spark, d), names, "exact", 0, lexical.QUOTAS["exact"])


EXACT_RECALL_SQL = f"""WITH {PROBE}, x AS (SELECT q.query_id, q.project_id, s.chunk_id, min((v.i, s.fqn <> v.t, NOT s.is_exported, s.file_path, s.start_line, s.id, v.t)) AS k FROM q,
LATERAL (SELECT * FROM (VALUES (0, q.symbol), (1, replace(q.symbol, '::', '.')), (2, replace(q.symbol, '.', '::'))) z(i, t)) v
JOIN {SY} s ON s.project_id = q.project_id AND (s.name = v.t OR s.fqn = v.t) AND s.chunk_id IS NOT NULL GROUP BY ALL)
SELECT query_id, project_id, chunk_id, 'exact' AS channel, rank, 0 AS tier, 'explicit symbol ' || k[7] AS reason FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k)::INT AS rank FROM x) WHERE rank <= 20"""


def covering(spark: SparkSession, d: str) -> DataFrame:
    points = _edges(spark, d).where("line is not null").select("edge_id", "project_id", "file_path", "line")
    return graph.covering_chunks(points, _chunks(spark, d), ["edge_id"])


COVER_SQL = f"""SELECT edge_id, chunk_id FROM (SELECT e.edge_id, c.id AS chunk_id, row_number() OVER (PARTITION BY e.edge_id ORDER BY c.end_line - c.start_line, c.id) AS r
FROM {ED} e JOIN {CH} c ON c.project_id = e.project_id AND c.file_path = e.file_path AND e.line BETWEEN c.start_line AND c.end_line) WHERE r = 1"""


def members(spark: SparkSession, d: str) -> DataFrame:
    holders = _symbols(spark, d).where("kind in ('class', 'struct') and fqn is not null").select("project_id", F.col("fqn").alias("container")).distinct()
    return graph.container_members(holders, _symbols(spark, d)).select("project_id", "container", "id")


MEMBER_SQL = f"""SELECT h.project_id, h.container, s.id FROM (SELECT DISTINCT project_id, fqn AS container FROM symbols WHERE kind IN ('class', 'struct') AND fqn IS NOT NULL) h
JOIN {SY} s ON s.project_id = h.project_id AND starts_with(replace(s.fqn, '::', '.'), replace(h.container, '::', '.') || '.')"""


def both_ways(spark: SparkSession, d: str) -> DataFrame:
    asked = probe(spark, d).select("project_id", F.col("symbol").alias("fqn"))
    return graph.edges_of(asked, _edges(spark, d)).groupBy("project_id", "fqn", "direction", "kind").agg(F.count(F.lit(1)).alias("edges"))


BOTH_SQL = f"""WITH {PROBE} SELECT project_id, fqn, direction, kind, count(*) AS edges FROM (
SELECT q.project_id, q.symbol AS fqn, 'out' AS direction, e.kind FROM q JOIN {ED} e ON e.project_id = q.project_id AND e.source_fqn = q.symbol
UNION ALL SELECT q.project_id, q.symbol, 'in', e.kind FROM q JOIN {ED} e ON e.project_id = q.project_id AND e.target_name = q.symbol AND e.source_fqn <> e.target_name) GROUP BY ALL"""


def dangling(spark: SparkSession, d: str) -> DataFrame:
    return graph.unresolved_edges(_edges(spark, d), _symbols(spark, d), ("calls", "extends")).select("edge_id")


def distinct_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.unique_edges(load(spark, d, "edges")).select("edge_id", "project_id", "source_fqn", "target_name", "kind", "line")


def entry_symbols(spark: SparkSession, d: str) -> DataFrame:
    return graph.entry_points(_symbols(spark, d), _edges(spark, d)).select("project_id", "id")


def reexports(spark: SparkSession, d: str) -> DataFrame:
    from ctxloom.functions.text import name_tail

    names = _symbols(spark, d).where("is_exported").select("project_id", name_tail(F.col("fqn")).alias("name"))
    return graph.reexport_sites(names, _edges(spark, d))


def _refs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "unresolved_refs").dropDuplicates(["id"])


def pending_edges(spark: SparkSession, d: str) -> DataFrame:
    edges, _ = resolve.resolve_pending(_refs(spark, d), _symbols(spark, d))
    return edges.select("project_id", "source_fqn", "target_name", "kind", "line", "provenance")


def pending_failed(spark: SparkSession, d: str) -> DataFrame:
    _, failed = resolve.resolve_pending(_refs(spark, d), _symbols(spark, d))
    return failed.select(F.col("ref_id").alias("id"), "status", "name_tail")


SHAPE = r"^[A-Za-z_~][\w~]*((\.|::|->)[A-Za-z_~][\w~]*)*$"
TAIL = "regexp_extract(replace({0}, '::', '.'), '([^.]*)$', 1)"
#: Matching without imports: the path hints of imports are tested on fixtures.
MATCH_SQL = f"""r AS (SELECT DISTINCT ON (id) id, project_id, from_fqn, trim(name) AS name, kind, line, file_path, status FROM unresolved_refs),
u AS (SELECT * FROM r WHERE status = 'pending' AND regexp_matches(name, '{SHAPE}') AND NOT regexp_matches(name, '\\.(h|hh|hpp|hxx|c|cc|cpp|cxx|py|md)$')),
m AS (SELECT u.id, u.file_path, s.id AS sid, s.fqn, s.file_path AS spath, coalesce(s.is_exported, false) AS ex, CASE WHEN u.name = s.fqn THEN 0 ELSE 1 END AS by_
  FROM u JOIN {SY} s ON s.project_id = u.project_id AND (u.name = s.fqn OR {TAIL.format("u.name")} = s.name OR {TAIL.format("u.name")} = s.fqn)),
m1 AS (SELECT * FROM m QUALIFY by_ = min(by_) OVER (PARTITION BY id)),
m2 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n, sum((spath = file_path)::INT) OVER (PARTITION BY id) AS own FROM m1) WHERE n = 1 OR own = 0 OR spath = file_path),
m3 AS (SELECT * FROM (SELECT * EXCLUDE (n), count(*) OVER (PARTITION BY id) AS n, sum(ex::INT) OVER (PARTITION BY id) AS exs FROM m2) WHERE n = 1 OR exs = 0 OR ex)"""


def _resolve_sql() -> str:
    """All pending references with path hints of imports, up to the matches ``m3``."""
    hint = """list_filter([m || '.py', m || '/__init__.py', CASE WHEN regexp_replace(m, '/?[^/]*$', '') <> '' THEN regexp_replace(m, '/?[^/]*$', '') || '.py' END, CASE WHEN regexp_replace(m, '/?[^/]*$', '') <> '' THEN regexp_replace(m, '/?[^/]*$', '') || '/__init__.py' END], lambda h: h IS NOT NULL)"""
    parts = r"""length(regexp_extract(name, '^(\.*)', 1)) AS dots, replace(regexp_replace(name, '^\.+', ''), '.', '/') AS rest, array_to_string(string_split(file_path, '/')[1:greatest(len(string_split(file_path, '/')) - greatest(length(regexp_extract(name, '^(\.*)', 1)), 1), 0)], '/') AS base"""
    hinted = f"""h AS (SELECT id, {hint} AS hints FROM (SELECT *, CASE WHEN dots > 0 AND base <> '' THEN base || '/' || rest ELSE rest END AS m FROM (SELECT id, {parts} FROM r WHERE kind = 'import'))),
m1 AS (SELECT * FROM m0 WHERE id NOT IN (SELECT id FROM h) OR EXISTS (SELECT 1 FROM (SELECT unnest(hints) AS hint FROM h WHERE h.id = m0.id) z WHERE spath = hint OR ends_with(spath, '/' || hint))),"""
    body = MATCH_SQL.replace("m1 AS (SELECT * FROM m QUALIFY by_ = min(by_) OVER (PARTITION BY id)),", "m0 AS (SELECT * FROM m QUALIFY by_ = min(by_) OVER (PARTITION BY id)),\n" + hinted)
    return "WITH " + body + ", f AS (SELECT *, count(*) OVER (PARTITION BY id) AS found FROM m3) "


def call_matches(spark: SparkSession, d: str) -> DataFrame:
    """Pending references with the number of symbols each may mean."""
    refs = _refs(spark, d).where("status = 'pending'").select("project_id", F.col("id").alias("ref_id"), F.trim("name").alias("name"), "kind", "file_path")
    return resolve.match(refs, _symbols(spark, d)).groupBy("ref_id").agg(F.min("symbol_id").alias("symbol_id"), F.count(F.lit(1)).alias("found"))


def retargeted(spark: SparkSession, d: str) -> DataFrame:
    return resolve.retarget_edges(_edges(spark, d), _symbols(spark, d)).select("edge_id", "project_id", "source_fqn", "target_name", "kind")


def _retarget_sql() -> str:
    """Edges that name no fqn take the fqn of the one symbol that their name, file and module path leave."""
    body = _resolve_sql().replace("FROM unresolved_refs)", "FROM x)").replace("WHERE status = 'pending' AND", "WHERE")
    body = body.replace("WITH r AS (SELECT DISTINCT ON (id) id, project_id, from_fqn, trim(name) AS name, kind, line, file_path, status FROM x)", f"""WITH e AS {ED}, r AS (SELECT edge_id AS id, project_id, source_fqn AS from_fqn, trim(target_name) AS name, kind, line, file_path FROM e
      WHERE NOT EXISTS (SELECT 1 FROM symbols s WHERE s.project_id = e.project_id AND s.fqn = e.target_name))""").replace("FROM r WHERE kind = 'import'", "FROM r WHERE kind IN ('import', 'imports')")
    return body + """, o AS (SELECT id, fqn FROM f WHERE found = 1), n AS (SELECT e.edge_id, e.project_id, e.source_fqn, coalesce(o.fqn, e.target_name) AS target_name, e.kind, e.line FROM e LEFT JOIN o ON o.id = e.edge_id)
SELECT edge_id, project_id, source_fqn, target_name, kind FROM (SELECT *, row_number() OVER (PARTITION BY project_id, source_fqn, target_name, kind, coalesce(line, -1) ORDER BY edge_id) AS r FROM n) WHERE r = 1"""


def nearest(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest embeddings of every query row, itself left in."""
    e = load(spark, d, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = vector.cosine_top_k(e.select("vec_id", F.col("embedding").alias("vector")), queries, 10, corpus_id="vec_id", query_id="query_id")
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"))


NEAREST_SQL = """SELECT query_id, vec_id, round(score, 6) AS score FROM (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score,
row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) DESC, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE r <= 10"""


def normalised(spark: SparkSession, d: str) -> DataFrame:
    from ctxloom.functions.text import dot, l2_normalize

    v = l2_normalize(F.col("embedding"))
    return load(spark, d, "embeddings").select("vec_id", F.round(dot(v, v), 6).alias("norm"), F.round(F.element_at(v, 1), 6).alias("first"))


def _three_channels(spark: SparkSession, d: str) -> DataFrame:
    """BM25, literal and exact candidates of the probe queries."""
    q = probe(spark, d)
    chunks, symbols = _chunks(spark, d), _symbols(spark, d)
    one = lexical.recall_bm25(chunks, q)
    two = literals(spark, d).join(q.select("query_id", "project_id"), "query_id").select("query_id", "project_id", "chunk_id", F.lit("literal").alias("channel"), "rank", F.lit(0).alias("tier"), F.lit("explicit literal x").alias("reason"))
    names = q.select("query_id", "project_id", F.col("symbol").alias("name"), F.lit(0).alias("pos"))
    return one.unionByName(two).unionByName(lexical.recall_symbols(symbols, names, "exact", 0, 20))


def fused(spark: SparkSession, d: str) -> DataFrame:
    return fuse(_three_channels(spark, d)).select("query_id", "chunk_id", "rrf_score", "channels", "best_rank", "tier", "pool_rank")


def _fuse_sql() -> str:
    bm = _bm25_sql().replace("SELECT query_id, chunk_id, round(round(score, 9), 4) AS score FROM", "SELECT query_id, chunk_id, rank FROM")
    lit = LITERAL_SQL.replace("SELECT query_id, chunk_id, hits, rank FROM", "SELECT query_id, chunk_id, rank FROM")
    exact = f"""WITH {PROBE}, x AS (SELECT q.query_id, s.chunk_id, min((v.i, s.fqn <> v.t, NOT s.is_exported, s.file_path, s.start_line, s.id)) AS k FROM q,
      LATERAL (SELECT * FROM (VALUES (0, q.symbol), (1, replace(q.symbol, '::', '.')), (2, replace(q.symbol, '.', '::'))) z(i, t)) v
      JOIN {SY} s ON s.project_id = q.project_id AND (s.name = v.t OR s.fqn = v.t) AND s.chunk_id IS NOT NULL GROUP BY ALL)
      SELECT query_id, chunk_id, rank FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY k) AS rank FROM x) WHERE rank <= 20"""
    return f"""WITH a AS (SELECT *, 1 AS tier FROM ({bm}) UNION ALL SELECT *, 0 FROM ({lit}) UNION ALL SELECT *, 0 FROM ({exact})),
p AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 12) AS rrf_score, count(*)::INT AS channels, min(rank)::INT AS best_rank, min(tier) AS tier FROM a GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, channels DESC, best_rank, chunk_id)::INT AS pool_rank FROM p) WHERE pool_rank <= 120"""


def index_of(spark: SparkSession, d: str) -> Index:
    """The tables as an index: names that stayed unresolved, and what the documents among the uploads mention."""
    symbols = _symbols(spark, d)
    documents = parse_files(load(spark, d, "blobs").where(F.lower("path").rlike(r"\.(md|markdown|mdx)$")))
    blocks = explode(documents, "spec_blocks").select("project_id", F.col("id").alias("block_id"), "mentioned")
    failed = _refs(spark, d).where("status = 'failed'").select("project_id", "file_path", F.trim("name").alias("name"))
    return Index(_chunks(spark, d), symbols, _edges(spark, d), current_files(load(spark, d, "files"), "generated"), resolve.link_mentions(blocks, symbols), failed_refs=failed)


#: The held-out questions, each asked of the project with the most chunks.
EVAL_PROBE = f"""q AS (SELECT item_id AS query_id, (SELECT project_id FROM {CH} GROUP BY 1 ORDER BY count(*) DESC, project_id LIMIT 1) AS project_id, query AS text FROM eval_items)"""


def questions(spark: SparkSession, d: str) -> DataFrame:
    """The held-out questions, each asked of the project with the most chunks."""
    largest = _chunks(spark, d).groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "project_id").limit(1).select("project_id", F.lit(1).alias("one"))
    return load(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("query").alias("text"), F.lit(1).alias("one")).join(largest, "one").select("query_id", "project_id", "text")


def question_hits(spark: SparkSession, d: str) -> DataFrame:
    """BM25 hits of the held-out questions."""
    return lexical.bm25(_chunks(spark, d), questions(spark, d)).select("query_id", "chunk_id", F.round("score", 4).alias("score"))


#: The two words a held-out question ends in, which a chunk that answers it is expected to hold.
ASKED_WORDS = r"(\S+ \S+?)\W*$"


def question_quality(spark: SparkSession, d: str) -> DataFrame:
    """Recall and reciprocal rank by category: the first BM25 hit of a held-out question whose text holds the words it ends in."""
    asked = load(spark, d, "eval_items").select("item_id", "category", F.lower(F.regexp_extract("query", ASKED_WORDS, 1)).alias("words"))
    found = lexical.bm25(_chunks(spark, d), questions(spark, d)).select("query_id", "project_id", "chunk_id", "rank")
    texts = _chunks(spark, d).select("project_id", F.col("id").alias("chunk_id"), F.lower("content").alias("text"))
    held = found.join(texts, ["project_id", "chunk_id"]).join(asked.where("words <> ''").select(F.col("item_id").alias("query_id"), "words"), "query_id").where(F.col("text").contains(F.col("words")))
    hits = held.groupBy(F.col("query_id").alias("case_id")).agg(F.min("rank").alias("rank"))
    m = metrics(asked.select(F.col("item_id").alias("case_id"), "category"), hits, ["category"])
    return m.select("category", "cases", *[F.round(c, 6).alias(c) for c in ("recall_at_5", "recall_at_10", "mrr")])


def _quality_sql() -> str:
    hits = _bm25_sql().replace(PROBE, EVAL_PROBE).replace("SELECT query_id, chunk_id, round(round(score, 9), 4) AS score FROM", "SELECT query_id, chunk_id, rank FROM")
    return f"""WITH hits AS ({hits}), a AS (SELECT item_id, category, lower(regexp_extract(query, '{ASKED_WORDS}', 1)) AS words FROM eval_items),
r AS (SELECT item_id, min(rank) AS rank FROM hits JOIN a ON a.item_id = query_id AND words <> '' JOIN (SELECT DISTINCT ON (project_id, id) * FROM chunks) c ON c.id = chunk_id AND contains(lower(c.content), words) GROUP BY 1)
SELECT category, count(*) AS cases, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_at_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_at_10, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM a LEFT JOIN r USING (item_id) GROUP BY 1"""


def question_packs(spark: SparkSession, d: str) -> DataFrame:
    """The evidence packs of the held-out questions."""
    asked = questions(spark, d).withColumn("query_id", F.col("query_id").cast("string"))
    return search(index_of(spark, d), asked).select("query_id", "answerable", "confidence", "evidence_count", "docs_count", "used_tokens", "truncated", "omitted")


def ranked_pool(spark: SparkSession, d: str) -> DataFrame:
    """The reranked pools of the probe queries."""
    _, pool = search_pool(index_of(spark, d), probe(spark, d).select("query_id", "project_id", "text"))
    return pool.select("query_id", "chunk_id", "kind", "tier", "score", "rank", "graph_depth")


def packs(spark: SparkSession, d: str) -> DataFrame:
    """The evidence packs of the probe queries."""
    return search(index_of(spark, d), probe(spark, d).select("query_id", "project_id", "text"))


def vector_pool(spark: SparkSession, d: str) -> DataFrame:
    """The pools with the vector channel, chunks embedded once per distinct content."""
    index = index_of(spark, d)
    provider = vector.HashedTrigrams()
    vectors = vector.embed_distinct(index.chunks, "content", "content_hash", provider)
    index.chunk_vectors = index.chunks.select("project_id", F.col("id").alias("chunk_id"), "content_hash").join(vectors, "content_hash").drop("content_hash")
    _, pool = search_pool(index, probe(spark, d).select("query_id", "project_id", "text"), provider)
    return pool.select("query_id", "chunk_id", "tier", "score", "rank", F.col("channel_ranks")["vector"].alias("vector_rank"))


def call_chains(spark: SparkSession, d: str) -> DataFrame:
    heads = probe(spark, d).select("query_id", "project_id", F.col("symbol").alias("fqn"), F.lit(1).alias("pos"))
    return graph.flows(heads, _symbols(spark, d), _edges(spark, d)).select("query_id", F.array_join("fqns", " > ").alias("chain"), "truncated")


def joined_spans(spark: SparkSession, d: str) -> DataFrame:
    return merged_spans(_chunks(spark, d).select("project_id", "file_path", "start_line", "end_line"), ["project_id", "file_path"])


SPAN_SQL = f"""SELECT project_id, file_path, min(start_line) AS start_line, max(end_line) AS end_line, count(*) AS spans FROM (
SELECT *, sum(fresh) OVER (PARTITION BY project_id, file_path ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS g FROM (
SELECT *, CASE WHEN far IS NULL OR start_line - far - 1 > {{gap}} THEN 1 ELSE 0 END AS fresh FROM (
SELECT project_id, file_path, start_line, end_line, max(end_line) OVER (PARTITION BY project_id, file_path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM {CH}))) GROUP BY project_id, file_path, g"""


def open_spans(spark: SparkSession, d: str) -> DataFrame:
    spans = _chunks(spark, d).where("symbol_kind <> 'fallback_block'").select("project_id", "file_path", "start_line", "end_line")
    totals = _chunks(spark, d).groupBy("project_id", "file_path").agg(F.max("end_line").alias("total"))
    return uncovered_spans(spans, totals, ["project_id", "file_path"])


OPEN_SQL = f"""WITH c AS (SELECT * FROM {CH}), t AS (SELECT project_id, file_path, max(end_line) AS total FROM c GROUP BY ALL),
l AS (SELECT t.project_id, t.file_path, unnest(range(1, total + 1)) AS n FROM t),
o AS (SELECT l.* FROM l WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.project_id = l.project_id AND c.file_path = l.file_path AND c.symbol_kind <> 'fallback_block' AND l.n BETWEEN c.start_line AND c.end_line)),
g AS (SELECT *, n - row_number() OVER (PARTITION BY project_id, file_path ORDER BY n) AS k FROM o)
SELECT project_id, file_path, min(n)::INT AS first, max(n)::INT AS last FROM g GROUP BY project_id, file_path, k"""


def register(reg: Registry) -> None:
    reg.query("search_pool")(ranked_pool)
    reg.query("search_packs")(packs)
    reg.query("question_packs")(question_packs)
    reg.query("quality_by_category", _quality_sql())(question_quality)
    reg.query("question_hits", _bm25_sql().replace(PROBE, EVAL_PROBE))(question_hits)
    reg.query("search_vector_pool")(vector_pool)
    reg.query("call_flows")(call_chains)
    reg.query("merged_spans", SPAN_SQL.format(gap=10))(joined_spans)
    reg.query("uncovered_spans", OPEN_SQL)(open_spans)
    reg.query("bm25_topk", _bm25_sql())(bm25_topk)
    reg.query("bm25_indexed", _bm25_sql())(bm25_indexed)
    reg.query("literal_search", LITERAL_SQL)(literals)
    reg.query("symbol_literal_search", ROOT_SQL)(symbol_roots)
    reg.query("exact_symbols", EXACT_SQL)(exact_lookup)
    reg.query("recall_exact", EXACT_RECALL_SQL)(recall_exact)
    reg.query("covering_chunk", COVER_SQL)(covering)
    reg.query("container_members", MEMBER_SQL)(members)
    reg.query("edges_both_ways", BOTH_SQL)(both_ways)
    reg.query("unresolved_edges", f"SELECT edge_id FROM {ED} e WHERE kind IN ('calls', 'extends') AND NOT EXISTS (SELECT 1 FROM symbols s WHERE s.project_id = e.project_id AND s.fqn = e.target_name)")(dangling)
    reg.query(
        "unique_edges",
        "SELECT edge_id, project_id, source_fqn, target_name, kind, line FROM (SELECT *, row_number() OVER (PARTITION BY project_id, source_fqn, target_name, kind, coalesce(line, -1) ORDER BY edge_id) AS r FROM edges) WHERE r = 1",
    )(distinct_edges)
    reg.query("entry_points", f"SELECT project_id, id FROM {SY} s WHERE is_exported AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.project_id = s.project_id AND e.kind = 'calls' AND e.target_name = s.fqn)")(entry_symbols)
    reg.query(
        "reexport_sites",
        f"""SELECT DISTINCT s.project_id, {TAIL.format("s.fqn")} AS name, e.source_fqn AS path FROM {SY} s JOIN edges e ON e.project_id = s.project_id AND e.kind = 'imports' AND e.source_fqn LIKE '%\\_\\_init\\_\\_.py' ESCAPE '\\'
        AND {TAIL.format("e.target_name")} = {TAIL.format("s.fqn")} WHERE s.is_exported""",
    )(reexports)
    reg.query("resolve_matches", _resolve_sql() + "SELECT id AS ref_id, min(sid) AS symbol_id, count(*) AS found FROM f GROUP BY 1")(call_matches)
    reg.query(
        "resolve_pending",
        _resolve_sql()
        + """SELECT DISTINCT r.project_id, r.from_fqn AS source_fqn, f.fqn AS target_name, CASE r.kind WHEN 'call' THEN 'calls' WHEN 'import' THEN 'imports' WHEN 'inherit' THEN 'extends' WHEN 'implement' THEN 'implements' WHEN 'extends' THEN 'extends' ELSE 'references' END AS kind, r.line,
        CASE WHEN found = 1 THEN 'resolved' ELSE 'synthesized' END AS provenance FROM f JOIN r ON r.id = f.id""",
    )(pending_edges)
    reg.query("resolve_failed", _resolve_sql() + f"SELECT id, 'failed' AS status, {TAIL.format('name')} AS name_tail FROM r WHERE status = 'pending' AND id NOT IN (SELECT id FROM f)")(pending_failed)
    reg.query("retarget_edges", _retarget_sql())(retargeted)
    reg.query("cosine_top_k", NEAREST_SQL)(nearest)
    reg.query(
        "l2_normalize",
        "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) / list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS first FROM embeddings",
    )(normalised)
    reg.query("rrf_fuse", _fuse_sql())(fused)
