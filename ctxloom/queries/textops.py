"""Scalar functions over chunks, symbols, paths and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.functions import classify as C
from ctxloom.functions import text as X
from ctxloom.functions.querytext import query_parts
from ctxloom.queries import Registry
from ctxloom.queries.search import CH, SY, TAIL, probe
from ctxloom.sources.ignore import IgnoreRules, Layer, ignore_reason
from ctxloom.tables import load


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "chunks").dropDuplicates(["project_id", "id"])


def names(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "symbols").dropDuplicates(["project_id", "id"])
    return s.select("project_id", "id", X.name_tail(F.col("fqn")).alias("tail"), F.array_join(X.spellings(F.col("fqn")), "|").alias("spellings"), F.array_join(X.identifier_words(F.col("name")), " ").alias("words"), X.fqn_of_id(F.col("id")).alias("fqn_of_id"), X.edge_name(F.col("fqn"), 20).alias("short"))


NAMES_SQL = f"""SELECT project_id, id, {TAIL.format("fqn")} AS tail,
array_to_string(list_distinct_ordered, '|') AS spellings,
array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(regexp_replace(replace(name, '::', '.'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[_.]+'), lambda w: w <> ''))), ' ') AS words,
coalesce(regexp_extract(id, '^[^:]*:(.*):[^:]*$', 1), '') AS fqn_of_id, substr(regexp_replace(trim(fqn), '\\s+', ' ', 'g'), 1, 20) AS short
FROM (SELECT *, list_filter([fqn, CASE WHEN replace(fqn, '::', '.') <> fqn THEN replace(fqn, '::', '.') END, CASE WHEN replace(fqn, '.', '::') <> fqn THEN replace(fqn, '.', '::') END], lambda x: x IS NOT NULL) AS list_distinct_ordered FROM {SY})"""


def chunk_texts(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d)
    return c.select(
        "project_id", "id", X.estimate_tokens(F.col("content")).alias("tokens"), X.answer_tokens(F.col("content")).alias("answer_tokens"), F.md5(X.numbered_lines(F.col("content"), F.col("start_line"))).alias("numbered"),
        F.md5(X.segment(F.col("content"))).alias("segments"), F.size(X.terms(F.col("content"))).alias("terms"), F.length(X.embedding_text(F.col("signature"), F.col("docstring"), F.col("content"))).alias("embedding_chars"),
        F.md5(X.cut_answer(F.col("content"), 100, "...")).alias("cut"), F.md5(X.visible(F.col("content"))).alias("visible"),
    )


CHUNK_TEXT_SQL = f"""SELECT project_id, id, {X.ESTIMATE_SQL.format(t="content")} AS tokens, CASE WHEN length(content) = 0 THEN 0 ELSE greatest(1, (length(content) + 1) // 2) END AS answer_tokens,
md5(array_to_string(list_transform(string_split(content, chr(10)), lambda x, i: CAST(start_line + i - 1 AS VARCHAR) || ' | ' || x), chr(10))) AS numbered,
md5(array_to_string(regexp_extract_all(content, '[A-Za-z0-9]+|\\S'), ' ')) AS segments, len(regexp_extract_all(content, '[A-Za-z0-9]+|[\\x{{4E00}}-\\x{{9FFF}}]')) AS terms,
length(array_to_string(list_filter([coalesce(signature, ''), coalesce(docstring, ''), substr(CASE WHEN coalesce(signature, '') <> '' AND starts_with(content, signature) THEN substr(content, length(signature) + 1) ELSE content END, 1, 8000)], lambda p: trim(regexp_replace(p, '\\s', ' ', 'g')) <> ''), chr(10) || chr(10))) AS embedding_chars,
md5(CASE WHEN length(content) > 100 THEN substr(content, 1, 100) || '...' ELSE content END) AS cut, md5(regexp_replace(content, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) AS visible FROM {CH}"""


def chunk_hashes(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("project_id", "id", X.chunk_hash(F.col("content")).alias("hash"), (X.chunk_hash(F.col("content")) == F.col("content_hash")).alias("same"))


def blob_hashes(spark: SparkSession, d: str) -> DataFrame:
    b = load(spark, d, "blobs")
    return b.select("project_id", "path", X.file_hash(F.col("content")).alias("file_hash"), (X.blob_hash(F.col("path"), F.col("content")) == F.col("blob_hash")).alias("same"), F.octet_length("content").alias("bytes"), X.human_bytes(F.octet_length("content")).alias("size"), C.is_oversize(F.octet_length("content")).alias("oversize"))


def binary_files(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "blobs").select("project_id", "path", C.is_binary("content").alias("binary"))


def paths(spark: SparkSession, d: str) -> DataFrame:
    f = load(spark, d, "files").select("project_id", "path").distinct()
    p = F.col("path")
    return f.select("project_id", "path", C.is_test_path(p).alias("test"), C.doctype(p).alias("doctype"), C.language_of(p).alias("language"), C.is_generated_path(p).alias("generated"), C.is_safe_path(p).alias("safe"))


PATH_SQL = """SELECT DISTINCT project_id, path, regexp_matches(path, '(^|/)(tests?|testdata|fixtures)(/|$)') OR regexp_matches(path, '(^|/)(test_[^/]*|[^/]*_test)\\.[A-Za-z0-9]+$') AS test,
CASE WHEN b IN ('agents.md', 'claude.md', '.cursorrules', '.agent.md', 'handoff.md', 'skill.md') THEN 'agent-instructions' WHEN starts_with(b, 'readme') THEN 'readme' WHEN starts_with(b, 'architecture') OR contains('/' || path, '/docs/design/') THEN 'design'
 WHEN contains('/' || path, '/docs/adr/') THEN 'adr' WHEN starts_with(b, 'api') OR starts_with(b, 'protocol') OR starts_with(b, 'openapi') THEN 'api' WHEN starts_with(b, 'changelog') THEN 'changelog' ELSE 'guide' END AS doctype,
CASE WHEN e IN ('py', 'pyi') THEN 'python' WHEN e IN ('c', 'h') THEN 'c' WHEN e IN ('cc', 'cpp', 'cxx', 'c++', 'hpp', 'hh', 'hxx', 'h++', 'ipp', 'tpp') THEN 'cpp' WHEN e IN ('md', 'markdown', 'mdx') THEN 'markdown' END AS language,
contains(b, '_generated.') OR contains(b, 'autogen') OR regexp_matches(b, '(\\.pb\\.cc|\\.pb\\.h|\\.pb\\.cpp|\\.pb2\\.py|\\.designer\\.cs|\\.g\\.cs)$') AS generated,
NOT regexp_matches(path, '^/|\\\\|(^|/)(\\.{1,2})?(/|$)') AS safe
FROM (SELECT *, lower(string_split(path, '/')[-1]) AS b, regexp_extract(lower(path), '\\.([^./]+)$', 1) AS e FROM files)"""

RULES = IgnoreRules(Layer(["*.ini", "docs/", "!docs/adr/", "/tests/**/*.py", "!tests/index/*.py"]), Layer(["!*.ini", "deploy/*.json"]), ("skills/",))


def ignored(spark: SparkSession, d: str) -> DataFrame:
    f = load(spark, d, "files").select("project_id", "path").distinct()
    return f.select("project_id", "path", ignore_reason(F.col("path"), RULES).alias("reason")).where("reason is not null")


IGNORE_SQL = """SELECT DISTINCT project_id, path, CASE WHEN regexp_matches(path, '(^|/)(\\.git|\\.hg|\\.svn|\\.venv|venv|env|node_modules|__pycache__|\\.mypy_cache|\\.pytest_cache|\\.ruff_cache|\\.tox|\\.eggs|dist|build|target|\\.idea|\\.vscode|cmake-build-[^/]*|build-[^/]*|out|htmlcov|\\.cache|\\.gradle|\\.next|\\.nuxt|\\.turbo|\\.parcel-cache|__pypackages__)/') THEN 'builtin'
 WHEN regexp_matches(path, '(^|/)deploy/[^/]*\\.json$') AND regexp_matches(path, '^deploy/') THEN 'custom' WHEN contains('/' || path, '/docs/') OR (regexp_matches(path, '^tests/.*\\.py$') AND NOT regexp_matches(path, '^tests/index/[^/]*\\.py$')) THEN 'ignore' END AS reason
 FROM files WHERE reason IS NOT NULL"""


def file_flags(spark: SparkSession, d: str) -> DataFrame:
    """Languages with C headers lifted where the project holds C++."""
    f = load(spark, d, "files").select("project_id", "path").distinct()
    has = f.groupBy("project_id").agg(F.max(C.language_of(F.col("path")) == "cpp").alias("has_cpp"))
    lang = C.language_of(F.col("path"))
    return f.join(has, "project_id").select("project_id", "path", C.lift_headers(lang, F.col("path"), F.coalesce("has_cpp", F.lit(False))).alias("language"))


LIFT_SQL = """WITH p AS (SELECT DISTINCT project_id, path, regexp_extract(lower(path), '\\.([^./]+)$', 1) AS e FROM files),
h AS (SELECT project_id, bool_or(e IN ('cc', 'cpp', 'cxx', 'c++', 'hpp', 'hh', 'hxx', 'h++', 'ipp', 'tpp')) AS cpp FROM p GROUP BY 1)
SELECT p.project_id, path, CASE WHEN e IN ('py', 'pyi') THEN 'python' WHEN e = 'h' AND cpp THEN 'cpp' WHEN e IN ('c', 'h') THEN 'c' WHEN e IN ('cc', 'cpp', 'cxx', 'c++', 'hpp', 'hh', 'hxx', 'h++', 'ipp', 'tpp') THEN 'cpp' WHEN e IN ('md', 'markdown', 'mdx') THEN 'markdown' END AS language
FROM p JOIN h USING (project_id)"""


def banners(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d)
    return c.select("project_id", "id", C.has_banner(F.col("content")).alias("banner"), C.candidate_kind(F.col("file_path"), F.col("symbol_kind")).alias("kind"), F.lower("content").contains("@deprecat").alias("deprecated"))


BANNER_SQL = f"""SELECT project_id, id, len(list_filter(['do not edit', 'don''t edit', '@generated', 'auto-generated', 'autogenerated by', 'this file was generated', 'machine generated', 'code generated by', 'automatically generated'],
 lambda b: contains(lower(array_to_string(string_split(content, chr(10))[1:10], chr(10))), b))) > 0 AS banner,
CASE WHEN symbol_kind = 'spec_block' THEN 'spec' WHEN symbol_kind = 'fallback_block' THEN 'fallback' WHEN regexp_matches(file_path, '(^|/)(tests?|testdata|fixtures)(/|$)') OR regexp_matches(file_path, '(^|/)(test_[^/]*|[^/]*_test)\\.[A-Za-z0-9]+$') THEN 'test' ELSE 'code' END AS kind,
contains(lower(content), '@deprecat') AS deprecated FROM {CH}"""


def queries_read(spark: SparkSession, d: str) -> DataFrame:
    q = probe(spark, d).withColumn("p", query_parts("text"))
    return q.select("query_id", F.array_join("p.symbols", "|").alias("symbols"), F.array_join("p.inferred", "|").alias("inferred"), F.size("p.phrases").alias("phrases"), C.is_test_intent(F.col("text")).alias("test_intent"))


def shapes(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "edges").select(F.trim("target_name").alias("name")).distinct()
    return n.select("name", C.is_symbol_reference(F.col("name")).alias("symbol"), C.is_worth(F.col("name")).alias("worth"), X.mention(F.col("name")).alias("mention"))


SHAPE_SQL = """SELECT DISTINCT name, regexp_matches(name, '^[A-Za-z_~][\\w~]*((\\.|::|->)[A-Za-z_~][\\w~]*)*$') AND NOT regexp_matches(name, '\\.(h|hh|hpp|hxx|c|cc|cpp|cxx|py|md)$') AS symbol,
length(name) >= 6 AND (regexp_matches(name, '[-=/:.]') OR (upper(name) = name AND regexp_matches(name, '[A-Z]')) OR regexp_matches(name, '^[0-9]+$')) AS worth,
CASE WHEN contains(m, '/') OR m = '' THEN NULL ELSE m END AS mention FROM (SELECT trim(target_name) AS name, trim(regexp_replace(replace(trim(target_name), '`', ''), '\\(.*\\)$', '')) AS m FROM edges)"""


def hints(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "edges").where("kind = 'imports'").select("file_path", F.trim("target_name").alias("name")).distinct()
    return e.select("file_path", "name", F.array_join(X.import_hints(F.col("file_path"), F.col("name")), "|").alias("hints"))


#: Files an imported name may live in, as a list; ``{f}`` is the importing file, ``{n}`` the name.
HINTS_EXPR = """list_filter([m || '.py', m || '/__init__.py', CASE WHEN regexp_replace(m, '/?[^/]*$', '') <> '' THEN regexp_replace(m, '/?[^/]*$', '') || '.py' END, CASE WHEN regexp_replace(m, '/?[^/]*$', '') <> '' THEN regexp_replace(m, '/?[^/]*$', '') || '/__init__.py' END], lambda h: h IS NOT NULL)"""
MODULE_EXPR = """CASE WHEN dots > 0 AND base <> '' THEN base || '/' || rest ELSE rest END"""
PARTS_EXPR = """length(regexp_extract(name, '^(\\.*)', 1)) AS dots, replace(regexp_replace(name, '^\\.+', ''), '.', '/') AS rest, array_to_string(string_split(file_path, '/')[1:greatest(len(string_split(file_path, '/')) - greatest(length(regexp_extract(name, '^(\\.*)', 1)), 1), 0)], '/') AS base"""
HINT_SQL = f"""SELECT file_path, name, array_to_string({HINTS_EXPR}, '|') AS hints FROM (SELECT *, {MODULE_EXPR} AS m FROM (SELECT *, {PARTS_EXPR} FROM (SELECT DISTINCT file_path, trim(target_name) AS name FROM edges WHERE kind = 'imports')))"""


def byte_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut to 100 bytes between characters, and their redacted heads."""
    t = load(spark, d, "documents")
    return t.select("doc_id", F.octet_length(X.cut_bytes(F.col("text"), 100)).alias("bytes"), F.md5(X.newlines(F.col("text"))).alias("lines"), F.size(X.noise_free(F.split(X.segment(F.col("text")), " "))).alias("words"))


BYTE_SQL = """SELECT doc_id, (SELECT max(CASE WHEN strlen(substr(text, 1, k)) <= 100 THEN strlen(substr(text, 1, k)) END) FROM range(0, 101) r(k)) AS bytes, md5(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g')) AS lines,
len(list_filter(regexp_extract_all(text, '[A-Za-z0-9]+|\\S'), lambda t: regexp_matches(t, '[\\p{L}\\p{N}]'))) AS words FROM documents WHERE text IS NOT NULL
UNION ALL SELECT doc_id, NULL, NULL, NULL FROM documents WHERE text IS NULL"""


def redactions(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d)
    return c.select("project_id", "id", F.md5(X.redact(F.col("content"))).alias("redacted"))


def register(reg: Registry) -> None:
    reg.query("symbol_names", NAMES_SQL)(names)
    reg.query("chunk_texts", CHUNK_TEXT_SQL)(chunk_texts)
    reg.query("chunk_hashes", f"SELECT project_id, id, sha256(regexp_replace(content, chr(13) || chr(10) || '?', chr(10), 'g')) AS hash, sha256(regexp_replace(content, chr(13) || chr(10) || '?', chr(10), 'g')) = content_hash AS same FROM {CH}")(chunk_hashes)
    reg.query(
        "blob_hashes",
        "SELECT project_id, path, sha256(content) AS file_hash, sha256(encode(path) || '\\x00'::BLOB || content) = blob_hash AS same, octet_length(content) AS bytes, CASE WHEN octet_length(content) < 1024 THEN printf('%d B', octet_length(content)) ELSE printf('%.1f KB', round(octet_length(content) / 1024.0, 1)) END AS size, octet_length(content) > 131072 AS oversize FROM blobs",
    )(blob_hashes)
    reg.query("binary_files")(binary_files)
    reg.query("path_classes", PATH_SQL)(paths)
    reg.query("ignored_paths", IGNORE_SQL)(ignored)
    reg.query("lifted_languages", LIFT_SQL)(file_flags)
    reg.query("chunk_classes", BANNER_SQL)(banners)
    reg.query("query_parts")(queries_read)
    reg.query("name_shapes", SHAPE_SQL)(shapes)
    reg.query("import_hints", HINT_SQL)(hints)
    reg.query("document_texts", BYTE_SQL)(byte_cuts)
    masked = "content"
    for pattern, mask in X.redact_patterns():
        masked = f"regexp_replace({masked}, '{pattern.replace(chr(39), chr(39) * 2)}', '{mask.replace('{', chr(92)).replace('}', '')}', 'g')"
    reg.query("redacted_chunks", f"SELECT project_id, id, md5({masked}) AS redacted FROM {CH}")(redactions)
