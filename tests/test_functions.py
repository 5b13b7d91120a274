"""Scalar functions, classification, query reading, ignore rules."""

import pytest
from pyspark.sql import functions as F

from ctxloom.functions import classify as C
from ctxloom.functions import text as X
from ctxloom.functions.querytext import query_parts, read_query
from ctxloom.sources.ignore import IgnoreRules, Layer, glob_regex, ignore_reason


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text,n", [("", 0), (None, 0), ("a", 1), ("abcd", 1), ("abcde", 2), ("中文字", 2), ("中a", 1), ("中文字符" * 3 + "abcd", 9), ("x" * 4001, 1001)])
def test_token_estimate(spark, text, n):
    assert one(spark, text, X.estimate_tokens) == n


@pytest.mark.parametrize("fqn,tail", [("a.b.c", "c"), ("A::b", "b"), ("x", "x"), ("A::b.c", "c")])
def test_tail(spark, fqn, tail):
    assert one(spark, fqn, X.name_tail) == tail


def test_names_and_words(spark):
    assert one(spark, "A::b", X.spellings) == ["A::b", "A.b"]
    assert one(spark, "getHTTPName_of.x", X.identifier_words) == ["get", "httpname", "of", "x"]
    assert one(spark, "p/a.py:A.b:12", X.fqn_of_id) == "A.b"
    assert one(spark, "`foo(a, b)`", X.mention) == "foo" and one(spark, "a/b.py", X.mention) is None
    assert one(spark, "a\r\nb\rc", X.newlines) == "a\nb\nc"


def test_numbered_lines_and_cuts(spark):
    assert one(spark, "a\nb", lambda c: X.numbered_lines(c, F.lit(7))) == "7 | a\n8 | b"
    assert one(spark, "aé中", lambda c: X.cut_bytes(c, 4)) == "aé" and one(spark, "ab", lambda c: X.cut_bytes(c, 9)) == "ab"
    assert one(spark, "x" * 30, lambda c: X.cut_answer(c, 10, "!")) == "x" * 10 + "!" and one(spark, None, X.cut_answer) is None
    assert one(spark, "a\x00b\tc", X.visible) == "ab\tc"
    assert one(spark, 2048, X.human_bytes, "long") == "2.0 KB"


def test_hashes(spark):
    import hashlib

    df = spark.createDataFrame([("p/a", bytearray(b"x\r\ny"), "x\r\ny")], "p string, b binary, t string")
    r = df.select(X.blob_hash(F.col("p"), F.col("b")).alias("b"), X.file_hash(F.col("b")).alias("f"), X.chunk_hash(F.col("t")).alias("c")).first()
    assert r.b == hashlib.sha256(b"p/a\0x\r\ny").hexdigest() and r.f == hashlib.sha256(b"x\r\ny").hexdigest() and r.c == hashlib.sha256(b"x\ny").hexdigest()


def test_vectors(spark):
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [[round(x, 9) for x in r.n] for r in v.select(X.l2_normalize(F.col("v")).alias("n")).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    got = [r.d for r in v.select(F.round(X.dot(X.l2_normalize(F.col("v")), X.l2_normalize(F.col("v"))), 9).alias("d")).collect()]
    assert got == [1.0, 0.0]


def test_import_hints(spark):
    df = spark.createDataFrame([("a/b/c.py", "..m.n"), ("a/c.py", "pkg.mod.f")], "f string, n string")
    hints = [r.h for r in df.select(X.import_hints(F.col("f"), F.col("n")).alias("h")).collect()]
    assert "a/m.py" in hints[0] and "pkg/mod.py" in hints[1] and "pkg/mod/f.py" in hints[1]


@pytest.mark.parametrize("path,test,doc,lang", [("tests/a.py", True, "guide", "python"), ("src/test_x.c", True, "guide", "c"), ("docs/adr/1.md", False, "adr", "markdown"), ("README.md", False, "readme", "markdown"), ("a/contest.hpp", False, "guide", "cpp"), ("x.unknown", False, "guide", None), ("docs/design/z.md", False, "design", "markdown")])
def test_paths(spark, path, test, doc, lang):
    r = spark.createDataFrame([(path,)], "p string").select(C.is_test_path(F.col("p")).alias("t"), C.doctype(F.col("p")).alias("d"), C.language_of(F.col("p")).alias("l")).first()
    assert (r.t, r.d, r.l) == (test, doc, lang)


def test_binary_generated_safe(spark):
    df = spark.createDataFrame([(bytearray(b"a\0b"),), (bytearray(b"text\n"),), (bytearray(b"\x01" * 5 + b"a" * 5),), (None,)], "b binary")
    assert [r.x for r in df.select(C.is_binary("b").alias("x")).collect()] == [True, False, True, False]
    assert one(spark, "// Code generated by x. DO NOT EDIT.\nint a;", C.has_banner) is True
    assert one(spark, "\n" * 12 + "do not edit", C.has_banner) is False
    assert [one(spark, p, C.is_safe_path) for p in ("a/b", "/a", "a/../b", "a//b", "a\\b")] == [True, False, False, False, False]


def test_reading_queries(spark):
    r = read_query("Does `Foo::bar` in src/a.py call api.get_x, make_thing, MAX_SIZE or key=VALUE-1? documentation")
    assert r["symbols"] == ["Foo::bar", "api.get_x"] and r["paths"] == ["src/a.py"] and r["inferred"] == ["make_thing", "MAX_SIZE"]
    assert {"text": "key=VALUE-1", "strong": True} in r["phrases"] and len(r["phrases"]) <= 6
    assert read_query(None) == {"symbols": [], "paths": [], "inferred": [], "phrases": []}
    df = spark.createDataFrame([("`a_b`",), (None,)], "t string").select(query_parts("t").alias("p"))
    assert [r.p.symbols for r in df.collect()] == [["a_b"], []]


@pytest.mark.parametrize(
    "lines,path,ignored",
    [
        (["*.log"], "a/b.log", True), (["/x"], "a/x", False), (["/x"], "x/y", True), (["d/"], "d", False), (["d/"], "a/d/f", True), (["*.py", "!keep.py"], "keep.py", False),
        (["out/", "!out/keep.py"], "out/keep.py", True), (["a/**/z"], "a/z", True), (["a/**/z"], "a/b/c/z", True), (["f?o"], "fxo", True), (["[!a]x"], "bx", True), (["# c", ""], "c", False), (["\\#x"], "#x", True),
    ],
)
def test_ignore_layer(lines, path, ignored):
    assert Layer(lines).decide(path) is ignored


def test_ignore_reasons(spark):
    rules = IgnoreRules(Layer(["*.log", "skills/"]), Layer(["!keep.log", "secret"]), ("skills/",))
    paths = {".git/config": "builtin", "a.log": "ignore", "keep.log": None, "secret": "custom", "skills/x.md": None, "src/a.py": None, "node_modules/skills/a": "builtin"}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.r for r in df.select("p", ignore_reason(F.col("p"), rules).alias("r")).collect()} == paths
    assert glob_regex("a*b") == "a[^/]*b"
