"""The engine end to end, uploads as a stream, sources and stores, usage."""

import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ctxloom.engine import ContextEngine
from ctxloom.operators import store, usage
from ctxloom.operators.pack import render
from ctxloom.sources import repo
from ctxloom.sources.ignore import IgnoreRules, Layer
from ctxloom.streaming.ingest import UPLOADS, ingest_stream, read_uploads

FILES = {"a.py": "from b import helper\n\nclass Foo:\n    def run(self, n):\n        return helper(n)\n", "b.py": "def helper(n):\n    return n\n", "docs/readme.md": "# Title\n\nUses `helper`.\n", "skip.log": "x"}


@pytest.fixture
def project(tmp_path):
    for p, t in FILES.items():
        f = tmp_path / "src" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(t)
    (tmp_path / "src" / "bin.dat").write_bytes(b"\0\1")
    (tmp_path / "src" / ".git").mkdir()
    (tmp_path / "src" / ".git" / "config").write_text("x")
    return tmp_path


def test_ingest_search_and_change(spark, project):
    e = ContextEngine(spark, f"file://{project}/idx")
    rules = IgnoreRules(Layer(["*.log"]))
    r = e.ingest_repo("p", str(project / "src"), rules)
    assert (r.added, r.modified, r.deleted) == (3, 0, 0) and r.skipped == ["bin.dat:binary"] and r.embedded > 0
    again = e.ingest_repo("p", str(project / "src"), rules)
    assert (again.added, again.modified, again.deleted) == (0, 0, 0)
    q = spark.createDataFrame([("1", "p", "What does `Foo.run` call?")], "query_id string, project_id string, text string")
    row = e.search(q).first()
    assert row.answerable and row.confidence in ("high", "low", "medium")
    text = render(json.loads(row.pack))
    assert "a.py" in text and "helper" in text
    assert e.ask(q)[0]["status"] == "degraded" and e.ask(q, lambda p: "It calls helper [E1].")[0]["status"] == "answered"
    (project / "src" / "b.py").write_text("def helper(n):\n    return 2 * n\n")
    (project / "src" / "a.py").unlink()
    r = e.ingest_repo("p", str(project / "src"), rules)
    assert (r.added, r.modified, r.deleted) == (0, 1, 1) and r.embedded == 1
    s = e.status("p")
    assert s["state"] == "ready" and s["files"] == 2 and s["spec_refs"] == 1
    assert e.list_projects() == ["p"]
    e.delete_project("p")
    assert e.list_projects() == [] and e.status("p") == {"state": "missing"}
    with pytest.raises(LookupError):
        e.search(q)


def upload(path, text, deleted=False, bad=False):
    data = text.encode()
    return ("p", path, bytearray(data), "0" if bad else hashlib.sha256(path.encode() + b"\0" + data).hexdigest(), deleted)


def test_stream_of_uploads(spark, tmp_path):
    e = ContextEngine(spark, f"file://{tmp_path}/idx")
    box = str(tmp_path / "in")

    def send(*rows):
        spark.createDataFrame(list(rows), UPLOADS).coalesce(1).write.mode("append").parquet(box)
        q = ingest_stream(e, read_uploads(spark, box), str(tmp_path / "ckpt"))
        q.awaitTermination()

    send(upload("a.py", "def f():\n    return 1\n"), upload("../x.py", "x"), upload("bad.py", "x", bad=True))
    assert e.status("p")["files"] == 1
    send(upload("b.py", "def g():\n    return f()\n"), upload("a.py", "", True))
    assert [r.path for r in e._read("p", "files").collect()] == ["b.py"]


def test_scan_plan_and_sources(spark, project):
    got = {r.path: (r.skip_reason, r.content is None) for r in repo.scan_directory(spark, str(project / "src"), IgnoreRules(Layer(["*.log"])), max_bytes=60).collect()}
    assert got["bin.dat"] == ("binary", True) and got["a.py"][0].startswith("oversize:") and got["b.py"] == (None, False) and ".git/config" not in got
    assert [p for p, _ in repo.list_paths(str(project / "src"), IgnoreRules(Layer(["*.log"])))] == ["a.py", "b.py", "bin.dat", "docs/readme.md"]
    now = spark.createDataFrame([("p", "a", "1"), ("p", "b", "2"), ("p", "c", "3")], "project_id string, path string, content_hash string")
    was = spark.createDataFrame([("p", "b", "2"), ("p", "c", "0"), ("p", "d", "4")], "project_id string, path string, content_hash string")
    assert sorted((r.path, r.change) for r in repo.plan_scan(now, was).collect()) == [("a", "added"), ("c", "modified"), ("d", "deleted")]


def test_golden_requests_and_ledgers(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "x.jsonl").write_text('{"id":"1","query":"q","expected":[{"path":"a","symbol":null}]}\n{"id":"","query":"q"}\nnot json\n{"id":"2","query":"q","expected":[{"symbol":"s"}]}\n')
    cases, bad = repo.load_golden(spark, str(tmp_path / "g"))
    assert [(c.id, c.lang) for c in cases.collect()] == [("1", "unknown")] and bad.count() == 3
    (tmp_path / "log.jsonl").write_text('{"ts":1,"request_id":"r","user_id":"u"}\noops\n{"ts":2,"request_id":"r","user_id":"v"}\n')
    log = repo.read_requests(spark, str(tmp_path / "log.jsonl"))
    assert [r.ts for r in log.collect()] == [2, 1] and repo.requests_of(log, "r", "u").count() == 1
    led = spark.createDataFrame([("p", '{"files":{"a":{"blob_hash":"h","size":3},"b":{"size":1}}}'), ("q", "broken")], "project_id string, value string")
    assert [(r.path, r.size) for r in repo.read_ledger(led).collect()] == [("a", 3)]


def test_uploads_checkpoints_and_blobs(spark):
    good = b"hi"
    h = hashlib.sha256(b"a\0hi").hexdigest()
    up = spark.createDataFrame([(1, 1, "a", h, base64.b64encode(good).decode()), (1, 2, "/x", "0", base64.b64encode(b"z").decode()), (1, 3, "b", "0", base64.b64encode(b"z").decode()), (1, 4, "c", "0", "%%%"), (2, 1, "a", h, base64.b64encode(b"x" * 50).decode())], "batch int, position int, path string, blob_hash string, content_b64 string")
    assert [r.error for r in repo.check_uploads(up, 40).orderBy("batch", "position").collect()] == [None, "path", "hash", "encoding", "batch_size"]
    blobs = spark.createDataFrame([("h1", bytearray(b"a")), ("h1", bytearray(b"a")), ("h2", bytearray(b"bb"))], "blob_hash string, content binary")
    assert tuple(repo.store_usage(blobs).first()) == (2, 3)
    led = spark.createDataFrame([("p", "a", "h1"), ("p", "b", "h1")], "project_id string, path string, blob_hash string")
    assert [r.blob_hash for r in repo.unreferenced(blobs, led).collect()] == ["h2"] and repo.blob_source(led, blobs).count() == 2
    assert repo.checkpoints(led).first().checkpoint_id == "cp_" + hashlib.sha256(b"h1").hexdigest()[:16]
    assert repo.put_blobs(blobs, blobs).count() == 0
    ids = repo.identify(spark.createDataFrame([("https://x/y.git", "", "main", "/r"), ("https://X/y", "", "main", "/s"), (None, None, None, "/r")], "remote string, relative string, branch string, root string")).collect()
    assert ids[0].project_id == ids[1].project_id != ids[2].project_id


def test_stores(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    s = spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    assert sorted(map(tuple, store.upsert(t, s, ["k"]).collect())) == [("a", 1), ("b", 9), ("c", 3)]
    assert sorted(map(tuple, store.insert_new(t, s, ["k"]).collect())) == [("a", 1), ("b", 2), ("c", 3)]
    assert store.keep_newest(t.unionByName(s), ["k"], [F.desc("v")], 1).where("k = 'b'").first().v == 9
    assert store.latest_config(spark.createDataFrame([("k", "x", 1), ("k", "y", 2)], "key string, value string, version int")).first().value == "y"
    assert store.invalidation({}, {"parser_hash": "a"}) == "none" and store.invalidation({"parser_hash": "b"}, {"parser_hash": "a"}) == "full_reparse" and store.invalidation({"parser_hash": "a", "model": "m"}, {"parser_hash": "a", "model": "n"}) == "reembed"
    with pytest.raises(Exception):
        store.check_vectors(spark.createDataFrame([([1.0],)], "vector array<float>"), 2).collect()


def test_usage(spark):
    a = spark.createDataFrame([(i, "p", "q" if i % 2 else "r", 1 if i < 5 else None, 1 if i >= 5 else 0, None, i * 10, 1, 0.5, 1000) for i in range(10)], "id int, project_id string, query string, answerable int, degraded int, confidence string, latency_ms int, used_tokens int, citation_coverage double, created_at long")
    r = usage.usage_summary(a, 1000).first()
    assert (r.total, r.succeeded, r.failed, r.avg_latency_ms, r.p95_latency_ms, r.used_tokens, r.citation_coverage_avg) == (10, 5, 5, 45, 90, 10, 0.5)
    assert usage.usage_summary(a, 10**9).first().total == 0
    assert [tuple(x) for x in usage.top_queries(a).collect()] == [("q", 5), ("r", 5)] and usage.confidence_counts(a).first().confidence == "unknown"
    n = spark.createDataFrame([([5, 1, 3, 2, 4],), ([],)], "v array<int>").select(usage.nearest_rank(F.col("v"), 0.5).alias("p")).collect()
    assert [x.p for x in n] == [2, None]
    q = usage.quota_status(spark.createDataFrame([("u", "a", 90), ("u", "b", 5), ("v", "c", 1)], "user_id string, project_id string, bytes long"), 100, 94).collect()
    assert {(x.project_id, x.status) for x in q} == {("a", "exceeded"), ("b", "exceeded"), ("c", "ok")}


def test_quality(spark):
    ev = spark.createDataFrame([(1, 1, "a.py", "X", "c"), (1, 2, "b.py", "A.run", ""), (2, 7, "z.py", "q", "see foo_bar here"), (3, 1, "n.py", "q", "foo_barx")], "case_id int, rank int, path string, symbol string, content string")
    ex = spark.createDataFrame([(1, "b.py", "run"), (2, "z.py", "foo_bar"), (3, "n.py", "foo_bar")], "case_id int, path string, symbol string")
    hits = usage.first_hits(ev, ex)
    assert sorted(map(tuple, hits.collect())) == [(1, 2), (2, 7)]
    m = usage.metrics(ex.select("case_id"), hits).first()
    assert m.recall_at_5 == pytest.approx(1 / 3) and m.recall_at_10 == pytest.approx(2 / 3) and m.mrr == pytest.approx((0.5 + 1 / 7) / 3)
    assert usage.negatives_passed(spark.createDataFrame([(1, False, 1), (2, True, 1)], "case_id int, answerable boolean, gaps int")).where("passed").count() == 1
    assert "| 3 |" in usage.report([m], "t")


def test_includes_retries_and_golden_cases(spark, tmp_path):
    from ctxloom.plans.evaluate import quality, run_golden
    from ctxloom.streaming.ingest import ORDERED

    e = ContextEngine(spark, f"file://{tmp_path}/idx")
    files = {"src/a.c": '#include "../inc/x.h"\n#include "y.h"\nint run(void) { return late(); }\n', "inc/x.h": "int f(void);\n", "lib/y.h": "#define Y 1\n", "u.py": "def use(o):\n    return getattr(o, 'later')\n"}
    table = lambda rows: spark.createDataFrame([("p", p, bytearray(t.encode())) for p, t in rows.items()], "project_id string, path string, content binary")
    e.apply_changes("p", table(files))
    edges = {(r.source_fqn, r.target_name) for r in e._read("p", "edges").collect()}
    assert {("src/a.c", "inc/x.h"), ("src/a.c", "lib/y.h")} <= edges
    assert [r.name for r in e._read("p", "unresolved").collect()] == ["later"]
    e.apply_changes("p", table({"v.py": "def later(n):\n    return n\n"}))
    assert e._read("p", "unresolved").count() == 0 and ("use", "later") in {(r.source_fqn, r.target_name) for r in e._read("p", "edges").collect()}
    golden = "id string, query string, category string, expected array<struct<path:string,symbol:string>>"
    cases = spark.createDataFrame([("1", "What does `later` do?", "symbol", [("v.py", "later")]), ("2", "Where is `later`?", "symbol", [("none.py", None)]), ("3", "zzzz qqqq", "none", [])], golden)
    results = run_golden(e.index(["p"]), cases, "p").cache()
    got = {r.case_id: r for r in results.collect()}
    assert got["1"].rank == 1 and got["2"].rank is None and got["2"].passed is None and got["3"].passed is True
    m = quality(results).first()
    assert (m.cases, m.recall_at_5, m.mrr) == (2, 0.5, 0.5)
    assert ORDERED.fieldNames()[-1] == "seq"


def test_last_upload_counts(spark, tmp_path):
    from ctxloom.streaming.ingest import ORDERED

    e, box = ContextEngine(spark, f"file://{tmp_path}/idx"), str(tmp_path / "box")
    rows = [(*upload("a.py", f"def f{k}(): pass\n"), k) for k in (3, 1, 2)] + [(*upload("b.py", "x = 1\n"), 1), ("p", "b.py", None, None, True, 2), ("q", *upload("c.py", "y = 1\n")[1:], None)]
    spark.createDataFrame(rows, ORDERED).coalesce(1).write.parquet(box)
    ingest_stream(e, read_uploads(spark, box), str(tmp_path / "ckpt")).awaitTermination()
    assert [r.fqn for r in e._read("p", "symbols").collect()] == ["f3"] and e.status("p")["files"] == 1 and e.status("q")["files"] == 1


def test_ignored_folders_are_looked_through_for_allowed_names(tmp_path):
    for p in ("a.py", ".claude/skills/x.md", ".claude/other.txt", "env/skills/y.md", "deep/1/2/agents.md", "cmake-build-x/z.c"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
    rules = IgnoreRules(Layer([".claude/", "deep/"]))
    assert [p for p, _ in repo.list_paths(str(tmp_path), rules)] == [".claude/skills/x.md", "a.py"]
