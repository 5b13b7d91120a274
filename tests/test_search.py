"""Lexical, vector and symbol search, fusion, graph, resolution, packing, answers."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxloom.operators import fusion, graph, lexical, pack, resolve, vector

CHUNKS = "project_id string, id string, file_path string, symbol_fqn string, symbol_kind string, start_line int, end_line int, signature string, docstring string, content string, content_hash string"
SYMBOLS = "project_id string, id string, name string, fqn string, kind string, chunk_id string, file_path string, start_line int, end_line int, is_exported boolean"
EDGES = "edge_id long, project_id string, file_path string, source_fqn string, target_name string, kind string, line int, provenance string"


def chunk(i, content, fqn=None, path="a.py", kind="function", start=1, end=9, signature=None, docstring=None, project="p"):
    return (project, i, path, fqn or i, kind, start, end, signature, docstring, content, "h" + i)


def symbol(i, fqn, chunk_id=None, path="a.py", line=1, exported=True, kind="function", project="p"):
    return (project, i, re.split(r"[.:]", fqn)[-1], fqn, kind, chunk_id, path, line, line + 3, exported)


def brute_bm25(docs, query):
    def toks(t):
        return [x.lower() for x in re.findall(r"[A-Za-z0-9]+", t or "")]

    bags = {i: [(t, 1) for t in toks(c)] + [(t, 5) for t in toks(s)] + [(t, 1) for t in toks(d)] for i, c, s, d in docs}
    mean = sum(map(len, bags.values())) / len(bags)
    out = {}
    for t in toks(query):
        df = sum(any(x == t for x, _ in b) for b in bags.values())
        if not df:
            continue
        idf = math.log((len(bags) - df + 0.5) / (df + 0.5))
        idf = idf if idf > 0 else 1e-6
        for i, b in bags.items():
            f = sum(w for x, w in b if x == t)
            if f:
                out[i] = out.get(i, 0) + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(b) / mean))
    return out


def test_bm25_equals_brute_force(spark):
    rnd = random.Random(4)
    words = "red green blue map key load store tree".split()
    docs = [(f"c{i:02}", " ".join(rnd.choices(words, k=rnd.randint(0, 12))), rnd.choice([None, "load tree", "key"]), rnd.choice([None, "blue"])) for i in range(40)]
    chunks = spark.createDataFrame([chunk(i, c, signature=s, docstring=d) for i, c, s, d in docs], CHUNKS)
    text = "Load the `key` tree tree::blue?"
    q = spark.createDataFrame([("q", "p", text), ("other", "zz", text), ("null", "p", None)], "query_id string, project_id string, text string")
    got = {r.chunk_id: r.score for r in lexical.bm25(chunks, q).collect()}
    want = brute_bm25(docs, "Load the key tree tree blue")
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    kept = {r.chunk_id: r.score for r in lexical.bm25(chunks, q, index=lexical.inverted_index(chunks)).collect()}
    assert kept == got
    both = {r.chunk_id for r in lexical.bm25(chunks, q.limit(1).withColumn("text", F.lit("load blue")), operator="and").collect()}
    bag = {i: set(f"{c} {s or ''} {d or ''}".split()) for i, c, s, d in docs}
    assert both == {i for i, b in bag.items() if {"load", "blue"} <= b}


def test_literals(spark):
    chunks = spark.createDataFrame([chunk("a", "x-y x-Y and x-y-z", end=4), chunk("b", "x-y here", fqn="X-Y_fn", end=9), chunk("c", "none", end=2)], CHUNKS)
    ph = spark.createDataFrame([("q", "p", "x-Y-"), ("q", "p", "x-y"), ("r", "p", "and x")], "query_id string, project_id string, phrase string")
    got = sorted((r.query_id, r.phrase, r.chunk_id, r.hits, r["rank"]) for r in lexical.literal_search(chunks, ph).collect())
    assert got == [("q", "x-Y-", "a", 1, 1), ("r", "and x", "a", 1, 1)]  # phrases of three characters find nothing
    syms = spark.createDataFrame([symbol("s1", "LongCapability", "a"), symbol("s2", "Capability", "b"), symbol("s3", "Capability", None)], SYMBOLS)
    ph2 = spark.createDataFrame([("q", "p", "capability")], "query_id string, project_id string, phrase string")
    assert [(r.chunk_id, r["rank"]) for r in lexical.symbol_literal_search(syms, ph2).orderBy("rank").collect()] == [("b", 1), ("a", 2)]


def test_exact_lookup_and_recall(spark):
    syms = spark.createDataFrame([symbol("1", "A::b", "c1", "z.cc"), symbol("2", "b", "c2", "a.py", exported=False), symbol("3", "b", "c3", "b.py")], SYMBOLS)
    tok = spark.createDataFrame([("q", "p", "b"), ("q", "p", "A::b"), ("q", "x", "b")], "query_id string, project_id string, token string")
    got = [(r.token, r.id) for r in lexical.exact_symbols(syms, tok).orderBy("token", "order").collect()]
    assert got == [("A::b", "1"), ("b", "3"), ("b", "1"), ("b", "2")]
    names = spark.createDataFrame([("q", "p", "A.b", 0), ("q", "p", "b", 1)], "query_id string, project_id string, name string, pos int")
    r = [(x.chunk_id, x["rank"], x.reason) for x in lexical.recall_symbols(syms, names, "exact", 0, 20).orderBy("rank").collect()]
    assert r == [("c1", 1, "explicit symbol A::b"), ("c3", 2, "explicit symbol b"), ("c2", 3, "explicit symbol b")]


def test_fusion_order_and_reasons(spark):
    c = [("q", "p", "a", "bm25", 1, 1, "x"), ("q", "p", "b", "exact", 1, 0, "e"), ("q", "p", "b", "bm25", 3, 1, "y"), ("q", "p", "c", "exact", 2, 0, None), ("q", "p", "a", "bm25", 5, 1, "later")]
    pool = fusion.fuse(spark.createDataFrame(c, "query_id string, project_id string, chunk_id string, channel string, rank int, tier int, reason string")).orderBy("pool_rank").collect()
    assert [p.chunk_id for p in pool] == ["b", "a", "c"]
    assert abs(pool[0].rrf_score - (1 / 61 + 1 / 63)) < 1e-9 and pool[0].tier == 0 and pool[0].channel_ranks == {"exact": 1, "bm25": 3}
    assert pool[0].reasons == ["e", "exact rank 1", "y", "bm25 rank 3"] and pool[2].reasons == ["exact rank 2"]
    assert fusion.weights_from({"CTXLOOM_W_LITERAL": "3", "CTXLOOM_W_LITERAL_ROOT": "x"})["literal hit"] == 3.0


def test_rerank_features(spark):
    chunks = spark.createDataFrame([chunk("a", "@deprecated", "f"), chunk("a2", "x", "f", start=20), chunk("t", "x", "g", "tests/t.py"), chunk("s", "x", "T", "docs/design/x.md", "spec_block"), chunk("g", "x", "h", "gen.pb.cc")], CHUNKS)
    syms = spark.createDataFrame([symbol("1", "h", "g"), symbol("2", "f", "a", exported=False)], SYMBOLS)
    files = spark.createDataFrame([("p", "a.py", False)], "project_id string, path string, generated boolean")
    rows = [("q", "p", i, ch, r, 0, None) for i, ch, r in (("a", "exact", 1), ("a2", "bm25", 2), ("t", "bm25", 3), ("s", "vector", 9), ("g", "vector", 1), ("g", "bm25", 4))]
    pool = fusion.enrich(fusion.fuse(spark.createDataFrame(rows, "query_id string, project_id string, chunk_id string, channel string, rank int, tier int, reason string")), chunks)
    q = spark.createDataFrame([("q", "p", "what is f", ["f"], ["gen.pb.cc"])], "query_id string, project_id string, text string, symbols array<string>, paths array<string>")
    out = {r.chunk_id: r for r in fusion.rerank(fusion.signals(fusion.promote_paths(pool, q), q, chunks, syms, files)).collect()}
    base = {k: r.rrf_score * 25 for k, r in out.items()}
    assert out["a"].score - base["a"] == pytest.approx(2.0 + 1.0 - 0.35) and out["a2"].score - base["a2"] == pytest.approx(1.0 - 0.35)
    assert out["t"].score - base["t"] == pytest.approx(-1.5) and out["s"].score - base["s"] == pytest.approx(0.7 + 0.8)
    assert out["g"].tier == 0 and out["g"].score - base["g"] == pytest.approx(2.0 + 1.5 + 0.2 - 1.0)
    assert out["g"]["rank"] == 1 and out["a"]["rank"] == 2 and "deprecated symbol -0.3" in " ".join(out["a"].reasons)


def test_cosine_in_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8)).astype(np.float32)
    m[7] = 0
    m[9] = m[8]
    df = spark.createDataFrame([(i, "s" if i % 2 else "t", v.tolist()) for i, v in enumerate(m)] + [(99, "s", None)], "id long, s string, vector array<float>")
    q = df.where("id % 5 = 0").select(F.col("id").alias("q"), "s", "vector")
    got = {}
    for r in vector.cosine_top_k(df, q, 4, corpus_id="id", query_id="q", block=3).collect():
        got.setdefault(r.q, []).append((r["rank"], r.id))
    n = m.astype(np.float64) / np.maximum(np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True), 1e-300)
    for i in range(0, 60, 5):
        sims = np.round(n @ n[i], 12)
        assert [x for _, x in sorted(got[i])] == sorted(range(60), key=lambda j: (-sims[j], j))[:4]
    scoped = vector.cosine_top_k(df, q, 60, corpus_id="id", query_id="q", scope="s").collect()
    assert all(r.q % 2 == r.id % 2 for r in scoped)
    assert vector.cosine_top_k(df, q.limit(0), 4, corpus_id="id", query_id="q").count() == 0


def test_embedding_once_per_content(spark):
    df = spark.createDataFrame([("a", "h1"), ("a", "h1"), ("b", "h2"), (None, "h3")], "t string, h string")
    v = vector.embed_distinct(df, "t", "h", vector.HashedTrigrams(16))
    assert v.count() == 3
    cache = spark.createDataFrame([("h1", [9.0] * 16, "trigrams-16")], "h string, vector array<float>, model string")
    got = {r.h: r.vector[0] for r in vector.embed_distinct(df, "t", "h", vector.HashedTrigrams(16), cache).collect()}
    assert got["h1"] == 9.0 and len(got) == 3
    assert vector.token_batches([5, 5, 50, 1, 1, 1], 2, 10) == [[0, 1], [2], [3, 4], [5]]


def test_graph_lookups(spark):
    chunks = spark.createDataFrame([chunk("big", "x", start=1, end=20), chunk("small", "x", start=5, end=8), chunk("pk", "x", path="pkg/__init__.py")], CHUNKS)
    pts = spark.createDataFrame([(1, "p", "a.py", 6), (2, "p", "a.py", 10), (3, "p", "a.py", 99)], "n int, project_id string, file_path string, line int")
    assert sorted((r.n, r.chunk_id) for r in graph.covering_chunks(pts, chunks, ["n"]).collect()) == [(1, "small"), (2, "big")]
    edges = spark.createDataFrame([(2, "p", "a", "f", "g", "calls", None, "parsed"), (1, "p", "a", "f", "g", "calls", None, "parsed"), (3, "p", "a", "g", "g", "calls", 4, "parsed"), (4, "p", "i", "pkg/__init__.py", "m.g", "imports", 1, "parsed")], EDGES)
    assert sorted(r.edge_id for r in graph.unique_edges(edges).collect()) == [1, 3, 4]
    syms = spark.createDataFrame([symbol("1", "f"), symbol("2", "K.m"), symbol("3", "K"), symbol("4", "K::n"), symbol("5", "Kx.m")], SYMBOLS)
    assert sorted(r.edge_id for r in graph.unresolved_edges(edges, syms).collect()) == [1, 2, 3, 4]
    box = spark.createDataFrame([("p", "K")], "project_id string, container string")
    assert sorted(r.fqn for r in graph.container_members(box, syms).collect()) == ["K.m", "K::n"]
    assert sorted((r.direction, r.target_name) for r in graph.edges_of(spark.createDataFrame([("p", "g")], "project_id string, fqn string"), edges).collect()) == [("in", "g"), ("in", "g"), ("out", "g")]
    assert [r.path for r in graph.reexport_sites(spark.createDataFrame([("p", "g")], "project_id string, name string"), edges).collect()] == ["pkg/__init__.py"]


def test_expansion_order_quota_and_flows(spark):
    n = 40
    chunks = spark.createDataFrame([chunk("seed", "x", "seed")] + [chunk(f"c{i:02}", "x", f"f{i:02}") for i in range(n)] + [chunk("priv", "x", "_p"), chunk("up", "x", "caller")], CHUNKS)
    syms = spark.createDataFrame([symbol("s", "seed", "seed")] + [symbol(f"y{i:02}", f"f{i:02}", f"c{i:02}") for i in range(n)] + [symbol("pp", "_p", "priv"), symbol("u", "caller", "up")], SYMBOLS)
    edges = spark.createDataFrame(
        [(i, "p", "a", "seed", f"f{i:02}", "calls", i, "parsed") for i in range(n)] + [(100, "p", "a", "seed", "_p", "calls", 999, "synthesized"), (101, "p", "a", "caller", "seed", "calls", 1, "parsed"), (102, "p", "a", "_p", "f05", "calls", 1, "parsed"), (103, "p", "a", "f05", "seed", "calls", 1, "parsed"), (104, "p", "a", "seed", "len", "calls", 0, "parsed")], EDGES,
    )
    pool = spark.createDataFrame([("q", "p", "seed", "seed", "code", 1.0, 1.0), ("q", "p", "c00", "f00", "code", 0.5, 0.5)], "query_id string, project_id string, chunk_id string, symbol_fqn string, kind string, score double, rrf_score double")
    got = graph.expand(pool, syms, edges, chunks).orderBy("hop").collect()
    assert len(got) == 30 and got[0].chunk_id == "priv" and got[0].synthesized and [g.chunk_id for g in got[1:4]] == ["c01", "c02", "c03"]
    few = graph.expand(pool, syms, edges.where("edge_id >= 100"), chunks).orderBy("hop").collect()
    assert [g.chunk_id for g in few] == ["priv", "up", "c05"] and few[0].reasons[0] == "graph from seed"
    heads = spark.createDataFrame([("q", "p", 1, "seed"), ("r", "p", 1, "f09"), ("z", "p", 1, "nowhere")], "query_id string, project_id string, pos int, fqn string")
    f = {r.query_id: (r.fqns, r.truncated) for r in graph.flows(heads, syms, edges).collect()}
    assert f == {"q": (["seed", "_p", "f05"], True)}


def test_resolution(spark):
    syms = spark.createDataFrame([symbol("1", "A.run", path="m/a.py"), symbol("2", "B.run", path="m/b.py"), symbol("3", "solo", path="m/c.py"), symbol("4", "thing", path="pkg/mod.py"), symbol("5", "hid", path="x.py", exported=False), symbol("6", "hid", path="y.py")], SYMBOLS)
    refs = spark.createDataFrame(
        [(1, "p", "s", "solo", "call", 1, "m/a.py", "python", "pending"), (2, "p", "s", "x.run", "call", 2, "m/a.py", "python", "pending"), (3, "p", "s", "run", "call", 2, "zz.py", "python", "pending"), (4, "p", "s", "pkg.mod.thing", "import", 3, "q.py", "python", "pending"),
         (5, "p", "s", "other.thing", "import", 3, "q.py", "python", "pending"), (6, "p", "s", "a[0]", "call", 3, "q.py", "python", "pending"), (7, "p", "s", " hid ", "call", None, "q.py", "python", "pending"), (8, "p", "s", "solo", "call", 1, "m/a.py", "python", "failed")],
        "id long, project_id string, from_fqn string, name string, kind string, line int, file_path string, language string, status string",
    )
    edges, failed = resolve.resolve_pending(refs, syms)
    got = sorted((r.target_name, r.kind, r.provenance) for r in edges.collect())
    assert got == [("A.run", "calls", "resolved"), ("A.run", "calls", "synthesized"), ("B.run", "calls", "synthesized"), ("hid", "calls", "resolved"), ("solo", "calls", "resolved"), ("thing", "imports", "resolved")] or got == [("A.run", "calls", "resolved"), ("B.run", "calls", "synthesized"), ("hid", "calls", "resolved"), ("solo", "calls", "resolved"), ("thing", "imports", "resolved")]
    assert sorted(r.ref_id for r in failed.collect()) == [5, 6]
    again, _ = resolve.retry_failed(refs, spark.createDataFrame([("p", "solo")], "project_id string, name string"), syms)
    assert [r.target_name for r in again.collect()] == ["solo"]
    e = spark.createDataFrame([(1, "p", "m/a.py", "A.run", "solo", "calls", 1, "parsed"), (2, "p", "m/a.py", "A.run", "x.solo", "calls", 1, "parsed"), (3, "p", "zz.py", "A.run", "run", "calls", 1, "parsed")], EDGES)
    assert sorted((r.edge_id, r.target_name) for r in resolve.retarget_edges(e, syms).collect()) == [(1, "solo"), (3, "run")]
    links = spark.createDataFrame([("p", "b", "1", "inferred", False), ("p", "b", "9", "inferred", False)], "project_id string, spec_block_id string, symbol_id string, provenance string, stale boolean")
    old = spark.createDataFrame([("p", "f", "A", "1"), ("p", "f", "Z", "9")], "project_id string, file_path string, fqn string, id string")
    new = spark.createDataFrame([("p", "f", "A", "1b")], "project_id string, file_path string, fqn string, id string")
    assert sorted((r.symbol_id, r.stale) for r in resolve.cascade_spec_refs(links, old, new).collect()) == [("1b", False), ("9", True)]


def cand(i, score, path="a.py", kind="code", tier=1, start=1, end=3, fqn=None, content="x = 1", ranks=None, reasons=None):
    return {"chunk_id": i, "path": path, "kind": kind, "tier": tier, "score": score, "rrf_score": score / 100, "channel_ranks": ranks or {"bm25": 1}, "reasons": reasons or ["r"], "symbol_fqn": fqn or i, "start_line": start, "end_line": end, "signature": "def f():", "content": content}


def test_packing_floor_merge_aggregation_and_caps():
    b = pack.Budget.of("fast")
    pool = [cand("a", 5.0), cand("b", 4.0, start=6, end=8), cand("c", 3.0, "b.py", fqn="a"), cand("d", 1.0, "c.py")]
    r = pack.Packer(pool, b).run()
    assert [e["chunkId"] for e in r["evidence"]] == ["a", "d"] or [e["chunkId"] for e in r["evidence"]] == ["a"]
    first = r["evidence"][0]
    assert first["lines"] == [1, 8] and "near lines joined" in first["reason"] and "same symbol x1" in first["reason"] and "... 2 lines left out ..." in first["content"]
    long = cand("l", 5.0, end=400, content="\n".join(f"line {i} " + "word " * 20 for i in range(400)))
    r = pack.Packer([long], b).run()
    assert r["evidence"][0]["elidedLines"] > 300 and r["budget"]["usedTokens"] < b.per_file() + b.overhead
    assert pack.Packer([], b).run()["missingEvidence"][0]["code"] == "no_context_match"
    spec = [cand("s", 0.1, "d.md", "spec"), *[cand(f"c{i}", 5.0, f"f{i}.py") for i in range(3)]]
    assert "s" in [e["chunkId"] for e in pack.Packer(spec, b).run()["evidence"]]
    tiny = pack.Packer([cand(f"c{i}", 5.0 - i / 100, f"f{i}.py", content="word " * 400) for i in range(60)], pack.Budget.of("fast", 2000)).run()
    assert tiny["budget"]["truncated"] and tiny["budget"]["usedTokens"] <= 2000


def test_backfill_and_answerability():
    pool = [cand("box", 5.0, fqn="Box", ranks={"exact": 1, "bm25": 1}), cand("m1", 0.1, "z.py", fqn="Box.m1", start=50, end=60), cand("h", 0.1, "h.py", fqn="_help"), cand("x", 0.1, "i.py", fqn="pkg", reasons=["re-export site"])]
    first = pack.Packer(pool, pack.Budget.of("fast")).run()
    plan = pack.plan_backfill(pool, first["evidence"], ["Box"], {"Box": ["_help"]})
    assert {c["chunk_id"] for c, _ in plan} <= {"m1", "h", "x"} and len(plan) >= 1
    done = pack.Packer(pool, pack.Budget.of("fast"), backfill=plan, reserve=True).run()
    assert len(done["evidence"]) >= len(first["evidence"]) and done["answerable"]
    assert pack.assess([cand("a", 1.0)], False) == (False, "low")
    assert pack.assess([cand("a", 1.0, "a.py", ranks={"bm25": 1, "vector": 2}), cand("b", 0.9, "b.py", ranks={"bm25": 1, "vector": 2})], False) == (True, "medium")


def test_citations():
    r = pack.verify_citations("# H\nIt is so [E1] and [E9].\n```\nx [E2]  y\n```\n\nMore  text.", ["E1", "E2"])
    assert r["valid"] == ["E1", "E2"] and r["invalid"] == ["E9"] and r["paragraphs"] == 3 and r["coverage"] == round(2 / 3, 4)
    assert "[E9]" not in r["answer"] and "x [E2]  y" in r["answer"] and "More text." in r["answer"] and "1 citations" in r["answer"]
    assert pack.split_sections("### A\nx\n### B\ny") == {"A": "x", "B": "y"}


def test_spans(spark):
    df = spark.createDataFrame([("f", 1, 5), ("f", 3, 4), ("f", 10, 12), ("f", 40, 41), ("g", 2, 2)], "k string, start_line int, end_line int")
    assert sorted((r.k, r.start_line, r.end_line, r.spans) for r in pack.merged_spans(df, ["k"]).collect()) == [("f", 1, 12, 3), ("f", 40, 41, 1), ("g", 2, 2, 1)]
    tot = spark.createDataFrame([("f", 45), ("g", 2), ("h", 3)], "k string, total int")
    assert sorted((r.k, r.first, r["last"]) for r in pack.uncovered_spans(df, tot, ["k"]).collect()) == [("f", 6, 9), ("f", 13, 39), ("f", 42, 45), ("g", 1, 1), ("h", 1, 3)]


def test_includes_visibility_and_error_spans(spark):
    inc = spark.createDataFrame([("p", 1, "a/b/x.c", "y.h"), ("p", 2, "a/b/x.c", "../z.h"), ("p", 3, "a/b/x.c", "only.h"), ("p", 4, "a/b/x.c", "two.h"), ("p", 5, "a/b/x.c", "none.h")], "project_id string, include_id int, file_path string, name string")
    files = spark.createDataFrame([("p", f) for f in ("a/b/y.h", "y.h", "a/z.h", "q/only.h", "m/two.h", "n/two.h")], "project_id string, path string")
    assert sorted((r.include_id, r.path) for r in resolve.resolve_includes(inc, files).collect()) == [(1, "a/b/y.h"), (2, "a/z.h"), (3, "q/only.h")]
    syms = spark.createDataFrame([symbol("1", "f", path="a.c", exported=False), symbol("2", "g", path="b.c", exported=False), symbol("3", "h", path="b.c")], SYMBOLS)
    assert sorted(r.id for r in graph.visible_symbols(syms, F.lit("a.c")).collect()) == ["1", "3"]
    facts = syms.select("project_id", "file_path", "id", "start_line", "end_line")
    spans = spark.createDataFrame([("p", "b.c", 4, 9)], "project_id string, file_path string, start_line int, end_line int")
    assert sorted(r.id for r in graph.drop_inside(facts, spans).collect()) == ["1"]


def test_query_vectors_are_cached(spark):
    q = spark.createDataFrame([("1", "p", "a b c"), ("2", "p", "a b c"), ("3", "p", None)], "query_id string, project_id string, text string")
    provider = vector.HashedTrigrams(8)
    got, cache = vector.cached_query_vectors(q, provider, None)
    assert got.count() == 2 and cache.count() == 1
    marked = cache.withColumn("vector", F.array(*[F.lit(1.0).cast("float")] * 8))
    again, grown = vector.cached_query_vectors(q, provider, marked)
    assert again.first().vector == [1.0] * 8 and grown.count() == 1


def test_documents_bring_the_code_they_name():
    pool = [cand("s", 5.0, "d.md", "spec"), cand("c", 4.0, "c.py"), cand("c2", 4.0, "c2.py"), cand("t", 0.1, "t.py")]
    first = pack.Packer(pool, pack.Budget.of("fast"), failed=["gone_name", "a[0]"]).run()
    assert first["missingEvidence"][0]["symbol"] == "gone_name"
    plan = pack.plan_backfill(pool, first["evidence"], [], {}, {"s": ["t", "zz"]})
    assert [(c["chunk_id"], why) for c, why in plan] == [("t", "gap: named by d.md")]
    assert pack.query_coverage("what does x do zzz", first) < 1.0 and pack.query_coverage("", first) == 1.0


def test_both_ways_of_literal_search_agree(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [chunk(f"c{i}", " ".join(rnd.choices(["aaaa", "aaab", "Flush", "flush_all", "x"], k=9)), fqn=rnd.choice(["m.flush", "m.other", None]), project=rnd.choice("pq")) for i in range(60)]
    phrases = [("1", "p", "FLUSH"), ("1", "p", "aaaa"), ("2", "q", "flush_all"), ("3", "p", "aaa"), ("4", "p", "aaaa aaaa"), ("5", "z", "flush")]
    c, q = spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(phrases, "query_id string, project_id string, phrase string")
    one = sorted(map(str, lexical.literal_search(c, q).collect()))
    monkeypatch.setattr(lexical, "HELD_PHRASES", 0)
    assert one == sorted(map(str, lexical.literal_search(c, q).collect())) and one
    assert lexical.literal_search(c, q.limit(0)).count() == 0


def test_single_matches_equal_those_of_all_pairs(spark):
    rnd = random.Random(8)
    fqns = ["a", "b", "m.a", "m.b", "n.a", "C::a", "C::d", "d"]
    syms = spark.createDataFrame([symbol(f"s{i}", rnd.choice(fqns), path=rnd.choice(["x.py", "y.py", "z.py"]), exported=rnd.choice([True, False, None])) for i in range(14)], SYMBOLS)
    refs = spark.createDataFrame([("p", i, rnd.choice([*fqns, "q.a", "self.b", "C::C", "a[0]", "x.h"]), "call", rnd.choice(["x.py", "y.py", "w.py"])) for i in range(300)], "project_id string, ref_id int, name string, kind string, file_path string")
    want = sorted((r.ref_id, r.fqn) for r in resolve.match(refs, syms).where("found = 1").collect())
    assert sorted((r.ref_id, r.fqn) for r in resolve.single_match(refs, syms).collect()) == want and len(want) > 20


def test_packs_count_all_failed_names():
    pool = [{"chunk_id": "c", "path": "a.py", "kind": "code", "tier": 0, "score": 1.0, "rrf_score": 1.0, "channel_ranks": {"exact": 1}, "reasons": [], "symbol_fqn": "f", "start_line": 1, "end_line": 2, "signature": "", "content": "x"}]
    done = pack.Packer(pool, pack.Budget.of("fast"), failed=["a", "b", "c"], failures=412).run()
    assert any(m["message"].startswith("412 names could not be resolved: a, b, c") for m in done["missingEvidence"])
