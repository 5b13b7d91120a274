"""Extraction of symbols, edges and blocks, and cutting files into chunks."""

from hypothesis import given, settings
from hypothesis import strategies as st

from ctxloom.operators.parse import c_facts, explode, fallback_blocks, markdown_blocks, parse_file, parse_files, python_facts

PY = '''"""Module."""
import os
from .m import n as k

LIMIT: int = 3

@deco
class Foo(Base, mix.In):
    """Foo."""
    def run(self, x):
        """Runs."""
        def inner():
            return helper(x)
        getattr(x, "dyn")
        return inner()()

def _hidden():
    pass
'''
CPP = """#include "a.h"
#include <vector>
#define SQ(x) ((x)*(x))
namespace ns {
class Base { public: virtual int go(); int stay() { return 1; } };
class Foo : public Base {
 public:
  int go() override { return stay(); }
};
int Foo::other(int a) { return helper(a) + obj->call("{"); }
static int hid(void) { return 0; }
template <class T> T id(T x) { return x; }
}
typedef struct Q { int a; } Q;
enum E { A, B };
"""


def test_python_symbols_and_edges():
    f = python_facts("p/a.py", PY)
    kinds = {s[1]: s[2] for s in f["symbols"]}
    assert kinds == {"LIMIT": "variable", "Foo": "class", "Foo.run": "method", "Foo.run.inner": "function", "_hidden": "function"}
    assert next(s for s in f["symbols"] if s[1] == "Foo")[3] == 7
    e = {(a, b, k) for a, b, k, *_ in f["edges"]}
    assert ("Foo", "Base", "extends") in e and ("Foo", "mix.In", "extends") in e and ("p/a.py", "os", "imports") in e and ("p/a.py", ".m.n", "imports") in e and ("Foo.run.inner", "helper", "calls") in e
    assert ("Foo.run", "dyn", "call", 14) in f["unresolved"]
    assert not dict((s[1], s[5]) for s in f["symbols"])["_hidden"]


def test_python_syntax_error_falls_back():
    r = parse_file("a.py", b"def f(:\n  x")
    assert r["parse_errors"] and not r["symbols"] and [c["symbol_kind"] for c in r["chunks"]] == ["fallback_block"]


def test_cpp_symbols_and_edges():
    f = c_facts("d/x.cpp", CPP, True)
    s = {x[1]: (x[2], x[5]) for x in f["symbols"]}
    assert s["ns"] == ("namespace", True) and s["ns::Base"][0] == "class" and s["ns::Foo::go"] == ("method", True) and s["ns::Foo::other"] == ("method", False) and s["ns::hid"] == ("function", False) and s["ns::id"][0] == "function"
    assert s["SQ"][0] == "macro" and s["E"][0] == "enum" and "Q" in s
    e = {(a, b, k) for a, b, k, *_ in f["edges"]}
    assert ("ns::Foo", "Base", "extends") in e and ("d/x.cpp", "d/a.h", "imports") in e and ("ns::Foo::other", "helper", "calls") in e and ("ns::Foo::other", "obj.call", "calls") in e
    assert ("d/x.cpp", "vector", "import", 2) in f["unresolved"]


def test_markdown_blocks():
    text = "---\na: 1\n---\nintro\n# A\nuse `Foo.bar` and make_it\n```py\n# not a heading\n```\n## B #\nx\n# C\n"
    b = markdown_blocks("docs/adr/x.md", text)
    assert [(x["heading_path"], x["start_line"], x["end_line"]) for x in b] == [("(front matter)", 1, 3), ("(preamble)", 4, 4), ("A", 5, 11), ("A > B", 10, 11), ("C", 12, 12)]
    assert b[2]["mentioned"][:2] == ["Foo.bar", "make_it"] and b[2]["code_fences"][0]["lang"] == "py" and b[0]["doctype"] == "adr"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400))
def test_fallback_blocks_give_the_text_back(text):
    blocks = fallback_blocks(text, 5, 40)
    assert "".join(b for _, _, b in blocks) == text
    assert all(len(b) <= 40 and b.count("\n") + (not b.endswith("\n")) <= 5 for _, _, b in blocks)


def test_chunks_cover_the_file():
    r = parse_file("p/a.py", PY.encode())
    kinds = {c["symbol_fqn"]: c["symbol_kind"] for c in r["chunks"]}
    assert kinds["Foo"] == "class_skeleton" and kinds["Foo.run"] == "method" and kinds["(module)"] == "fallback_block"
    lines = {n for c in r["chunks"] for n in range(c["start_line"], c["end_line"] + 1)}
    text = PY.splitlines()
    assert all(n in lines for n in range(1, len(text) + 1) if text[n - 1].strip())
    run = next(c for c in r["chunks"] if c["symbol_fqn"] == "Foo.run")
    assert run["docstring"] == "Runs." and run["signature"].strip() == "def run(self, x):"
    assert len({c["id"] for c in r["chunks"]}) == len(r["chunks"])


def test_parse_never_raises_on_bytes():
    for name in ("a.py", "b.c", "c.cpp", "d.md", "e.bin", "f"):
        for data in (None, b"", b"\xff\xfe\x00{", b"}" * 50, b"(" * 3000, "中".encode() * 10, b"a" * 90_000):
            r = parse_file(name, data)
            assert isinstance(r["chunks"], list)


def test_parse_files_as_rows(spark):
    df = spark.createDataFrame([("p", "a.py", bytearray(PY.encode()), 1), ("p", "r.md", bytearray(b"# T\nx"), 2), ("p", None, bytearray(b"x"), 3)], "project_id string, path string, content binary, language int")
    p = parse_files(df).cache()
    assert p.count() == 2 and explode(p, "symbols").count() == 5 and explode(p, "chunks").where("symbol_kind = 'spec_block'").count() == 1
    assert parse_files(df.limit(0)).count() == 0


def test_calls_through_pointers():
    code = "static int one(int a) { return a; }\nstatic int two(int a) { return a; }\nstruct ops { int (*run)(int); };\nint (*hook)(int) = one;\nstruct ops t = { .run = two, };\nint go(struct ops *o) { return hook(1) + o->run(2); }\n"
    e = {(a, b, p) for a, b, k, _, p in c_facts("x.c", code, False)["edges"] if k == "calls"}
    assert ("go", "one", "synthesized") in e and ("go", "two", "synthesized") in e and ("go", "hook", "parsed") in e


def test_files_are_read_around_syntax_errors():
    text = "import os\n\ndef good(a):\n    return os.path(a)\n\ndef bad(:\n    x = 1\n\nclass C:\n    def m(self):\n        return good(1\n\n    def n(self):\n        return 2\n"
    r = parse_file("a.py", text.encode())
    assert {"good", "C", "C.n"} <= {s["fqn"] for s in r["symbols"]} and "bad" not in {s["fqn"] for s in r["symbols"]}
    assert r["parse_errors"][0] == "L6: SyntaxError" and {s["start_line"] for s in r["symbols"] if s["fqn"] == "C.n"} == {13}
    assert not parse_file("a.py", b"((((\n")["symbols"] and parse_file("a.py", b"((((\n")["chunks"][0]["symbol_kind"] == "fallback_block"


def test_branches_of_conditionals_do_not_upset_scopes():
    c = "#ifdef A\nint f(int a) {\n#else\nint f(void) {\n#endif\n  return 1;\n}\n#if 0\nint dead(void) { return 2; }\n#else\nint live(void) { return 3; }\n#endif\n#ifdef B\nint b(void) { return 4; }\n#else\nint c(void) { return 5; }\n#endif\nint last(void) { return g(); }\n"
    facts = c_facts("a.c", c, False)
    assert [(s[1], s[3], s[4]) for s in facts["symbols"]] == [("f", 2, 7), ("live", 11, 11), ("b", 14, 14), ("c", 16, 16), ("last", 18, 18)]
    assert ("last", "g", "calls", 18, "parsed") in facts["edges"]


def test_many_headings_and_members_take_linear_time():
    import time

    start = time.perf_counter()
    text = "".join(f"# h{i}\n\ntext `name_{i}`\n\n```py\nx = {i}\n```\n" for i in range(4_000))
    blocks = markdown_blocks("a.md", text)
    assert len(blocks) == 4_000 and all(len(b["code_fences"]) == 1 for b in blocks) and blocks[-1]["end_line"] == 28_000
    r = parse_file("a.py", "".join(f"class C{i}:\n    def m(self):\n        return {i}\n" for i in range(3_000)).encode())
    assert len(r["chunks"]) == 6_000 and time.perf_counter() - start < 20
