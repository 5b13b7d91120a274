"""Files that do not parse: grammars against the language's own parser, damaged files, and the tables."""

import ast
import json
import keyword
import tokenize
import warnings
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ctxloom.llm.chart import Grammar
from ctxloom.llm.syntax import broken_files, family_of, first_error


def ok(text, family):
    return first_error(text.encode() if isinstance(text, str) else text, family) is None


def test_recogniser():
    g = Grammar("s: item (',' item)* ','?\nitem: 'n' | '(E'")
    assert g.error("s", ("n", ",", "n")) == -1 and g.error("s", ("n", ",", ",")) == 2 and g.error("s", ()) == 0 and g.error("s", ("(EP",)) == -1 and g.error("s", ("(P",)) == 0
    amb = Grammar("e: e '+' e | 'n'")
    assert amb.error("e", ("n", "+", "n", "+", "n")) == -1 and amb.error("e", ("n", "+")) == 2


STDLIB = sorted(Path(tokenize.__file__).parent.glob("*.py"))[::5]


@pytest.mark.parametrize("path", STDLIB, ids=lambda p: p.name)
def test_standard_library_parses(path):
    assert first_error(path.read_bytes(), "python") is None


def valid_python(text):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return True
    except (SyntaxError, ValueError):
        return False


SOURCE = Path(keyword.__file__).read_text() + "\n" + Path(ast.__file__).read_text()[:6000].rsplit("\ndef ", 1)[0] + "\n"


@settings(max_examples=150, deadline=None)
@given(st.integers(0, len(SOURCE)))
def test_truncated_python_agrees_with_the_language(cut):
    text = SOURCE[:cut]
    assert ok(text, "python") == valid_python(text)


@pytest.mark.parametrize(
    "text",
    ["x = 1 if a else b\n", "match x:\n    case [1, *r] if r:\n        pass\n    case _:\n        pass\n", "async def f():\n    async with a as b, c:\n        await d\n", "@dec(1)\nclass A[T](B, metaclass=C):\n    x: int = 3\n", "f'{a!r:>{w}} {b}'\n",
     "try:\n    pass\nexcept* E as e:\n    raise\nelse:\n    pass\nfinally:\n    pass\n", "lambda *a, k=1, **kw: (yield)\n", "a[1:2, ..., ::3] = {**b, 'k': v for_ in_}\n".replace(" for_ in_", ""), "def f(a, /, b: int = 1, *, c, **k) -> None: ...\n", "if x: pass; y = 2\n", "", "# only\n", "\n\n  \n", "x = (1,\n     2)\n",
     "print(\"a\" 'b')\n", "with (open(a) as f, open(b) as g):\n    pass\n", "x = yield\n", "global a, b\n", "from . import (a, b as c,)\n", "type X = int\n", "del a, b[0]\n"],
)
def test_python_forms(text):
    assert ok(text, "python") == valid_python(text)
    assert ok(text.replace("\n", "\r\n"), "python") == valid_python(text)
    assert ok(b"\xef\xbb\xbf" + text.encode(), "python") == valid_python(text)


@pytest.mark.parametrize("text", ["if x:\n", "def f(:\n  pass\n", "x = = 1\n", "try:\n  pass\nx = 1\n", "  x = 1\n y = 2\n", "x = 'abc\n", '"""abc', "print 'x'\n", "1abc\n", "else:\n  pass\n", "@dec\nx = 1\n", "foo(\n", "a]\n", "x $ y\n", "if a:\n    x\n  y\n"])
def test_broken_python(text):
    assert not ok(text, "python") and not valid_python(text)


C_GOOD = ["int main(void) { return 0; }", "struct A { int x; char *y[3]; };\ntypedef struct A A;\n", "static const unsigned short T[] = {\n 1, 2,\n 0x3,\n};", "#if A\nif (\n#else\n#endif\n".replace("if (\n", "int f(void) {\n").replace("#endif", "int g(void) {\n#endif\n}"),
          "template <typename T> class V : public std::vector<T>, private B { public: V() : a(1), b{2} {} ~V() = default; T &operator[](size_t i) const { return p[i]; } };", "namespace a::b { enum class E : int { X = 1, Y }; }", "auto f = [&](int x) -> int { return x ? 1 : 2; };", "void f() { for (auto &x : v) { if (a) b(); else if (c) d(); else { e(); } } do { x--; } while (x); switch (x) { case 1: y(); break; default: ; } }",
          "extern \"C\" { int f(int, char *); }", "int x = sizeof(struct foo) * (int)y;", "const char *s = \"{ \\\" }\" \"b\";\nchar c = '}';", "#define X(a) \\\n  do { a; \nint y;", "std::map<std::string, std::vector<int>> m;", "", "/* only */"]
C_BAD = ["int main(void) { return 0; ", "int f( {", "/* open", "int x = ;;= 3", "static int fo", "char *s = \"abc\n;", "#endif\n", "#ifdef A\nint x;\n", "# Title of a text\n\nSome words here.\n", "def f(x):\n    return x\n", "<!DOCTYPE html>\n<html></html>\n", "}", "int f(void) { if (x return; }", "import { a } from './b.js';\nexport function f(x) {\n  return x;\n}\n"]


@pytest.mark.parametrize("text", C_GOOD)
def test_valid_c(text):
    assert first_error(text.encode(), "c") is None


@pytest.mark.parametrize("text", C_BAD)
def test_broken_c(text):
    assert not ok(text, "c")


@pytest.mark.parametrize(
    "text,line",
    [("#ifdef A\nint x;\n#else\nint f( {\n#endif\n", 4), ("#if 0\nno code (\n#else\nint f( {\n#endif\n", 4), ("#if A\n#elif B\nint y = ;;= 3\n#else\n#endif\n", 3), ("#ifdef A\n#ifdef B\n#else\nint f( {\n#endif\n#else\nint x;\n#endif\n", 4), ("#ifdef A\n#else\n#endif\n#ifndef A\n#else\nstatic int )\n#endif\n", 6), ("#else\n", 1), ("#ifdef A\n#else\n#else\n#endif\n", 3)],
)
def test_later_branches_are_read(text, line):
    error = first_error(text.encode(), "c")
    assert error and error[0] == line


@pytest.mark.parametrize(
    "text",
    ["#ifdef A\nint f(int x) {\n#else\nint f(void) {\n#endif\nreturn 0; }\n", "#ifdef A\nint f(int x) {\n#endif\n#if !defined(A)\nint f(void) {\n#endif\n}\n", "#if 0\nno code (\n#else\nint x;\n#endif\n", "#if 0 /* two\n lines */\n(\n#endif\nint x;\n", "#ifndef X_H\n#define X_H\n#ifdef __cplusplus\nextern \"C\" {\n#endif\nint f(void);\n#ifdef __cplusplus\n}\n#endif\n#endif\n", "#if A > 1\nint f(\n#elif defined B\nint g(\n#else\nint h(\n#endif\nvoid);\n"],
)
def test_branches_are_chosen_alike(text):
    assert first_error(text.encode(), "c") is None


JS_GOOD = ["import a, { b as c } from './x.js';\nimport * as d from \"e\"\nexport default function f(a, { b = 1, ...r }, [c]) {}\nexport const g = async (x) => { await x; }\nexport { g, f as h } from './y.js'\n", "const r = /[/]\\/x/g.test(s) ? `a ${b + `c`} d` : {k: 1, 'l': 2, [m]: 3, n() {}, get o() { return 1 }, ...p}\nlet z\n",
           "!function(e,t){if(!a)n=[1,2];k.prototype.v=function(w){this.r=w};function k(n){return n?n.d:null}}(window,document);", "class A extends B { static x = 1; #y; constructor() { super(); } async *gen() { yield* z } get q() { return this.#y } }", "for (let i = 0; i < 3; i++) { if (a) b()\n else c() }\nfor (const x of y) {}\nfor (k in o) ;\n", "a?.b?.[c]?.(d) ?? e\nx ||= 1\n", "if (a)\n  b\nelse\n  c\nwhile (x) y--\ndo { z() } while (q)\nlabel: for (;;) { break label }\n", "try { a } catch { b } finally { c }\nthrow new E('x')\n", ""]
JS_BAD = ["function f() {", "const x = ", "a b c d", "let y = 'abc\n", "`abc", "}", "if (x {}", "/* x", "def f(x):\n    pass\n", "#include <a.h>\nint main() { return 0; }\n", "else { x }", "import { a fro", "<html><body>x</body></html>"]


@pytest.mark.parametrize("text", JS_GOOD)
def test_valid_js(text):
    assert first_error(text.encode(), "js") is None


@pytest.mark.parametrize("text", JS_BAD)
def test_broken_js(text):
    assert not ok(text, "js")


@settings(max_examples=80, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=8), st.integers(0, 60))
def test_json_agrees(value, cut):
    text = json.dumps(value)
    for t in (text, text[:cut], json.dumps(value, indent=1, ensure_ascii=False)):
        try:
            json.loads(t)
            good = True
        except ValueError:
            good = False
        assert ok(t, "json") == good


@pytest.mark.parametrize(
    "family,good,bad",
    [
        ("toml", "# c\n[a.b]\nk = \"v\" # x\n'q' = [1,\n 2]\nd = 2024-01-01\nt = {a = 1, b.c = 2}\n[[l]]\n", ["k =\n", "k\n", "[a\n", "k = \"x\n", "k = v w\n"]),
        ("ini", "[s]\na=1\nb: 2\n; c\n# d\n  more\n", ["[s\n", "just words\n<html>\n"]),
        ("env", "A=1\nexport B='x y'\n# c\n\nC=\"multi\nline\"\n", ["A\n", "<html>\n", "A='x\n"]),
        ("yaml", "a: 1\nb:\n  - x\n  - k: v\n    l: \"q\n      r\"\nc: |\n  any: [ thing\n  {\nd: [1,\n  2]\n---\ne: {f: g}\n", ["a: 1\nbroken line\n", "a: \"x\n", "a: [1, 2\n", "\ta: 1\n"]),
    ],
)
def test_settings(family, good, bad):
    assert first_error(good.encode(), family) is None
    for b in bad:
        assert not ok(b, family), b


YAML_GOOD = ["a:\n- x\n- - y\n  - z\nb: {a: [1, {b: c}], d}\n", "? a\n: b\n? [c]\n: d\n", "- a: 1\n  b: 2\n- c\n", "%YAML 1.2\n--- |\n abc\n...\n---\nx: >-\n  y\n\n  z: [\nw: 1\n", "a: &x\n  b: *y\nc: !t {}\nd: !!str\n", "'q': http://x:80/a#b\n\"r\": plain\n  goes on\n<<: *z\n", "a: 'x\n  y' # c\n", "x: [a: b, ? c : d, 'e':f]\n", "a: [1,\n  2 # c\n ]\n", "plain\n text\n", "- \n-   a:\n      b\n", "a:\tb\n", "", "# only\n"]
YAML_BAD = [("a:\n  b: 1\n c: 2\n", 3), ("a: 1\n b: 2\n", 2), ("a: b: c\n", 1), ("a: 1\n  - b\nc: 2\nd\n", 5), ("- a\nb: c\n", 2), ("a:\n   - b\n  - c\n", 3), ("a: - b\n", 1), ("- a: 1\n b: 2\n", 2), ("a: |\n  x\n y\n", 4), ("a: [b}\n", 1), ("a: \"b\" c\n", 1), ("a: \"q\\q\"\n", 1), ("a:\n  b: 1\n  c\n  d: 2\n", 4), ("a: &x *y\n", 1), ("x: {a: 1, , b}\n", 1), ("a: b # c\n  d\n", 2)]


@pytest.mark.parametrize("text", YAML_GOOD)
def test_valid_yaml(text):
    assert first_error(text.encode(), "yaml") is None and first_error(text.replace("\n", "\r\n").encode(), "yaml") is None


@pytest.mark.parametrize("text,line", YAML_BAD)
def test_broken_yaml(text, line):
    assert first_error(text.encode(), "yaml") and first_error(text.encode(), "yaml")[0] <= line


def test_merge_markers_and_bytes():
    for family in ("markdown", "yaml", "", "python", "ini"):
        assert first_error(b"a\n<<<<<<< HEAD\nb\n=======\nc\n>>>>>>> x\n", family) == (2, "merge marker")
        assert not ok("a\n>>>>>>> x\n", family)
    assert ok("Title\n=======\n\ntext\n    <<<<<<< x\n", "markdown")
    assert ok(b"x = 'caf\xe9'\n", "python") and not ok(b"x\0 = 1\n", "python") and ok(None, "python") and ok(b"", "c") and not ok(b"", "json")
    assert ok("(" * 400 + ")" * 400 + "\n", "python")
    assert first_error(("a = [" + "1, " * 200_000 + "]\n").encode(), "python") is None


def test_families():
    assert [family_of(p, g) for p, g in (("a.py", None), ("a.h", "cpp"), ("x.c", "python"), ("a.mjs", "fallback"), ("README", None), (None, None))] == ["python", "c", "python", "js", "", ""]


def test_broken_files_table(spark):
    import datetime as dt

    t = dt.datetime(2025, 1, 1)
    files = spark.createDataFrame(
        [("p", "a.py", "python", "h1", t, "x"), ("p", "a.py", "python", "h0", t - dt.timedelta(1), "x"), ("p", "b.py", "python", "h2", t, "x"), ("p", "c.txt", "python", "h3", t, "x"), ("p", "gone.py", "python", "h", t, "x"), ("p", "d.py", None, "h", None, None), ("p", "b.py", "python", "h2", t, "x")],
        "project_id string, path string, language string, content_hash string, indexed_at timestamp_ntz, content string",
    )
    blobs = spark.createDataFrame([("p", "a.py", bytearray(b"x = (\n"), 1), ("p", "b.py", bytearray(b"x = 1\n"), 1), ("p", "c.txt", bytearray(b"def\n"), 1), ("p", "notafile.py", bytearray(b"("), 1), ("p", "d.py", None, 1), (None, None, None, None)], "project_id string, path string, content binary, language int")
    got = sorted((r.path, r.language, r.line) for r in broken_files(files, blobs).collect())
    assert got == [("a.py", "python", 1), ("c.txt", "python", 1)]
    assert broken_files(files.limit(0), blobs).count() == 0 and broken_files(files, blobs.limit(0)).count() == 0


def test_the_earlier_of_marker_and_error_counts():
    marks = b"<<<<<<< ours\nx = 1\n=======\nx = 2\n>>>>>>> theirs\n"
    assert first_error(b"def f(:\n    pass\n" + marks, "python")[0] == 1
    assert first_error(b"y = 1\n" + marks + b"def f(:\n", "python") == (2, "merge marker")
    assert first_error(b"a: 1\n" + marks, "yaml")[0] == 2 and first_error(b"text\n" + marks, "")[0] == 2
