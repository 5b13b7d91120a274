"""Column functions that classify paths, files and queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Extension -> language (fixed values).
LANGUAGES = {
    "py": "python", "pyi": "python",
    "c": "c", "h": "c",
    "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "c++": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "h++": "cpp", "ipp": "cpp", "tpp": "cpp",
    "md": "markdown", "markdown": "markdown", "mdx": "markdown",
}
#: File names that instruct agents, lower case (fixed values).
AGENT_FILES = ("agents.md", "claude.md", ".cursorrules", ".agent.md", "handoff.md", "skill.md")
#: Texts in the first ten lines that say a file was generated (fixed values).
BANNERS = ("do not edit", "don't edit", "@generated", "auto-generated", "autogenerated by", "this file was generated", "machine generated", "code generated by", "automatically generated")
#: Parts and ends of names of generated files (fixed values).
GENERATED_PARTS = ("_generated.", "autogen", "autogenerated")
GENERATED_ENDS = (".pb.cc", ".pb.h", ".pb.cpp", ".pb2.py", ".designer.cs", ".g.cs")
#: Words that show a query is about tests (fixed values).
TEST_WORDS = ("test", "tests", "pytest", "unittest", "fixture", "测试", "单测", "用例")
TEST_DIR = r"(^|/)(tests?|testdata|fixtures)(/|$)"
TEST_FILE = r"(^|/)(test_[^/]*|[^/]*_test)\.[A-Za-z0-9]+$"
MAX_FILE_BYTES, BINARY_RATIO, BINARY_PROBE = 131_072, 0.10, 8_192


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_DIR) | path.rlike(TEST_FILE)


def candidate_kind(path: Column, symbol_kind: Column) -> Column:
    return F.when(symbol_kind == "spec_block", "spec").when(symbol_kind == "fallback_block", "fallback").when(is_test_path(path), "test").otherwise("code")


#: Kinds of documents in order: names, beginnings of names, and folders that tell them (fixed values).
DOCTYPES = (
    ("agent-instructions", AGENT_FILES, (), ()),
    ("readme", (), ("readme",), ()),
    ("design", (), ("architecture",), ("docs/design",)),
    ("adr", (), (), ("docs/adr",)),
    ("api", (), ("api", "protocol", "openapi"), ()),
    ("changelog", (), ("changelog",), ()),
)
OTHER_DOCTYPE = "guide"


def doctype(path: Column) -> Column:
    """The kind of document a Markdown path holds, by the first rule that fits."""
    name, slashed = F.lower(base_name(path)), F.concat(F.lit("/"), path)
    out = None
    for kind, names, beginnings, folders in DOCTYPES:
        fits = name.isin(*names)
        for b in beginnings:
            fits = fits | name.startswith(b)
        for f in folders:
            fits = fits | slashed.contains(f"/{f}/")
        out = F.when(fits, kind) if out is None else out.when(fits, kind)
    return out.otherwise(OTHER_DOCTYPE)


def doctype_of(path: str) -> str:
    """:func:`doctype` of one path."""
    slashed = "/" + path.replace("\\", "/")
    name = slashed[slashed.rfind("/") + 1 :].lower()
    fits = (kind for kind, names, beginnings, folders in DOCTYPES if name in names or name.startswith(beginnings) or any(f"/{f}/" in slashed for f in folders))
    return next(fits, OTHER_DOCTYPE)


def language_of(path: Column) -> Column:
    """The language the extension tells, null for others."""
    ends = F.regexp_extract(F.lower(F.trim(path)), r"\.([^./\\]+)$", 1)
    return F.create_map(*[F.lit(x) for p in LANGUAGES.items() for x in p])[ends]


def lift_headers(language: Column, path: Column, project_has_cpp: Column) -> Column:
    """C headers of a project that holds C++ are C++."""
    return F.when((language == "c") & F.lower(path).endswith(".h") & project_has_cpp, "cpp").otherwise(language)


def is_generated_path(path: Column) -> Column:
    name = F.lower(base_name(path))
    found = F.lit(False)
    for p in GENERATED_PARTS:
        found = found | name.contains(p)
    for e in GENERATED_ENDS:
        found = found | name.endswith(e)
    return found


def has_banner(text: Column) -> Column:
    head = F.lower(F.array_join(F.slice(F.split(text, "\n", 11), 1, 10), "\n"))
    found = F.lit(False)
    for b in BANNERS:
        found = found | head.contains(b)
    return found


def is_generated(path: Column, text: Column) -> Column:
    return is_generated_path(path) | F.coalesce(has_banner(text), F.lit(False))


def is_oversize(length: Column) -> Column:
    return length > MAX_FILE_BYTES


@F.pandas_udf(T.BooleanType())
def is_binary(content: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A zero byte in the first 8 KiB, or more than a tenth of control bytes there; null is no binary file."""
    control = bytes(b for b in range(32) if b not in (9, 10, 12, 13, 27)) + b"\x7f"

    def check(data) -> bool:
        head = bytes(data[:BINARY_PROBE]) if data is not None else b""
        return b"\0" in head or (bool(head) and (len(head) - len(head.translate(None, control))) / len(head) > BINARY_RATIO)

    for s in content:
        yield s.map(check, na_action=None).astype(bool)


def is_test_intent(query: Column) -> Column:
    low = F.lower(query)
    found = F.lit(False)
    for w in TEST_WORDS:
        found = found | low.contains(w)
    return found


def is_worth(token: Column) -> Column:
    """Whether a bare token is a literal by its shape: long enough, with a structural sign, all capitals or all digits."""
    return (F.length(token) >= 6) & (token.rlike("[-=/:.]") | ((F.upper(token) == token) & token.rlike("[A-Z]")) | token.rlike("^[0-9]+$"))


def is_symbol_reference(name: Column) -> Column:
    """Names that may be symbols: no paths, system headers, wildcards or expressions."""
    return name.rlike(r"^[A-Za-z_~][\w~]*((\.|::|->)[A-Za-z_~][\w~]*)*$") & ~name.rlike(r"\.(h|hh|hpp|hxx|c|cc|cpp|cxx|py|md)$")


def is_safe_path(path: Column) -> Column:
    """Relative paths without empty, ``.`` or ``..`` parts and without backslashes."""
    return path.isNotNull() & ~path.rlike(r"^/|\\|(^|/)(\.{1,2})?(/|$)")
