"""Functions paired with their documentation, and what counts as documentation."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The states of the lexer for languages with braces: comments, strings, characters, template strings, marks.
_BRACED = re.compile(r"(?P<block>/\*.*?(?:\*/|\Z))|(?P<line>//[^\n]*)|R\"(?P<d>[^\s()\\]{0,16})\(.*?\)(?P=d)\"|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?|(?P<mark>[{};])", re.S)
_PYTHON = re.compile(r"(?P<line>#[^\n]*)|(?P<string>[rRbBuUfF]{0,2}(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?))|(?P<mark>[()\[\]{}])|(?P<def>(?:(?<=\n)|\A)[ \t]*(?:async[ \t]+)?def[ \t]+(?P<name>\w+))", re.S)
_NOT_A_FUNCTION = re.compile(r"(?:^|[\s;}])(?:if|for|while|switch|catch|do|else|try|return|struct|union|enum|class|interface|namespace|extern)\b[^()]*(?:\(|$)")
_SCOPE = re.compile(r"\b(?:namespace|class|struct|union|interface)\b|extern\s*$")
_HEAD_NAME = re.compile(r"([~\w$]+(?:::~?\w+)*|operator\s*\S{1,3})\s*(?:<[^<>()]*>)?\s*\(")
#: Directives and access labels, which belong to no declaration.
_ASIDE = re.compile(r"(?m)^[ \t]*#(?:.*\\\n)*.*$|\b(?:public|private|protected)\s*:(?!:)")


@dataclass(frozen=True)
class Function:
    """A function as it stands in the source: name, signature, body, raw documentation and the place of the signature."""

    name: str
    signature: str
    body: str
    documentation: str
    start: int


def _braced(text: str) -> list[Function]:
    """Functions of a language with braces. Comments directly above (no blank line, no code between) document them."""
    out: list[Function] = []
    notes: list[tuple[int, int]] = []
    head, depth, opened, scopes = 0, 0, 0, []
    current: tuple[str, str, int] | None = None
    declaring = -1  # the head that is known to hold code
    for m in _BRACED.finditer(text):
        kind = m.lastgroup
        if kind in ("block", "line"):
            if current is None:
                if declaring == head:
                    continue
                between = text[head : m.start()]
                if between.strip():
                    if _ASIDE.sub("", between).strip():
                        declaring = head
                        continue  # inside a declaration
                    notes = []
                if notes and text.count("\n", notes[-1][1], m.start()) > 1:
                    notes = []
                notes.append(m.span())
                head = m.end()
            continue
        if kind != "mark":
            continue
        mark = m.group("mark")
        if current is not None:
            if mark == "{":
                depth += 1
            elif mark == "}":
                depth -= 1
                if depth == 0:
                    name, doc, at = current
                    out.append(Function(name, text[at:opened].strip(), text[opened : m.end()], doc, at))
                    current, head, notes = None, m.end(), []
            continue
        if mark == "{":
            declared = text[head : m.start()]
            plain = re.sub(r"(?m)^\s*#.*$", "", declared)
            named = _HEAD_NAME.search(plain)
            if named and ")" in plain and not _NOT_A_FUNCTION.search(plain[: named.end()]):
                at = head + len(declared) - len(declared.lstrip())
                doc = ""
                if notes and text.count("\n", notes[-1][1], at) <= 1:
                    doc = "\n".join(text[a:b] for a, b in notes)
                current, depth, opened = (named.group(1), doc, at), 1, m.start()
            else:
                scopes.append(bool(_SCOPE.search(plain)))
                if not scopes[-1]:
                    current, depth, opened = ("", "", head), 1, m.start()
                    scopes.pop()
                else:
                    head, notes = m.end(), []
        else:
            if mark == "}" and scopes:
                scopes.pop()
            head, notes = m.end(), []
    if current is not None and current[0]:
        out.append(Function(current[0], text[current[2] : opened].strip(), text[opened:], current[1], current[2]))
    return [f for f in out if f.name]


#: The marks that end or open something in a signature.
_SIGNATURE = re.compile(r"[()\[\]{}:]|#[^\n]*|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"")
_FIRST_STRING = re.compile(r"(?:\s|#[^\n]*\n)*[rRuU]?(\"\"\"(.*?)(?:\"\"\"|\Z)|'''(.*?)(?:'''|\Z)|\"((?:\\.|[^\"\\\n])*)\"|'((?:\\.|[^'\\\n])*)')", re.S)
_CODE_LINE = re.compile(r"^[ \t]*(?=[^\s#])", re.M)


def _above(text: str, start: int) -> str:
    """The comment lines that end where decorators or the definition at ``start`` begin."""
    top, low = start, start
    while low > 0:
        line = text.rfind("\n", 0, low - 1) + 1
        sign = text[line:low].lstrip(" \t")[:1]
        if sign == "@" and low == top:
            top = low = line
        elif sign == "#":
            low = line
        else:
            break
    return text[low:top]


def _indented(text: str) -> list[Function]:
    """Functions of a language with indentation. The first string of the body documents them, else the comment above.

    One pass of the lexer finds definitions and the stretches (strings, open brackets) inside which no line of code begins;
    one pass over the lines of code then closes the bodies that are open, by a stack, so the work grows with the text."""
    shut: list[tuple[int, int]] = []
    defs: list[re.Match] = []
    depth = opened = 0
    for m in _PYTHON.finditer(text):
        if m.lastgroup == "mark":
            if m.group() in "([{":
                opened = m.start() if depth == 0 else opened
                depth += 1
            elif depth:
                depth -= 1
                if depth == 0:
                    shut.append((opened, m.end()))
        elif m.group("name"):
            if depth == 0:
                defs.append(m)
        elif m.group("string") and depth == 0 and "\n" in m.group():
            shut.append(m.span())
    if depth:
        shut.append((opened, len(text)))
    heads: list[tuple[re.Match, int]] = []
    for k, m in enumerate(defs):
        opens, stop = 0, defs[k + 1].start() if k + 1 < len(defs) else len(text)
        for t in _SIGNATURE.finditer(text, m.end(), stop):
            c = t.group()[0]
            if c in "([{":
                opens += 1
            elif c in ")]}":
                opens -= 1
            elif c == ":" and opens == 0:
                heads.append((m, t.end()))
                break
    ends = [len(text)] * len(heads)
    open_: list[tuple[int, int]] = []
    at = nth = 0
    for line in _CODE_LINE.finditer(text):
        begin, pos = line.span()
        while at < len(shut) and shut[at][1] <= pos:
            at += 1
        if at < len(shut) and shut[at][0] < pos:
            continue
        while open_ and pos - begin <= open_[-1][0]:
            ends[open_.pop()[1]] = max(begin - 1, 0)
        if nth < len(heads) and heads[nth][0].start() == begin:
            open_.append((pos - begin, nth))
            nth += 1
    out = []
    for (m, colon), end in zip(heads, ends):
        end = max(end, colon)
        first = _FIRST_STRING.match(text, colon, end)
        doc = next((g for g in first.groups()[1:] if g is not None), "") if first else ""
        if not doc.strip():
            doc = _above(text, m.start())
        out.append(Function(m.group("name"), text[m.start() : colon].strip(), text[colon:end], doc, m.start()))
    return out


def functions_in(text: str | None, path: str | None) -> list[Function]:
    """All functions of a source text; the path's extension tells the syntax. Null and empty texts have none."""
    if not text:
        return []
    return _indented(text) if (path or "").lower().endswith((".py", ".pyi")) else _braced(text)


_LICENCE = re.compile(r"copyright|spdx-license|licen[cs]ed under|all rights reserved|permission is hereby|without warrant|redistribution and use|\(c\)\s*\d{4}|©|licen[cs]e file", re.I)
_MARK = re.compile(r"^\W*(?:todo|fixme|xxx|hack|wip|tbd|待补充|待办|待完善|未完成)", re.I)
_ELSEWHERE = re.compile(r"^\W*(?:see|refer to|as (?:above|below|in)|same as|cf|ditto|likewise|inherited|inheritdoc|\{?@inheritdoc|@see|@copydoc|参见|同上|见上|详见|见下)(?:\b|(?<=[一-鿿]))", re.I)
_FILLER = re.compile(r"^\W*(?:docstring|doc ?string|documentation|description|n/?a|none|pass|null|nil|tba|empty|placeholder|missing|undocumented|no (?:docs?|documentation|description)|write docs?|add (?:docs?|description|documentation)|文档|说明|无|暂无|略)?\W*$", re.I)
_TAG = re.compile(r"^\s*(?:[@\\](?!brief\b|summary\b|desc\b|description\b)[A-Za-z]+|:[A-Za-z]+[^:\n]*:)")
_SECTION = re.compile(r"^\s*(?:args|arguments|params|parameters|returns?|raises|yields?|throws|attributes|examples?|notes?|todo|keyword args|other parameters|see also|参数|返回|返回值)\s*:\s*$|^\s*(?:parameters|returns?|raises|yields?|attributes)\s*$", re.I)
_CODE = re.compile(
    r"[;{}]\s*$|^\s*(?:if|for|while|elif|else|try|except|with|switch)\b.*[:{]\s*$|^\s*(?:return|raise|yield|break|continue|pass)\b\s*[\w.\[\]()-]*\s*;?\s*$|^\s*(?:import|from)\s+[\w.]+(?:\s+import\b.*)?$|^\s*#\s*(?:include|define|if)"
    r"|^\s*(?:[\w.\[\]\"'>*&-]+\s+)?[\w.\[\]\"'>-]+\s*(?:[+*/|&-]?=)(?!=)\s*\S.*$|^\s*[\w.]+(?:::\w+)*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*;?\s*$|^\s*(?:def|class|function|const|let|var|int|void|static|size_t|bool|char)\s+\w+.*[=(;:{]"
)
_WORDS = re.compile(r"[A-Za-z]+|[一-鿿]")
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_STOP = {"the", "a", "an", "this", "that", "function", "method", "routine", "func", "is", "of", "it", "for", "to", "and"}


def plain_documentation(raw: str | None) -> str:
    """The words of a documentation comment without comment marks, quotes and leading stars."""
    lines = []
    for line in (raw or "").split("\n"):
        line = re.sub(r"^\s*(?:/\*[*!]?|\*/|\*(?!/)|//[/!]?|#+|\"\"\"|'''|;+)[ \t]?", "", line.rstrip())
        line = re.sub(r"(?:\*/|\"\"\"|''')\s*$", "", line)
        lines.append(line.rstrip())
    return "\n".join(lines).strip("\n")


def _stem(word: str) -> str:
    word = word.lower()
    for end in ("ing", "ies", "es", "ed", "s", "e"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)]
    return word


def description(raw: str | None, name: str | None) -> str:
    """What a documentation says in words about the function ``name``; empty if it says nothing.

    Taken out: parameter tags and sections, licence notices, lines of code, sentences that are work marks, bare
    references, fillers, or nothing but the function's own name.
    """
    keep: list[str] = []
    in_section, licensed = False, False
    for line in plain_documentation(raw).split("\n"):
        if not line.strip():
            in_section = licensed = False
            keep.append("")
            continue
        if _SECTION.match(line):
            in_section = True
            continue
        if in_section or _TAG.match(line):
            continue
        if licensed or _LICENCE.search(line):
            licensed = True
            continue
        line = re.sub(r"[@\\](?:brief|summary|desc|description)\b", "", line)
        if _CODE.search(line):
            continue
        keep.append(line)
    own = {_stem(w) for w in _SPLIT.findall(re.split(r"[.:]", name or "")[-1])}
    said = []
    for sentence in re.split(r"(?<=[.!?])(?=\s|$)|(?<=[。！？；])|\n\s*\n", "\n".join(keep)):
        sentence = re.sub(r"\s+", " ", sentence).strip()
        if not sentence or _MARK.match(sentence) or _FILLER.match(sentence):
            continue
        if _ELSEWHERE.match(sentence) and len(_WORDS.findall(sentence)) <= 10:
            continue
        words = {_stem(w) for part in _WORDS.findall(sentence) for w in (_SPLIT.findall(part) or [part])} - {_stem(w) for w in _STOP}
        if not words - own:
            continue
        said.append(sentence)
    text = " ".join(said)
    words = _WORDS.findall(text)
    dense = sum("一" <= w <= "鿿" for w in words)
    return text if len(words) - dense >= 3 or dense >= 5 else ""


def pair(docstring: str | None, content: str | None, path: str | None, fqn: str | None, signature: str | None) -> tuple[str, str, str] | None:
    """(signature, body, description) of a chunk, or None if its documentation says nothing.

    The docstring column counts; where it is null or blank, the documentation found in the content by lexing it. The body
    is that of the function named by ``fqn`` (of the first one where that is null); if the content holds none of that name
    nothing of another function is taken, and the whole content stands for the body."""
    name = re.split(r"[.:]", fqn or "")[-1]
    found = functions_in(content, path)
    own = next((f for f in found if re.split(r"[.:]", f.name)[-1] == name), None if name else next(iter(found), None))
    raw = docstring if docstring and docstring.strip() else (own.documentation if own else "")
    text = description(raw, name or (own.name if own else ""))
    if not text:
        return None
    if own:
        return (signature or own.signature, own.body, text)
    return (signature or "", content or "", text)


def documented_functions(chunks: DataFrame) -> DataFrame:
    """project_id, chunk_id, signature, body, description of every function or method whose documentation says something.

    Columns used: project_id, id, symbol_kind, symbol_fqn, signature, docstring, content, file_path; others are ignored. Any
    may be null: a null kind is no function, a null docstring leaves the content to tell, with both null or empty there is
    no pair. Texts are lexed whole whatever their length. Repeated rows give repeated pairs, which the caller folds; an
    empty table gives no rows. One pass over Arrow batches; kinds are filtered at the scan."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("project_id", "chunk_id", "signature", "body", "description")])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for project, chunk, doc, content, path, fqn, signature in zip(*(c.to_pylist() for c in b.columns)):
                if p := pair(doc, content, path, fqn, signature):
                    rows.append((project, chunk, *p))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=schema.fieldNames())

    asked = chunks.where(F.col("symbol_kind").isin("function", "method")).select("project_id", "id", "docstring", "content", "file_path", "symbol_fqn", "signature")
    return asked.mapInArrow(extract, schema)
