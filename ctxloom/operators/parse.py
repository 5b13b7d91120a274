"""One file in, many rows out: symbols, edges, unresolved references, document blocks and chunks.

The functions here are pure and never raise; ``parse_files`` runs them over Arrow batches of files and returns nested
rows, from which the tables are exploded.
"""

from __future__ import annotations

import ast
import hashlib
import re
import warnings
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxloom.functions.classify import LANGUAGES, doctype_of, is_generated

#: Limits of fallback blocks and signatures (fixed values).
BLOCK_LINES, BLOCK_CHARS, SIGNATURE_LINES = 800, 40_000, 40
MODULE = "(module)"
#: Most attempts to go on behind a syntax error before a file counts as text (fixed value).
RECOVERIES = 40


def language_for(path: str) -> str | None:
    name = path.strip().lower().rsplit("/", 1)[-1]
    return LANGUAGES.get(name.rsplit(".", 1)[-1]) if "." in name else None


# ------------------------------------------------------------------------------------------------ Python


def _dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
        return ".".join(reversed(parts))
    return None


def recovered(text: str) -> tuple[ast.Module | None, list[str]]:
    """The tree of a Python text and its errors. A statement that does not parse gives way to ``pass``, with the block it
    opens, and parsing goes on; line numbers stay. None if nothing is left or errors do not end."""
    lines = text.split("\n")
    errors: list[str] = []
    gone: set[int] = set()

    def indent(k: int) -> int:
        return len(lines[k]) - len(lines[k].lstrip())

    for _ in range(RECOVERIES):
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse("\n".join(lines))
            held = any(not isinstance(n, ast.Pass) for n in tree.body)
            return (tree if held or not errors else None), errors
        except SyntaxError as e:
            bad = min(max((e.lineno or 1) - 1, 0), len(lines) - 1)
            if not errors or bad + 1 not in gone:
                errors.append(f"L{bad + 1}: {type(e).__name__}")
            while bad > 0 and (bad in gone or not lines[bad].strip()):
                bad -= 1  # the cause stands above what was taken out already
            if bad in gone:
                return None, errors
            depth = indent(bad)
            end = bad + 1
            while end < len(lines) and (not lines[end].strip() or indent(end) > depth):
                end += 1
            lines[bad] = " " * depth + "pass"
            gone.add(bad)
            for k in range(bad + 1, end):
                lines[k] = ""
                gone.add(k)
        except (ValueError, RecursionError, MemoryError) as e:
            return None, [*errors, f"L0: {type(e).__name__}"]
    return None, errors


def python_facts(path: str, text: str) -> dict:
    """Symbols, edges and unresolved references of a Python file. What stands around syntax errors is kept; a file without
    any part that parses is a fallback file."""
    tree, errors = recovered(text)
    if tree is None:
        return {"fallback": True, "errors": errors}
    exported: set[str] | None = None
    for node in tree.body:
        if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets) and isinstance(node.value, (ast.List, ast.Tuple)):
            exported = {e.value for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)}
    symbols, edges, open_refs = [], [], []

    def public(name: str, top: str) -> bool:
        return top in exported if exported is not None else not name.startswith("_")

    def edge(source: str, target: str, kind: str, line: int) -> None:
        edges.append((source, re.sub(r"\s+", " ", target.strip())[:120], kind, line, "parsed"))

    def visit(node: ast.AST, scope: list[str], in_class: bool) -> None:
        owner = ".".join(scope) or path
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                fqn = ".".join([*scope, child.name])
                start = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                is_class = isinstance(child, ast.ClassDef)
                kind = "class" if is_class else "method" if in_class else "function"
                symbols.append((child.name, fqn, kind, start, child.end_lineno, public(child.name, (scope or [child.name])[0])))
                if is_class:
                    for base in child.bases:
                        name = _dotted(base)
                        if name:
                            edge(fqn, name, "extends", child.lineno)
                        else:
                            open_refs.append((fqn, ast.unparse(base)[:120], "inherit", child.lineno))
                visit(child, [*scope, child.name], is_class)
                continue
            if isinstance(child, ast.Import):
                for a in child.names:
                    edge(owner, a.name, "imports", child.lineno)
            elif isinstance(child, ast.ImportFrom):
                base = "." * child.level + (child.module or "")
                for a in child.names:
                    edge(owner, f"{base}.{a.name}" if base.strip(".") else f"{base}{a.name}", "imports", child.lineno)
            elif isinstance(child, ast.AnnAssign) and not scope and isinstance(child.target, ast.Name):
                symbols.append((child.target.id, child.target.id, "variable", child.lineno, child.end_lineno, public(child.target.id, child.target.id)))
            elif isinstance(child, ast.Call):
                name = _dotted(child.func)
                if name in ("getattr", "setattr", "hasattr", "delattr") or (name or "").startswith("importlib."):
                    text_args = [a.value for a in child.args if isinstance(a, ast.Constant) and isinstance(a.value, str)]
                    open_refs.append((owner, text_args[0] if text_args else name, "call", child.lineno))
                elif name:
                    edge(owner, name, "calls", child.lineno)
                else:
                    open_refs.append((owner, ast.unparse(child.func)[:120], "call", child.lineno))
            visit(child, scope, False)

    visit(tree, [], False)
    return {"symbols": symbols, "edges": edges, "unresolved": open_refs, "errors": errors}


# ------------------------------------------------------------------------------------------------ C and C++

_NOISE = re.compile(r"//(?:\\\n|[^\n])*|/\*.*?(?:\*/|\Z)|R\"(?P<d>[^\s()\\]{0,16})\(.*?\)(?P=d)\"|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?", re.S)
_NOT_CALLS = {"if", "for", "while", "switch", "return", "sizeof", "catch", "defined", "alignof", "decltype", "static_assert", "throw", "new", "delete", "else", "do", "case", "operator", "void", "int", "char", "bool", "float", "double", "long", "short", "unsigned", "signed"}
_CALL = re.compile(r"([A-Za-z_]\w*(?:(?:::|\.|->)~?[A-Za-z_]\w*)*)\s*\(")
_FUNCTION = re.compile(r"([A-Za-z_~]\w*(?:::~?[A-Za-z_]\w*)*|operator\s*\S{1,3})\s*\(")
_TYPE = re.compile(r"\b(class|struct|union|enum(?:\s+(?:class|struct))?)\s+(?:[A-Z_]+\s+)?([A-Za-z_]\w*(?:::\w+)*)\s*(?:final\s*)?(?::([^:].*))?$", re.S)


def _masked(text: str) -> str:
    return _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


_CONDITION = re.compile(r"[ \t]*#[ \t]*(if|ifdef|ifndef|elif|elifdef|elifndef|else|endif)\b[ \t]*(.*)")


def _closed(lines: list[str]) -> bool:
    depth = 0
    for line in lines:
        for c in line:
            depth += (c == "{") - (c == "}")
            if depth < 0:
                return False
    return depth == 0


def one_branch(code: str) -> str:
    """``code`` (without comments and strings) with its braces in step: of the branches of a conditional the first live one
    stays, and of the others those whose braces close; the rest is blanked. ``#if 0`` is dead."""
    lines = code.split("\n")
    open_: list[dict] = []

    def end_branch(group: dict, at: int) -> None:
        own = range(group["from"] + 1, at)
        if group["dead"] or group["taken"] and not _closed([lines[k] for k in own]):
            for k in own:
                lines[k] = " " * len(lines[k])  # places stay
        elif not group["dead"]:
            group["taken"] = True

    for k, line in enumerate(lines):
        m = _CONDITION.match(line)
        if not m:
            continue
        word, rest = m.group(1), m.group(2).strip()
        if word.startswith("if"):
            open_.append({"from": k, "taken": False, "dead": word == "if" and rest == "0"})
        elif open_:
            end_branch(open_[-1], k)
            if word == "endif":
                open_.pop()
            else:
                open_[-1].update({"from": k, "dead": word == "elif" and rest == "0"})
    return "\n".join(lines)


def c_facts(path: str, text: str, cpp: bool) -> dict:
    """Symbols and edges of a C or C++ file by scopes of braces: functions, types with bodies, typedefs, macros, includes.

    Prototypes, globals and forward declarations are no symbols; namespaces are symbols and scopes, anonymous ones add no
    scope; ``static`` functions are not exported; methods defined outside their class are methods and not exported.
    """
    starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def line(at: int) -> int:
        return bisect_right(starts, at)

    symbols, edges, open_refs, errors = [], [], [], []
    sep = "::"
    for m in re.finditer(r"(?m)^[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*)(\([^)]*\))?((?:.*\\\n)*.*)$", text):
        symbols.append((m.group(1), m.group(1), "macro", line(m.start(1)), line(max(m.start(1), m.end() - 1)), True))
        if "##" in m.group(3) or "..." in (m.group(2) or ""):
            errors.append(f"L{line(m.start(1))}: macro uses ## and is not expanded")
    folder = path.rsplit("/", 1)[0] + "/" if "/" in path else ""
    for m in re.finditer(r"(?m)^[ \t]*#[ \t]*include[ \t]*(?:\"([^\"\n]+)\"|<([^>\n]+)>)", text):
        if m.group(1):
            edges.append((path, folder + m.group(1), "imports", line(m.start()), "parsed"))
        else:
            open_refs.append((path, m.group(2), "import", line(m.start())))
    code = one_branch(_masked(text))
    code = re.sub(r"(?m)^[ \t]*#(?:.*\\\n)*.*$", lambda m: re.sub(r"[^\n]", " ", m.group()), code)
    scope: list[tuple[str, str]] = []
    bases: dict[str, list[str]] = {}
    head = 0
    k = 0
    marks = [(m.start(), m.group()) for m in re.finditer(r"[{};]", code)]

    def close_of(i: int) -> int:
        depth = 0
        for j in range(i, len(marks)):
            depth += {"{": 1, "}": -1, ";": 0}[marks[j][1]]
            if depth == 0:
                return j
        return len(marks) - 1

    pointers: dict[str, set[str]] = {}
    for m in re.finditer(r"(?:\(\s*\*\s*([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*\)\s*\([^()]*\)|\.?\b([A-Za-z_]\w*)(?:\[[^\]]*\])?)\s*=\s*(\{[^{}]*\}|&?\s*[A-Za-z_]\w*\s*[;,}])", code):
        pointers.setdefault(m.group(1) or m.group(2), set()).update(re.findall(r"[A-Za-z_]\w*", m.group(3)))
    for m in re.finditer(r"\.([A-Za-z_]\w*)\s*=\s*&?\s*([A-Za-z_]\w*)\s*[,};]", code):
        pointers.setdefault(m.group(1), set()).add(m.group(2))

    while k < len(marks):
        at, mark = marks[k]
        if mark == "}":
            if scope:
                scope.pop()
            head = at + 1
        elif mark == ";":
            declared = code[head:at].strip()
            t = re.match(r"typedef\b.*?([A-Za-z_]\w*)\s*(?:\[[^\]]*\])*$", declared, re.S) or re.match(r"typedef\b.*?\(\s*\*\s*([A-Za-z_]\w*)\s*\)", declared, re.S)
            if t and "{" not in declared:
                symbols.append((t.group(1), sep.join([*(n for n, _ in scope if n), t.group(1)]), "typedef", line(head + len(code[head:at]) - len(code[head:at].lstrip())), line(at), True))
            head = at + 1
        else:
            raw = code[head:at]
            declared = re.sub(r"^\s*(?:(?:public|private|protected)\s*:\s*)+", "", raw)
            begin = at - len(declared.lstrip())
            declared = declared.strip()
            template = re.match(r"template\s*<.*?>\s*", declared, re.S)
            plain = declared[template.end() :] if template else declared
            names = [n for n, _ in scope if n]
            space = re.match(r"(?:inline\s+)?namespace\b\s*([\w:]*)", plain)
            kind = _TYPE.search(plain) if "(" not in plain or plain.lstrip().startswith(("class", "struct", "enum", "union")) else None
            fn = _FUNCTION.search(plain)
            end = close_of(k)
            if space:
                if space.group(1):
                    symbols.append((space.group(1), sep.join([*names, space.group(1)]), "namespace", line(begin), line(marks[end][0]), True))
                scope.append((space.group(1), "namespace"))
                head = at + 1
            elif re.match(r"extern\s*$", plain):
                scope.append(("", "extern"))
                head = at + 1
            elif kind and not plain.startswith("typedef struct {"):
                word, name, base = kind.group(1).split()[0], kind.group(2), kind.group(3)
                fqn = sep.join([*names, name])
                symbols.append((name.split(sep)[-1], fqn, word, line(begin), line(marks[end][0]), True))
                for b in re.split(r",(?![^<]*>)", base or ""):
                    target = re.sub(r"\b(?:public|private|protected|virtual)\b", "", b).strip()
                    target = re.sub(r"<.*", "", target).strip()
                    if target and word != "enum":
                        edges.append((fqn, target[:120], "extends", line(at), "parsed"))
                        bases.setdefault(fqn, []).append(target)
                if word == "enum":
                    head, k = marks[end][0] + 1, end
                else:
                    scope.append((name, word))
                    head = at + 1
            elif fn and fn.group(1).split(sep)[-1] not in _NOT_CALLS and "=" not in plain[: fn.start()]:
                name = re.sub(r"\s+", "", fn.group(1))
                inside = any(w in ("class", "struct") for _, w in scope)
                outside = sep in name
                fqn = sep.join([*names, name])
                static = re.match(r"(?:\w+\s+)*static\b", plain) is not None
                symbols.append((name.split(sep)[-1], fqn, "method" if inside or outside else "function", line(begin), line(marks[end][0]), not static and not outside))
                body_at = at + 1
                for c in _CALL.finditer(code, body_at, marks[end][0]):
                    target = c.group(1).replace("->", ".")
                    if re.split(r"::|\.", target)[0] not in _NOT_CALLS:
                        edges.append((fqn, target[:120], "calls", line(c.start()), "parsed"))
                if cpp and re.search(r"\boverride\b", plain):
                    owner = sep.join(names)
                    for b in bases.get(owner, ["?"]):
                        hit = [s for s in symbols if s[1].endswith(f"{b}::{name}")]
                        if hit:
                            edges.append((fqn, hit[0][1], "overrides", line(begin), "synthesized"))
                        else:
                            open_refs.append((fqn, f"{b}::{name}", "reference", line(begin)))
                head, k = marks[end][0] + 1, end
            else:
                head, k = marks[end][0] + 1, end
        k += 1
    functions = {s[0]: s[1] for s in symbols if s[2] in ("function", "method")}
    for source, target, kind, at_line, _ in list(edges) if pointers else ():
        name = re.split(r"::|\.", target)[-1]
        if kind == "calls" and name in pointers and name not in functions:
            # a call through a pointer may reach every function the file assigns to it
            edges += [(source, functions[f], "calls", at_line, "synthesized") for f in sorted(pointers[name]) if f in functions]
    return {"symbols": symbols, "edges": edges, "unresolved": open_refs, "errors": errors}


# ------------------------------------------------------------------------------------------------ Markdown

_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_MENTIONS = [re.compile(p) for p in (r"\b[a-z]+(?:[A-Z][a-z0-9]*)+\b|\b(?:[A-Z][a-z0-9]+){2,}\b", r"\b[A-Za-z]\w*(?:::\w+)+\b", r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b", r"\b[\w.-]+(?:/[\w.-]+)+\.\w+\b")]


def _fence(line: str) -> tuple[str, int, str] | None:
    """The sign, length and info string of a code fence: up to three blanks, three or more equal signs; no backquote may
    follow in the info string of a fence of backquotes."""
    bare = line.lstrip(" ")
    sign = bare[:1]
    if len(line) - len(bare) > 3 or sign not in ("`", "~"):
        return None
    info = bare.lstrip(sign)
    size = len(bare) - len(info)
    return None if size < 3 or sign == "`" and "`" in info else (sign, size, info)


def markdown_blocks(path: str, text: str) -> list[dict]:
    """Front matter, preamble, and one block per ATX heading outside fences, up to the next heading of its level or above."""
    lines = text.splitlines()
    blocks: list[dict] = []
    body = 0
    if lines and lines[0].strip() == "---":
        closing = next((i for i in range(1, len(lines)) if lines[i].strip() == "---"), None)
        if closing is not None:
            blocks.append({"heading": "", "heading_path": "(front matter)", "level": 0, "start_line": 1, "end_line": closing + 1, "content": "\n".join(lines[1:closing])})
            body = closing + 1
    heads: list[tuple[int, int, str]] = []
    fences: list[dict] = []
    i = body
    while i < len(lines):
        f = _fence(lines[i])
        if f:
            j = i + 1
            while j < len(lines):
                c = _fence(lines[j])
                if c and c[0] == f[0] and c[1] >= f[1] and not c[2].strip():
                    break
                j += 1
            info = f[2].split()
            fences.append({"lang": info[0] if info else "", "content": "\n".join(lines[i + 1 : j]), "line": i + 1})
            i = j + 1
            continue
        h = _ATX.match(lines[i])
        if h:
            heads.append((i + 1, len(h.group(1)), (h.group(2) or "").strip()))
        i += 1
    first = heads[0][0] - 1 if heads else len(lines)
    preamble = "\n".join(lines[body:first])
    if preamble.strip():
        blocks.append({"heading": "", "heading_path": "(preamble)", "level": 0, "start_line": body + 1, "end_line": first, "content": preamble})
    above: list[tuple[int, str]] = []
    ends = [len(lines)] * len(heads)
    waiting: list[int] = []
    for k, (at, level, _) in enumerate(heads):
        while waiting and heads[waiting[-1]][1] >= level:
            ends[waiting.pop()] = at - 1
        waiting.append(k)
    for (at, level, title), end in zip(heads, ends):
        above = [a for a in above if a[0] < level] + [(level, title)]
        blocks.append({"heading": title, "heading_path": " > ".join(t for _, t in above), "level": level, "start_line": at, "end_line": end, "content": "\n".join(lines[at - 1 : end])})
    firsts = [b["start_line"] for b in blocks]  # ascending, so the innermost block of a line is the last that starts before it
    held: dict[int, list[dict]] = {}
    for f in fences:
        held.setdefault(bisect_right(firsts, f["line"]) - 1, []).append(f)
    for k, b in enumerate(blocks):
        b["code_fences"] = held.get(k, [])
        said = [(m.start(1), m.group(1).strip()) for m in re.finditer(r"`([^`\n]+)`", b["content"])]
        said += [(m.start(), m.group()) for p in _MENTIONS for m in p.finditer(b["content"])]
        b["mentioned"] = list(dict.fromkeys(v for _, v in sorted(said, key=lambda x: x[0]) if v))
        b["doctype"] = doctype_of(path)
        b["id"] = f"{path}:{b['heading_path']}:{b['start_line']}"
    return blocks


# ------------------------------------------------------------------------------------------------ chunks


def fallback_blocks(text: str, lines: int = BLOCK_LINES, chars: int = BLOCK_CHARS) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of blocks within the limits whose concatenation is the text.

    Cuts fall after blank lines where possible, else after lines, else after blanks, else anywhere; neighbouring pieces
    are gathered greedily."""

    def fits(s: str) -> bool:
        return len(s) <= chars and s.count("\n") + (not s.endswith("\n")) <= lines

    def pieces(s: str, seps: tuple[str, ...]) -> Iterator[str]:
        if fits(s):
            yield s
            return
        for n, sep in enumerate(seps):
            parts = [p for p in re.split(f"(?<={re.escape(sep)})", s) if p]
            if len(parts) > 1:
                held = ""
                for p in parts:
                    if held and not fits(held + p):
                        yield held
                        held = ""
                    if fits(p):
                        held += p
                    else:
                        yield from pieces(p, seps[n + 1 :])
                if held:
                    yield held
                return
        for a in range(0, len(s), chars):
            yield s[a : a + chars]

    out, at = [], 0
    for p in pieces(text, ("\n\n", "\n", " ")) if text else ():
        first = text.count("\n", 0, at) + 1
        out.append((first, text.count("\n", 0, at + len(p) - 1) + 1, p))
        at += len(p)
    return out


def _python_head(lines: list[str], start: int, end: int) -> tuple[str, str]:
    depth, k = 0, start
    last = min(end, start + SIGNATURE_LINES - 1)
    while k <= last:
        bare = re.sub(r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|#.*", "", lines[k - 1])
        depth += sum(map(bare.count, "([{")) - sum(map(bare.count, ")]}"))
        if depth <= 0 and bare.rstrip().endswith(":"):
            break
        k += 1
    k = min(k, last)
    rest = "\n".join(lines[k:end])
    m = re.match(r"\s*[rRuUbBfF]{0,3}(\"\"\"|'''|\"|')", lines[k]) if k < end else None
    doc = ""
    if m:
        body = rest[m.end() :]
        doc = body.split(m.group(1), 1)[0].strip() if m.group(1) in body else body.strip()
    return "\n".join(lines[start - 1 : k]).rstrip(), doc


def _c_head(lines: list[str], start: int, end: int) -> str:
    taken = []
    for line in lines[start - 1 : min(end, start + SIGNATURE_LINES - 1)]:
        cut = re.search(r"[{;]", re.sub(r"\"(?:\\.|[^\"\\])*\"", lambda m: " " * len(m.group()), line))
        taken.append(line[: cut.start()].rstrip() if cut else line)
        if cut:
            break
    return "\n".join(taken).strip() or lines[start - 1].strip()


def chunks_of(path: str, text: str, language: str | None, facts: dict, blocks: list[dict]) -> list[dict]:
    """Chunks of a file: symbols (classes as skeletons up to their first member), document blocks, and fallback blocks for the rest."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = text.splitlines()
    out: list[dict] = []
    covered: list[tuple[int, int]] = []

    def add(fqn: str, kind: str, start: int, end: int, signature: str, docstring: str, content: str | None = None) -> None:
        content = "\n".join(lines[start - 1 : end]) if content is None else content
        out.append({"id": f"{path}:{fqn}:{start}", "symbol_fqn": fqn, "symbol_kind": kind, "start_line": start, "end_line": end, "signature": signature, "docstring": docstring, "content": content, "content_hash": hashlib.sha256(content.encode("utf-8", "replace")).hexdigest()})

    if language == "markdown" and blocks:
        for b in blocks:
            add(b["heading_path"], "spec_block", b["start_line"], b["end_line"], b["heading"], "", b["content"])
            covered.append((b["start_line"], b["end_line"]))
    elif not facts.get("fallback"):
        symbols = [s for s in facts.get("symbols", ()) if s[2] not in ("namespace", "macro", "typedef", "variable") and 1 <= s[3] <= s[4]]
        members: dict[str, list[int]] = {}
        for s in sorted(symbols, key=lambda s: s[3]):
            for m in re.finditer(r"\.|::", s[1]):
                members.setdefault(s[1][: m.start()], []).append(s[3])
        for name, fqn, kind, start, end, _ in sorted(symbols, key=lambda s: (s[3], s[4], s[1])):
            end = min(end, len(lines))
            if start > end:
                continue
            if kind in ("class", "struct"):
                mine = members.get(fqn, [])
                at_first = bisect_left(mine, start)
                first = mine[at_first] if at_first < len(mine) and mine[at_first] <= end else None
                if kind == "class" or first is not None:
                    kind = "class_skeleton"
                    if first is not None and first > start:
                        end = first - 1
            signature, doc = _python_head(lines, start, end) if language == "python" else (_c_head(lines, start, end), "")
            add(fqn, kind, start, end, signature, doc)
            covered.append((start, end))
    at = 1
    spans = [*sorted(covered), (len(lines) + 1, len(lines) + 1)]
    for start, end in spans:
        if start > at:
            for a, b, part in fallback_blocks("\n".join(lines[at - 1 : start - 1])):
                if part.strip():
                    add(MODULE, "fallback_block", at + a - 1, at + b - 1, "", "", part)
        at = max(at, end + 1)
    seen: dict[str, int] = {}
    for c in sorted(out, key=lambda c: (c["start_line"], c["end_line"], c["id"])):
        seen[c["id"]] = seen.get(c["id"], 0) + 1
        if seen[c["id"]] > 1:
            c["id"] += f"#{seen[c['id']]}"
    return sorted(out, key=lambda c: (c["start_line"], c["end_line"], c["id"]))


def parse_file(path: str, content: bytes | None) -> dict:
    """Everything about one file. Never raises: a failure leaves a fallback file with the error recorded."""
    text = (content or b"").decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
    language = language_for(path)
    facts: dict = {"fallback": True} if language in (None, "markdown") else {}
    blocks: list[dict] = []
    try:
        if language == "python":
            facts = python_facts(path, text)
        elif language in ("c", "cpp"):
            facts = c_facts(path, text, language == "cpp")
        elif language == "markdown":
            blocks = markdown_blocks(path, text)
        chunks = chunks_of(path, text, language, facts, blocks)
    except Exception as e:  # a file that breaks its extractor is indexed as plain text
        facts, blocks = {"fallback": True, "errors": [f"{type(e).__name__}: {e}"]}, []
        chunks = chunks_of(path, text, None, facts, [])
    ids = {c["symbol_fqn"] + ":" + str(c["start_line"]): c["id"] for c in chunks}
    symbols = [
        {"id": f"{path}:{fqn}:{start}", "name": name, "fqn": fqn, "kind": kind, "start_line": start, "end_line": end, "is_exported": bool(exp), "chunk_id": ids.get(f"{fqn}:{start}")}
        for name, fqn, kind, start, end, exp in dict.fromkeys(facts.get("symbols", ()))
    ]
    return {
        "language": language or "fallback",
        "content_hash": hashlib.sha256(content or b"").hexdigest(),
        "parse_errors": facts.get("errors", []),
        "symbols": symbols,
        "edges": [dict(zip(("source_fqn", "target_name", "kind", "line", "provenance"), e)) for e in sorted(set(facts.get("edges", ())))],
        "unresolved": [dict(zip(("from_fqn", "name", "kind", "line"), u)) for u in sorted(set(facts.get("unresolved", ())))],
        "spec_blocks": blocks,
        "chunks": chunks,
    }


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()
PARSED = T.StructType(
    [
        T.StructField("project_id", _S),
        T.StructField("path", _S),
        T.StructField("language", _S),
        T.StructField("generated", _B),
        T.StructField("content_hash", _S),
        T.StructField("parse_errors", T.ArrayType(_S)),
        T.StructField("symbols", T.ArrayType(_struct(id=_S, name=_S, fqn=_S, kind=_S, start_line=_I, end_line=_I, is_exported=_B, chunk_id=_S))),
        T.StructField("edges", T.ArrayType(_struct(source_fqn=_S, target_name=_S, kind=_S, line=_I, provenance=_S))),
        T.StructField("unresolved", T.ArrayType(_struct(from_fqn=_S, name=_S, kind=_S, line=_I))),
        T.StructField("spec_blocks", T.ArrayType(_struct(id=_S, heading=_S, heading_path=_S, level=_I, start_line=_I, end_line=_I, content=_S, doctype=_S, code_fences=T.ArrayType(_struct(lang=_S, content=_S, line=_I)), mentioned=T.ArrayType(_S)))),
        T.StructField("chunks", T.ArrayType(_struct(id=_S, symbol_fqn=_S, symbol_kind=_S, start_line=_I, end_line=_I, signature=_S, docstring=_S, content=_S, content_hash=_S))),
    ]
)


def parse_files(blobs: DataFrame) -> DataFrame:
    """``blobs`` (project_id, path, content) parsed, one nested row per file; nothing is shuffled.

    Whether a file was generated is told by its path and its head in the plan, before the parser sees it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [parse_file(p, bytes(c) if c is not None else None) for p, c in zip(f["path"], f["content"])]
            out = pd.DataFrame(rows, columns=[n for n in PARSED.fieldNames() if n not in f.columns])
            for name in ("project_id", "path", "generated"):
                out[name] = f[name].to_numpy()
            yield out[PARSED.fieldNames()]

    text = F.make_valid_utf8(F.col("content").cast("string"))
    told = F.coalesce(is_generated(F.col("path"), F.regexp_replace(text, "\r\n?", "\n")), F.lit(False))
    return blobs.where("path is not null").select("project_id", "path", "content", told.alias("generated")).mapInPandas(run, PARSED)


def explode(parsed: DataFrame, part: str) -> DataFrame:
    """One of the tables of parsed files: symbols, edges, unresolved, spec_blocks or chunks."""
    return parsed.select("project_id", F.col("path").alias("file_path"), F.explode(part).alias("_x")).select("project_id", "file_path", "_x.*")
