"""Source files that do not parse: lexers, folding of groups, and the check of whole files against bundled grammars."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxloom.llm import grammars
from ctxloom.llm.chart import Grammar
from ctxloom.tables import current_files, cut

#: Extension -> grammar family; a path without one of these is only searched for merge markers.
FAMILIES = {
    "py": "python", "pyi": "python", "c": "c", "h": "c", "cc": "c", "cpp": "c", "cxx": "c", "hpp": "c", "hh": "c", "hxx": "c", "js": "js", "mjs": "js", "cjs": "js",
    "json": "json", "toml": "toml", "yaml": "yaml", "yml": "yaml", "ini": "ini", "cfg": "ini", "env": "env", "md": "markdown", "markdown": "markdown",
}
#: The indexer's language names that fix the family whatever the extension.
LANGUAGES = {"python": "python", "c": "c", "cpp": "c", "markdown": "markdown"}

_MERGE = re.compile(r"^(?:<{7}|>{7})(?: |$)", re.M)
Error = tuple[int, str]


class Broken(Exception):
    """The first error of a file: a place in the text and what is wrong."""

    def __init__(self, at: int, why: str):
        self.at, self.why = at, why


class _Lazy:
    def __init__(self) -> None:
        self._made: dict[str, Grammar] = {}

    def __getitem__(self, name: str) -> Grammar:
        if name not in self._made:
            self._made[name] = Grammar(getattr(grammars, name))
        return self._made[name]


_GRAMMARS = _Lazy()


class _Lexemes(dict):
    """Token text -> kind; unseen tokens are classified once."""

    def __init__(self, classify):
        super().__init__()
        self.classify = classify

    def __missing__(self, token: str) -> str:
        kind = self.classify(token)
        if len(self) < 300_000 and len(token) < 80:
            self[token] = kind
        return kind


_PY = re.compile(
    r"[ \t\f]+|#[^\n]*|\\\n|\n|[rRbBuUfFtT]{0,2}(?:\"\"\"(?:\\[\s\S]|[^\\])*?\"\"\"|'''(?:\\[\s\S]|[^\\])*?''')|[rRbBuUfFtT]{0,2}(?:\"\"\"[\s\S]*|'''[\s\S]*)"
    r"|[fFtT][rR]?(?:\"(?:\\[\s\S]|\{\{|\{(?:[^{}\n]|\{[^{}\n]*\})*\}|[^\"\\\n{])*\"|'(?:\\[\s\S]|\{\{|\{(?:[^{}\n]|\{[^{}\n]*\})*\}|[^'\\\n{])*')"
    r"|[rRbBuUfFtT]{0,2}(?:\"(?:\\[\s\S]|[^\"\\\n])*\"|'(?:\\[\s\S]|[^'\\\n])*')|[rRbBuUfFtT]{0,2}[\"'][^\n]*|[^\W\d]\w*"
    r"|0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[jJ]?"
    r"|\*\*=|//=|>>=|<<=|\.\.\.|->|:=|!=|==|<=|>=|\*\*|//|<<|>>|[-+*/%@&|^]=|[-+*/%@&|^~<>()\[\]{},:;.=]|[\s\S]"
)
_PY_WORDS = set("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type".split()) - {"False", "None", "True"}
_PY_SIGNS = {"=", "*", "**", "-", "+", "~", "@", ".", "...", ",", ":", ";", ":=", "->", "(", ")", "[", "]", "{", "}"}


def _py_kind(t: str) -> str:
    c = t[0]
    if c in " \t\f" or t == "\\\n" or c == "#":
        return ""
    if c == "\n":
        return "\n"
    if c.isalpha() or c == "_":
        if t[-1] in "\"'" and len(t) > 1:
            return _py_text(t)
        if '"' in t or "'" in t:
            return "!unterminated text"
        return t if t in _PY_WORDS else "n"
    if c in "\"'":
        return _py_text(t)
    if c.isdigit() or (c == "." and len(t) > 1 and t != "..."):
        return "!number with a leading zero" if re.fullmatch(r"0[0-9_]*[1-9][0-9_]*", t) else "0"
    if t in _PY_SIGNS:
        return t
    if len(t) > 1 and t[-1] == "=" and t not in ("==", "!=", "<=", ">="):
        return "aug"
    if t in ("==", "!=", "<=", ">=", "<", ">", "/", "//", "%", "&", "|", "^", "<<", ">>"):
        return "o"
    return "!stray character"


def _py_text(t: str) -> str:
    body = t.lstrip("rRbBuUfFtT")
    if body[:3] in ('"""', "'''"):
        return "s" if len(body) >= 6 and body.endswith(body[:3]) else "!unterminated text"
    if len(body) < 2 or body[-1] != body[0]:
        return "!unterminated text"
    back = len(body) - 1 - len(body[:-1].rstrip("\\"))
    return "s" if back % 2 == 0 and "\n" not in re.sub(r"\\\n", "", body) else "!unterminated text"


_PY_LEX = _Lexemes(_py_kind)
_PAIR = {")": "(", "]": "[", "}": "{"}
_PY_GROUPS = {"(": (("E", "round_e"), ("P", "round_p"), ("I", "round_i"), ("W", "round_w")), "[": (("E", "square_e"), ("S", "square_s")), "{": (("E", "curly_e"),)}
#: clause -> clauses that may follow its block at the same depth, and whether it may end there.
_NEXT = {
    "if": ({"elif", "else"}, True), "elif": ({"elif", "else"}, True), "for": ({"else"}, True), "while": ({"else"}, True), "try": ({"except", "finally"}, False),
    "except": ({"except", "else", "finally"}, True), "else": (set(), True), "try-else": ({"finally"}, True), "finally": (set(), True),
}
_CLAUSES = {"elif", "else", "except", "finally"}
_HEADS = {"if", "elif", "else", "for", "while", "try", "except", "finally", "with", "def", "class", "async", "match", "case"}
_LONG = re.compile(r"((?:\S+ ){1,8}?, )\1{2,}")


def _short(kinds: tuple[str, ...]) -> tuple[str, ...]:
    """Runs of equal list items cut to two: a list of one shape is a list whatever its length."""
    if len(kinds) < 24:
        return kinds
    return tuple(_LONG.sub(r"\1\1", " ".join(kinds) + " ").split())


def _group(g: Grammar, choices, kinds: list[str], places: list[int], opener: str, at: int) -> str:
    content = _short(tuple(kinds))
    letters, best = "", -1
    for letter, rule in choices:
        e = g.error(rule, content)
        if e < 0:
            letters += letter
        elif e > best:
            best = e
    if not letters:
        if len(content) != len(kinds):
            best = max(g.error(rule, tuple(kinds)) for _, rule in choices)
        raise Broken(places[best] if best < len(places) else at, "unexpected token in " + {"(": "round", "[": "square", "{": "curly"}[opener] + " brackets")
    return opener + letters


def _python(text: str) -> None:
    g = _GRAMMARS["PYTHON"]
    if "\0" in text:
        raise Broken(text.index("\0"), "null byte")
    tokens = _PY.findall(text)
    lex = _PY_LEX
    kinds: list[str] = []
    places: list[int] = []
    stack: list[tuple[str, int, list[str], list[int]]] = []
    indents = [0]
    # per depth: the clause whose block was last closed there, and whether a decorator waits
    pending: list[str] = [""]
    decorated = [False]
    expect = False
    at = 0
    indent = 0
    fresh = True
    before = ""

    def finish(where: int) -> None:
        nonlocal expect
        line = tuple(kinds)
        e = g.error("line", _short(line))
        if e >= 0:
            e = min(g.error("line", line) if len(_short(line)) != len(line) else e, len(places))
            raise Broken(places[e] if e < len(places) else where, "invalid syntax")
        head = line[0]
        block = line[-1] == ":" and (head in _HEADS)
        if expect:
            if indent <= indents[-1]:
                raise Broken(places[0], "expected an indented block")
            indents.append(indent)
            pending.append("")
            decorated.append(False)
        elif indent > indents[-1]:
            raise Broken(places[0], "unexpected indent")
        while indent < indents[-1]:
            if not _may_end(pending[-1]):
                raise Broken(places[0], "expected 'except' or 'finally' block")
            if decorated[-1]:
                raise Broken(places[0], "decorator without a definition")
            indents.pop()
            pending.pop()
            decorated.pop()
        if indent != indents[-1]:
            raise Broken(places[0], "unindent does not match any outer level")
        word = line[1] if head == "async" else head
        if word == "else" and pending[-1] == "except":
            word_now = "try-else"
        else:
            word_now = word
        if head in _CLAUSES:
            if word not in _NEXT.get(pending[-1], (set(), True))[0]:
                raise Broken(places[0], f"'{word}' without a fitting block")
            pending[-1] = word_now
        else:
            if not _may_end(pending[-1]):
                raise Broken(places[0], "expected 'except' or 'finally' block")
            pending[-1] = word if word in _NEXT and (block or head in _HEADS) else ""
        if decorated[-1] and word not in ("def", "class", "@"):
            raise Broken(places[0], "decorator without a definition")
        decorated[-1] = word == "@"
        expect = block

    for token in tokens:
        kind = lex[token]
        if kind == "":
            if fresh and token[0] in " \t\f":
                indent = len(token.replace("\f", "").expandtabs(8))
                fresh = False
            elif fresh and token[0] != "#":
                fresh = False
            before = ""
        elif kind == "\n":
            if not stack:
                if kinds:
                    finish(at)
                    kinds, places = [], []
                fresh, indent = True, 0
            before = ""
        else:
            fresh = False
            c = kind[0]
            if c == "!" and len(kind) > 2:
                raise Broken(at, kind[1:])
            if kind in "([{":
                stack.append((kind, at, kinds, places))
                kinds, places = [], []
            elif kind in ")]}":
                if not stack or stack[-1][0] != _PAIR[kind]:
                    raise Broken(at, f"unmatched '{kind}'")
                opener, start, outer, outer_places = stack.pop()
                folded = _group(g, _PY_GROUPS[opener], kinds, places, opener, at)
                kinds, places = outer, outer_places
                kinds.append(folded)
                places.append(start)
            else:
                if before == "0" and (kind == "n" or kind == "0"):
                    raise Broken(at, "invalid number")
                kinds.append(kind)
                places.append(at)
            before = kind
        at += len(token)
    if stack:
        raise Broken(stack[-1][1], f"'{stack[-1][0]}' was never closed")
    if kinds:
        finish(at)
    if expect:
        raise Broken(at, "expected an indented block")
    if not all(_may_end(p) for p in pending):
        raise Broken(at, "expected 'except' or 'finally' block")
    if any(decorated):
        raise Broken(at, "decorator without a definition")


def _may_end(clause: str) -> bool:
    return _NEXT.get(clause, (set(), True))[1]


_C = re.compile(
    r"[ \t\f\v\r]+|\\\n|\n|//(?:\\\n|[^\n])*|/\*[\s\S]*?\*/|/\*[\s\S]*|(?:u8|[uUL])?R\"(?P<d>[^\s()\\]{0,16})\([\s\S]*?\)(?P=d)\"|(?:u8|[uUL])?\"(?:\\[\s\S]|[^\"\\\n])*\"(?:_\w+)?|(?:u8|[uUL])?'(?:\\[\s\S]|[^'\\\n])+'|[\"'][^\n]*"
    r"|operator\s*(?:\(\s*\)|\[\s*\]|new\b|delete\b|co_await\b|<=>|->\*?|<<=?|>>=?|&&|\|\||\+\+|--|[-+*/%^&|=!<>]=|[-+*/%^&|~!=<>,])|[^\W\d][\w$]*|\.?\d(?:'?[\w.]|[eEpP][+-])*"
    r"|\.\.\.|<=>|<<=|>>=|->\*|::|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%^&|]=|##|[\s\S]"
)
_T_WORDS = set("void int char short long float double signed unsigned bool _Bool const volatile static extern inline register auto constexpr consteval constinit mutable virtual explicit friend typename thread_local restrict wchar_t char8_t char16_t char32_t _Noreturn __inline __inline__ __restrict __volatile__ _Atomic _Thread_local decltype".split()) - {"decltype"}
_C_WORDS = {
    **{w: "t" for w in _T_WORDS}, **{w: "c" for w in ("struct", "union", "enum", "class")}, **{w: "a" for w in ("public", "private", "protected")}, **{w: "v" for w in ("this", "nullptr", "true", "false")},
    **{w: "u" for w in ("sizeof", "alignof", "_Alignof", "new", "delete", "throw", "co_await", "co_yield", "co_return")}, **{w: "q" for w in ("override", "final", "noexcept")},
    **{w: w for w in ("if", "else", "for", "do", "while", "switch", "case", "default", "return", "break", "continue", "goto", "typedef", "using", "namespace", "template", "try", "catch")},
}
_MACRO = re.compile(r"__\w+|[A-Z][A-Z0-9]*_[A-Z0-9_]+|[A-Z]{4,}")
_C_SIGNS = {"*", "&", "&&", "-", "+", "!", "~", "++", "--", ".", "->", "::", ",", ";", ":", "...", "?", "<", ">", "(", ")", "[", "]", "{", "}"}


def _c_kind(t: str) -> str:
    c = t[0]
    if c in " \t\f\v\r\n" or t.startswith(("//", "\\\n")):
        return ""
    if t.startswith("/*"):
        return "" if len(t) >= 4 and t.endswith("*/") else "!unterminated comment"
    if t.startswith("operator") and not re.fullmatch(r"\w+", t):
        return "n"
    if c in "\"'" or (c in "uULR" and len(t) > 2 and t.find('"') >= 0) or (c in "uUL" and len(t) > 2 and t[-1] == "'"):
        if c in "\"'" and (len(t) < 2 or not re.search(r"[\"'](?:_\w+)?$", t)):
            return "!unterminated text"
        return "s" if c not in "\"'" or re.fullmatch(r"\"(?:\\[\s\S]|[^\"\\\n])*\"(?:_\w+)?|'(?:\\[\s\S]|[^'\\\n])+'", t) else "!unterminated text"
    if c.isalpha() or c in "_$":
        return _C_WORDS.get(t) or ("M" if _MACRO.fullmatch(t) else "n")
    if c.isdigit() or (c == "." and len(t) > 1 and t[1].isdigit()):
        return "0"
    if t in _C_SIGNS:
        return t
    if t == ">>":
        return "rr"
    if t in ("=", "==", "!=", "<=", ">=", "<<", "/", "%", "|", "^", "||", "<=>", "->*", "##") or (len(t) > 1 and t[-1] == "="):
        return "o"
    return "!stray character"


_C_LEX = _Lexemes(_c_kind)
_DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(?:(include|include_next|define|undef|if|ifdef|ifndef|elif|elifdef|elifndef|else|endif|error|warning|pragma|line|ident|import|embed|region|endregion|\d+)\b|$)")


_C_HIDDEN = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|/\*[\s\S]*?\*/|//.*")


def _lines(text: str) -> Iterator[tuple[str, tuple[str, str, int] | None]]:
    """Lines as they stand with None, and directives blanked with their word, what follows it, and their place."""
    at, k = 0, 0
    comment = hidden = False  # inside a comment; inside one that a directive began
    lines = text.split("\n")
    while k < len(lines):
        line = lines[k]
        if hidden:
            end = line.find("*/") + 2
            hidden = end < 2
            yield " " * (end if end >= 2 else len(line)) + line[end:] * (end >= 2), None
            comment = end >= 2 and "/*" in _C_HIDDEN.sub(" ", line[end:])
        elif not comment and line.lstrip().startswith("#"):
            whole = [line]
            while whole[-1].endswith("\\") and k + 1 < len(lines):
                k += 1
                whole.append(lines[k])
            joined = "\n".join(whole)
            m = _DIRECTIVE.match(line)
            naked = _C_HIDDEN.sub(lambda c: " " if c.group()[0] == "/" else c.group(), joined)
            hidden = "/*" in _C_HIDDEN.sub(" ", joined)
            rest = _DIRECTIVE.sub("", naked.replace("\\\n", " "), count=1).split("/*")[0]
            yield re.sub(r"[^\n]", " ", joined), ((m.group(1) or "") if m else "?", " ".join(rest.split()), at)
            at += len(joined) - len(lines[k])
        else:
            yield line, None
            if comment:
                if "*/" in line:
                    comment = "/*" in line[line.rindex("*/") :]
            elif "/*" in line:
                comment = "/*" in _C_HIDDEN.sub(" ", line)
        at += len(lines[k]) + 1
        k += 1
    if hidden:
        raise Broken(len(text), "unterminated comment")


def _condition(word: str, rest: str) -> tuple[str, bool]:
    """What a branch asks, and whether it is taken if that is so; the question '' is always so."""
    if word.endswith("def"):
        return "defined " + rest.split(" ")[0], not word.endswith("ndef")
    want = True
    while m := re.fullmatch(r"!\s*(defined\b.*|\w+|\(.*\))|\(([^()]*|\s*defined\s*\(\s*\w+\s*\)\s*)\)", rest):
        if m.group(1) and not re.fullmatch(r"defined\s*\(?\s*\w+\s*\)?|\w+|\([^()]*(?:\([^()]*\)[^()]*)*\)", m.group(1)):
            break
        want, rest = want != bool(m.group(1)), (m.group(1) or m.group(2) or "").strip()
    if m := re.fullmatch(r"defined\s*\(?\s*(\w+)\s*\)?", rest):
        return "defined " + m.group(1), want
    if re.match(r"(?:0[uUlL]*|false)\s*(?:$|&&(?!.*\|\|))", rest):
        return "", not want
    return ("", want) if re.fullmatch(r"[1-9]\d*[uUlL]*|true", rest) else (rest, want)


def _preprocess(text: str) -> Iterator[str]:
    """The text with directives blanked, places unchanged, once per choice of branches until each that can be taken was kept.

    A question is answered alike throughout a choice. Branches that none can take, as under '#if 0', are blank in all."""
    if "#" not in text:
        yield text
        return
    pieces = list(_lines(text))
    branches: list[tuple[str, bool, list[int], list[tuple[str, bool]]]] = []  # question, answer, itself and those around, all answers needed
    later: list[list[int]] = []  # per branch the branches of its conditional
    starts: dict[int, int] = {}  # piece -> branch
    opened: list[tuple[int, list[int], list[tuple[str, bool]], list[int], list[tuple[str, bool]], bool]] = []
    for k, (_, directive) in enumerate(pieces):
        word, rest, at = directive or ("", "", 0)
        if word in ("if", "ifdef", "ifndef"):
            around = branches[opened[-1][1][-1]] if opened else ("", True, [], [])
            opened.append((at, [], around[3], around[2], [], False))
        elif word in ("else", "elif", "elifdef", "elifndef", "endif"):
            if not opened:
                raise Broken(at, f"#{word} without #if")
            if word == "endif":
                opened.pop()
                continue
            if opened[-1][5]:
                raise Broken(at, f"#{word} after #else")
        else:
            continue
        place, own, answers, outer, past, _ = opened[-1]
        question, answer = ("", True) if word == "else" else _condition(word, rest)
        starts[k] = len(branches)
        own.append(len(branches))
        later.append(own)
        branches.append((question, answer, [*outer, len(branches)], [*answers, *past, (question, answer)]))
        if word == "else":
            opened[-1] = (place, own, answers, outer, past, True)
        else:
            past.append((question, not answer))
    if opened:
        raise Broken(opened[-1][0], "conditional without #endif")
    left = set(range(len(branches)))
    seen: set[str] = set()
    while True:
        target = min(left, default=-1)
        known = {"": True}
        for question, so in branches[target][3] if left else ():
            known.setdefault(question, so)
        wanted = {b for x in left for b in branches[x][2]}
        out: list[str] = []
        live = True
        stack: list[tuple[bool, bool]] = []  # live outside, a branch was taken
        for k, (line, directive) in enumerate(pieces):
            if directive:
                word, rest, at = directive
                if word == "?" and live:
                    raise Broken(at, "unknown directive")
                if word == "endif":
                    live = stack.pop()[0]
                elif k in starts:
                    b = starts[k]
                    if word.startswith("if"):
                        stack.append((live, False))
                    outside, taken = stack[-1]
                    live = outside and not taken
                    if live and word != "else":
                        question, answer = branches[b][:2]
                        if question not in known:
                            known[question] = answer == (b in wanted or not any(x in wanted for x in later[b] if x > b))
                        live = known[question] == answer
                    if live:
                        stack[-1] = (outside, True)
                        left.discard(b)
                elif live and word in ("define", "undef"):
                    known["defined " + re.split(r"\W", rest, maxsplit=1)[0]] = word == "define"
                out.append(line)
            else:
                out.append(line if live else " " * len(line))
        left.discard(target)
        variant = "\n".join(out)
        if variant not in seen:
            seen.add(variant)
            yield variant
        if not left:
            return


_JS = re.compile(
    r"[ \t\f\v\r\u2028\u00a0]+|\n|//[^\n]*|/\*[\s\S]*?\*/|/\*[\s\S]*|<!--[^\n]*|#![^\n]*"
    r"|(?:(?<=[=(,:;!&|?{}\[\n~^%*+<>-])|(?<=[=(,:;!&|?{}\[>] )|(?<=return )|(?<=typeof )|(?<=case )|\A)/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
    r"|(?<=[ \n\t])/(?![*/= ])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[ ])+/[a-z]*(?=[.,;)\]])"
    r"|\"(?:\\[\s\S]|[^\"\\\n])*\"|'(?:\\[\s\S]|[^'\\\n])*'|`(?:\\[\s\S]|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\}|[^`\\])*`|[\"'][^\n]*|`[\s\S]*"
    r"|\??\.#?(?:[^\W\d]|\$)[\w$]*|\?\.(?!\d)|#?(?:[^\W\d]|\$)[\w$]*|0[xXbBoO][0-9a-fA-F_]+n?|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?"
    r"|\.\.\.|=>|>>>=|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|===|!==|>>>|\+\+|--|\*\*|<<|>>|<=|>=|==|!=|&&|\|\||\?\?|[-+*/%^&|]=|[\s\S]"
)
_JS_WORDS = {
    **{w: "V" for w in ("var", "let", "const")}, **{w: "v" for w in ("this", "null", "true", "false", "undefined")}, **{w: "u" for w in ("typeof", "void", "delete", "new")},
    **{w: w for w in "function class extends if else for while do switch case default break continue return throw try catch finally import export in instanceof super with await yield debugger async of from as get set static".split()},
}


def _js_kind(t: str) -> str:
    c = t[0]
    if c == "\n":
        return "\n"
    if c in " \t\f\v\r\u2028\u00a0" or t.startswith(("//", "<!--", "#!")):
        return ""
    if t.startswith("/*"):
        return ("\n" if "\n" in t else "") if len(t) >= 4 and t.endswith("*/") else "!unterminated comment"
    if c in "\"'`":
        if len(t) < 2 or t[-1] != c:
            return "!unterminated text"
        back = len(t) - 1 - len(t[:-1].rstrip("\\"))
        return "s" if back % 2 == 0 else "!unterminated text"
    if c == "/" and len(t) > 2 and t != "/=" or c == "/" and len(t) > 1 and t[1] not in "=":
        return "r"
    if c == "." and len(t) > 1 and not t[1].isdigit() and t != "..." or c == "?" and len(t) > 2 and t[1] == ".":
        return "m"
    if c == "#":
        return "h" if len(t) > 1 else "!stray character"
    if c.isalpha() or c in "_$":
        return _JS_WORDS.get(t, "n")
    if c.isdigit() or (c == "." and len(t) > 1 and t[1].isdigit()):
        return "0"
    if t in ("*", "-", "+", "!", "~", "++", "--", ",", ";", ":", "?", "?.", "...", "=>", "(", ")", "[", "]", "{", "}"):
        return t
    if t in ("=", "==", "===", "!=", "!==", "<", ">", "<=", ">=", "<<", ">>", ">>>", "/", "%", "&", "|", "^", "&&", "||", "??", "**") or (len(t) > 1 and t[-1] == "=" and t != "=>"):
        return "o"
    return "!stray character"


_JS_LEX = _Lexemes(_js_kind)
_ENDS = {"n", "0", "s", "r", "v", "m", "h", "++", "--", "return", "break", "continue", "of", "from", "as", "async", "get", "set", "static", "super", "debugger", "yield"}
_HEADED = {"if", "for", "while", "with", "switch", "catch", "await"}
_GOES_ON = {"o", "*", "-", "+", "m", "?.", ",", ")", "]", "?", ":", "=>", "in", "instanceof", "else", "catch", "finally", ";", "from", "of"}


def _asi(kinds: list[str], places: list[int]) -> tuple[list[str], list[int]]:
    """Line ends as semicolons where the language inserts them, else out."""
    if "\n" not in kinds:
        return kinds, places
    out, where = [], []
    n = len(kinds)
    for i, k in enumerate(kinds):
        if k != "\n":
            out.append(k)
            where.append(places[i])
            continue
        if not out:
            continue
        j = i + 1
        while j < n and kinds[j] == "\n":
            j += 1
        following = kinds[j] if j < n else "}"
        last = out[-1]
        if last[0] == "(" and len(out) > 1 and out[-2] in _HEADED:
            continue
        if (last in _ENDS or (len(last) > 1 and last[0] in "([{")) and (following not in _GOES_ON or following == "else" and last[0] != "{") and not (following[0] in "([" and len(following) > 1 and last not in ("return", "break", "continue")):
            out.append(";")
            where.append(places[i])
    return out, where


class _Block:
    """Statements of one block: cut into segments, each parsed with the chart."""

    def __init__(self, g: Grammar, js: bool):
        self.g, self.js = g, js

    def check(self, kinds: list[str], places: list[int], end: int) -> Error | None:
        if self.js:
            kinds, places = _asi(kinds, places)
        g = self.g
        start, n = 0, len(kinds)
        last = ""
        i = 0
        while i < n:
            k = kinds[i]
            if k == ";" or (k[0] == "{" and "B" in k or k == "{C"):
                part = tuple(kinds[start : i + 1])
                if part[0] == "else" and not last.startswith("if"):
                    return places[start], "'else' without 'if'"
                e = g.error("seg", _short(part))
                if e < 0:
                    if part == (";",):
                        start = i + 1
                        i += 1
                        continue
                    word = next((x for x in part if x in ("if", "for", "while", "do", "switch", "try", "catch")), "")
                    last = "if" if "if" in part else word
                    if part[0] == "catch" or part[0] == "finally":
                        last = part[0]
                    start = i + 1
                elif k == ";":
                    if len(_short(part)) != len(part):
                        e = g.error("seg", part)
                    at = start + min(e, len(part) - 1)
                    return places[at], "unexpected token"
            i += 1
        rest = tuple(kinds[start:])
        if rest:
            if self.js and g.error("seg", _short((*rest, ";"))) < 0:
                return None
            if not self.js and g.error("eof", rest) < 0:
                return None
            e = g.error("seg", _short(rest))
            at = start + min(max(e, 0), len(rest) - 1)
            return (places[at] if e < len(rest) else end), "unfinished statement" if e >= len(rest) else "unexpected token"
        return None


_C_GROUPS = {"(": (("E", "round_e"),), "[": (("E", "square_e"),)}


def _c(text: str) -> None:
    """Every choice of branches; the first error of any counts."""
    if "\0" in text:
        raise Broken(text.index("\0"), "null byte")
    first: Broken | None = None
    for source in _preprocess(text):
        try:
            _braces(source, False)
        except Broken as b:
            first = b if first is None or b.at < first.at else first
    if first:
        raise first


def _braces(source: str, js: bool) -> None:
    g = _GRAMMARS["JS" if js else "C"]
    block = _Block(g, js)
    if "\0" in source:
        raise Broken(source.index("\0"), "null byte")
    tokens = [m.group() for m in _C.finditer(source)] if not js else _JS.findall(source)
    lex = _JS_LEX if js else _C_LEX
    kinds: list[str] = []
    places: list[int] = []
    stack: list[tuple[str, int, list[str], list[int]]] = []
    at = 0
    for token in tokens:
        kind = lex[token]
        if kind == "":
            pass
        elif kind == "\n":
            if (not stack or stack[-1][0] == "{") and kinds:
                kinds.append(kind)
                places.append(at)
        elif kind[0] == "!" and len(kind) > 2:
            raise Broken(at, kind[1:])
        elif kind in "([{":
            stack.append((kind, at, kinds, places))
            kinds, places = [], []
        elif kind in ")]}":
            if not stack or stack[-1][0] != _PAIR[kind]:
                raise Broken(at, f"unmatched '{kind}'")
            opener, start, outer, outer_places = stack.pop()
            folded = _curly(g, block, kinds, places, at, js) if opener == "{" else _group(g, _C_GROUPS[opener], kinds, places, opener, at)
            kinds, places = outer, outer_places
            kinds.append(folded)
            places.append(start)
        else:
            kinds.append(kind)
            places.append(at)
        at += len(token)
    if stack:
        raise Broken(stack[-1][1], f"'{stack[-1][0]}' was never closed")
    error = block.check(kinds, places, at)
    if error:
        raise Broken(*error)


def _curly(g: Grammar, block: _Block, kinds: list[str], places: list[int], at: int, js: bool) -> str:
    error = block.check(kinds, places, at)
    letters = "" if error else "B"
    plain = _short(tuple(k for k in kinds if k != "\n")) if js else _short(tuple(kinds))
    for letter, rule in (("O", "curly_o"), ("M", "curly_m")) if js else (("I", "curly_i"),):
        if (";" not in plain) and g.error(rule, plain) < 0:
            letters += letter
    if js:
        member, _ = _asi(kinds, places)
        if g.error("curly_c", tuple(member)) < 0:
            letters += "C"
    if not letters:
        raise Broken(*error)
    return "{" + letters


_JSON = re.compile(r"\s+|\"(?:\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4})|[^\"\\\x00-\x1f])*\"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true\b|false\b|null\b|[{}\[\],:]|[\s\S]")


def _json(text: str) -> None:
    g = _GRAMMARS["JSON"]
    kinds: list[str] = []
    places: list[int] = []
    stack: list = []
    at = 0
    for token in _JSON.findall(text):
        c = token[0]
        if c.isspace() and token.strip() == "":
            pass
        elif c in "[{":
            stack.append((c, at, kinds, places))
            kinds, places = [], []
        elif c in "]}":
            if not stack or stack[-1][0] != _PAIR[c]:
                raise Broken(at, f"unmatched '{c}'")
            opener, start, outer, outer_places = stack.pop()
            folded = _group(g, (("E", "curly_e" if opener == "{" else "square_e"),), kinds, places, opener, at)
            kinds, places = outer, outer_places
            kinds.append(folded)
            places.append(start)
        else:
            kind = c if c in ",:" else "s" if c == '"' and len(token) > 1 else "v" if token in ("true", "false", "null") else "0" if c in "-0123456789" and token != "-" else ""
            if not kind:
                raise Broken(at, "unexpected character")
            kinds.append(kind)
            places.append(at)
        at += len(token)
    if stack:
        raise Broken(stack[-1][1], f"'{stack[-1][0]}' was never closed")
    e = g.error("document", tuple(kinds))
    if e >= 0:
        raise Broken(places[e] if e < len(places) else at, "unexpected token" if e < len(places) else "no value")


_TOML = re.compile(r"[ \t\r]+|#[^\n]*|\n|\"\"\"(?:\\[\s\S]|[^\\])*?\"\"\"|'''[\s\S]*?'''|\"(?:\\.|[^\"\\\n])*\"|'[^'\n]*'|[+-]?\d[\w:.+-]*(?: \d\d:[\w:.+-]*)?|[+-]?(?:inf|nan)\b|[A-Za-z0-9_-]+|[{}\[\],.=]|[\s\S]")


def _toml(text: str) -> None:
    g = _GRAMMARS["TOML"]
    kinds: list[str] = []
    places: list[int] = []
    stack: list = []
    at = 0

    def line(where: int) -> None:
        if kinds:
            e = g.error("line", tuple(kinds))
            if e >= 0:
                raise Broken(places[e] if e < len(places) else where, "not a key with a value, nor a table")

    for token in _TOML.findall(text):
        c = token[0]
        if c in " \t\r#":
            pass
        elif c == "\n":
            if not stack:
                line(at)
                kinds, places = [], []
        elif c in "[{":
            stack.append((c, at, kinds, places))
            kinds, places = [], []
        elif c in "]}":
            if not stack or stack[-1][0] != _PAIR[c]:
                raise Broken(at, f"unmatched '{c}'")
            opener, start, outer, outer_places = stack.pop()
            choices = (("E", "square_e"), ("T", "square_t")) if opener == "[" else (("E", "curly_e"),)
            folded = _group(g, choices, kinds, places, opener, at)
            kinds, places = outer, outer_places
            kinds.append(folded)
            places.append(start)
        else:
            if c in "\"'":
                kind = "s" if len(token) > 1 and token[-1] == c else ""
            elif c in ",.=":
                kind = c
            elif token in ("true", "false"):
                kind = "v"
            elif c.isdigit() or (c in "+-" and len(token) > 1) or token in ("inf", "nan"):
                kind = "0"
            else:
                kind = "n" if re.fullmatch(r"[A-Za-z0-9_-]+", token) else ""
            if not kind:
                raise Broken(at, "unexpected character")
            kinds.append(kind)
            places.append(at)
        at += len(token)
    if stack:
        raise Broken(stack[-1][1], f"'{stack[-1][0]}' was never closed")
    line(at)


_INI_LINE = re.compile(r"\s*(?:[#;].*)?$|\s*\[[^\]\n]+\]\s*(?:[#;].*)?$|\s*[^\s=:\[][^=:\n]*[=:].*$")
_ENV_LINE = re.compile(r"\s*(?:#.*)?$|\s*(?:export\s+)?[A-Za-z_][\w.-]*\s*=.*$|\s*export(?:\s+[A-Za-z_]\w*)+\s*$")


def _ini(text: str) -> None:
    at, opened = 0, False
    for line in text.split("\n"):
        if not _INI_LINE.match(line) and not (opened and line[:1] in " \t"):
            raise Broken(at, "neither a section nor a key with a value")
        opened = opened or bool(line.strip())
        at += len(line) + 1


def _env(text: str) -> None:
    at, quote = 0, ""
    for line in text.split("\n"):
        if quote:
            if re.search(r"(?<!\\)" + quote + r"\s*(?:#.*)?$", line):
                quote = ""
        else:
            if not _ENV_LINE.match(line):
                raise Broken(at, "not a name with a value")
            m = re.match(r"[^=]*=\s*([\"'])", line)
            if m and not re.search(r"(?<!\\)" + m.group(1), line[m.end() :]):
                quote = m.group(1)
        at += len(line) + 1
    if quote:
        raise Broken(len(text), "unterminated text")


_YAML_QUOTED = re.compile(r"\"(?:\\[\s\S]|[^\"\\])*\"|'(?:''|[^'])*'")
_YAML_ESCAPE = re.compile(r"\\(?:[0abt\tnvefr \"/\\N_LP\n]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|([\s\S]))")
_YAML_MARK = re.compile(r"(?:---|\.\.\.)(?=\s|\Z)")
_YAML_PROPERTY = re.compile(r"[&*][^\s,\[\]{}]*[^\s,\[\]{}:]|!<[^>\s]*>|![^\s,\[\]{}]*")
_YAML_HEADER = re.compile(r"[|>](?:[+-]?([1-9])|([1-9])?[+-])?(?=\s|\Z)[ \t]*(?:(?<=[ \t])#[^\n]*)?(?:\n|\Z)")
#: A stretch of a plain scalar on one line, in block and in flow context.
_YAML_PLAIN = re.compile(r"(?:[^\s:#]|:(?=\S)|(?<=\S)#|[ \t]+(?=[^\s#:]|:\S))+")
_YAML_PLAIN_FLOW = re.compile(r"(?:[^\s:#,\[\]{}]|:(?=[^\s,\[\]{}])|(?<=\S)#|[ \t]+(?=[^\s#:,\[\]{}]|:[^\s,\[\]{}]))+")
_YAML_BLANK = re.compile(r"[ \t]*(?:#[^\n]*)?(?:\n|\Z)")
_YAML_BREAK = re.compile(r"[ \t]*\n\s*")
_CLOSED = {"[": "]", "{": "}"}
Token = tuple[str, int]


def _yaml_tokens(text: str) -> list[Token]:
    """Tokens (kind, place), indentation as B (mapping), S (sequence) and E (end) of blocks, K and V before keys and values,
    = and . for the marks of documents.

    A key is only known by the ':' after it, so the place where one may have begun is kept per flow level and K inserted."""
    out: list[Token] = []
    n, at, start, line = len(text), 0, 0, 0  # start: of the line
    indent, indents = -1, []
    flow = 0
    may = True  # whether a key may begin here
    keys: dict[int, tuple[int, int, int, int, bool]] = {}  # flow level -> token, place, line, column, whether ':' must follow

    def forget() -> None:
        if flow in keys and keys.pop(flow)[4]:
            raise Broken(at, "expected a key with ':'")

    def keep() -> None:
        if may:
            forget()
            keys[flow] = (len(out), at, line, at - start, not flow and indent == at - start)

    def open_block(column: int, kind: str, where: int, place: int) -> None:
        nonlocal indent
        if not flow and indent < column:
            indents.append(indent)
            indent = column
            out.insert(where, (kind, place))

    def close_blocks(column: int) -> None:
        nonlocal indent
        while not flow and indent > column:
            indent = indents.pop()
            out.append(("E", at))

    def advance(to: int) -> None:
        nonlocal at, start, line
        breaks = text.count("\n", at, to)
        if breaks:
            line += breaks
            start = text.rindex("\n", at, to) + 1
        at = to

    while True:
        while at < n:
            c = text[at]
            if c == "\n":
                advance(at + 1)
                may = may or not flow
            elif c == " ":
                at += 1
            elif c == "\t":
                if not flow and not text[start:at].strip(" ") and not _YAML_BLANK.match(text, at):
                    raise Broken(at, "tab as indentation")
                at += 1
            elif c == "#":
                at = text.find("\n", at) if text.find("\n", at) >= 0 else n
            else:
                break
        old = keys.get(flow)
        if old and not flow and (old[2] != line or at - old[1] > 1024):
            forget()
        column = at - start
        if at >= n:
            close_blocks(-1)
            forget()
            out.append(("", n))
            return out
        close_blocks(column)
        c, follow = text[at], text[at + 1 : at + 2]
        parted = not follow or follow.isspace()
        if column == 0 and (m := _YAML_MARK.match(text, at)):
            close_blocks(-1)
            forget()
            out.append(("=" if c == "-" else c, at))
            may = False
            at += 3
        elif column == 0 and c == "%" and not flow and (not out or out[-1][0] in ".%"):
            out.append(("%", at))
            at = text.find("\n", at) if text.find("\n", at) >= 0 else n
        elif c in "[{":
            keep()
            out.append((c, at))
            flow += 1
            may = True
            at += 1
        elif c in "]}":
            if not flow:
                raise Broken(at, f"unmatched '{c}'")
            forget()
            flow -= 1
            out.append((c, at))
            may = False
            at += 1
        elif c == "," and flow:
            forget()
            out.append((c, at))
            may = True
            at += 1
        elif c in "-?" and parted:
            if not flow and not may:
                raise Broken(at, "a block cannot begin within a line" if c == "-" else "a key cannot begin here")
            if not flow:
                open_block(column, "S" if c == "-" else "B", len(out), at)
            forget()
            out.append(("-" if c == "-" else "K", at))
            may = not flow or c == "-"
            at += 1
        elif c == ":" and (parted or flow and (follow in ",[]{}" or out and out[-1][0] in ("q", "]", "}"))):
            key = keys.pop(flow, None)
            if key:
                out.insert(key[0], ("K", key[1]))
                open_block(key[3], "B", key[0], key[1])
                may = False
            else:
                if not flow and not may:
                    raise Broken(at, "a second ':' in a line")
                open_block(column, "B", len(out), at)
                may = not flow
            out.append(("V", at))
            at += 1
        elif c in "&*!":
            m = _YAML_PROPERTY.match(text, at)
            if not m:
                raise Broken(at, "an anchor or alias without a name")
            keep()
            out.append((c, at))
            may = False
            at = m.end()
        elif c in "|>" and not flow:
            m = _YAML_HEADER.match(text, at)
            if not m:
                raise Broken(at, "text after the sign of a block text")
            forget()
            out.append(("s", at))
            least = indent + 1
            more = m.group(1) or m.group(2)
            depth = max(indent, 0) + int(more) if more else -1
            advance(m.end())
            while at < n:
                end = text.find("\n", at)
                end = n if end < 0 else end
                body = text[at:end].lstrip(" ")
                if body:
                    inset = end - at - len(body)
                    if depth < 0 and inset >= least:
                        depth = inset
                    if depth < 0 or inset < depth or inset == 0 and _YAML_MARK.match(text, at):
                        break
                advance(min(end + 1, n))
            may = True
        elif c in "\"'":
            m = _YAML_QUOTED.match(text, at)
            if not m:
                raise Broken(at, "unterminated text")
            if c == '"' and "\\" in m.group():
                for e in _YAML_ESCAPE.finditer(m.group()):
                    if e.group(1):
                        raise Broken(at + e.start(), "unknown escape")
            if "\n---" in m.group() or "\n..." in m.group():
                for e in re.finditer(r"\n(?:---|\.\.\.)(?=\s)", m.group()):
                    raise Broken(at + e.start() + 1, "the document ends within a text")
            keep()
            out.append(("q", at))
            may = False
            advance(m.end())
        elif c not in "-?:,[]{}#&*!|>'\"%@`" or c in "-?:" and not (flow and follow in ",[]{}"):
            keep()
            out.append(("s", at))
            may = False
            plain = _YAML_PLAIN_FLOW if flow else _YAML_PLAIN
            m = plain.match(text, at)
            at = m.end() if m else at + 1
            while True:
                g = _YAML_BREAK.match(text, at)
                if not g:
                    break
                end = g.end()
                inset = end - (text.rindex("\n", at, end) + 1)
                tabbed = "\t" in text[end - inset : end]
                if tabbed and not flow:
                    inset = len(text[end - inset : end].split("\t")[0])
                m = plain.match(text, end)
                if not m or text[end] == "#" or inset <= indent and not flow or inset == 0 and _YAML_MARK.match(text, end):
                    break
                advance(end)
                at = m.end()
        else:
            raise Broken(at, "a plain value cannot start like this")


def _yaml(text: str) -> None:
    """A stack automaton over the tokens: documents, block and flow collections, properties before nodes."""
    tokens = _yaml_tokens(text)
    k = 0
    stack = ["stream"]
    while stack:
        state = stack.pop()
        kind, at = tokens[k]
        wrong = Broken(at, "expected a key with ':'" if state == "map" else "unexpected token" if kind else "a collection was never closed")
        k += 1  # taken unless given back
        if state in ("node", "value", "flow"):
            seen = ""
            while kind and kind in "&!":
                if kind in seen:
                    raise wrong
                seen += kind
                kind, at = tokens[k]
                k += 1
            if kind == "*":
                if seen:
                    raise Broken(at, "an alias has no properties")
            elif kind == "B" and state != "flow":
                stack.append("map")
            elif kind == "S" and state != "flow":
                stack.append("list")
            elif kind == "-" and state == "value":
                k -= 1
                stack.append("entries")
            elif kind == "[":
                stack.append("[")
            elif kind == "{":
                stack.append("{")
            elif kind not in ("s", "q"):
                k -= 1
        elif state == "map":
            if kind == "K":
                stack += ["keyed", "value"]
            elif kind == "V":
                stack += ["map", "value"]
            elif kind != "E":
                raise wrong
        elif state == "keyed":
            if kind == "V":
                stack += ["map", "value"]
            else:
                k -= 1
                stack.append("map")
        elif state == "list":
            if kind == "-":
                stack += ["list", "node"]
            elif kind != "E":
                raise wrong
        elif state == "entries":
            if kind == "-":
                stack += ["entries", "node"]
            else:
                k -= 1
        elif state in ("[", "{"):
            if kind == _CLOSED[state]:
                continue
            stack.append(state + ",")
            if kind == "K":
                stack += ["pair", "flow"]
            elif kind == "V":
                stack.append("flow")
            elif kind and kind in "&!*sq[{":
                k -= 1
                stack.append("flow")
            else:
                raise wrong
        elif state in ("[,", "{,"):
            if kind == ",":
                stack.append(state[0])
            elif kind != _CLOSED[state[0]]:
                raise wrong
        elif state == "pair":
            if kind == "V":
                stack.append("flow")
            else:
                k -= 1
        elif state == "stream":
            if kind == "=":
                stack += ["ended", "node"]
            elif kind == "%":
                stack.append("directives")
            elif kind == ".":
                stack.append("stream")
            elif kind:
                k -= 1
                stack += ["ended", "node"]
        elif state == "directives":
            k -= 1
            if kind not in ("%", "="):
                raise wrong
            stack.append("stream")
        elif state == "ended":
            if kind == ".":
                stack.append("stream")
            elif kind == "=":
                stack += ["ended", "node"]
            elif kind:
                raise wrong


_CHECKS = {"python": _python, "c": _c, "js": lambda t: _braces(t, True), "json": _json, "toml": _toml, "yaml": _yaml, "ini": _ini, "env": _env}


def family_of(path: str | None, language: str | None = None) -> str:
    """The grammar family of a file: the indexer's language, or the extension where that says nothing."""
    if language in LANGUAGES:
        return LANGUAGES[language]
    return FAMILIES.get((path or "").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower(), "")


def first_error(content: bytes | None, family: str) -> Error | None:
    """(line, message) of the first unrecoverable error, None for a file that parses.

    A byte order mark and CRLF are no fault, bytes that are not UTF-8 read as replacement characters. Null and empty
    files parse, but for JSON. Merge markers at the start of a line make any file an error; of a marker and a syntax error
    the earlier counts."""
    text = (content or b"").decode("utf-8", "replace")
    if text.startswith("\ufeff"):
        text = text[1:]
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    check = _CHECKS.get(family)
    found: tuple[int, str] | None = None
    m = _MERGE.search(text)
    if m:
        found = (m.start(), "merge marker")
    # before a marker only what stands before it can be at fault, so the text is read up to there; formats of single lines
    # have no structure that could break there
    part = text[: found[0]] if found else text
    if check and (not found or part.strip() and family not in ("ini", "env")):
        try:
            check(part)
        except Broken as b:
            if not found or b.at < found[0]:
                found = (b.at, b.why)
        except RecursionError:
            found = found or (0, "nested too deeply")
    if found is None:
        return None
    return text.count("\n", 0, found[0]) + 1, found[1]


ERRORS = T.StructType([T.StructField("project_id", T.StringType()), T.StructField("path", T.StringType()), T.StructField("family", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("message", T.StringType())])


def _scan(blobs: DataFrame) -> DataFrame:
    """First errors of ``blobs`` (project_id, path, content and, if present, family), one row per broken file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for project, path, content, family in zip(*(b.column(k).to_pylist() for k in range(4))):
                if e := first_error(content, family):
                    rows.append((project, path, family, *e))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()))], names=ERRORS.fieldNames())

    return blobs.select("project_id", "path", "content", "family").mapInArrow(run, ERRORS)


def _extension_family():
    name = F.lower(F.element_at(F.split("path", r"\."), -1))
    known = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])
    return F.coalesce(known[name], F.lit(""))


def broken_files(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """project_id, path, language, line, message of every current file that is not valid text of its language.

    Every blob is parsed where it is read, by the family its extension tells, and only errors meet the current rows of
    ``files``. Files whose recorded language tells another family than the extension are few; their blobs alone are
    fetched and parsed again. Files without a blob are not judged, nor blobs without a current row or with a null path;
    copies count once, null contents are empty files, empty tables give no rows. Further columns are ignored."""
    current = current_files(files, "language").select("project_id", "path", "language")
    told = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[F.col("language")]
    current = current.withColumn("family", F.coalesce(told, _extension_family())).withColumn("_own", _extension_family())
    guess = _scan(blobs.select("project_id", "path", "content").where("path is not null").withColumn("family", _extension_family()))
    agreed = guess.join(current.where("family = _own").select("project_id", "path", "language"), ["project_id", "path"])
    other = cut(current.where("family <> _own").select("project_id", "path", "language", "family"), "p1")
    done = ["project_id", "path", "language", "line", "message"]
    if other.isEmpty():  # then no content has to be fetched by key
        return agreed.select(*done).dropDuplicates(["project_id", "path"])
    again = _scan(blobs.select("project_id", "path", "content").join(other, ["project_id", "path"]).select("project_id", "path", "content", "family"))
    differed = again.join(other.select("project_id", "path", "language"), ["project_id", "path"])
    return agreed.unionByName(differed).select(*done).dropDuplicates(["project_id", "path"])
