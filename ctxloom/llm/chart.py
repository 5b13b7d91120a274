"""A chart parser over bundled grammars, and folding of bracketed groups so that charts stay short."""

from __future__ import annotations

import re
from collections.abc import Sequence

_SYMBOL = re.compile(r"'[^']+'|[a-z_0-9]+|[()|?*+]")


class Grammar:
    """A context-free grammar with an Earley recogniser.

    The text has one rule a line, ``name: alternatives`` (lines that start with a blank go on), with quoted terminals and
    ``( ) | ? * +``. A token kind that starts with a bracket is a folded group: the letters behind it name what its content
    may be, and the terminal ``'(E'`` matches every group in round brackets whose letters hold E.
    """

    def __init__(self, text: str):
        self.rules: dict[str, list[tuple[str, ...]]] = {}
        self._fresh = 0
        body = re.sub(r"\n[ \t]+", " ", text.strip())
        for line in body.split("\n"):
            if line.strip() and not line.startswith("#"):
                name, _, right = line.partition(":")
                tokens = _SYMBOL.findall(right)
                alternatives, rest = self._alternatives(tokens, 0)
                if rest != len(tokens):
                    raise ValueError(f"rule {name} has too many brackets")
                self.rules.setdefault(name.strip(), []).extend(alternatives)
        self._prepare()

    def _alternatives(self, t: list[str], i: int) -> tuple[list[tuple[str, ...]], int]:
        out, seq = [], []
        while i < len(t) and t[i] != ")":
            if t[i] == "|":
                out.append(tuple(seq))
                seq, i = [], i + 1
                continue
            if t[i] == "(":
                inner, i = self._alternatives(t, i + 1)
                i += 1
                symbol = self._new(inner)
            else:
                symbol, i = t[i], i + 1
            while i < len(t) and t[i] in "?*+":
                if t[i] == "?":
                    symbol = self._new([(), (symbol,)])
                else:
                    name = self._name()
                    self.rules[name] = [() if t[i] == "*" else (symbol,), (name, symbol)]
                    symbol = name
                i += 1
            seq.append(symbol)
        out.append(tuple(seq))
        return out, i

    def _name(self) -> str:
        self._fresh += 1
        return f"_{self._fresh}"

    def _new(self, alternatives: list[tuple[str, ...]]) -> str:
        name = self._name()
        self.rules[name] = alternatives
        return name

    def _prepare(self) -> None:
        self.names = {n: k for k, n in enumerate(self.rules)}
        self.productions: list[tuple[int, tuple]] = []
        self.of: list[list[int]] = [[] for _ in self.names]
        for n, alternatives in self.rules.items():
            for a in alternatives:
                right = tuple(s[1:-1] if s[0] == "'" else self.names[s] for s in a)
                self.of[self.names[n]].append(len(self.productions))
                self.productions.append((self.names[n], right))
        self.nullable = [False] * len(self.names)
        again = True
        while again:
            again = False
            for left, right in self.productions:
                if not self.nullable[left] and all(isinstance(s, int) and self.nullable[s] for s in right):
                    self.nullable[left] = again = True
        self.terminals = {s for _, right in self.productions for s in right if isinstance(s, str)}
        # dotted rules as numbers: base of the production plus the place of the dot
        self.base, at = [], 0
        self.next: list = []
        self.left: list[int] = []
        for left, right in self.productions:
            self.base.append(at)
            for s in (*right, None):
                self.next.append(s)
                self.left.append(left)
            at += len(right) + 1
        self.starts = [[self.base[p] for p in ps] for ps in self.of]
        self._kinds: dict[str, frozenset[str]] = {}
        self._memo: dict = {}

    def _matches(self, kind: str) -> frozenset[str]:
        found = self._kinds.get(kind)
        if found is None:
            if len(kind) > 1 and kind[0] in "([{":
                found = frozenset(t for t in self.terminals if len(t) == 2 and t[0] == kind[0] and t[1] in kind[1:])
            else:
                found = frozenset(("n", "M")) if kind == "M" else frozenset((kind,))
            self._kinds[kind] = found
        return found

    def error(self, start: str, kinds: tuple[str, ...]) -> int:
        """-1 if ``kinds`` is a sentence of ``start``, else the place of the first token that cannot stand where it does
        (the length if more tokens must follow). Results are kept, as statements of one shape come again and again."""
        key = (start, kinds)
        found = self._memo.get(key)
        if found is None:
            found = self._parse(self.names[start], kinds)
            if len(self._memo) > 300_000:
                self._memo.clear()
            self._memo[key] = found
        return found

    def _parse(self, start: int, kinds: Sequence[str]) -> int:
        nxt, left, starts, nullable = self.next, self.left, self.starts, self.nullable
        n = len(kinds)
        waiting: list[dict[int, list]] = []
        current = {(s, 0) for s in starts[start]}
        for i in range(n + 1):
            wants: dict[int, list] = {}
            waiting.append(wants)
            todo = list(current)
            scan = self._matches(kinds[i]) if i < n else None
            following = set()
            while todo:
                state = todo.pop()
                dotted, origin = state
                s = nxt[dotted]
                if s is None:
                    done = left[dotted]
                    for d, o in waiting[origin].get(done, ()):
                        new = (d + 1, o)
                        if new not in current:
                            current.add(new)
                            todo.append(new)
                elif s.__class__ is int:
                    if s in wants:
                        wants[s].append(state)
                    else:
                        wants[s] = [state]
                        for d in starts[s]:
                            new = (d, i)
                            if new not in current:
                                current.add(new)
                                todo.append(new)
                    if nullable[s]:
                        new = (dotted + 1, origin)
                        if new not in current:
                            current.add(new)
                            todo.append(new)
                elif scan is not None and s in scan:
                    following.add((dotted + 1, origin))
            if i == n:
                return -1 if any(o == 0 and left[d] == start and nxt[d] is None for d, o in current) else n
            if not following:
                return i
            current = following
        return n
