"""Ignore rules for repository paths: built-in folders, an allow list, ignore files, a project's own ignore file."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders that are never entered (fixed values).
SKIPPED_DIRS = (
    ".git", ".hg", ".svn", ".venv", "venv", "env", "node_modules", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".eggs", "dist", "build", "target", ".idea", ".vscode",
    "cmake-build-*", "build-*", "out", "htmlcov", ".cache", ".gradle", ".next", ".nuxt", ".turbo", ".parcel-cache", "__pypackages__",
)
#: What is taken in although ignore files leave it out: a folder name with a slash, else file names (fixed values).
ALLOWED = ("skills/", "agents.md", "claude.md", ".agent.md", ".cursorrules", "handoff.md")
#: How many ignored folders in a row are looked through for allowed names (fixed value).
LOOK_THROUGH = 4


def glob_regex(pattern: str) -> str:
    """A glob of an ignore file as a regular expression: ``*`` and ``?`` stay within a part, ``**`` crosses parts."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            body = ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\")
            out, i = out + f"[{body}]", end + 1
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


@dataclass(frozen=True)
class Rule:
    """One line of an ignore file below ``base``: matches the path itself, or anything below a path that matches."""

    negated: bool
    folders_only: bool
    itself: re.Pattern
    below: re.Pattern

    @staticmethod
    def read(line: str, base: str = "") -> Rule | None:
        line = line.rstrip("\n").rstrip("\r")
        if not line.endswith("\\ "):
            line = line.rstrip(" ")
        if not line or line.startswith("#"):
            return None
        negated = line.startswith("!")
        line = line[1:] if negated else line[1:] if line.startswith(("\\!", "\\#")) else line
        folders = line.endswith("/")
        line = line.rstrip("/")
        if not line:
            return None
        anchored = "/" in line
        body = glob_regex(line.lstrip("/"))
        lead = re.escape(base.strip("/") + "/") if base.strip("/") else ""
        full = lead + (body if anchored else f"(?:.*/)?{body}")
        return Rule(negated, folders, re.compile(full + r"\Z"), re.compile(full + r"/.*\Z", re.S))


class Layer:
    """Rules in order; the last one that matches decides. A ``!`` cannot bring back what lies in an excluded folder."""

    def __init__(self, lines: Sequence[str], base: str = ""):
        self.rules = [r for line in lines if (r := Rule.read(line, base))]

    def extend(self, lines: Sequence[str], base: str) -> None:
        self.rules += [r for line in lines if (r := Rule.read(line, base))]

    def decide(self, path: str, is_dir: bool = False, initial: bool = False) -> bool:
        result, rescued = initial, False
        for r in self.rules:
            if r.below.match(path) or r.itself.match(path) and (is_dir or not r.folders_only):
                result, rescued = not r.negated, r.negated
        if rescued:
            parts = path.split("/")
            if any(self.decide("/".join(parts[:k]), True) for k in range(1, len(parts))):
                return True
        return result


@dataclass
class IgnoreRules:
    """The layers together. Built-in folders win over all; then the allow list includes; then ignore files, which a
    project's own file may overrule."""

    ignore: Layer = field(default_factory=lambda: Layer([]))
    custom: Layer = field(default_factory=lambda: Layer([]))
    allow: tuple[str, ...] = ALLOWED
    skipped: tuple[str, ...] = SKIPPED_DIRS

    def builtin(self, path: str, is_dir: bool = False) -> bool:
        parts = path.split("/")
        folders = parts if is_dir else parts[:-1]
        return any(fnmatch.fnmatchcase(p, s) for p in folders for s in self.skipped)

    def allows(self, path: str, is_dir: bool = False) -> bool:
        held = False
        parts = [p.lower() for p in path.split("/")]
        folders = parts if is_dir else parts[:-1]
        for entry in self.allow:
            off = entry.startswith("!")
            name = entry.lstrip("!").rstrip("/").lower()
            hit = name in folders if entry.rstrip().endswith("/") else name == parts[-1]
            held = (not off) if hit else held
        return held

    def looks_allowed(self, name: str) -> bool:
        """Whether a file or folder of this name may be allowed, wherever it is."""
        return self.allows(name) or self.allows(name, True)

    def reason(self, path: str, is_dir: bool = False) -> str | None:
        """builtin, ignore or custom for ignored paths, None for others."""
        path = path.strip("/")
        if not path:
            return None
        if self.builtin(path, is_dir):
            return "builtin"
        if self.allows(path, is_dir):
            return None
        first = self.ignore.decide(path, is_dir)
        if not self.custom.decide(path, is_dir, first):
            return None
        return "custom" if self.custom.decide(path, is_dir) else "ignore"


def ignore_reason(path: Column, rules: IgnoreRules) -> Column:
    """Why a path is ignored, null if it is not; the rules travel with the function, paths in Arrow batches."""

    @F.pandas_udf(T.StringType())
    def check(paths: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in paths:
            yield s.map(lambda p: rules.reason(p) if p else None)

    return check(path)
