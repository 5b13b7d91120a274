"""Source files that are not a project's own hand-written code: generated, minified, data, or copied from elsewhere."""

from __future__ import annotations

import hashlib
import keyword
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxloom.operators.skew import salted_join
from ctxloom.tables import cut

#: Extensions of the languages that are judged; settings and Markdown never are.
CODE = (".py", ".pyi", ".c", ".h", ".cc", ".cpp", ".cxx", ".hpp", ".hh", ".hxx", ".js", ".mjs", ".cjs", ".jsx")
_PY_TOKEN = re.compile(r"#[^\n]*|[rRbBuUfF]{0,2}(?:\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|[^\W\d]\w*|\.?\d[\w.]*|\n|[^\w\s]")
_C_TOKEN = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?|[^\W\d][\w$]*|\.?\d[\w.]*|[^\w\s]")
_WORDS = {k: 16 + i for i, k in enumerate(sorted({*keyword.kwlist, *"self if else for while do switch case break continue return struct union enum typedef static const void int char short long float double unsigned signed size_t bool class public private protected virtual namespace template typename using new delete this operator auto function var let export import from default async await typeof instanceof of null true false undefined".split()}))}
_TEXT, _NUMBER, _NAME, _LINE, _NOTE = 2, 3, 4, 5, 1


class _Kinds(dict):
    """Token text -> (kind code, hash of the text); grows as tokens appear and starts afresh when large."""

    def __missing__(self, token: str):
        c = token[0]
        if c == "#" and len(token) > 1 or token.startswith(("//", "/*")):
            kind = _NOTE
        elif c in "\"'`" or token[-1] in "\"'" and len(token) > 1:
            kind = _TEXT
        elif c == "\n":
            kind = _LINE
        elif c.isdigit() or (c == "." and len(token) > 1):
            kind = _NUMBER
        elif c == "_" or c.isalpha():
            kind = _WORDS.get(token, _NAME)
        else:
            kind = 256 + ord(c)
        raw = token.encode("utf-8", "replace")
        value = (kind, (zlib.crc32(raw) << 32) ^ zlib.crc32(raw, 0x5EED))
        if len(self) < 500_000:
            self[token] = value
        return value


_KINDS = _Kinds()
_MIX, _MIX2, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (a * _MIX) ^ ((b + _SPREAD) * _MIX2)
        return (h ^ (h >> np.uint64(29))) * _SPREAD


def repair(symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair grammars of many sequences at once.

    ``symbols`` holds the sequences end to end, ``owner`` (ascending) tells whose each symbol is. A round counts the digrams of
    every sequence, and replaces all non-overlapping occurrences of those that occur twice or more and are more frequent than
    the digrams they overlap, or else of the most frequent one; the pair's hash names the rule, so equal rules of different
    sequences have equal names. A sequence is finished when none of its digrams repeats.
    Returns the start symbols, their owners, their expanded lengths, and the number of rules per owner.
    """
    sym, own = symbols.astype(np.uint64), owner.astype(np.int64)
    length = np.ones(len(sym), dtype=np.int64)
    owners = int(own[-1]) + 1 if len(own) else 0
    rules = np.zeros(owners, dtype=np.int64)
    finished: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(sym) >= 4:
        dig = _mix(sym[:-1], sym[1:])
        key = dig ^ ((own[:-1] + 1).astype(np.uint64) * _MIX2)
        # in a run of one digram (a a a) only every second place may be taken
        again = np.concatenate(([False], (dig[1:] == dig[:-1]) & (own[1:-1] == own[:-2])))
        index = np.arange(len(dig))
        ok = (own[:-1] == own[1:]) & ((index - np.maximum.accumulate(np.where(again, 0, index))) % 2 == 0)
        codes, uniq = pd.factorize(key)
        count = np.bincount(codes[ok], minlength=len(uniq))[codes]
        weight = np.where(ok & (count >= 2), count.astype(np.float64) + (dig >> np.uint64(12)).astype(np.float64) / 2.0**53, 0.0)
        before, after = np.concatenate(([0.0], weight[:-1])), np.concatenate((weight[1:], [0.0]))
        chosen = np.nonzero((weight > 0) & (weight > before) & (weight >= after))[0]
        chosen = chosen[np.bincount(codes[chosen], minlength=len(uniq))[codes[chosen]] >= 2]
        moved = np.zeros(owners, dtype=bool)
        moved[own[chosen]] = True
        most = np.zeros(owners)
        np.maximum.at(most, own[:-1], weight)
        if (most[~moved] > 0).any():
            rest = np.nonzero((weight > 0) & ~moved[own[:-1]] & (weight == most[own[:-1]]))[0]
            moved[own[rest]] = True
            chosen = np.sort(np.concatenate((chosen, rest)))
        if len(chosen):
            np.add.at(rules, own[chosen[np.unique(codes[chosen], return_index=True)[1]]], 1)
            sym[chosen] = dig[chosen]
            length[chosen] += length[chosen + 1]
        stay = np.ones(len(sym), dtype=bool)
        stay[chosen + 1] = False
        live = moved[own]
        done = stay & ~live
        finished.append((sym[done], own[done], length[done]))
        stay &= live
        sym, own, length = sym[stay], own[stay], length[stay]
    finished.append((sym, own, length))
    sym, own, length = (np.concatenate(x) for x in zip(*finished))
    order = np.argsort(own, kind="stable")
    return sym[order], own[order], length[order], rules


#: Reuse is measured on grammars of equal parts of at most this many tokens, so that long files do not look repetitive.
PART = 500


def grammar_share(symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Per owner the size of the Re-Pair grammars of its parts (two symbols a rule, and the start symbols) over its length."""
    n = np.bincount(owner)
    parts = np.maximum(1, -(-n // PART))
    first = np.cumsum(parts) - parts
    place = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
    part = first[owner] + place * parts[owner] // np.maximum(1, n)[owner]
    _, own, _, rules = repair(symbols, part)
    size = 2 * rules + np.bincount(own, minlength=len(rules))
    return np.add.reduceat(size, first) / np.maximum(1, n) if len(n) else np.zeros(0)


_TOOL = r"[\w./+-]"
_BANNER = re.compile(
    r"^\W*(?:(?:this (?:file|code|module) (?:is|was|has been) )?(?:auto(?:matically)?[- ]?)?generated\s+(?:by|from|with|using|on)\b|(?:this (?:file|code|module) (?:is|was|has been) )?(?:auto(?:matically)?[- ]?|machine[- ]?)(?:generated|made|written|produced)\b|@generated\b|code generated by\b|generated (?:code|file)\b|(?:emitted|produced|written|created|compiled|rendered|dumped|exported)\s+(?:automatically\s+)?(?:by|from|with)\s+(?:the\s+)?" + _TOOL + r".*(?:regenerat|do not|don't|edit|overwritten|lost|patch)|do not (?:edit|modify|change)\b|don't edit\b|machine[- ]made\b)|自动生成|自动產生|由工具生成|请勿(?:手工|手动)?(?:修改|编辑)",
    re.I,
)
_NOT_BANNER = re.compile(r"generated by [A-Z]\w+[;,] |blocks? generated", re.I)
_NOTICE = re.compile(r"^\W*(?:upstream|origin(?:al)? (?:source|project)|homepage|source repo(?:sitory)?)\s*:\s*\S+://|single[- ]file (?:library|header)|(?:vendored|copied|imported|taken|borrowed|adapted) (?:verbatim )?from\b.*(?:://|v?\d+\.\d+)|^\W*(?:local copy|vendored copy|third[- ]party (?:code|copy|library))\b", re.I)
_VENDOR_PATH = re.compile(r"(?:^|/)(?:node_modules|third_party|third-party|3rdparty|vendor|vendored|bower_components)/|(?:^|/)(?:external|deps|contrib|extern|subprojects)/([^/]+)/\1[^/]*$", re.I)


_HEAD = re.compile(r"\s+|/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*|<!--[^\n]*|#[^\n]*")
_DIRECTIVES = ("#include", "#define", "#if", "#pragma", "#endif", "#else", "#ifdef", "#undef")


def _run(text: str) -> int:
    """Where the comments end that ``text`` begins with."""
    at = 0
    while m := _HEAD.match(text, at):
        at = m.end()
    return at


def comment_head(text: str, lines: int = 12) -> list[str]:
    """The lines of all comments before the first code, however many, and of those behind it among the first ``lines``.

    Preprocessor lines are no comments and do not end the head; strings and code do not count."""
    end = _run(text.lstrip("\ufeff"))
    head = text.lstrip("\ufeff")[:end]
    out = [h for line in head.split("\n") if (h := line.strip()) and not h.startswith(_DIRECTIVES)]
    inside = False
    for raw in text.split("\n", lines)[:lines]:
        line = raw.strip().lstrip("\ufeff")
        if inside or line.startswith(("#", "//", "/*", "*", "<!--")):
            shut = line.find("*/") + 2 if inside or line.startswith("*") else 0
            note = line if shut == 1 else line[: shut + _run(line[shut:])]
            if not line.startswith(_DIRECTIVES):
                out.append(note)
            inside = (inside or line.startswith("/*")) and "*/" not in line
    return out


def traits(texts: Sequence[str], paths: Sequence[str]) -> list[dict]:
    """What tells about the origin of each text, and its phrases; grammars are inferred for all texts together."""
    ids, own, hashes, out = [], [], [], []
    for k, (text, path) in enumerate(zip(texts, paths)):
        tokens = (_PY_TOKEN if path.endswith((".py", ".pyi")) else _C_TOKEN).findall(text)
        kinds = [_KINDS[t] for t in tokens]
        code = [p for p in kinds if p[0] != _NOTE]
        lexemes = np.array([p[1] for p in code if p[0] != _LINE], dtype=np.uint64)
        ids += [p[0] for p in code]
        hashes += [p[1] for p in code]
        own += [k] * len(code)
        note = literal = total = 0
        numbers, long_text = set(), ""
        n_numbers = 0
        for t, (kind, _) in zip(tokens, kinds):
            n = len(t)
            if kind == _NOTE:
                note += n
                continue
            total += n
            if kind == _TEXT:
                if t[:3] in ('"""', "'''") or n > 4 and t.count(" ") * 6 > n:
                    total -= n  # prose
                else:
                    literal += n
                    long_text = max(long_text, t, key=len)
            elif kind == _NUMBER:
                literal += n
                n_numbers += 1
                numbers.add(t)
        longest = max(map(len, text.split("\n"))) if text else 0
        lines = text.count("\n") + 1
        space = sum(map(text.count, " \n\t\r"))
        head = comment_head(text)
        out.append(
            {
                "tokens": len(code),
                "whole": int.from_bytes(hashlib.blake2b(lexemes.tobytes(), digest_size=8).digest(), "big", signed=True) if len(lexemes) else None,
                "literal_share": literal / total if total else 0.0,
                "literal_bytes": literal,
                "fresh_numbers": len(numbers) / n_numbers if n_numbers else 0.0,
                "n_numbers": n_numbers,
                "dense_text": len(zlib.compress(long_text.encode("utf-8", "replace"), 1)) / len(long_text) if len(long_text) >= 512 else 0.0,
                "chars": len(text),
                "lines": lines,
                "longest": longest,
                "space_share": space / len(text) if text else 1.0,
                "banner": any(_BANNER.search(h) and not _NOT_BANNER.search(h) for h in head),
                "notice": any(_NOTICE.search(h) for h in head),
                "grammar": 1.0,
                "prose": 0.0,
                "phrases": [],
            }
        )
    if ids:
        name, of = np.array(ids) == _NAME, np.array(own, dtype=np.int64)
        kinds = np.array(ids, dtype=np.uint64)
        sym, owner, length, _ = repair(kinds, of)
        share = grammar_share(kinds, of)
        running = np.bincount(of[1:][name[1:] & name[:-1] & (of[1:] == of[:-1])], minlength=len(texts))
        h = np.array(hashes, dtype=np.uint64)
        two = _mix(h, np.concatenate((h[1:], np.zeros(1, np.uint64))))
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(two, np.concatenate((h[2:], np.zeros(2, np.uint64)))))))
        ends = np.cumsum(length)
        # a phrase: start symbols up to and with one whose name ends in three zero bits, as the lexemes stand in the text
        last = np.concatenate((owner[1:] != owner[:-1], [True]))
        cut = last | ((_mix(sym, sym) & np.uint64(7)) == 0)
        stops = np.nonzero(cut)[0]
        hi = ends[stops]
        lo = np.concatenate(([0], hi[:-1]))
        inner = np.maximum(hi - 2, lo)
        with np.errstate(over="ignore"):
            phrase = sums[inner] - sums[lo]
        size = hi - lo
        for k, p, n in zip(owner[stops].tolist(), phrase.tolist(), size.tolist()):
            if n >= 12:
                out[k]["phrases"].append((p - (1 << 64) if p >= 1 << 63 else p, n))
        for k, o in enumerate(out):
            if o["tokens"]:
                o["grammar"] = float(share[k])
            o["prose"] = running[k] / o["tokens"] if o["tokens"] else 0.0
    return out


#: A grammar this small against its text marks a machine at work; hand-written code stays above it.
REUSE, REUSE_TOKENS = 0.27, 60
#: Names next to names fill this share of running text, which is no code whoever wrote it; code stays far below.
PROSE = 0.35
#: Literals fill this share of the code and hardly compress: data in the form of code.
DATA_SHARE, DATA_BYTES = 0.72, 800


def verdict(t: dict, path: str) -> dict[str, bool]:
    """The reasons that hold for a file by itself."""
    fresh = t["n_numbers"] >= 64 and t["fresh_numbers"] >= 0.3 or t["dense_text"] >= 0.55
    return {
        "generated": t["banner"] or (t["tokens"] >= REUSE_TOKENS and t["grammar"] < REUSE and t["prose"] < PROSE),
        "minified": t["chars"] >= 500 and t["chars"] / max(1, t["lines"]) >= 150 and t["space_share"] < 0.08,
        "data": t["literal_share"] >= DATA_SHARE and t["literal_bytes"] >= DATA_BYTES and fresh,
        "noticed": t["notice"] or _VENDOR_PATH.search(path) is not None,
    }


PROFILE = T.StructType(
    [T.StructField("project_id", T.StringType()), T.StructField("path", T.StringType())]
    + [T.StructField(n, T.BooleanType()) for n in ("generated", "minified", "data", "noticed")]
    + [T.StructField("tokens", T.IntegerType()), T.StructField("whole", T.LongType())]
    + [T.StructField("phrases", T.ArrayType(T.StructType([T.StructField("phrase", T.LongType()), T.StructField("size", T.IntegerType())])))]
)
_ARROW = pa.schema(
    [("project_id", pa.string()), ("path", pa.string()), *((n, pa.bool_()) for n in ("generated", "minified", "data", "noticed")), ("tokens", pa.int32()), ("whole", pa.int64()), ("phrases", pa.list_(pa.struct([("phrase", pa.int64()), ("size", pa.int32())])))]
)


def decode(content: bytes | None) -> str:
    """Bytes as text: UTF-8, wrong bytes replaced, byte order mark off, line ends as LF."""
    return (content or b"").decode("utf-8", "replace").lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n")


def profiles(blobs: DataFrame) -> DataFrame:
    """One row per source file of a judged language, its own reasons and its phrases; nothing is shuffled.

    ``blobs``: project_id, path, content. Null content is an empty file, which has no reasons and no phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                b = batch.slice(lo, 500)
                paths = b.column(1).to_pylist()
                found = traits([decode(c) for c in b.column(2).to_pylist()], [p.lower() for p in paths])
                told = [verdict(t, p) for t, p in zip(found, paths)]
                phrases = [[{"phrase": p, "size": n} for p, n in t["phrases"]] for t in found]
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1).cast(pa.string()), *(pa.array([v[k] for v in told], pa.bool_()) for k in ("generated", "minified", "data", "noticed")), pa.array([t["tokens"] for t in found], pa.int32()), pa.array([t["whole"] for t in found], pa.int64()), pa.array(phrases, _ARROW.field("phrases").type)], schema=_ARROW)

    judged = F.lower("path").rlike("(?:" + "|".join(re.escape(e) for e in CODE) + ")$")
    return blobs.where(judged).select("project_id", "path", "content").mapInArrow(run, PROFILE)


def shared_share(profile: DataFrame, repos: DataFrame, *, hot_rows: int = 200_000) -> DataFrame:
    """(project_id, path, shared, shared_tokens): the share and number of a file's phrase tokens whose phrase stands in two or
    more repositories.

    ``repos``: project_id, repo; a project without a row is a repository of its own. A phrase's repositories are folded to
    their least and greatest name on the map side, so a phrase found everywhere costs one row per task; files find their
    repository before they are spread into phrases, salted for projects of very many files, and the way back to the files is
    a join with one row per shared phrase, salted for phrases that very many files hold."""
    phrases = profile.select("project_id", "path", F.explode("phrases").alias("p")).select("project_id", "path", "p.phrase", "p.size")
    named = salted_join(profile.select("project_id", "path", "phrases.phrase"), repos, ["project_id"], "left", salt_from=["path"], hot_rows=hot_rows)
    named = named.select(F.coalesce("repo", "project_id").alias("repo"), F.explode("phrase").alias("phrase"))
    shared = named.groupBy("phrase").agg(F.min("repo").alias("lo"), F.max("repo").alias("hi")).where("lo <> hi").select("phrase", F.lit(1).alias("_shared"))
    back = salted_join(phrases, shared, ["phrase"], "left", salt_from=["project_id", "path"], hot_rows=hot_rows)
    held = F.sum(F.when(F.col("_shared").isNotNull(), F.col("size")).otherwise(0))
    return back.groupBy("project_id", "path").agg((held / F.sum("size")).alias("shared"), held.alias("shared_tokens"))


def whole_copies(profile: DataFrame, repos: DataFrame) -> DataFrame:
    """The distinct ``whole`` hashes (all code of a file in order, without comments and line ends) that stand in two or more
    repositories."""
    named = salted_join(profile.where("whole is not null").select("project_id", "path", "whole"), repos, ["project_id"], "left", salt_from=["path"]).withColumn("repo", F.coalesce("repo", "project_id"))
    return named.groupBy("whole").agg(F.min("repo").alias("lo"), F.max("repo").alias("hi")).where("lo <> hi").select("whole", F.lit(True).alias("_copy"))


def foreign_files(blobs: DataFrame, files: DataFrame, repos: DataFrame, *, share: float = 0.5, least_tokens: int = 80) -> DataFrame:
    """Current source files that are not the project's own hand-written code, with the reasons.

    project_id, path, generated, minified, data, vendored. ``files`` tells which paths are current (any version counts),
    ``repos`` which projects are one repository. Copies of rows count once; null paths are no files, null and empty contents
    have no reason of their own. A file of which half of the phrase tokens, and ``least_tokens`` of them, stand in other
    repositories is vendored, ties included: a few idioms that agree by chance are no copy. Of a file whose whole code stands in
    another repository all tokens count, those of phrases too short to be compared by themselves included. Empty tables give no rows; columns that are not named here are ignored."""
    profile = cut(profiles(blobs), "p2")
    current = files.select("project_id", "path").where("path is not null").distinct()
    one = repos.groupBy("project_id").agg(F.max("repo").alias("repo"))
    wide = profile.drop("phrases").join(shared_share(profile, one), ["project_id", "path"], "left")
    wide = salted_join(wide, whole_copies(profile, one), ["whole"], "left", salt_from=["project_id", "path"], hot_rows=200_000)
    copied = (F.coalesce("shared", F.lit(0.0)) >= share) & (F.coalesce("shared_tokens", F.lit(0)) >= least_tokens)
    copied = copied | (F.coalesce("_copy", F.lit(False)) & (F.col("tokens") >= least_tokens))
    out = wide.select("project_id", "path", "generated", "minified", "data", (F.col("noticed") | copied).alias("vendored"))
    return out.where("generated or minified or data or vendored").join(current, ["project_id", "path"], "left_semi").dropDuplicates(["project_id", "path"])
