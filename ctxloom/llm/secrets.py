"""Credentials in code, notes and settings: finding the values and masking them in place."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Grammars of tokens that a prefix gives away: anchor (lower case) -> pattern from the anchor on.
FORMATS = {
    "sk-": r"sk-(?:[a-z]{2,8}-){0,2}[A-Za-z0-9_]{20,}",
    "sk_": r"sk_(?:live|test)_[A-Za-z0-9]{16,}",
    "akia": r"AKIA[A-Z0-9]{16}(?![A-Z0-9])",
    "asia": r"ASIA[A-Z0-9]{16}(?![A-Z0-9])",
    "ghp_": r"ghp_[A-Za-z0-9]{30,}",
    "gho_": r"gho_[A-Za-z0-9]{30,}",
    "ghs_": r"ghs_[A-Za-z0-9]{30,}",
    "ghu_": r"ghu_[A-Za-z0-9]{30,}",
    "ghr_": r"ghr_[A-Za-z0-9]{30,}",
    "github_pat_": r"github_pat_[A-Za-z0-9_]{30,}",
    "glpat-": r"glpat-[A-Za-z0-9_-]{18,}",
    "xoxb-": r"xoxb-[A-Za-z0-9-]{20,}",
    "xoxp-": r"xoxp-[A-Za-z0-9-]{20,}",
    "xoxa-": r"xoxa-[A-Za-z0-9-]{20,}",
    "aiza": r"AIza[A-Za-z0-9_-]{35}",
    "npm_": r"npm_[A-Za-z0-9]{30,}",
    "hf_": r"hf_[A-Za-z0-9]{30,}",
    "eyj": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]{6,})?",
}

#: Words that, at the end of a name, say that its value is a credential.
NAMES = (
    "password", "passwd", "passphrase", "pwd", "pass", "passwort", "secret", "token", "apikey", "api_key", "api-key", "api key", "access_key", "accesskey", "access-key",
    "secret_key", "secretkey", "private_key", "privatekey", "storage_key", "storagekey", "account_key", "accountkey", "signing_key", "signingkey", "encryption_key",
    "encryptionkey", "master_key", "masterkey", "auth_key", "authkey", "client_key", "license_key", "credential", "credentials", "auth", "_key", "jwt", "bearer", "authorization", "密码", "口令", "密钥", "令牌",
)

_ARMOR = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: A line of an armored body: base64 or a header between signs of comments and literals, up to the line break, escaped or not.
_ARMOR_LINE = re.compile(r"[\"'+*#/ \t]*+(?:[A-Za-z-]+: [^\n\\]*+|[A-Za-z0-9+/]{16,}+=*+|[A-Za-z0-9+/]{1,15}+=*+(?=[\s\"'\\,;)]|\Z))?(?:\\r)?(?:\\n)?[\"'+, \t\\)]*+(?:\r?\n|\Z|(?<=\\n)|(?<=[=\"']))")
_ARMOR_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_ADDRESS = re.compile(r"://([^\s:/@\"'<>`]*+):([^\s@\"'<>`/?#]{6,}+)@[A-Za-z0-9\[]")
_SCHEME_TOKEN = re.compile(r"(?:basic|bearer|token)\s+([A-Za-z0-9+/_.~=-]{16,})", re.I)
_HEADER = re.compile(r"['\"]?\s*:\s*([A-Za-z0-9+/_.~=-]{16,})")
#: What may stand between the end of a name and its value: closing quote or bracket, array brackets, a type, the sign.
_TO_VALUE = re.compile(r"(?:_?\d{1,3})?(?![A-Za-z0-9_])(?:\[\d*\])?[\"'`]?\]?\s*(?:[:]\s*[A-Za-z_][\w.<>\[\] ]{0,30}\s*=|:=|=>|==?|:|：|,|\sis\s|是|\)?\s*(?:\|\||\?\?|\bor\b))\s*(?:\(\s*)?(?:(?:[rbuf]|L|u8)(?=[\"']))?(?=[^\s])")
_QUOTED = re.compile(r"\"((?:\\.|[^\"\\\n]){3,}+)\"|'((?:\\.|[^'\\\n]){3,}+)'|`([^`\n]{3,}+)`")
_MORE = re.compile(r"\s*(?:\+|\\|\.)?\s*\n\s*(?:\+\s*)?[rbuf]?(?:\"((?:\\.|[^\"\\\n]){1,}+)\"|'((?:\\.|[^'\\\n]){1,}+)')|[ \t]*\+?[ \t]*(?:\"((?:\\.|[^\"\\\n]){1,}+)\"|'((?:\\.|[^'\\\n]){1,}+)')")
#: A bare value; a further parameter of an address ends it.
_BARE = re.compile(r"(?:[^\s\"'`,;(){}<>\[\]|&]|&(?![A-Za-z_][\w.-]*=))*+")
_VENDOR = re.compile(r"_[A-Za-z0-9]{24,}+(?!_)")
_VENDOR_PREFIX = re.compile(r"[a-z]{2,10}\Z")
_STAND_IN = re.compile(
    r"change.?me|place.?holder|example|dummy|sample|replace|insert|your[-_ ]|<|\$\{|\{\{|\$\(|^\$[A-Za-z_]+$|^%|^env:|^vault:|^secret:|^file:|^arn:|environ|getenv|process\.env|^\*+$|xxxx|^x+$|\*\*\*|\.\.\.|redacted|hidden|masked|not[-_ ]?set|^set[-_ ]|todo|fixme|deadbeef|12345678|abcdef|^(?:user|pass|password|passwd|secret|token|key|admin|root|guest|test|testing|none|null|nil|true|false|undefined|empty|default|letmein|foo|bar|foobar|hunter2)$",
    re.I,
)
_HARMLESS = re.compile(r"sha(?:1|2|256|384|512)?|digest|checksum|hash|etag|uuid|guid|revision|commit|build|integrity|public|pub|fingerprint|request_?id|trace_?id|md5|crc", re.I)
_SETTINGS = (".env", ".ini", ".yaml", ".yml", ".toml", ".json", ".md", ".markdown", ".txt", ".cfg", ".conf", ".properties", ".rst", ".sh")
_COMMENT = re.compile(r"^\s*(?:#|//|/\*|\*|--|;|>|<!--)|(?:\s#|\s//|/\*)\s|\bexport\s|(?:-H|--header|--user|-u)\s")
#: Overlap of scanned windows: longer than any anchor; what follows an anchor is read from the text itself, to its end.
WINDOW, OVERLAP = 1 << 20, 1 << 14


@dataclass(frozen=True)
class Finding:
    """A credential: the absolute spans of its value (several if it is split over literals) and its kind."""

    spans: tuple[tuple[int, int], ...]
    kind: str


def entropy(value: str) -> float:
    """Shannon entropy of the characters, in bits."""
    n = len(value)
    return math.log2(n) - sum(c * math.log2(c) for c in Counter(value).values()) / n if n else 0.0


def _jumbled(value: str) -> bool:
    """Whether letters without digits look drawn at random: both cases in about equal parts, as no name in camel case has."""
    letters = [c for c in value if c.isalpha()]
    upper = sum(c.isupper() for c in letters)
    return len(letters) >= 16 and 0.25 <= upper / len(letters) <= 0.75 and entropy(value) >= 3.6


def _random(value: str, least: int, *, capitals: bool = False) -> bool:
    """Whether ``value`` looks drawn at random: long enough, letters with digits (or jumbled letters, or ``capitals`` where
    the format has no other letters), and many different characters."""
    if len(value) < least or _STAND_IN.search(value) or not re.search(r"[A-Za-z]", value):
        return False
    if not (re.search(r"[0-9]", value) or capitals or _jumbled(value)):
        return False
    return entropy(value) >= min(3.0, math.log2(len(value)) * 0.72)


#: Signs between the words of a reference (a field, a path, a header, a call), as no digit marks them as a password.
_REFERENCE = re.compile(r"[A-Za-z_]\w*(?:(?:[./:]|::|->)\w*)+|[\w.]+\(.*\)|[A-Z]\w*(?:-[A-Z]\w*)+|[\[{(].*|.*[\])}]|--?\w.*|.*%[a-z].*|.*[:=]")
_ABOUT = re.compile(r"pass|pwd|secret|token|credential|auth|login|prompt|enter|key|密码|口令", re.I)


def _password(value: str) -> bool:
    """Whether ``value`` may be a password someone uses: no stand-in, no reference, not a plain word.

    Digits beside other characters are enough; without digits it takes both cases and signs, and the value must not read
    as a reference or speak of passwords."""
    if len(value) < 6 or _STAND_IN.search(value) or re.search(r"\s", value) or len(set(value)) < 5:
        return False
    kinds = sum(bool(re.search(p, value)) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]"))
    if re.search(r"[0-9]", value):
        return kinds >= 2
    signs = re.search(r"[!@#$&^~+?][A-Za-z]", value)  # no name has these between its words
    return kinds >= 3 and len(value) >= 8 and not _REFERENCE.fullmatch(value) and (signs is not None or not _ABOUT.search(value))


_AUTOMATON = None


def automaton():
    """One Aho-Corasick automaton over all anchors: formats, armor, addresses, authorization schemes and names."""
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for anchor, pattern in FORMATS.items():
            a.add_word(anchor, ("format", anchor, re.compile(pattern)))
        a.add_word("-----begin ", ("armor", "-----begin ", None))
        a.add_word("://", ("address", "://", None))
        for w in ("basic ", "bearer "):
            a.add_word(w, ("scheme", w, None))
        for w in NAMES:
            a.add_word(w, ("name", w, None))
        a.make_automaton()
        _AUTOMATON = a
    return _AUTOMATON


def _literals(text: str, at: int) -> tuple[str, list[tuple[int, int]], int] | None:
    """The string literal at ``at`` joined with adjacent or continued ones: its value, spans and end."""
    m = _QUOTED.match(text, at)
    if not m:
        return None
    k = m.lastindex
    value, spans, end = m.group(k), [m.span(k)], m.end()
    while more := _MORE.match(text, end):
        k = more.lastindex
        value, end = value + more.group(k), more.end()
        spans.append(more.span(k))
    return value, spans, end


def _line(text: str, at: int) -> str:
    lo = text.rfind("\n", 0, at) + 1
    hi = text.find("\n", at)
    return text[lo : hi if hi >= 0 else len(text)]


def _whole_name(text: str, end: int) -> str:
    lo = end
    while lo > 0 and end - lo < 80 and (text[lo - 1].isalnum() or text[lo - 1] in "_-."):
        lo -= 1
    return text[lo:end]


def _format(text: str, start: int, pattern: re.Pattern, anchor: str) -> Finding | None:
    if start and (text[start - 1].isalnum() or text[start - 1] in "_-+/"):
        return None
    quote = text[start - 1] if start else ""
    capitals = anchor in ("akia", "asia")
    if quote in ("'", '"', "`") and (joined := _literals(text, start - 1)):
        value, spans, _ = joined
        m = pattern.match(value)
        if m and m.end() == len(value) and _random(value[len(anchor) :], 10, capitals=capitals):
            return Finding(tuple(spans), "token")
    m = pattern.match(text, start)
    if m and _random(m.group()[len(anchor) :], 10, capitals=capitals):
        end = m.end()
        while end > start and text[end - 1] in ".-_":
            end -= 1
        return Finding(((start, end),), "token")
    return None


def _armor(text: str, start: int) -> Finding | None:
    """A private key from its opening line to its closing one, however long; without one, to the end of its body."""
    m = _ARMOR.match(text, start)
    if not m:
        return None
    dashes = text.find("-----", m.end())
    stop = _ARMOR_END.match(text, dashes) if dashes >= 0 else None
    last = dashes if stop else m.end()
    if not stop:
        limit = dashes if dashes >= 0 else len(text)
        while last < limit and (line := _ARMOR_LINE.match(text, last, limit)) and line.end() > last:
            last = line.end()
    body = re.sub(r"\\n|[\s\"'+*#/\\]", "", text[m.end() : last])
    if len(re.match(r"[A-Za-z0-9+/=]*", re.sub(r"^(?:Proc-Type:|DEK-Info:)[^\n]*", "", body)).group()) < 32 or _STAND_IN.search(text[m.end() : last]) and len(body) < 80:
        return None
    end = stop.end() if stop else last
    while not stop and text[end - 1] in " \t\n\r\"'+*#\\,;)":
        end -= 1
    return Finding(((start, end),), "private key")


def _named(text: str, end: int, word: str, settings: bool, runs: dict[str, int]) -> Finding | None:
    m = _TO_VALUE.match(text, end)
    if not m:
        return None
    name = _whole_name(text, end)
    low = name.lower()
    if word == "pass" and not re.search(r"(?:^|[_.-])pass$|[a-z]Pass$|^PASS$|_PASS$", name):
        return None
    if word == "_key" and re.search(r"(?:public|primary|foreign|sort|cache|partition|row|map|dict|idempotency)_key$", low):
        return None
    if _HARMLESS.search(low.replace("hash_secret", "")):
        return None
    at = m.end()
    is_pass = word.startswith(("pass", "pwd")) or word in ("密码", "口令")
    joined = _literals(text, at)
    if joined:
        value, spans, _ = joined
        scheme = re.match(r"(?:basic|bearer|token)\s+", value, re.I)
        if scheme:
            value = value[scheme.end() :]
            spans[0] = (spans[0][0] + scheme.end(), spans[0][1])
        if "://" in value:
            return None
        ok = _password(value) if is_pass else (not re.search(r"\s", value) and _random(value, 16))
        return Finding(tuple(spans), "password" if is_pass else "secret") if ok else None
    if "," in m.group():
        return None
    if not settings:
        if not runs.get("line", 1) <= end < runs.get("break", 0):
            line = _line(text, end)
            runs["line"] = text.rfind("\n", 0, end) + 1
            runs["break"], runs["comment"] = runs["line"] + len(line) + 1, _COMMENT.search(line) is not None
        if not runs["comment"]:
            return None
    if runs.get("from", 1) <= at < runs.get("to", 0):
        stop = runs["to"]  # of the run of characters that an earlier name's value belongs to
    else:
        stop = _BARE.match(text, at).end()
        runs["from"], runs["to"] = at, stop
    if stop - at < 6 or (stop < len(text) and not (text[stop].isspace() or text[stop] in "\"'`,;&")):
        return None
    value = text[at:stop].rstrip(".:!?*")
    stop = at + len(value)
    if "://" in value or value.startswith("-----"):
        return None
    ok = _password(value) if is_pass else _random(value, 16)
    return Finding(((at, stop),), "password" if is_pass else "secret") if ok else None


def _hit(text: str, end: int, what: tuple, settings: bool, runs: dict[str, int]) -> Finding | None:
    kind, anchor, pattern = what
    start = end - len(anchor)
    if kind == "format":
        return _format(text, start, pattern, anchor)
    if kind == "name":
        return _named(text, end, anchor, settings, runs)
    if kind == "armor":
        return _armor(text, start)
    if kind == "address":
        m = _ADDRESS.match(text, start)
        if not m or _STAND_IN.search(m.group(2)) or entropy(m.group(2)) < 2.3:
            return None
        return Finding((m.span(2),), "password in address")
    m = _SCHEME_TOKEN.match(text, start)
    if start and (text[start - 1].isalnum() or text[start - 1] == "_"):
        return None
    if m and _random(m.group(1).rstrip("="), 16):
        if any(p.match(m.group(1)) for p in _FORMAT_PATTERNS):
            return None  # the format finds it with its exact end
        return Finding((m.span(1),), "token")
    return None


_FORMAT_PATTERNS = [re.compile(p) for p in FORMATS.values()]


def find_credentials(text: str | None, path: str | None = None) -> list[Finding]:
    """All credentials of ``text`` by position, overlapping finds reduced to the earliest and longest.

    The text is scanned in windows that overlap; spans are absolute, so a find in two windows is one. Null and empty
    texts have none. ``path`` only tells whether bare values after a name count (settings and notes) or only quoted
    ones and those in comments (code).
    """
    if not text:
        return []
    settings = (path or "").lower().endswith(_SETTINGS)
    found: dict[int, Finding] = {}
    runs: dict[str, int] = {}
    scan = automaton()
    for base in range(0, max(1, len(text)), WINDOW):
        part = text[base : base + WINDOW + OVERLAP]
        low = part.lower()
        if len(low) != len(part):  # a few characters change length in lower case
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in part)
        for last, what in scan.iter(low):
            f = _hit(text, base + last + 1, what, settings, runs)
            if f:
                old = found.get(f.spans[0][0])
                if old is None or f.spans[-1][1] > old.spans[-1][1]:
                    found[f.spans[0][0]] = f
        for m in _VENDOR.finditer(part):
            at = base + m.start()
            lo = max(0, at - 11)
            pre = _VENDOR_PREFIX.search(text[lo:at])
            if not pre or (lo + pre.start() and (text[lo + pre.start() - 1].isalnum() or text[lo + pre.start() - 1] in "_-/+")):
                continue
            value = m.group()[1:]
            if re.search(r"[a-z]", value) and re.search(r"[A-Z]", value) and (re.search(r"[0-9]", value) or _jumbled(value)) and entropy(value) >= 3.4:
                found.setdefault(lo + pre.start(), Finding(((lo + pre.start(), base + m.end()),), "token"))
    out: list[Finding] = []
    for start in sorted(found):
        f = found[start]
        if out and start < out[-1].spans[-1][1]:
            continue
        out.append(f)
    return out


def mask(text: str, findings: list[Finding], placeholder: str = "REDACTED") -> str:
    """``text`` with every span of every finding replaced; quotes, signs, line breaks and all else stay as they are."""
    parts, at = [], 0
    for f in findings:
        for lo, hi in f.spans:
            parts.append(text[at:lo])
            body = text[lo:hi]
            parts.append(re.sub(r"[A-Za-z0-9+/=_.-]+", placeholder, body) if "\n" in body else placeholder)
            at = hi
    parts.append(text[at:])
    return "".join(parts)


def credential_lines(chunks: DataFrame) -> DataFrame:
    """(project_id, chunk_id, line_no, kind) per line on which a credential begins; copies of a chunk count once.

    ``chunks``: project_id, id, file_path, content; further columns are ignored. Null and empty contents have no findings, a
    null path is no settings file, null ids stay null in the result; several credentials on one line are one row, with
    the least kind. Texts of any length are scanned whole. One pass over Arrow batches; only the findings are shuffled, to
    fold copies."""
    schema = T.StructType([T.StructField("project_id", T.StringType()), T.StructField("chunk_id", T.StringType()), T.StructField("line_no", T.IntegerType()), T.StructField("kind", T.StringType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[], [], [], []]
            project, ids = None, None
            for i, (path, text) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                for f in find_credentials(text, path):
                    if project is None:
                        project, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
                    for column, v in zip(rows, (project[i], ids[i], text.count("\n", 0, f.spans[0][0]) + 1, f.kind)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.string(), pa.int32(), pa.string()))], names=schema.fieldNames())

    hits = chunks.select("project_id", "id", "file_path", "content").mapInArrow(scan, schema)
    return hits.groupBy("project_id", "chunk_id", "line_no").agg(F.min("kind").alias("kind"))


def redacted(chunks: DataFrame, placeholder: str = "REDACTED") -> DataFrame:
    """Chunks that hold credentials: project_id, chunk_id, findings, content with the values masked.

    Copies of a chunk count once; chunks without findings, with null or empty content give no row."""
    schema = T.StructType([T.StructField("project_id", T.StringType()), T.StructField("chunk_id", T.StringType()), T.StructField("findings", T.IntegerType()), T.StructField("content", T.StringType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for project, chunk, path, text in zip(*(b.column(k).to_pylist() for k in range(4))):
                if found := find_credentials(text, path):
                    rows.append((project, chunk, len(found), mask(text, found, placeholder)))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.string()))], names=schema.fieldNames())

    return chunks.select("project_id", "id", "file_path", "content").mapInArrow(scan, schema).distinct()
