"""Column functions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count one token per 1.5 in the token estimate (fixed values): kana, CJK ideographs, full-width forms.
WIDE = r"　-ヿ㐀-䶿一-鿿豈-﫿＀-￯"


def wide_count(text: Column) -> Column:
    """How many wide characters ``text`` has.

    Plain ASCII is told by the byte length alone. Else characters below U+3000 and then ideographs are taken out by
    classes of one range, which the regex engine runs over fast, and the class of all ranges meets only the few left."""
    high = F.regexp_replace(text, "[\\x00-\\u2FFF]+", "")
    rest = F.regexp_replace(high, "[\\u4E00-\\u9FFF]+", "")
    wide = F.length(high) - F.length(rest) + F.length(F.regexp_replace(rest, f"[^{WIDE}]+", ""))
    return F.when(F.octet_length(text) == F.length(text), F.lit(0)).otherwise(wide)


def estimate_tokens(text: Column) -> Column:
    """0 if empty or null, else max(1, ceil(wide / 1.5 + other / 4)); exact in integers: ceil((8 w + 3 o) / 12)."""
    wide = wide_count(text).cast("long")
    twelfths = wide * 8 + (F.length(text) - wide) * 3
    ceil = F.floor((twelfths + 11) / 12).cast("long")
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), ceil))


#: The same estimate in DuckDB SQL; ``{t}`` is the text expression.
ESTIMATE_SQL = (
    "CASE WHEN coalesce(length({t}),0)=0 THEN 0 ELSE greatest(1, (8*length(regexp_replace({t},'[^\\x{{3000}}-\\x{{30FF}}\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{F900}}-\\x{{FAFF}}\\x{{FF00}}-\\x{{FFEF}}]+','','g'))"
    " + 3*(length({t})-length(regexp_replace({t},'[^\\x{{3000}}-\\x{{30FF}}\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{F900}}-\\x{{FAFF}}\\x{{FF00}}-\\x{{FFEF}}]+','','g')))+11)//12) END"
)


def newlines(text: Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def blob_hash(path: Column, content: Column) -> Column:
    """sha-256 of path, a zero byte and the bytes."""
    return F.sha2(F.concat(F.encode(path, "UTF-8"), F.unhex(F.lit("00")), content), 256)


def file_hash(content: Column) -> Column:
    """sha-256 of the bytes."""
    return F.sha2(content, 256)


def chunk_hash(text: Column) -> Column:
    """sha-256 of the text with LF line ends."""
    return F.sha2(newlines(text), 256)


def id_of_project(identity: Column) -> Column:
    """The first 16 hex digits of the identity's sha-256."""
    return F.substring(F.sha2(identity, 256), 1, 16)


#: Terms of the lexical index: runs of ASCII letters and digits, and single ideographs.
TERM = r"[A-Za-z0-9]+|[一-鿿]"


def terms(text: Column) -> Column:
    """Lower-case terms of a text in order, for index and query alike; null gives none."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TERM})"), F.lit(1)), F.lower)


def segment(text: Column) -> Column:
    """Space-joined segments: ASCII words, and every other visible character by itself."""
    return F.array_join(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9]+|\S)"), F.lit(1)), " ")


def noise_free(tokens: Column) -> Column:
    """Tokens with at least one letter or digit."""
    return F.filter(tokens, lambda t: t.rlike(r"[\p{L}\p{N}]"))


def lexical_query(text: Column) -> Column:
    """A query without backticks and scope signs."""
    return F.regexp_replace(F.regexp_replace(text, "`", ""), "::", " ")


def name_tail(name: Column) -> Column:
    """The last part of a dotted or scoped name."""
    return F.element_at(F.split(F.regexp_replace(name, "::", "."), r"\."), -1)


def spellings(token: Column) -> Column:
    """The distinct spellings of a name with dots and with scope signs."""
    return F.array_distinct(F.array(token, F.regexp_replace(token, "::", "."), F.regexp_replace(token, r"\.", "::")))


def symbol_names(symbol: Column) -> Column:
    """All names under which a symbol may be asked for: as it is, dotted, its tail, scoped."""
    return F.array_distinct(F.array(symbol, F.regexp_replace(symbol, "::", "."), name_tail(symbol), F.regexp_replace(symbol, r"\.", "::")))


def identifier_words(name: Column) -> Column:
    """The lower-case parts of an identifier, split at underscores, dots and capitals, sorted."""
    spaced = F.lower(F.regexp_replace(F.regexp_replace(name, "::", "."), "([a-z0-9])([A-Z])", "$1_$2"))
    return F.array_sort(F.array_distinct(F.filter(F.split(spaced, "[_.]+"), lambda w: w != "")))


def answer_tokens(text: Column) -> Column:
    """Half the characters, rounded up, at least 1; 0 for an empty or null text."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(F.length(text) / 2).cast("int"))).cast("int")


def numbered_lines(text: Column, start: Column) -> Column:
    """Every line with its number in front."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda line, i: F.concat((start + i).cast("string"), F.lit(" | "), line)), "\n")


def edge_name(text: Column, limit: int = 120) -> Column:
    """A name with single blanks, cut to ``limit`` characters."""
    return F.substring(F.regexp_replace(F.trim(text), r"\s+", " "), 1, limit)


def mention(text: Column) -> Column:
    """A mention without backticks and call brackets; null for paths and empty mentions."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, "`", ""), r"\(.*\)$", ""))
    return F.when(bare.contains("/") | (bare == ""), F.lit(None)).otherwise(bare)


def fqn_of_id(symbol_id: Column) -> Column:
    """The part of an id between its first and last colon."""
    return F.regexp_extract(symbol_id, "^[^:]*:(.*):[^:]*$", 1)


def embedding_text(signature: Column, docstring: Column, content: Column, limit: int = 8000) -> Column:
    """What is embedded: signature, docstring, and the body without the signature cut to ``limit`` characters."""
    sig = F.coalesce(signature, F.lit(""))
    body = F.when((sig != "") & content.startswith(sig), F.substring(content, F.length(sig) + 1, 2147483647)).otherwise(content)
    filled = F.filter(F.array(sig, F.coalesce(docstring, F.lit("")), F.substring(body, 1, limit)), lambda p: F.trim(F.regexp_replace(p, r"\s", " ")) != "")
    return F.array_join(filled, "\n\n")


def l2_normalize(vector: Column, eps: float = 1e-12) -> Column:
    """The vector over its norm, the norm not under ``eps``."""
    wide = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0).cast("double"), lambda a, x: a + x * x))
    return F.transform(wide, lambda x: x / F.greatest(norm, F.lit(eps)))


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0).cast("double"), lambda s, x: s + x)


def cut_bytes(text: Column, limit: int) -> Column:
    """The longest prefix with at most ``limit`` UTF-8 bytes that ends between characters."""
    whole = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, limit).cast("string"))
    cut = F.when(F.startswith(text, whole), whole).otherwise(F.regexp_replace(whole, "\ufffd+$", ""))
    return F.when(F.octet_length(text) <= limit, text).otherwise(cut)


#: Names whose values are never kept in a log (fixed values).
SECRET_NAMES = ("authorization", "proxy-authorization", "cookie", "set-cookie", "x-api-key", "api-key", "api_key", "apikey", "access-token", "access_token", "accesstoken", "token", "secret", "password", "passwd", "credential")
#: Beginnings of bare keys; a service adds those of the keys it issues.
KEY_PREFIXES = ("sk-",)


def redact_patterns(prefixes: tuple[str, ...] = KEY_PREFIXES) -> list[tuple[str, str]]:
    """Patterns and what replaces them, in order: bearer tokens, values behind secret names, bare keys of eight characters or more."""
    bare = "|".join(p.replace("-", "\\-") for p in prefixes)
    return [
        (r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]+", "Bearer ***"),
        (r"(?i)\b(" + "|".join(n.replace("-", "\\-") for n in SECRET_NAMES) + r")\b(\"?\s*[:=]\s*\"?)[^\s,;\"']+", "{1}{2}***"),
        (rf"\b(?:{bare})[A-Za-z0-9_\-]{{8,}}", "***"),
    ]


def redact(text: Column, prefixes: tuple[str, ...] = KEY_PREFIXES) -> Column:
    """Text fit for a log: bearer tokens, values of secret names and bare keys masked. Null stays null."""
    for pattern, mask in redact_patterns(prefixes):
        text = F.regexp_replace(text, pattern, mask.replace("{", "$").replace("}", ""))
    return text


def cut_answer(text: Column, limit: int = 20000, suffix: str = "… (truncated)") -> Column:
    """The text, or its first ``limit`` characters and a mark that it goes on; null stays null."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(suffix))).otherwise(text)


def visible(text: Column) -> Column:
    """The text without control characters but line ends and tabs."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")


def human_bytes(size: Column) -> Column:
    """A size as B, KB, MB or GB."""
    return (
        F.when(size < 1024, F.format_string("%d B", size.cast("long")))
        .when(size < 1024**2, F.format_string("%.1f KB", size / 1024))
        .when(size < 1024**3, F.format_string("%.1f MB", size / 1024**2))
        .otherwise(F.format_string("%.1f GB", size / 1024**3))
    )


def import_hints(source_file: Column, name: Column) -> Column:
    """Files in which an imported name may live: its module path as a module or as a package, relative imports from the source's folder."""
    dots = F.length(F.regexp_extract(name, r"^(\.*)", 1))
    rest = F.regexp_replace(F.regexp_replace(name, r"^\.+", ""), r"\.", "/")
    parts = F.split(source_file, "/")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.greatest(dots, F.lit(1)), F.lit(0))), "/")
    module = F.when(dots > 0, F.when(base == "", rest).otherwise(F.concat(base, F.lit("/"), rest))).otherwise(rest)
    parent = F.regexp_replace(module, "/?[^/]*$", "")
    made = F.array(F.concat(module, F.lit(".py")), F.concat(module, F.lit("/__init__.py")), F.when(parent != "", F.concat(parent, F.lit(".py"))), F.when(parent != "", F.concat(parent, F.lit("/__init__.py"))))
    return F.array_distinct(F.filter(made, lambda h: h.isNotNull()))


def hint_matches(path: Column, hints: Column) -> Column:
    """Whether the path is one of the hints or ends with one after a slash."""
    return F.exists(hints, lambda h: (path == h) | path.endswith(F.concat(F.lit("/"), h)))
