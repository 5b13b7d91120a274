"""Repetition inside a document, and what tokenizer fertility says about it."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxloom.llm.tokens import Tokenizer

#: Scripts written without spaces: a unit is one character.
DENSE = "぀-ヿ㐀-䶿一-鿿豈-﫿가-힯"
_UNITS = re.compile(f"[{DENSE}]|[^\\W\\d_{DENSE}]+")
_DENSE = re.compile(f"[{DENSE}]")


class _Numbers(dict):
    """Unit -> number in order of appearance."""

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        return n


_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _repeats(ids: np.ndarray, own: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Those of the windows at ``starts`` that stand earlier in the same text.

    Windows are grouped by a hash; every one is compared unit by unit with the first of its group, and groups in which
    unlike windows meet are told apart by the windows themselves."""
    code = (own[starts].astype(np.uint64) + np.uint64(1)) * _SPREAD
    with np.errstate(over="ignore"):
        for k in range(size):
            code = (code ^ (code >> np.uint64(29))) * _SPREAD + ids[starts + k].astype(np.uint64) + np.uint64(1)
    _, first, group = np.unique(code, return_index=True, return_inverse=True)
    origin = first[group]
    later = origin != np.arange(len(starts))
    same = own[starts] == own[starts[origin]]
    for k in range(size):
        same &= ids[starts + k] == ids[starts[origin] + k]
    if not same.all():
        mixed = np.isin(group, group[~same])
        seen: set[tuple[int, ...]] = set()
        for i in np.nonzero(mixed)[0].tolist():
            window = (int(own[starts[i]]), *ids[starts[i] : starts[i] + size].tolist())
            later[i] = window in seen
            seen.add(window)
    return starts[later]


def repeated_shares(texts: Sequence[str | None], words: int = 6, chars: int = 10) -> list[float]:
    """Per text the share of units that lie in second or later occurrences of stretches of the same text.

    Units are words, or characters where the script has no spaces; case, spacing, punctuation and digits do not count.
    A stretch is ``words`` units without a dense character or ``chars`` units of any kind. Null, empty and short texts
    have share 0.0. All texts are measured together over arrays of unit numbers.
    """
    numbers = _Numbers()
    units = [_UNITS.findall(t.lower()) if t else [] for t in texts]
    sizes = np.array([len(u) for u in units], dtype=np.int64)
    ends = np.cumsum(sizes)
    ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(units)), dtype=np.int64, count=int(ends[-1]) if len(ends) else 0)
    n = len(ids)
    if not n:
        return [0.0] * len(texts)
    own = np.repeat(np.arange(len(texts)), sizes)
    left = ends[own] - np.arange(n)
    dense = np.fromiter((_DENSE.match(u) is not None for u in numbers), dtype=bool, count=len(numbers))[ids]
    many = np.concatenate(([0], np.cumsum(dense)))
    change = np.zeros(n + 1, dtype=np.int64)
    starts = np.nonzero(left >= words)[0]
    found = [(words, starts[many[starts + words] == many[starts]])]
    if many[-1]:
        found.append((chars, np.nonzero((left >= chars) & (np.bincount(own[dense], minlength=len(texts)) > 0)[own])[0]))
    for size, at in found:
        again = _repeats(ids, own, at, size)
        np.add.at(change, again, 1)
        np.add.at(change, again + size, -1)
    covered = np.bincount(own, weights=np.cumsum(change[:-1]) > 0, minlength=len(texts))
    return [float(c) / k if k > words else 0.0 for c, k in zip(covered, sizes.tolist())]


def repeated_share(text: str | None, words: int = 6, chars: int = 10) -> float:
    """:func:`repeated_shares` of one text."""
    return repeated_shares([text], words, chars)[0]


def repetition(docs: DataFrame, key: str = "doc_id", text: str = "text", *, words: int = 6, chars: int = 10) -> DataFrame:
    """(key, repeated_share) for every row of ``docs``, repeated and null-keyed rows included; other columns are ignored and
    an empty table gives no rows. Nothing is shuffled, one pass over Arrow batches."""
    schema = T.StructType([docs.schema[key], T.StructField("repeated_share", T.DoubleType())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                shares = repeated_shares(part.column(1).to_pylist(), words, chars)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shares, pa.float64())], names=[key, "repeated_share"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(measure, schema)


#: Bands in which a text of a script counts as usual: characters per token, byte-fallback share, bits of entropy a token.
BANDS = {"dense": (0.5, 2.2, 0.35, 5.0), "other": (1.8, 6.5, 0.10, 5.0)}


def fertility(docs: DataFrame, tokenizer: Tokenizer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: tokens, characters per token, share of byte-fallback tokens, token entropy, and whether a band of its
    script rejects it. Null and empty texts have 0 tokens, null measures and are not rejected. Byte fallback is told by
    the ids 3..258 that sentencepiece models with fallback reserve for bytes; other vocabularies report 0."""
    fields = [docs.schema[key]] + [T.StructField(n, t) for n, t in (("script", T.StringType()), ("n_tokens", T.LongType()), ("chars_per_token", T.DoubleType()), ("byte_share", T.DoubleType()), ("entropy", T.DoubleType()), ("rejected", T.BooleanType()))]
    bytes_at = range(3, 259) if tokenizer.name.endswith(".model") else range(0)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = tokenizer.encoder()
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            out = []
            for t, ids in zip(texts, run(texts)):
                script = "dense" if len(_DENSE.findall(t)) * 4 > len(t) else "other"
                if not ids:
                    out.append((script, 0, None, None, None, False))
                    continue
                n = len(ids)
                freq = Counter(ids)
                bits = math.log2(n) - sum(c * math.log2(c) for c in freq.values()) / n
                per, fall = len(t) / n, sum(c for i, c in freq.items() if i in bytes_at) / n
                lo, hi, most, least = BANDS[script]
                out.append((script, n, per, fall, bits, not lo <= per <= hi or fall > most or (n >= 64 and bits < least)))
            columns = list(zip(*out)) or [[]] * 6
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=[f.name for f in fields])

    return docs.select(F.col(key), F.col(text)).mapInArrow(measure, T.StructType(fields))
