"""Passages of evaluation items inside documents."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxloom.llm.simhash import HammingIndex, Units, window_prints

DENSE = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿가-힯]")
_MARKUP = re.compile(r"</?[a-zA-Z][^<>]{0,200}>|\]\([^)\s]{0,300}\)|&(?:[a-zA-Z]{2,8}|#\d{1,6});|[­​-‏﻿]")
_WORD = re.compile(r"[^\W_]+")


def normal(text: str) -> str:
    """Case, width, markup and invisible characters out of the way."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "<" in text or "](" in text or "&" in text or "­" in text or "​" in text or "﻿" in text:
        text = _MARKUP.sub(lambda m: "" if m.group()[0] in "­​‌‍‎‏﻿" else " ", text)
    return text.lower()


def word_units(text: str) -> list[str]:
    """Words, for scripts with spaces."""
    return _WORD.findall(text)


def letter_units(text: str) -> str:
    """Letters and digits one by one, for scripts without spaces."""
    return "".join(_WORD.findall(text))


class _Passages:
    """The passages of the items end to end as unit numbers, and the exact check of places where a text may give one away.

    A stretch qualifies if at least ``least`` of a passage's units stand in a text in order with at most one edit in
    ``per_edit``. A qualifying stretch of twice ``least`` units or more has a half that qualifies, so looking twice ``least``
    units to both sides of a place, with the edits such a length allows, decides exactly.
    """

    def __init__(self, items: Sequence[tuple[int, str | None]], *, dense: bool, least: int, per_edit: int = 8, seed: int = 6):
        self.dense, self.least, self.per_edit, self.seed = dense, least, per_edit, seed
        self.most_edits = (2 * least - 1) // per_edit
        self.names: list[str] = []
        numbers: dict[str, int] = {}
        self.item: list[int] = []
        flat, begins, ends = [-1], [], []
        for item, passage in items:
            text = normal(passage or "")
            if not text or bool(len(DENSE.findall(text)) * 3 > len(text)) != dense:
                continue
            units = letter_units(text) if dense else word_units(text)
            if len(units) < seed:
                continue
            for u in units:
                if u not in numbers:
                    numbers[u] = len(self.names)
                    self.names.append(u)
            begins.append(len(flat))
            flat += [numbers[u] for u in units]
            ends.append(len(flat))
            flat.append(-1)
            self.item.append(item)
        self.flat = np.array(flat, dtype=np.int64)
        self.begins, self.ends = np.array(begins, dtype=np.int64), np.array(ends, dtype=np.int64)
        self._units: Units | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_units": None}

    def numbered(self, texts: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The units of all texts end to end as numbers, those of the passages by the passages' own, and where texts start."""
        if self._units is None:
            self._units = Units(self.names)
        starts = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) for t in texts], out=starts[1:])
        return self._units.numbers(chain.from_iterable(texts), int(starts[-1])), starts

    def settle(self, text: np.ndarray, starts: np.ndarray, t: np.ndarray, p: np.ndarray) -> list[set[int]]:
        """Per text the items it gives away, of places ``t`` in the texts and ``p`` in the passages that hold equal units."""
        found: list[set[int]] = [set() for _ in range(len(starts) - 1)]
        order = np.lexsort((t, t - p))
        t, p = t[order], p[order]
        # places that follow each other on a diagonal are one run, and its first place decides for all
        follows = np.concatenate(([False], (t[1:] == t[:-1] + 1) & (p[1:] == p[:-1] + 1))) if len(t) else np.zeros(0, dtype=bool)
        t, p = t[~follows], p[~follows]
        for lo in range(0, len(t), 4096):
            a, b = t[lo : lo + 4096], p[lo : lo + 4096]
            doc, k = np.searchsorted(starts, a, side="right") - 1, np.searchsorted(self.begins, b, side="right") - 1
            right = self._reach(text, a, starts[doc + 1] - a, b, self.ends[k] - b, 1)
            left = self._reach(text, a - 1, a - starts[doc], b - 1, b - self.begins[k], -1)
            good = np.zeros(len(a), dtype=bool)
            for e1 in range(self.most_edits + 1):
                for e2 in range(self.most_edits + 1):
                    length = right[e1] + left[e2]
                    good |= (length >= self.least) & ((e1 + e2) * self.per_edit <= length)
            for d, i in zip(doc[good].tolist(), k[good].tolist()):
                found[d].add(self.item[i])
        return found

    def _reach(self, text: np.ndarray, t: np.ndarray, m: np.ndarray, p: np.ndarray, n: np.ndarray, sign: int) -> np.ndarray:
        """For 0, 1, 2 ... edits the most units of the passages, from ``p`` in direction ``sign``, that align with the texts
        from ``t`` on; ``n`` and ``m`` units are left there. Furthest reach per diagonal, all places at once."""
        width, most = 2 * self.least + self.seed, self.most_edits
        n, m = np.minimum(n, width), np.minimum(m, width + most)
        i = np.arange(width)
        ours = self.flat[np.clip(p[:, None] + sign * i, 0, len(self.flat) - 1)].astype(np.int32)
        ours[i >= n[:, None]] = -1
        j = np.arange(-most, width + most)
        theirs = text[np.clip(t[:, None] + sign * j, 0, len(text) - 1)].astype(np.int32)
        theirs[(j < 0) | (j >= m[:, None])] = -2
        stops = np.full((2 * most + 1, len(p), width + 1), width, dtype=np.int16)
        for d in range(2 * most + 1):
            differ = np.where(ours == theirs[:, d : d + width], np.int16(width), i.astype(np.int16))
            stops[d, :, :width] = np.minimum.accumulate(differ[:, ::-1], axis=1)[:, ::-1]
        none = np.full(len(p), -9, dtype=np.int64)
        every = np.arange(len(p))
        rows = {0: stops[most, :, 0].astype(np.int64)}
        out = [rows[0]]
        for e in range(1, most + 1):
            now: dict[int, np.ndarray] = {}
            best = out[-1]
            for d in range(-e, e + 1):  # d = place in the text minus place in the passage
                at = np.maximum(np.maximum(rows.get(d, none), rows.get(d + 1, none)) + 1, rows.get(d - 1, none))
                at = np.minimum(at, n)
                ok = (at >= 0) & (at + d >= 0) & (at + d <= m)
                at = np.where(ok, stops[d + most, every, np.maximum(at, 0)], -9)
                now[d] = at.astype(np.int64)
                best = np.maximum(best, now[d])
            rows = now
            out.append(best)
        return np.stack(out)


class PassageIndex(_Passages):
    """The passages by their seed grams: the measure of ``FingerprintIndex``, without fingerprints.

    A stretch of at least ``least`` units with at most one edit in ``per_edit`` holds an unedited run of at least ``seed``
    units: e edits leave e + 1 runs that share 7 e units or more when one in 8 may be edited, and 7 e / (e + 1) > 5 from
    e = 3 on. So looking up all runs of that length is complete.
    """

    def __init__(self, items: Sequence[tuple[int, str | None]], *, dense: bool, least: int, per_edit: int = 8, seed: int = 6):
        super().__init__(items, dense=dense, least=least, per_edit=per_edit, seed=seed)
        self.places: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for a, b in zip(self.begins.tolist(), self.ends.tolist()):
            for p in range(a, b - seed + 1):
                self.places[tuple(self.flat[p : p + seed].tolist())].append(p)

    def search(self, texts: Sequence[Sequence[str]]) -> list[set[int]]:
        """Per text (a sequence of units) the items it gives away."""
        text, starts = self.numbered(texts)
        hits = []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
            ids = text[lo:hi].tolist()
            for k, gram in enumerate(zip(*(ids[s:] for s in range(self.seed)))):
                if gram in self.places:
                    hits += [(lo + k, p) for p in self.places[gram]]
        t, p = np.array(hits, dtype=np.int64).reshape(-1, 2).T
        return self.settle(text, starts, t, p)


class FingerprintIndex(_Passages):
    """The passages as SimHash fingerprints of their windows, each hit checked exactly on the texts.

    A window holds ``seed`` units, the length of the unedited run that every stretch that counts is certain to hold (see
    ``PassageIndex``). Equal windows have equal fingerprints, so the search is complete at any ``radius``, 0 included; a
    greater one adds windows that differ a little. All document windows within ``radius`` bits of a passage window are
    found, each is checked from its first equal unit.
    """

    def __init__(self, items: Sequence[tuple[int, str | None]], *, dense: bool, least: int, per_edit: int = 8, seed: int = 6, radius: int = 1):
        super().__init__(items, dense=dense, least=least, per_edit=per_edit, seed=seed)
        whole = [np.arange(a, b - seed + 1) for a, b in zip(self.begins.tolist(), self.ends.tolist())]
        self.windows = np.concatenate(whole) if whole else np.zeros(0, dtype=np.int64)
        hashes = Units(self.names).hashes(np.maximum(self.flat, 0)) if self.names else np.zeros(0, dtype=np.uint64)
        self.index = HammingIndex(window_prints(hashes, seed)[self.windows] if len(self.windows) else np.zeros(0, dtype=np.uint64), radius)

    def search(self, texts: Sequence[Sequence[str]]) -> list[set[int]]:
        """Per text (a sequence of units) the items it gives away."""
        if not len(self.windows):
            return [set() for _ in texts]
        text, starts = self.numbered(texts)
        at, window = self.index.near(window_prints(self._units.hashes(text), self.seed))
        owner = np.searchsorted(starts, at, side="right") - 1
        whole = at + self.seed <= starts[owner + 1]
        t, p = at[whole], self.windows[window[whole]]
        equal = np.stack([text[t + k] == self.flat[p + k] for k in range(self.seed)]) if len(t) else np.zeros((self.seed, 0), dtype=bool)
        first, some = equal.argmax(axis=0), equal.any(axis=0)
        return self.settle(text, starts, (t + first)[some], (p + first)[some])


def _scan(documents: DataFrame, items: DataFrame, make: Callable[[list, bool], object]) -> DataFrame:
    rows = [(r.item_id, r.passage) for r in items.select("item_id", "passage").collect()]
    held = documents.sparkSession.sparkContext.broadcast((make(rows, False), make(rows, True)))
    schema = T.StructType([T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("doc_id", documents.schema["doc_id"].dataType)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, dense = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                b = batch.slice(lo, 1000)
                ids = b.column(0).to_pylist()
                texts = [normal(t) if t else "" for t in b.column(1).to_pylist()]
                pairs = [(item, ids[k]) for k, hits in enumerate(plain.search([word_units(t) for t in texts])) for item in hits]
                some = [k for k, t in enumerate(texts) if not t.isascii() and DENSE.search(t)]
                if some:
                    pairs += [(item, ids[some[k]]) for k, hits in enumerate(dense.search([letter_units(texts[k]) for k in some])) for item in hits]
                columns = list(zip(*pairs)) or [(), ()]
                yield pa.RecordBatch.from_pydict({"item_id": pa.array(columns[0], pa.int64()), "doc_id": pa.array(columns[1], pa.int64())})

    return documents.select(F.col("doc_id"), F.col("text")).mapInArrow(scan, schema)


def leaked(documents: DataFrame, items: DataFrame, *, words: int = 24, letters: int = 36, per_edit: int = 8, radius: int = 1) -> DataFrame:
    """(item_id, doc_id) for every document that holds a stretch of an item's passage.

    A stretch is at least ``words`` words (scripts without spaces: ``letters`` letters and digits) in order, with at most
    one unit in ``per_edit`` replaced, dropped or inserted; case, punctuation, spacing, line breaks and markup do not
    count. Candidates are SimHash windows within ``radius`` bits, found through the Hamming multi-index; windows are as long
    as the unedited run that every stretch is certain to hold, so none is lost. An exact alignment of the texts decides.
    ``items`` (item_id, passage) is the held-out set: it is stated, of
    fixed size, and goes to every executor; every document is read once, whole, in Arrow batches, and nothing is shuffled.
    Copies of a document count each. Null passages and texts match nothing; items that repeat an id count as one item.
    """
    return _scan(documents, items, lambda rows, dense: FingerprintIndex(rows, dense=dense, least=letters if dense else words, per_edit=per_edit, radius=radius))


def leaked_by_runs(documents: DataFrame, items: DataFrame, *, words: int = 24, letters: int = 36, per_edit: int = 8) -> DataFrame:
    """The same rows by unedited runs alone, without fingerprints: the measure of ``leaked``."""
    return _scan(documents, items, lambda rows, dense: PassageIndex(rows, dense=dense, least=letters if dense else words, per_edit=per_edit))
