"""SimHash windows and a multi-index over Hamming blocks.

Windows of ``size`` units slide over a text; each has a 64-bit SimHash, the majority of the hashes of its units bit by
bit. Sums of bits are held in planes (one array per binary digit), so a window costs some sixty word operations whatever
its size, and no bit is ever unpacked.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import xxhash

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


class Units(dict):
    """Unit -> number, with a table of 64-bit hashes by number; ``first`` units keep their numbers for good, the rest starts
    afresh when it has grown to ``most``."""

    def __init__(self, first: Sequence[str] = (), most: int = 1_000_000):
        super().__init__()
        self.first, self.most = list(first), most
        self.table = np.zeros(1024, dtype=np.uint64)
        self._renew()

    def _renew(self) -> None:
        self.clear()
        for unit in self.first:
            self[unit]

    def __missing__(self, unit: str) -> int:
        place = len(self)
        if place == len(self.table):
            self.table = np.concatenate((self.table, np.zeros(place, dtype=np.uint64)))
        self.table[place] = xxhash.xxh3_64_intdigest(unit.encode("utf-8", "replace"))
        self[unit] = place
        return place

    def numbers(self, units: Iterable[str], count: int) -> np.ndarray:
        """The numbers of ``count`` units; those of earlier calls stay valid only for ``first`` units."""
        if len(self) > self.most:
            self._renew()
        return np.fromiter(map(self.__getitem__, units), dtype=np.int64, count=count)

    def hashes(self, numbers: np.ndarray) -> np.ndarray:
        return self.table[numbers]


def _add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """The sums of two numbers per bit place, both given as planes from low to high."""
    out, carry = [], None
    for k in range(max(len(a), len(b))):
        x, y = a[k] if k < len(a) else None, b[k] if k < len(b) else None
        if x is None or y is None:
            one = x if y is None else y
            out.append(one if carry is None else one ^ carry)
            carry = None if carry is None else one & carry
        elif carry is None:
            out.append(x ^ y)
            carry = x & y
        else:
            both = x ^ y
            out.append(both ^ carry)
            carry = (x & y) | (both & carry)
    return out if carry is None else [*out, carry]


def window_prints(hashes: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every window of ``size`` hashes; none if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    power, width = [hashes], 1
    total: list[np.ndarray] | None = None
    at = 0
    left = size
    while left:
        if left & 1:
            part = [p[at : at + n] for p in power]
            total = part if total is None else _add(total, part)
            at += width
        left >>= 1
        if left:
            m = len(power[0]) - width
            power = _add([p[:m] for p in power], [p[width : width + m] for p in power])
            width *= 2
    least = size // 2 + 1
    above, equal = np.zeros(n, dtype=np.uint64), np.full(n, _ALL)
    for k in range(len(total) - 1, -1, -1):
        if least >> k & 1:
            equal &= total[k]
        else:
            above |= equal & total[k]
            equal &= ~total[k]
    return above | equal


class HammingIndex:
    """All pairs within ``radius`` bits of a fixed set of fingerprints.

    The 64 bits are cut into ``radius + 1`` blocks; of at most ``radius`` differing bits one block has none, so looking up
    every block by equality and comparing what is found misses nothing within the radius."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = []
        for a, b in zip(edges[:-1], edges[1:]):
            mask = np.uint64((1 << int(b - a)) - 1)
            key = ((prints >> np.uint64(a)) & mask).astype(np.int64)
            order = np.argsort(key, kind="stable")
            if b - a <= 22:
                starts = np.zeros((1 << int(b - a)) + 1, dtype=np.int64)
                np.cumsum(np.bincount(key, minlength=1 << int(b - a)), out=starts[1:])
                self.blocks.append((np.uint64(a), mask, starts, None, order, prints[order]))
            else:
                held = np.zeros(1 << 20, dtype=bool)
                held[key & 0xFFFFF] = True
                self.blocks.append((np.uint64(a), mask, held, key[order], order, prints[order]))

    def near(self, asked: np.ndarray, step: int = 16_384) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``asked``, place in the index) of all pairs within the radius, by place, each once."""
        found = [np.zeros(0, dtype=np.int64)]
        size = max(1, len(self.prints))
        for base in range(0, len(asked), step):
            part = asked[base : base + step]
            for shift, mask, starts, keys, order, values in self.blocks:
                k = ((part >> shift) & mask).astype(np.int64)
                if keys is None:
                    lo, hi = starts[k], starts[k + 1]
                    n = hi - lo
                    some = np.nonzero(n)[0]
                    n, lo = n[some], lo[some]
                else:  # the low bits of a key tell most that are not held
                    some = np.nonzero(starts[k & 0xFFFFF])[0]
                    lo = np.searchsorted(keys, k[some], "left")
                    n = np.searchsorted(keys, k[some], "right") - lo
                    some, n, lo = some[n > 0], n[n > 0], lo[n > 0]
                if not len(some):
                    continue
                ends = np.cumsum(n)
                at = np.arange(ends[-1]) + np.repeat(lo - (ends - n), n)
                left = np.repeat(some, n)
                ok = np.nonzero(np.bitwise_count(part[left] ^ values[at]) <= self.radius)[0]
                if len(ok):
                    found.append((left[ok] + base) * size + order[at[ok]])
        pairs = np.unique(np.concatenate(found))
        return pairs // size, pairs % size
