"""Vectorised word, line and shingle primitives over Arrow text columns.

Texts stay in their Arrow buffers as UTF-8 bytes; no Python string is made per row. A word is a
maximal run of bytes outside 0x20 and 0x09-0x0D, which is ``[^\\x20\\x09-\\x0D]+`` on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_PIECE = 1 << 20
_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        step = np.full(max(n, _PIECE + 1), base, dtype=np.uint64)
        step[0] = 1
        have = _powers[name] = np.multiply.accumulate(step)
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Texts:
    """Some rows' texts: ``data`` holds their bytes, row i has data[off[i]:off[i + 1]]; a null has none."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off, self.n = data, off, len(off) - 1

    def space(self) -> np.ndarray:
        d = self.data
        return (d == 32) | ((d >= 9) & (d <= 13))

    def words(self) -> None:
        """Sets ws, we (byte bounds of each word), wd (its row) and wn (words of each row)."""
        d = self.data
        solid = np.empty(len(d) + 2, dtype=bool)
        solid[0] = solid[-1] = False
        np.logical_not(self.space(), out=solid[1:-1])
        cut = np.zeros(len(d) + 1, dtype=bool)
        cut[self.off] = True
        self.ws = np.flatnonzero(solid[1:-1] & (~solid[:-2] | cut[:-1]))
        self.we = np.flatnonzero(solid[1:-1] & (~solid[2:] | cut[1:])) + 1
        self.first = np.searchsorted(self.ws, self.off)
        self.wn = np.diff(self.first)
        self.wd = np.repeat(np.arange(self.n), self.wn)
        self.first = self.first[:-1]

    def hash_spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte span; spans are sorted and don't overlap."""
        out = np.empty(len(start), dtype=np.uint64)
        at, total = 0, len(start)
        while at < total:  # in pieces, so that a very long text needs no large table
            to = max(at + 1, int(np.searchsorted(end, start[at] + _PIECE, "right")))
            lo, hi = int(start[at]), int(end[to - 1])
            power, inverse = _power_table("r", _R, hi - lo + 1), _power_table("i", _R_INV, hi - lo + 1)
            sums = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum((self.data[lo:hi].astype(np.uint64) + np.uint64(1)) * power[: hi - lo], out=sums[1:])
            s, e = start[at:to] - lo, end[at:to] - lo
            out[at:to] = (sums[e] - sums[s]) * inverse[s]
            at = to
        return mixed(out + (end - start).astype(np.uint64) * _R)

    def hashed_words(self) -> np.ndarray:
        self.words()
        self.h = self.hash_spans(self.ws, self.we)
        return self.h

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (in words) at which k words of one row begin, and the hashes of those k words."""
        g, m, power = self.h, 1, 1  # power: above those of all words so far, so that no two words share one
        for bit in bin(k)[3:]:
            g = _joined(g, g, m, power)
            m, power = 2 * m, 2 * power
            if bit == "1":
                g = _joined(g, self.h, m, power)
                m, power = m + 1, 2 * power
        n = max(0, len(self.wd) - k + 1)
        at = np.flatnonzero(self.wd[:n] == self.wd[k - 1 : k - 1 + n])
        return at, mixed(g[at])

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, 48-bit hash), sorted and distinct, of each row's runs of k words.

        A row of 1 to k - 1 words has one shingle: all its words. A row without words has none.
        """
        at, g = self.grams(k)
        rows = self.wd[at]
        short = np.flatnonzero((self.wn > 0) & (self.wn < k))
        if len(short):
            g = np.concatenate([g, [self._all(r) for r in short]])
            rows = np.concatenate([rows, short])
        both = np.sort((rows.astype(np.uint64) << np.uint64(48)) | (g >> np.uint64(16)))
        both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
        return (both >> np.uint64(48)).astype(np.int64), both & np.uint64((1 << 48) - 1)

    def _all(self, row: int) -> np.uint64:
        total = np.zeros(1, dtype=np.uint64)
        for h in self.h[self.first[row] : self.first[row] + self.wn[row]]:
            total = mixed(total * _R + h)
        return total[0]


def _joined(left: np.ndarray, right: np.ndarray, m: int, power: int) -> np.ndarray:
    """left's m-word values followed by right's at the place m words on; hashes that run over a row's end are never used."""
    n = len(left) - m
    scale = np.uint64(pow(0xD6E8FEB86659FD93, power, 1 << 64))
    out = np.zeros(len(left), dtype=np.uint64)
    if n > 0:
        out[:n] = left[:n] * scale + right[m : m + n]
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by doubling."""
    m = 1
    while 2 * m <= w:
        x = np.minimum(x[:-m], x[m:])
        m *= 2
    return np.minimum(x[: len(x) - (w - m)], x[w - m :]) if w > m else x


def sums_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each consecutive run of counts[i] values; 0 for an empty run."""
    total = np.concatenate([np.zeros(1, dtype=values.dtype), np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Parts of the batches with at most ``most`` bytes of text, or a single row, and their texts."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if col.type != pa.string():
            col = col.cast(pa.string())
        if col.null_count:
            col = col.fill_null("")
        _, off, data = col.buffers()
        n = len(col)
        off = np.frombuffer(off, dtype=np.int32, count=n + 1 + col.offset)[col.offset :].astype(np.int64) if n else np.zeros(1, dtype=np.int64)
        data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
        at = 0
        while at < n:
            to = min(n, max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1), at + 30_000)
            yield batch.slice(at, to - at), Texts(data[off[at] : off[to]], off[at : to + 1] - off[at])
            at = to
