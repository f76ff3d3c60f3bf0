"""Texts of an Arrow batch as one array of code points, and lookup tables over code points."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batch: pa.RecordBatch, column: str, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes of text each (a longer text stands alone)."""
    col = batch.column(column)
    if not batch.num_rows:
        return
    ends = np.cumsum(np.asarray(pc.binary_length(col).fill_null(0)), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def decode(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, starts with the total length at the end); null counts as empty."""
    texts = [x or "" for x in col.to_pylist()]
    cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return cps, np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)])


class Table:
    """A table over all code points, filled on first sight of each."""

    def __init__(self, rule: Callable[[str], int]):
        self.rule = rule
        self.values = np.full(0x110000, -1, dtype=np.int32)

    def __call__(self, cps: np.ndarray) -> np.ndarray:
        v = self.values[cps]
        if (v < 0).any():
            for c in np.unique(cps[v < 0]).tolist():
                self.values[c] = self.rule(chr(c))
            v = self.values[cps]
        return v


def fold_word_char(c: str) -> int:
    """The lower-case letter or the digit, 0 for anything else."""
    for x in c.lower():
        if (k := unicodedata.category(x))[0] == "L" or k == "Nd":
            return ord(x)
    return 0


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            a = np.full(max(n, 4096), np.uint64(base))
            a[0] = 1
            have = _POWERS[base] = np.multiply.accumulate(a)
    return have[:n]


def rolling(values: np.ndarray, q: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Scrambled polynomial hashes of all windows of q values (none if there are fewer)."""
    n = len(values) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    v = values.astype(np.uint64)
    b = np.uint64(base)
    with np.errstate(over="ignore"):
        # doubling: hashes of 2 ** k values joined as q's binary digits ask
        part, width, done = v + np.uint64(1), 1, 0
        while width <= q:
            if q & width:
                h = h * np.uint64(pow(base, width, 1 << 64)) + part[done : done + n]
                done += width
            if width * 2 <= q:
                part = part[:-width] * np.uint64(pow(base, width, 1 << 64)) + part[width:]
            width *= 2
        del b
        return mix(h)
