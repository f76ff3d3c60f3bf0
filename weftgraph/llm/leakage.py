"""Evaluation passages inside corpus documents, whole or in part, with small edits.

Texts become streams of folded words with one space between (and around). By the q-gram lemma, a window of w characters with at most e
edits shares at least w + 1 - q (e + 1) of its q-grams with its copy, within a band of e diagonals to either side; q is chosen for
each window so that this is at least 1. Of e + 1 disjoint q-grams one is always left whole, so every window is looked up by its e + 1
disjoint q-grams that are rarest among the items: a stem that many items share is hardly ever looked up. In the bands around the places found all shared
q-grams are counted, regions that meet the bound are kept, and those are verified by banded alignment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftgraph.llm.codepoints import Table, fold_word_char, slices

#: Consecutive words of an item that make a leak.
WORDS = 13
#: Lengths of q-grams; a window has the longest that its lemma allows.
LADDER = (20, 12, 8, 5, 3)
#: A window may have an edit for each so many of its characters (a word of a few letters is one edit away from too many others).
CHARS_PER_EDIT = 10
#: The items' index is sent to every executor up to so many characters at once; more items go in several passes.
ITEM_CHARS = 4_000_000
#: Candidates looked at together.
TOGETHER = 200_000
FOLD = Table(fold_word_char)
BITS = 22
SPREAD = np.uint32(0x9E3779B1)
BASE = np.uint32(0x85EBCA6B)


def word_streams(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(folded characters, starts): each text as ' w1 w2 ... wn ', texts without words as one space."""
    texts = [x or "" for x in col.to_pylist()]
    if not texts:
        return np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
    f = FOLD(np.frombuffer(("\0" + "\0\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
    lead = np.cumsum([0, *(len(x) + 2 for x in texts)], dtype=np.int64)
    keep = f > 0
    keep[1:] |= keep[:-1].copy()  # the first sign behind a word is the space behind it
    keep[lead[:-1]] = True
    at = np.flatnonzero(keep)
    out = f[at]
    out[out == 0] = 32
    return out, np.searchsorted(at, lead)


def roll32(chars: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hashes of all windows of q characters, modulo 2 ** 32; equal windows have equal hashes, the reverse is verified."""
    n = len(chars) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    part, width, done = chars.astype(np.uint32), 1, 0
    h = np.zeros(n, dtype=np.uint32)
    power = lambda k: np.uint32(pow(int(BASE), k, 1 << 32))
    while width <= q:  # doubling: hashes of 2 ** k characters joined as q's binary digits ask
        if q & width:
            h *= power(width)
            h += part[done : done + n]
            done += width
        if width * 2 <= q:
            part = part[:-width] * power(width) + part[width:]
        width *= 2
    return h


def slot(h: np.ndarray) -> np.ndarray:
    return (h * SPREAD) >> np.uint32(32 - BITS)


@dataclass
class Grams:
    """The lookups of all windows with one q: distinct hashes, sorted, and of each its (item position, window) entries."""

    q: int
    hashes: np.ndarray
    first: np.ndarray
    at: np.ndarray
    win: np.ndarray
    of_items: np.ndarray  # hashes of all item positions

    def seen(self) -> np.ndarray:
        """A table by slot of which hashes may be looked up."""
        t = np.zeros(1 << BITS, dtype=bool)
        t[slot(self.hashes)] = True
        return t


@dataclass
class ItemIndex:
    """Streams and windows of a block of items, and the windows' lookups."""

    ids: np.ndarray
    chars: np.ndarray
    item: np.ndarray  # of each window
    start: np.ndarray
    size: np.ndarray
    budget: np.ndarray  # edits
    grams: list[Grams]


def disjoint(cost: np.ndarray, q: int, n: int) -> list[int]:
    """Positions of n q-grams that don't overlap, of least total cost."""
    rows = [cost]
    for _ in range(n - 1):
        low = np.minimum.accumulate(rows[-1])
        nxt = np.full(len(cost), np.inf)
        nxt[q:] = cost[q:] + low[:-q]
        rows.append(nxt)
    out = [int(np.argmin(rows[-1]))]
    for k in range(n - 2, -1, -1):
        out.append(int(np.argmin(rows[k][: out[-1] - q + 1])))
    return out


def build_index(items: list[tuple[int, str]], edits: int, words: int = WORDS) -> ItemIndex:
    """Items without a word take no part."""
    items = [x for x in items if x[0] is not None and x[1]]
    chars, starts = word_streams(pa.array([t for _, t in items], pa.string()))
    it, ws, wl = ([np.zeros(0, dtype=np.int64)] for _ in range(3))
    for k in range(len(items)):
        spaces = starts[k] + np.flatnonzero(chars[starts[k] : starts[k + 1]] == 32)
        n = min(words, len(spaces) - 1)
        if n > 0:
            it.append(np.full(len(spaces) - n, k))
            ws.append(spaces[:-n])
            wl.append(spaces[n:] - spaces[:-n] + 1)
    item, start, size = np.concatenate(it), np.concatenate(ws), np.concatenate(wl)
    budget = np.minimum(edits, size // CHARS_PER_EDIT)
    longest = np.maximum(LADDER[-1], size // (budget + 1))
    q_of = np.array([next((q for q in LADDER if q <= n), LADDER[-1]) for n in longest.tolist()], dtype=np.int64)
    own = np.repeat(np.arange(len(items)), np.diff(starts))
    grams = []
    for q in sorted(set(q_of.tolist()), reverse=True):
        h = roll32(chars, q)
        inside = own[: len(h)] == own[q - 1 : q - 1 + len(h)]
        values, back, many = np.unique(np.where(inside, h, np.uint32(0)), return_inverse=True, return_counts=True)
        cost = many[back] + h / 2.0**33  # of equally rare q-grams the same everywhere
        at, win = [], []
        for w in np.flatnonzero(q_of == q).tolist():
            got = disjoint(cost[start[w] : start[w] + size[w] - q + 1], q, int(budget[w]) + 1)
            at += [int(start[w]) + g for g in got]
            win += [w] * len(got)
        at, win = np.array(at, dtype=np.int64), np.array(win, dtype=np.int64)
        order = np.argsort(h[at], kind="stable")
        at, win = at[order], win[order]
        hashes, first = np.unique(h[at], return_index=True)
        grams.append(Grams(q, hashes, np.append(first, len(at)), at, win, h))
    return ItemIndex(np.array([i for i, _ in items], dtype=np.int64), chars, item, start, size, budget, grams)


def _shared(x: ItemIndex, g: Grams, h: np.ndarray, place: np.ndarray, win: np.ndarray, edits: int) -> np.ndarray:
    """How many of each window's q-grams stand in the document within ``edits`` diagonals of a place."""
    count = np.zeros(len(win), dtype=np.int64)
    many = x.size[win] - g.q + 1
    order = np.argsort(many, kind="stable")
    at = 0
    while at < len(order):
        wide = int(many[order[min(len(order), at + 2_000) - 1]])
        rows = order[at : at + 2_000]
        j = np.arange(wide)
        mine = g.of_items[np.minimum(x.start[win[rows]][:, None] + j, len(g.of_items) - 1)]
        hit = np.zeros(mine.shape, dtype=bool)
        for d in range(-edits, edits + 1):
            hit |= h[np.clip(place[rows][:, None] + (j + d), 0, len(h) - 1)] == mine
        hit &= j < many[rows][:, None]
        count[rows] = hit.sum(axis=1)
        at += len(rows)
    return count


def _align(x: ItemIndex, chars: np.ndarray, lo: np.ndarray, hi: np.ndarray, place: np.ndarray, win: np.ndarray, edits: int, back: bool = False, stop: int = 1 << 40) -> np.ndarray:
    """Least edits of each window against the document within ``edits`` diagonals of a place; edits + 1 means more.

    From the front, or from the back; ``stop`` ends after so many characters with what they cost at least. Pairs that can't come under the bound leave early.
    """
    band, big = np.arange(-edits, edits + 1), edits + 1
    size, start = x.size[win], x.start[win]
    out = np.full(len(win), big)
    who = np.arange(len(win))
    cost = np.zeros((len(win), len(band)), dtype=np.int16)
    for i in range(min(stop, int(size.max()) if len(win) else 0)):
        step = size[who] - 1 - i if back else np.full(len(who), i)
        at = (place[who] + step)[:, None] + band
        ok = (at >= lo[who][:, None]) & (at < hi[who][:, None])
        same = chars[np.clip(at, 0, len(chars) - 1)] == x.chars[start[who] + step][:, None]
        new = np.where(ok, cost + ~same, np.int16(big))
        a, b = (new[:, ::-1], cost[:, ::-1]) if back else (new, cost)
        a[:, :-1] = np.minimum(a[:, :-1], b[:, 1:] + 1)  # the window's character is missing in the document
        for k in range(1, len(band)):  # a character of the document is extra
            a[:, k] = np.minimum(a[:, k], a[:, k - 1] + 1)
        cost = np.minimum(new, big)
        low = cost.min(axis=1)
        ended = (size[who] == i + 1) | (i + 1 == stop)
        out[who[ended]] = low[ended]
        stay = ~ended & (low <= edits)
        if i % 4 == 3 or ended.any():
            who, cost = who[stay], cost[stay]
        if not len(who):
            break
    return out


def leaks_of(x: ItemIndex, seen: list[np.ndarray], chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Columns (row, item number, first and last document place, least edits) of every document row and item with a leaked window."""
    found = [np.zeros((5, 0), dtype=np.int64)]
    for g, table in zip(x.grams, seen):
        h = roll32(chars, g.q)
        p = np.flatnonzero(table[slot(h)])
        k = np.minimum(np.searchsorted(g.hashes, h[p]), len(g.hashes) - 1)
        right = g.hashes[k] == h[p]
        p, k = p[right], k[right]
        many = g.first[k + 1] - g.first[k]
        total = np.cumsum(many)
        at = 0
        while at < len(p):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + TOGETHER, side="right")))
            m = many[at:to]
            e = np.repeat(g.first[k[at:to]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            here = np.repeat(p[at:to], m)
            at = to
            win = g.win[e]
            place = here - g.at[e] + x.start[win]
            row = np.searchsorted(starts, here, side="right") - 1
            fits = (place >= starts[row] - x.budget[win]) & (place + x.size[win] <= starts[row + 1] + x.budget[win])
            _, one = np.unique(win[fits] * (len(chars) + 1) + place[fits], return_index=True)
            win, place, row = win[fits][one], place[fits][one], row[fits][one]
            for edits in np.unique(x.budget[win]).tolist():
                of = np.flatnonzero(x.budget[win] == edits)
                w, s, r = win[of], place[of], row[of]
                near = _align(x, chars, starts[r], starts[r + 1], s, w, edits, True, 8) <= edits  # what differs at the end leaves first
                w, s, r = w[near], s[near], r[near]
                near = _shared(x, g, h, s, w, edits) >= x.size[w] + 1 - g.q * (edits + 1)
                w, s, r = w[near], s[near], r[near]
                cost = _align(x, chars, starts[r], starts[r + 1], s, w, edits)
                good = cost <= edits
                found.append(np.stack([r, x.item[w], s - starts[r], s - starts[r] + x.size[w], cost])[:, good])
    rows = np.concatenate(found, axis=1)
    rows = rows[:, np.lexsort((rows[1], rows[0]))]
    if not rows.shape[1]:
        return rows
    first = np.flatnonzero(np.concatenate([[True], (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)]))
    return np.stack([rows[0, first], rows[1, first], np.minimum.reduceat(rows[2], first), np.maximum.reduceat(rows[3], first), np.minimum.reduceat(rows[4], first)])


def _scan(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index.value
        seen = [g.seen() for g in x.grams]
        for batch in batches:
            for b in slices(batch, "text", 800_000):
                row, item, s, t, c = leaks_of(x, seen, *word_streams(b.column("text")))
                if len(row):
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array(x.ids[item]), pa.array(s), pa.array(t), pa.array(c)], names=["doc_id", "item_id", "place", "place_end", "edits"])

    return run


def leaked(docs: DataFrame, items: DataFrame, edits: int = 1, words: int = WORDS) -> DataFrame:
    """doc_id, item_id, place, place_end, edits: documents with a window of ``words`` words of an item (all of a shorter one).

    ``edits`` is the most character edits a window may have (and at most one for each CHARS_PER_EDIT of its characters, so that short words match
    exactly); the column has the least found, 0 for a word-by-word copy. Places count characters of the folded word stream. Null, blank and wordless texts match nothing; documents of one id are reported together;
    items are read in blocks of ITEM_CHARS characters, each a pass over the documents, so the index never outgrows an executor.
    """
    spark = docs.sparkSession
    d = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    i = items.select("item_id", "text").filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    schema = "doc_id long, item_id long, place long, place_end long, edits long"
    chars = i.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(chars) // ITEM_CHARS))
    out = None
    for k in range(blocks):
        rows = i.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).distinct().collect() if chars else []
        index = spark.sparkContext.broadcast(build_index(sorted((r.item_id, r.text) for r in rows), edits, words))
        part = d.mapInArrow(_scan(index), schema)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.min("place").alias("place"), F.max("place_end").alias("place_end"), F.min("edits").alias("edits"))
