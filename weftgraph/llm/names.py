"""Variant spellings of persons and organisations, linked to the entity they name.

A name is read into parts: titles go, organisation words are spelled out, given names (full, short or initials) are told
from the rare part, the key (a family or an organisation's own name). Typed-over words and keys are found by a
pigeonhole segment join: of k + 1 segments of a string at least one stands unchanged, at most k places shifted, in any string within k edits; strings too short to be cut
are looked up by what is left of them without k of their letters; candidates are verified by banded edit distance. Within a family, short forms and initials go to the one full given name they fit.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from weftgraph.operators.hotcold import salted_join
from weftgraph.session import cut, free, shuffle_partitions

c = F.col
# Titles, and words that carry nothing in an organisation's name.
TITLES = frozenset("dr prof hon mr mrs ms miss sir rev sen gov st".split())
EMPTY = frozenset("the of and for de".split())
TOKEN = re.compile(r"[^\W\d_]+")
#: A word is common if it stands beside at least COMMON different words and beside more than those do themselves: a given name beside
#: more than any of them, a word of organisations beside TIMES as many as the QUARTER of them, by names, that has the fewest. None of it depends on the number of names.
COMMON, TIMES, QUARTER = 5, 2, 0.25
#: A common word within one edit of one that is more than so many times as common is that one typed over.
SLIPS = 10
#: Aliases and common words that are sent to every executor at most: vocabularies, not rows. Beyond it there is an error, no cut.
MOST_WORDS = 1_000_000
#: Keys under LONG letters are too short for segments and are looked up by their deletions.
LONG = 8
#: Given names and words of organisations whose corrections each task looks up by itself, in a table of their deletions; beyond it they are joined.
LOCAL_WORDS = 50_000
#: Entries of one segment that a task looks through at most; a more frequent segment is dealt out.
HOT_SEGMENT = 2_000


def fold(s: str) -> str:
    """Lower case without accents and invisible characters."""
    if s.isascii():
        return s.lower()
    s = unicodedata.normalize("NFD", s)
    return "".join(c for c in s if unicodedata.category(c) not in ("Mn", "Cf")).lower()


def sound(key: str) -> str:
    """A key with letters that are heard alike written alike."""
    return plain(key).replace("ph", "f")


def plain(key: str) -> str:
    """As ``sound``, but with 'ph' left alone: one typo that makes or breaks a 'ph' is one edit here, and two there."""
    return key.replace("y", "i").replace("c", "k")


def budget(n: int) -> int:
    """Edits between keys of which the shorter has n letters: 2 from six letters on, else 1; under four letters that one is a swap of neighbours."""
    return 2 if n >= 6 else 1


def within_all(a: list[str], b: list[str], k: np.ndarray) -> np.ndarray:
    """Edit distances of pairs, swaps of neighbours counting one, in a band of width k; k + 1 if it is more.

    All pairs of a batch take each step of the band together.
    """
    n = len(a)
    if not n:
        return np.zeros(0, dtype=np.int64)
    wide = int(k.max())
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])

    def codes(x: list[str], size: np.ndarray) -> np.ndarray:
        flat = np.frombuffer("".join(x).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        out = np.zeros((n, int(size.max()) + 2 * wide + 2), dtype=np.uint32)
        r = np.repeat(np.arange(n), size)
        out[r, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + wide + 1] = flat
        return out

    x, y = codes(a, la), codes(b, lb)  # the i-th letter (from 1) stands at i + wide
    big = wide + 1
    band = 2 * wide + 1  # place d of the band is j = i - wide + d
    row = np.full((n, band), big, dtype=np.int16)
    row[:, wide:] = np.arange(wide + 1)
    before = np.full((n, band), big, dtype=np.int16)
    out = np.full(n, big)
    at_end = lb - la + wide
    reach = (at_end >= 0) & (at_end < band)
    done = reach & (la == 0)
    out[done] = row[done, at_end[done]]
    for i in range(1, int(la.max()) + 1):
        new = np.full((n, band), big, dtype=np.int16)
        for d in range(band):
            j = i - wide + d
            if j < 0 or j + wide >= y.shape[1]:
                continue
            if j == 0:
                new[:, d] = min(i, big)
                continue
            v = row[:, d] + (x[:, i + wide] != y[:, j + wide])
            if d + 1 < band:
                v = np.minimum(v, row[:, d + 1] + 1)
            if d:
                v = np.minimum(v, new[:, d - 1] + 1)
            if i > 1 and j > 1:
                swap = (x[:, i + wide] == y[:, j + wide - 1]) & (x[:, i + wide - 1] == y[:, j + wide])
                v = np.where(swap, np.minimum(v, before[:, d] + 1), v)
            new[:, d] = np.minimum(v, big)
        before, row = row, new
        done = reach & (la == i)
        out[done] = row[done, at_end[done]]
    return np.minimum(out, k + 1)


def deletions(s: str, k: int) -> set[str]:
    """The string and all strings with up to k characters left out: two strings within k edits share one."""
    if k == 1:
        return {s, *[s[:i] + s[i + 1 :] for i in range(len(s))]}
    return {"".join(s[i] for i in range(len(s)) if i not in out) for m in range(min(k, len(s)) + 1) for out in combinations(range(len(s)), m)}


def compose_given(fulls: set[str]) -> set[str]:
    """Given names built from beginnings and endings that recur in the known ones, with the known ones."""
    splits = [(f[:i], f[i:]) for f in fulls for i in range(2, len(f) - 3)]
    ends = Counter(e for _, e in splits)
    starts = Counter(s for s, _ in splits)
    good_ends = {e for e, n in ends.items() if n >= 8}
    good_ends = {e for e in good_ends if not any(e != x and x.endswith(e) and ends[x] == ends[e] for x in good_ends)}
    pairs = [(s, e) for s, e in splits if e in good_ends and starts[s] >= 2]
    by_end = Counter(e for _, e in pairs)
    use = {e for e in by_end if by_end[e] >= 8 and not any(x != e and (x.endswith(e) or e.endswith(x)) and by_end[x] > by_end[e] for x in by_end)}
    stems = {s for s, e in pairs if e in use}
    return fulls | {s + e for s in stems for e in use}


class Lexicon:
    """Given names and their short forms, organisation words, and how a name is read with them."""

    def __init__(self, aliases: list[tuple[str, str, str]], common: dict[str, int], common_org: set[str]):
        self.org_short = {fold(s): fold(f) for s, f, k in aliases if s and f and k == "org_word"}
        self.markers = set(self.org_short) | set(self.org_short.values())
        self.org = self.markers | {w for w in common_org if len(w) > 2}
        known = {fold(f) for s, f, k in aliases if s and f and k == "given"}
        self.alias: dict[str, set[str]] = defaultdict(set)
        for s, f, k in aliases:
            if s and f and k == "given":
                self.alias[fold(s)].add(fold(f))
        full = {w for w in compose_given(known) if len(w) > 3}
        self.starts = {g[:i] for g in full for i in range(2, len(g))}
        self.tails = {g[i:] for g in full for i in range(1, len(g) - 3)}
        # a common word that is a short form of a known name, or that name typed over, isn't a name of its own
        own = {w: n for w, n in common.items() if len(w) > 3 and not self.is_short(w)}
        by_deletion: dict[str, set[str]] = defaultdict(set)
        for g in full | set(own):
            for x in deletions(g, 1):
                by_deletion[x].add(g)

        def typed_over(w: str) -> bool:
            near = {g for x in deletions(w, 1) for g in by_deletion[x] if g != w and (g in full or own.get(g, 0) > SLIPS * own[w])}
            return len(w) > 4 and bool((within_all([w] * len(near), sorted(near), np.ones(len(near), dtype=np.int64)) <= 1).any())

        self.given = (full | {w for w in own if not typed_over(w)}) - self.org - EMPTY - TITLES
        self.starts = {g[:i] for g in self.given for i in range(2, len(g))}
        self.tails = {g[i:] for g in self.given for i in range(1, len(g) - 3)}

    def words(self, name: str) -> list[str]:
        """The words of a name, without titles."""
        words = TOKEN.findall(fold(name))
        words = [w for w in words if w not in TITLES or len(words) == 1]
        return [x for w in words for x in ((w[:-2], "of") if w.endswith("of") and w[:-2] in self.org else (w,))]

    def unknown(self, name: str) -> list[str]:
        """Words that may be typed-over given names or words of organisations."""
        return [w for w in self.words(name) if len(w) > 4 and w not in self.given and w not in self.org]

    def corrections(self, names: list[str]) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
        """The given names and the words of organisations within one edit of each unknown word of the names, as ``segment_join`` would find them."""
        if not hasattr(self, "_near"):
            self._near: dict[str, list[tuple[int, str]]] = {}
            for i, known in enumerate((self.given, [g for g in self.org if len(g) > 4])):
                for g in known:
                    for x in deletions(g, 1) if len(g) > 1 else ():
                        self._near.setdefault(x, []).append((i, g))
        asked = [(w, i, g) for w in {w for name in names for w in self.unknown(name)} for i, g in sorted({x for left in deletions(w, 1) if left in self._near for x in self._near[left]})]
        found = within_all([w for w, _, _ in asked], [g for _, _, g in asked], np.ones(len(asked), dtype=np.int64)) <= 1
        out: tuple[dict[str, list[str]], dict[str, list[str]]] = ({}, {})
        for (w, i, g), ok in zip(asked, found):
            if ok:
                out[i].setdefault(w, []).append(g)
        return out

    def base(self, w: str) -> str:
        """A short form without its pet ending: kevvie and kevy give kev."""
        b = w[:-2] if w.endswith("ie") else w[:-1] if w[-1:] in "yo" else w
        if len(b) > 2 and b[-1] == b[-2] and b not in self.starts:
            b = b[:-1]
        return b

    def is_short(self, w: str) -> bool:
        return len(w) == 1 or w in self.alias or (3 <= len(w) <= 7 and (w in self.starts or self.base(w) in self.starts or w in self.tails))

    def read(self, name: str, fixes: dict[str, list[str]], org_fixes: dict[str, list[str]]) -> tuple[str, str, list[str], list[str]] | None:
        """(kind 'p' or 'o', key with 'ph' left alone, given names in order, organisation words), or None if there is no key.

        ``fixes`` and ``org_fixes`` have the given names and the words of organisations within one edit of a word.
        """
        words = self.words(name)
        spelled = [self.org_short.get(w, w) for w in words]
        org = [w for w in spelled if w in self.org]
        if not any(w in self.given for w in spelled):
            fixed = []
            for w in spelled:
                close = org_fixes.get(w, [])
                fixed.append(close[0] if close else w)
            if len([w for w in fixed if w in self.org]) > len(org):
                spelled, org = fixed, [w for w in fixed if w in self.org]
        if org:
            rest = [w for w in spelled if w not in self.org and w not in EMPTY]
            key = "".join(rest)
            return ("o", plain(key), [], sorted(set(org))) if key else None
        given: list[str] = []
        rest = []
        for w in words:
            if w in self.given or len(w) == 1:
                given.append(w)
                continue
            close = fixes.get(w, [])
            if close:
                given.append(close[0] if len(close) == 1 else "?" + "|".join(close))
                continue
            glued = next((w[:i] for i in range(min(len(w) - 4, 12), 5, -1) if w[:i] in self.given), "") if len(w) > 12 else ""
            if glued:
                given.append(glued)
                rest.append(w[len(glued) :])
                continue
            rest.append(w)
        if not any(len(g) > 1 for g in given) and len(rest) > 1:
            shorts = [w for w in rest if self.is_short(w)]
            if shorts and len(shorts) < len(rest):
                # the short form comes first or last; of several the first in the name's order is the given name
                given = [shorts[0], *given]
                rest.remove(shorts[0])
        elif len(given) == 1 and len(given[0]) > 1 and len(rest) > 1 and given[0] in words:
            # a short first name before a full second one
            i = words.index(given[0])
            if i and words[i - 1] in rest and self.is_short(words[i - 1]):
                given = [words[i - 1], *given]
                rest.remove(words[i - 1])
        key = "".join(rest)
        return ("p", plain(key), given[:2], []) if key else None

    def forms(self, full: str) -> list[tuple[str, int]]:
        """(short form, rank) that may stand for a full given name: 0 itself, 1 listed, 2 by its build, 3 the initial."""
        out = {full[:1]: 3}
        out |= {full[:i]: 2 for i in range(2, len(full))}
        out |= {full[i:]: 2 for i in range(1, len(full) - 3)}
        out |= {"t" + full[i : i + 3]: 2 for i in range(2, len(full) - 3)}
        out |= {s: 1 for s, fs in self.alias.items() if full in fs}
        out[full] = 0
        return list(out.items())


def _unknown(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = lexicon.value
        for b in batches:
            rows = [(n, w) for n in b.column("name").to_pylist() for w in dict.fromkeys(x.unknown(n))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["name", "word"])

    return run


def _read(lexicon, local: bool):
    """``local``: corrections are looked up here and not in the column ``fixes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = lexicon.value
        for b in batches:
            got = []
            given = b.column("name").to_pylist()
            shared = x.corrections(given) if local else None
            for name, fixes in zip(given, [None] * b.num_rows if local else b.column("fixes").to_pylist()):
                near = shared or ({}, {})
                for f in sorted(fixes or [], key=lambda f: f["b"]):
                    near[f["grp"] == "o"].setdefault(f["word"], []).append(f["b"])
                got.append(x.read(name, *near))
            keep = pa.array([g is not None for g in got], pa.bool_())
            rows = [g for g in got if g is not None]
            first = [g[2][0] if g[2] else "" for g in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column("name").filter(keep), b.column("is_entity").filter(keep), pa.array([g[0] for g in rows], pa.string()), pa.array([sound(g[1]) for g in rows], pa.string()), pa.array([g[1] for g in rows], pa.string()), pa.array(first, pa.string()), pa.array([" ".join(g[3]) for g in rows], pa.string()),
                 pa.array([f if f in x.given else "" for f in first], pa.string())],
                names=["name", "is_entity", "kind", "key", "plain", "first", "words", "full"],
            )

    return run


def read_names(names: DataFrame, lex) -> DataFrame:
    """name, is_entity, kind, key, plain, first, words, full of names (name, is_entity) that hold a key, typed-over given names and words of organisations read as such."""
    spark = names.sparkSession
    schema = "name string, is_entity boolean, kind string, key string, plain string, first string, words string, full string"
    if len(lex.value.given) + len(lex.value.org) <= LOCAL_WORDS:
        return names.select("name", "is_entity").mapInArrow(_read(lex, True), schema)
    known = [("g", g) for g in sorted(lex.value.given)] + [("o", g) for g in sorted(lex.value.org) if len(g) > 4]
    unknown = cut(names.mapInArrow(_unknown(lex), "name string, word string"))
    asked = unknown.select("word").distinct().select(F.explode(F.array(F.lit("g"), F.lit("o"))).alias("grp"), c("word").alias("key"))
    near = segment_join(asked, spark.createDataFrame(known, "grp string, key string"), 1)
    fixes = unknown.join(near.select("grp", c("a").alias("word"), "b"), "word").groupBy("name").agg(F.collect_list(F.struct("word", "grp", "b")).alias("fixes"))
    return names.join(fixes, "name", "left").select("name", "is_entity", "fixes").mapInArrow(_read(lex, False), schema)


def segments(n: int, k: int) -> list[tuple[int, int]]:
    """(start, end) of k + 1 nearly equal segments of n letters."""
    base, extra = divmod(n, k + 1)
    ends = np.cumsum([0] + [base + (i >= k + 1 - extra) for i in range(k + 1)]).tolist()
    return list(zip(ends, ends[1:]))


def probes(n: int, k: int, least: int = 0) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(length, segment number, slices) of keys of n letters, under which a key of ``least`` letters or more within k edits is indexed.

    Some segment i stands whole with at most i edits before it and k - i behind it, which bounds how far it can be shifted. Or else a swap
    crosses a border and damages two: for k = 1 the swapped key itself is looked up, for k = 2 what the swap makes of the first
    segment, if it crosses the first border and the other edit comes later, or of the last one, if it crosses the last border and the other comes before.
    """
    out = []
    for length in range(max(k + 1, n - k, least), n + k + 1):
        places, delta = segments(length, k), n - length
        for i, (at, end) in enumerate(places):
            low, high = max(-i, delta - (k - i)), min(i, delta + (k - i))
            out += [(length, i, [(start, start + end - at)]) for start in range(max(0, at + low), min(n - (end - at), at + high) + 1)]
        if k == 1 and not delta:
            h = places[1][0]
            out.append((length, -1, [(0, h - 1), (h, h + 1), (h - 1, h), (h + 1, n)]))
        if k == 2 and abs(delta) < 2:
            h, g = places[1][0], places[2][0] + delta
            if h < n:
                out.append((length, 0, [(0, h - 1), (h, h + 1)]))
            if 0 < g < n:
                out.append((length, 2, [(g - 1, g), (g + 1, n)]))
    return out


def signatures(keys: list[str]) -> np.ndarray:
    """64 bits a key: whether it has a letter of each of 32 classes, and whether it has two. An edit changes two of them at most, one that adds or drops a letter one, a swap none."""
    size = np.array([len(x) for x in keys], dtype=np.int64)
    flat = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    n = np.bincount(np.repeat(np.arange(len(keys)), size) * 32 + flat % 32, minlength=len(keys) * 32).reshape(len(keys), 32)
    return np.packbits(np.concatenate([n > 0, n > 1], axis=1), axis=1).view(np.int64).ravel()


def _index(k: int, probe: bool, least: int = 0):
    """The places where keys are looked up or indexed, for all keys of one length in a batch at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5_000):
                b = batch.slice(at, 5_000)
                size = pc.utf8_length(b.column("key")).to_numpy(zero_copy_only=False)
                sig = signatures(b.column("key").to_pylist())
                out: list[list] = [[], [], [], [], []]
                for n in np.unique(size).tolist():
                    rows = np.flatnonzero(size == n)
                    grp, key, bits = b.column("grp").take(pa.array(rows)), b.column("key").take(pa.array(rows)), pa.array(sig[rows])
                    where = probes(n, k, least) if probe else [(n, i, [x]) for i, x in enumerate(segments(n, k))] + [(n, -1, [(0, n)])] * (k == 1)
                    for length, i, slices in where:
                        parts = [pc.utf8_slice_codeunits(key, x, y) for x, y in slices if y > x]
                        text = parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, "")
                        for col, v in zip(out, (grp, pa.array(np.full(len(rows), length * 4 + i + 1, dtype=np.int32)), text, key, bits)):
                            col.append(v)
                types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([x.cast(t) for x in col]) if col else pa.array([], t) for col, t in zip(out, types)], names=["grp", "slot", "text", "key", "sig"])

    return run


def _verify(k: int | None):
    """Keeps pairs within ``k`` edits, or, for None, within the budget of the shorter key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                b = batch.slice(at, 20_000)
                x, y = b.column("a").to_pylist(), b.column("b").to_pylist()
                most = np.array([budget(min(len(p), len(q))) if k is None else k for p, q in zip(x, y)], dtype=np.int64)
                d = within_all(x, y, most)
                keep = d <= most
                if k is None:
                    keep &= np.array([min(len(p), len(q)) > 3 or sorted(p) == sorted(q) for p, q in zip(x, y)], dtype=bool)
                yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("a"), b.column("b"), pa.array(d.astype(np.int32))], names=["grp", "a", "b", "dist"]).filter(pa.array(keep))

    return run


def dealt_join(probe: DataFrame, index: DataFrame, on: list[str]) -> DataFrame:
    """Inner join; entries of the index that have more than HOT_SEGMENT equals are dealt out, and what asks for them goes to every part.

    The broadcast list holds only such keys: at most all entries / HOT_SEGMENT.
    """
    hot = F.broadcast(index.groupBy(*on).agg(F.count("*").alias("__n")).filter(c("__n") > HOT_SEGMENT).select(*on, F.ceil(c("__n") / HOT_SEGMENT).cast("int").alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    i = index.join(hot, on, "left").withColumn("__part", F.pmod(F.xxhash64("b"), parts).cast("int")).drop("__parts")
    p = probe.join(hot, on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return p.join(i, [*on, "__part"])


def segment_join(keys: DataFrame, targets: DataFrame, k: int, least: int = 0) -> DataFrame:
    """grp, a, b, dist: keys (grp, key) and the different targets of their group within ``k`` edits (1 or 2), swaps of neighbours counting one; both need k + 1 letters, targets ``least``.

    Chance pairs that share a segment grow with the square of the keys, so their letters are compared where they meet, by signatures, and only what passes travels on.
    """
    parts = shuffle_partitions(keys.sparkSession)  # a key gives many rows, so few keys are spread too
    cuttable = lambda d, n: d.filter(F.length("key") >= n).select("grp", "key").repartition(parts, "grp", "key").distinct()
    placed = lambda d, f, *names: d.mapInArrow(f, "grp string, slot int, text string, key string, sig long").select(F.xxhash64("grp", "slot", "text").alias("place"), *[c(x).alias(y) for x, y in zip(("grp", "key", "sig"), names)])
    index = placed(cuttable(targets, max(k + 1, least)), _index(k, False), "grp_b", "b", "sig_b")
    probe = placed(cuttable(keys, k + 1), _index(k, True, least), "grp", "a", "sig_a")
    bits = F.bit_count(c("sig_a").bitwiseXOR(c("sig_b")))
    alike = (bits <= 2 * k) & (bits <= 2 * k - F.abs(F.length("a") - F.length("b")))  # the first, cheaper one decides nearly all
    pairs = dealt_join(probe, index, ["place"]).filter(alike & (c("grp") == c("grp_b")) & (c("a") != c("b"))).select("grp", "a", "b").distinct()
    return pairs.mapInArrow(_verify(k), "grp string, a string, b string, dist int")


def _left_out(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(g, t, s) for g, s in zip(b.column("grp").to_pylist(), b.column("key").to_pylist()) for t in deletions(s, budget(len(s)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["grp", "text", name])

    return run


def short_join(keys: DataFrame, targets: DataFrame) -> DataFrame:
    """grp, a, b, dist: as ``segment_join``, within their budget, for keys and targets under LONG letters."""
    short = lambda d: d.filter(F.length("key") < LONG).select("grp", "key").distinct()
    probe = short(keys).mapInArrow(_left_out("a"), "grp string, text string, a string")
    index = short(targets).mapInArrow(_left_out("b"), "grp string, text string, b string")
    pairs = dealt_join(probe, index, ["grp", "text"]).filter("a <> b").select("grp", "a", "b").distinct()
    return pairs.mapInArrow(_verify(None), "grp string, a string, b string, dist int")


def _bounded(df: DataFrame, what: str) -> list:
    rows = df.limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} {what}")
    return rows


def lexicon(names: DataFrame, aliases: DataFrame) -> Lexicon:
    """The listed aliases and the common words: given names stand beside many families, and few of those beside so many given names."""
    listed = [(r.short_form, r.full_form, r.alias_kind) for r in _bounded(aliases.select("short_form", "full_form", "alias_kind").distinct(), "aliases")]
    marks = sorted({fold(x) for s, f, k in listed if k == "org_word" and s and f for x in (s, f)})
    tokens = names.select(F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace("name", r"[\p{Cf}\p{Mn}]", "")), r"[^\p{L}]+"), lambda t: F.length(t) > 2)).alias("ts"))
    is_org = F.arrays_overlap("ts", F.array(*[F.lit(m) for m in marks])) if marks else F.lit(False)
    skip = [F.lit(w) for w in [*marks, *EMPTY, *TITLES]]
    beside = tokens.select(is_org.alias("is_org"), "ts", F.explode("ts").alias("t")).select("is_org", "t", F.explode(F.array_except("ts", F.array(*skip))).alias("o")).filter("t <> o")
    beside = cut(beside.groupBy("is_org", "t", "o").agg(F.count("*").alias("w")))
    many = cut(beside.groupBy("is_org", "t").agg(F.count("*").alias("n")))
    mine = beside.join(many.filter(c("n") >= COMMON), ["is_org", "t"]).join(many.select("is_org", c("t").alias("o"), c("n").alias("m")), ["is_org", "o"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    usual = mine.groupBy("is_org", "t", "n").agg(F.max("m").alias("most"), F.percentile("m", QUARTER, c("w")).alias("few"))
    rows = _bounded(usual.filter(F.when(c("is_org"), c("n") > TIMES * c("few")).otherwise(c("n") > c("most"))), "common words")
    return Lexicon(listed, {fold(r.t): r.n for r in rows if not r.is_org}, {fold(r.t) for r in rows if r.is_org})


def related(records: DataFrame) -> DataFrame:
    """kind, a, b, dist: keys of a kind within their budget of edits of each other, of which one is an entity's, whatever given names stand beside them.

    Edits are counted between the sounds of keys and, where one of them has a 'ph', between the keys with 'ph' left alone too.
    """
    def keyed(*parts) -> DataFrame:
        one = [records.filter(where).select(c("kind").alias("grp"), c(key).alias("key"), F.lit(1 << i).alias("bit")) for i, (key, where) in enumerate(parts)]
        return cut(one[0].unionByName(one[1]).unionByName(one[2]).groupBy("grp", "key").agg(F.bit_or("bit").alias("bits")))

    ph = c("plain").contains("ph")
    # the few probe: entities' keys among all; of keys with a 'ph', which are few, all among entities' and entities' among the others
    few = keyed(("key", c("is_entity")), ("plain", ph), ("plain", ph & c("is_entity")))
    many = keyed(("key", F.lit(True)), ("plain", c("is_entity")), ("plain", ~ph))
    size, tag = F.length("key"), lambda d, x: d.select(F.concat("grp", F.lit(x)).alias("grp"), "key")
    # two edits between a short key and a longer one: the short one probes, whichever side it is on
    probing = tag(few.filter(size >= 6), "+").unionByName(tag(many.filter(size.between(6, LONG - 1)), "-"))
    indexed = tag(many.filter(size >= LONG), "+").unionByName(tag(few.filter(size.between(LONG, LONG + 1)), "-"))
    near = segment_join(probing, indexed, 2, LONG).unionByName(short_join(tag(few, "+"), tag(many, "+")))
    turned = F.substring("grp", -1, 1) == "-"
    near = near.select(F.substring("grp", 1, 1).alias("kind"), F.when(turned, c("a")).otherwise(c("b")).alias("a"), F.when(turned, c("b")).otherwise(c("a")).alias("b"), "dist")
    bits = lambda d, x: d.select(c("grp").alias("kind"), c("key").alias(x), c("bits").alias(f"bits_{x}"))
    near = near.join(bits(many, "a"), ["kind", "a"]).join(bits(few, "b"), ["kind", "b"]).filter(c("bits_a").bitwiseAND(c("bits_b")) != 0)
    bare = lambda x: F.replace(x, F.lit("ph"), F.lit("f"))
    near = near.select("kind", bare(c("a")).alias("a"), bare(c("b")).alias("b"), "dist").filter("a <> b")
    return near.groupBy("kind", "a", "b").agg(F.min("dist").alias("dist"))


def roots(records: DataFrame) -> DataFrame:
    """kind, key, root: each key's nearest relative of more support (of equal ones the best supported), followed until nothing changes."""
    keys = records.groupBy("kind", "key").agg(F.countDistinct("name").alias("support"))
    keys = cut(keys)
    near = related(records)
    free(records.sparkSession)
    both = near.unionByName(near.select("kind", F.col("b").alias("a"), F.col("a").alias("b"), "dist")).distinct()
    ka, kb = keys.select("kind", F.col("key").alias("a"), F.col("support").alias("sa")), keys.select("kind", F.col("key").alias("b"), F.col("support").alias("sb"))
    up = both.join(ka, ["kind", "a"]).join(kb, ["kind", "b"]).filter("sb > sa or (sb = sa and b < a)")
    best = F.min(F.struct("dist", (-c("sb")).alias("s"), "b")).alias("m")
    parent = cut(up.groupBy("kind", "a").agg(best).select("kind", "a", c("m.b").alias("p")))
    while True:  # each round doubles the steps followed; support only grows along them, so there is an end
        nxt = parent.select("kind", F.col("a").alias("p"), F.col("p").alias("pp"))
        parent = cut(parent.join(nxt, ["kind", "p"], "left").select("kind", "a", F.coalesce("pp", "p").alias("p"), c("pp").isNotNull().alias("on")))
        if not parent.filter("on").limit(1).count():
            break
        parent = parent.drop("on")
    del near, both, up
    free(records.sparkSession)
    return keys.join(parent.select("kind", c("a").alias("key"), "p"), ["kind", "key"], "left").select("kind", "key", F.coalesce("p", "key").alias("root"))


def _forms(lex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = lex.value
        for b in batches:
            rows = [(r, f, s, k) for r, f in zip(b.column("root").to_pylist(), b.column("full").to_pylist()) for s, k in x.forms(f)]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int32()))], names=["root", "full", "form", "rank"])

    return run


def _asked(lex):
    """The forms under which a short given name is looked up: as typed, without its pet ending, or its possible corrections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = lex.value
        for b in batches:
            rows = []
            for r, f in zip(b.column("root").to_pylist(), b.column("first").to_pylist()):
                asked = f[1:].split("|") if f.startswith("?") else {f, x.base(f)} if len(f) > 1 else {f}
                rows += [(r, f, s) for s in asked if s]
            cols = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["root", "first", "form"])

    return run


def resolve(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, entity: for ``names`` (name, is_entity; distinct), the entity key of each name that can be read as one."""
    spark = names.sparkSession
    lex = spark.sparkContext.broadcast(lexicon(names.filter("is_entity").select("name"), aliases))
    records = cut(read_names(names, lex).drop("words"))
    root = roots(records)
    r = cut(records.select("name", "kind", "key", "first", "full").join(root, ["kind", "key"]).drop("key"))
    del records, root
    free(spark)
    orgs = r.filter("kind = 'o'").select("name", F.concat(F.lit("o|"), "root").alias("entity"))
    people = r.filter("kind = 'p'")
    fulls = people.filter("full <> ''").select("root", "full").distinct()
    full_people = people.filter("full <> ''").select("name", F.concat_ws("|", F.lit("p"), "root", "full").alias("entity"))
    short = people.filter("full = '' and first <> ''").select("name", "root", "first")
    wants = short.select("root", "first").distinct().mapInArrow(_asked(lex), "root string, first string, form string")
    fits = wants.join(fulls.mapInArrow(_forms(lex), "root string, full string, form string, rank int"), ["root", "form"])
    best = fits.groupBy("root", "first", "full").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("root", "first")
    best = best.withColumn("least", F.min("rank").over(w)).filter("rank = least").groupBy("root", "first").agg(F.count("*").alias("n"), F.min("full").alias("full"))
    one = best.filter("n = 1").select("root", "first", "full")
    has_full = fulls.groupBy("root").agg(F.count("*").alias("n_full"), F.min("full").alias("only"))
    # a family without any full given name: one person if the forms agree in their first letter
    letters = short.groupBy("root").agg(F.countDistinct(F.substring(F.ltrim(F.lit("?"), F.col("first")), 1, 1)).alias("n_letters"))
    s = short.join(one, ["root", "first"], "left").join(has_full, "root", "left").join(letters, "root", "left")
    initial = F.substring(F.ltrim(F.lit("?"), F.col("first")), 1, 1)
    tail = F.when(F.col("full").isNotNull(), F.col("full")).when(F.col("n_full").isNull() & (F.col("n_letters") <= 1), F.lit("*")).when(F.col("n_full").isNull(), F.concat(F.lit("*"), initial)).otherwise(F.concat(F.lit("?"), F.col("first")))
    short_people = s.select("name", F.concat_ws("|", F.lit("p"), "root", tail).alias("entity"))
    bare = people.filter("first = ''").select("name", "root").join(has_full, "root", "left").join(letters, "root", "left")
    bare_tail = F.when(F.col("n_full") == 1, F.col("only")).when(F.col("n_full").isNull() & (F.coalesce("n_letters", F.lit(0)) <= 1), F.lit("*"))
    bare_people = bare.select("name", F.concat_ws("|", F.lit("p"), "root", F.coalesce(bare_tail, F.lit("??"))).alias("entity"))
    return orgs.unionByName(full_people).unionByName(short_people).unionByName(bare_people)


def link(nodes: DataFrame, triples: DataFrame, aliases: DataFrame) -> DataFrame:
    """entity_id, ref_kind, ref_id: every writing of an entity that at least one 'Entity' node names.

    Null and blank names and null ids name nothing; rows delivered twice count once; a writing that fits several entities of a family is left out. Empty tables give no rows.
    """
    n = nodes.filter((F.col("node_type") == "Entity") & F.col("node_id").isNotNull() & F.col("label").isNotNull()).groupBy("node_id").agg(F.min("label").alias("label"))
    t = triples.filter(F.col("triple_id").isNotNull()).groupBy("triple_id").agg(F.min(F.struct("source", "target")).alias("r")).select("triple_id", "r.source", "r.target")
    typed = t.select("triple_id", F.explode(F.array(*[F.struct(F.lit(f).alias("ref_kind"), F.col(f).alias("name")) for f in ("source", "target")])).alias("r")).select("triple_id", "r.ref_kind", "r.name").filter("name is not null")
    counts = cut(n.select(F.col("label").alias("name"), F.lit(1).alias("e"), F.lit(0).alias("k")).unionByName(typed.select("name", F.lit(0).alias("e"), F.lit(1).alias("k"))).groupBy("name").agg((F.max("e") > 0).alias("is_entity"), F.sum("k").alias("k"), F.sum("e").alias("e")))
    free(nodes.sparkSession)
    entity = resolve(counts.select("name", "is_entity"), aliases)
    known = cut(counts.join(entity, "name").drop("is_entity"))
    del counts, entity
    free(nodes.sparkSession)
    node_names = salted_join(n.withColumnRenamed("label", "name"), known.filter("e > 0").select("name", "entity", "e"), ["name"], "e")
    node_names = cut(node_names.filter(~F.col("entity").endswith("|??")))
    heads = node_names.groupBy("entity").agg(F.min(F.struct("node_id", "name")).alias("h"), F.count("*").alias("n")).select("entity", F.col("h.node_id").alias("entity_id"), F.col("h.name").alias("head"), "n")
    heads = cut(heads)
    a = salted_join(node_names, heads, ["entity"], "n").filter("node_id <> entity_id").select("entity_id", F.lit("node").alias("ref_kind"), F.col("node_id").alias("ref_id"))
    per_name = known.filter("k > 0").join(heads.select("entity", "entity_id", "head"), "entity").select("name", "entity_id", "head", "k").filter("name <> head")
    b = salted_join(typed, per_name.select("name", "entity_id", "k"), ["name"], "k").select("entity_id", "ref_kind", F.col("triple_id").alias("ref_id"))
    return a.unionByName(b)
