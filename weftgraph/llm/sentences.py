"""Sentences of texts in any script.

Candidate boundaries are end marks (and, in Thai, spaces) outside quotations and brackets; a blank line always ends a unit. A
maximum-entropy classifier decides each candidate from its neighbourhood: the tokens on both sides, their case, length,
digits and script, the mark, the closers and the gap. It is trained on boundaries that are certain without it: ends of
paragraphs on one side, marks before a lower-case letter, after a title or an initial, or inside a number on the other.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftgraph.llm.codepoints import slices

#: Articles the classifier is fitted on, at most, and the longest that may be among them (the sample must fit on the driver).
TRAIN_ARTICLES = 2_000
LONGEST_TRAINING = 20_000
DIMS = 1 << 15
# Abbreviations (lower case, without the last period) that stand before what they belong to.
BEFORE_NAME = frozenset(
    "mr mrs ms dr prof sr sra srta dra st ste mt ft gen col lt sgt capt maj cmdr adm sen rep gov pres rev hon fr hr frl nr no nos vol fig figs p pp art bros vs cf ca approx "
    "m mm mme mmes mlle me mgr d dª dña ud uds sig dott ing avv vd kap abb abs bd tel z u zb bzw vgl evtl ggf "
    "г-н г-жа им ул стр рис т тт тов гр проф акад см напр κ κα κος δρ καθ αρ σελ डॉ श्री सुश्री प्रो प्रा पं "
    "e.g i.e p.ex e.g. i.e. p. ex z. б т. tues jan feb mar apr jun jul aug sept sep oct nov dec".split()
)
# Words of clauses that report speech in scripts without capitals.
REPORTING = ("कहा", "बोले", "बोला", "बताया", "पूछा", "说", "說", "道", "表示", "と", "って", "قال", "أضاف", "กล่าว", "พูด")
OPEN = {"«": "»", "“": "”", "‘": "’", "„": "“", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "‹": "›"}
CLOSE = "»”’“」』)）]】》›\"'"
MARK = re.compile(r"[.!?…。｡．！？।॥۔؟።;;]+(?:[   ](?=[!?]))?[!?]*")
BLANK = re.compile(r"[^\S\r\n]*(?:\r\n|[\r\n  ])(?:[^\S\r\n]*(?:\r\n|[\r\n  ]))+")
WORD = re.compile(r"\w[\w'’.-]*\w|\w")
# what stands before a mark, read backwards
TOKEN_BACK = re.compile(r"[^\s(\[«“\"„‘「『]*")
WORD_BACK = re.compile(r"\s*(\S*)")
SIGNS = re.compile("[" + re.escape("".join(OPEN) + "".join(OPEN.values())) + "\"']")
OPENER = {v: k for k, v in OPEN.items() if k not in "‘„"}
SINGLE_END = re.compile(r"(?<=[.!?,…])'(?!\w)")
CURLY_END = re.compile(r"’(?!\w)")
CLOSERS = re.compile("[   " + re.escape(CLOSE) + "]*")
THAI = re.compile(r"[฀-๿]")


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Stretches between blank lines, without white space at either end."""
    out, at = [], 0
    for a, b in [*((m.start(), m.end()) for m in BLANK.finditer(text)), (len(text), len(text))]:
        s = text[at:a]
        if s.strip():
            lead = len(s) - len(s.lstrip())
            out.append((at + lead, at + len(s.rstrip())))
        at = b
    return out


def enclosures(text: str) -> list[tuple[int, int]]:
    """Outermost quotations and brackets [start, end) of a paragraph; what is never closed encloses nothing.

    A straight double quote opens after white space or at the start and closes elsewhere; a straight single one is a quote only if it opens
    before a letter after white space and closes after an end mark or comma. All ends are known after one pass: those of brackets by stacks, those of quotes by sorted places.
    """
    at: dict[str, list[int]] = defaultdict(list)
    ends: dict[int, int] = {}
    stacks: dict[str, list[int]] = defaultdict(list)
    order = []
    for m in SIGNS.finditer(text):
        k, x = m.start(), m.group()
        at[x].append(k)
        order.append(k)
        if x in OPEN:
            stacks[x].append(k)
        elif stacks[o := OPENER.get(x, "")]:
            ends[stacks[o].pop()] = k
    if not order:
        return []
    single, curly = [m.start() for m in SINGLE_END.finditer(text)], [m.start() for m in CURLY_END.finditer(text)]

    def after(places: list[int], k: int) -> int:
        i = bisect_right(places, k)
        return places[i] if i < len(places) else -1

    found: list[tuple[int, int]] = []
    free = 0
    for a in order:
        c = text[a]
        if a < free or not (c in OPEN or c in "\"'"):
            continue
        left = text[a - 1] if a else " "
        if c == '"':
            end = after(at['"'], a)
        elif c == "'":
            opens = not left.isalnum() and a + 1 < len(text) and not text[a + 1].isspace()
            end = after(single, a) if opens else -1
        elif c == "‘":
            end = after(curly, a) if not left.isalnum() else -1
        elif c == "“" and at["„"] and at["„"][0] < a and not (at["”"] and at["”"][-1] > a):
            end = -1
        elif c == "„":
            end = min((k for k in (after(at["“"], a), after(at["”"], a)) if k >= 0), default=-1)
        else:
            end = ends.get(a, -1)
        if end > a:
            found.append((a, end + 1))
            free = end + 1
    return found


@lru_cache(1 << 16)
def _shape(tok: str) -> str:
    if not tok:
        return "none"
    c = tok[0]
    if tok.isdigit():
        return "num1" if len(tok) < 3 else "num3" if len(tok) < 4 else "num4"
    if c.isdigit():
        return "numx"
    if not (c.isupper() or c.islower()):
        return "other" if c.isalpha() else "punct"
    if len(tok) == 1:
        return "I" if c.isupper() else "i"
    if re.fullmatch(r"(?:\w\.)+\w?", tok):
        return "acr"
    if c.isupper():
        return "UP" if tok.isupper() else "Cap"
    return "camel" if any(x.isupper() for x in tok[1:4]) else "low"


@lru_cache(1 << 12)
def _script(c: str) -> str:
    o = ord(c) if c else 0
    for name, a, b in (("lat", 0x41, 0x24F), ("ell", 0x370, 0x3FF), ("cyr", 0x400, 0x52F), ("ara", 0x600, 0x6FF), ("dev", 0x900, 0x97F), ("tha", 0xE00, 0xE7F), ("kan", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF)):
        if a <= o <= b:
            return name
    return "-"


def _next_token(text: str, at: int) -> tuple[str, str, str]:
    """(openers, token, what follows it) from a position on."""
    k = at
    while k < len(text) and (text[k] in OPEN or text[k] in "\"'¿¡-–—*"):
        k += 1
    m = WORD.match(text, k)
    if not m:
        return text[at:k], text[k : k + 1], ""
    return text[at:k], m.group(), text[m.end() : m.end() + 2]


class Candidate:
    __slots__ = ("end", "nxt", "mark_at", "token", "before", "mark", "closers", "gap", "openers", "next", "after", "script", "last")

    def __init__(self, **kw):
        for k, v in kw.items():
            setattr(self, k, v)


def candidates(text: str, a: int, b: int) -> list[Candidate]:
    """Possible ends in a paragraph [a, b), in order, the paragraph's end not among them."""
    para = text[a:b]
    inside = enclosures(para)
    out: list[Candidate] = []
    ends = {e for _, e in inside}
    k = 0

    def last_before(s: int) -> str:
        while s and para[s - 1].isspace():
            s -= 1
        return para[s - 1 : s]

    for m in MARK.finditer(para):
        s, e = m.start(), m.end()
        mark = m.group()
        while k < len(inside) and inside[k][1] <= s:
            k += 1
        span = inside[k] if k < len(inside) and inside[k][0] <= s else None
        left = para[s - 1] if s else ""
        if mark[0] in ";;" and _script(last_before(s)) != "ell":
            continue
        if s and left.isdigit() and e < len(para) and para[e].isdigit() and len(mark) == 1:
            continue
        closers = ""
        if span:
            if CLOSERS.match(para, e, max(e, span[1] - 1)).end() < span[1] - 1:
                continue
            closers = para[e : span[1]].strip()
            e = span[1]
        if MARK.match(para, e):
            continue  # the marks after the closer decide
        while e < len(para) and para[e] in "»”’」』)）]】》›" and e not in ends:
            closers += para[e]
            e += 1
        if e >= len(para):
            continue
        nxt = e
        while nxt < len(para) and para[nxt].isspace():
            nxt += 1
        token = TOKEN_BACK.match(para[max(0, s - 40) : s][::-1]).group()[::-1]
        before = WORD_BACK.match(para[max(0, s - 60) : s - len(token)][::-1]).group(1)[::-1]
        openers, word, after = _next_token(para, nxt)
        if nxt == e and word[:1].islower() and not openers:
            continue
        gap = para[e:nxt]
        out.append(Candidate(end=a + e, nxt=a + nxt, mark_at=a + s, token=token, before=before, mark=mark.strip(), closers=closers, gap="n" if "\n" in gap else "s" if gap else "0", openers=openers, next=word, after=after, script=_script(last_before(s)), last=False))
    if THAI.search(para):
        k = 0
        for m in re.finditer(r"(?<=[฀-๿])[^\S\r\n]+(?=[฀-๿])", para):
            while k < len(inside) and inside[k][1] <= m.start():
                k += 1
            if k < len(inside) and inside[k][0] <= m.start():
                continue
            out.append(Candidate(end=a + m.start(), nxt=a + m.end(), mark_at=a + m.start(), token="", before="", mark=" ", closers="", gap="s", openers="", next=para[m.end() : m.end() + 1], after="", script="tha", last=False))
        out.sort(key=lambda c: c.end)
    return out


def _type(c: Candidate) -> str:
    t = c.token.lower()
    joined = f"{c.before.lower()} {t}".strip()
    if t in BEFORE_NAME or joined in BEFORE_NAME:
        return "abbr"
    return _shape(c.token)


def _hashed(f: list[str]) -> tuple[int, ...]:
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % DIMS for x in f)


def _kind(c: Candidate) -> tuple:
    """What a candidate has in common with many others: types of both tokens, mark, gap, closers, openers, script, length."""
    nx = "list" if c.next.isdigit() and c.after[:2] == ". " else _shape(c.next)
    m = c.mark[:1] if c.mark in (".", "!", "?", "。", "।", ";") else c.mark[:3]
    return _type(c), nx, m, c.gap, "q" if c.closers else "-", bool(c.openers), c.script, min(len(c.token), 6)


def _of_kind(kind: tuple) -> tuple[int, ...]:
    ty, nx, m, gap, ends, opened, script, size = kind
    return _hashed([
        "b", f"t={ty}", f"n={nx}", f"tn={ty}|{nx}", f"m={m}", f"mn={m}|{nx}", f"mt={m}|{ty}|{nx}", f"g={gap}", f"gn={gap}|{ty}|{nx}", f"q={ends}|{nx}", f"qg={ends}|{gap}|{script}",
        f"s={script}|{m}", f"o={opened}|{nx}", f"len={size}|{ty}|{nx}",
    ])


def _of_words(c: Candidate, kind: tuple) -> tuple[int, ...]:
    low = c.token.lower()[-12:]
    report = c.next.startswith(REPORTING)
    return _hashed([f"w={low}", f"wn={low}|{kind[1]}", f"x={c.next[:10]}", f"r={report}|{kind[4]}", f"d={c.before.lower()[-5:] if kind[0].startswith('num') else ''}|{kind[0]}"])


def features(c: Candidate) -> list[int]:
    kind = _kind(c)
    return [*_of_kind(kind), *_of_words(c, kind)]


class Scorer:
    """The classifier's scores; what candidates of one kind share is added up once."""

    def __init__(self, w: np.ndarray):
        self.w = w.tolist()
        self.shared: dict[tuple, float] = {}

    def __call__(self, c: Candidate) -> float:
        kind = _kind(c)
        s = self.shared.get(kind)
        if s is None:
            if len(self.shared) > 100_000:
                self.shared.clear()
            s = self.shared[kind] = sum(self.w[i] for i in _of_kind(kind))
        return s + sum(self.w[i] for i in _of_words(c, kind))


MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember".split())
ORDINAL = frozenset("der die das dem den des am im zum zur vom bis ab seit den le".split())


def certain(c: Candidate) -> int | None:
    """1 for a sure boundary, 0 for a sure non-boundary, None where only the classifier can tell."""
    ty, nx = _type(c), _shape(c.next)
    m = c.mark
    if c.mark == " ":
        return 1
    if c.closers and c.next.startswith(REPORTING):
        return 0
    if c.closers and c.gap == "0" and c.script in ("han", "kan") or (c.closers and c.gap == "0" and _script(c.next[:1]) in ("han", "kan")):
        return 0
    if nx in ("low", "i"):
        return 0
    if c.next[:1] in ",;:)»-–—/" and not c.openers:
        return 0
    if m == ".":
        if ty == "abbr" and nx not in ("punct", "none"):
            return 0
        if ty == "I" and nx in ("Cap", "I", "UP"):
            return 0
        if ty == "num1" and (c.before.lower() in ORDINAL or c.next.lower() in MONTHS):
            return 0
        if ty.startswith("num") and c.before.lower() == "h.":
            return 1
        if ty == "low" and len(c.token) > 3 and nx in ("Cap", "camel") and c.gap != "0":
            return 1
        if ty in ("num4", "other") and nx in ("Cap", "other") and c.gap != "0":
            return 1
        return None
    if m[0] in "。।！？!?؟;;" and nx in ("Cap", "camel", "other", "I", "UP"):
        return 1
    return None


def training_rows(text: str) -> list[tuple[list[int], int]]:
    rows = []
    paras = paragraphs(text)
    for k, (a, b) in enumerate(paras):
        for c in candidates(text, a, b):
            y = certain(c)
            if y is not None:
                rows.append((features(c), y))
        if k + 1 < len(paras):
            # the end of a paragraph, with the next one's start as what follows
            n0, n1 = paras[k + 1]
            both = text[a:b] + " " + text[n0:n1]
            for c in candidates(both, 0, len(both)):
                if c.nxt == b - a + 1 and c.mark != " ":
                    rows.append((features(c), 1))
    return rows


def fit(texts: list[str], rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Weights of the classifier: logistic regression by AdaGrad over the certain boundaries of the texts."""
    rows = [r for t in texts for r in training_rows(t)]
    w = np.zeros(DIMS)
    if not rows:
        rows = []
    n = len(rows)
    if n:
        x = np.array([f for f, _ in rows])
        y = np.array([v for _, v in rows], dtype=float)
        g2 = np.full(DIMS, 1e-6)
        rng = np.random.default_rng(seed)
        for _ in range(rounds):
            for part in np.array_split(rng.permutation(n), max(1, n // 256)):
                p = 1 / (1 + np.exp(-w[x[part]].sum(axis=1)))
                g = np.zeros(DIMS)
                np.add.at(g, x[part].ravel(), np.repeat(p - y[part], x.shape[1]))
                g = g / len(part) + 1e-6 * w
                g2 += g * g
                w -= 0.15 * g / np.sqrt(g2)
    return w


def spans(text: str, w: np.ndarray | Scorer) -> list[tuple[int, int]]:
    """Sentences [start, end) of a text, in code points."""
    score = w if isinstance(w, Scorer) else Scorer(w)
    out = []
    for a, b in paragraphs(text):
        start = a
        for c in candidates(text, a, b):
            # a list number belongs to what follows: nothing but a number since the last boundary
            if c.mark == "." and not c.closers and re.fullmatch(r"\d{1,3}", text[start : c.mark_at]) and c.gap != "0":
                continue
            if c.mark == " " or score(c) > 0:
                out.append((start, c.end))
                start = c.nxt
        if start < b:
            out.append((start, b))
    return out


def sample_texts(df: DataFrame, column: str, n: int = TRAIN_ARTICLES) -> list[str]:
    """At most ``n`` distinct texts, chosen by hash: the same for the same table."""
    t = df.select(column).filter(F.col(column).isNotNull() & (F.trim(column) != "") & (F.length(column) <= LONGEST_TRAINING)).select(F.xxhash64(column).alias("h"), F.col(column).alias("t"))
    return [r.t for r in t.orderBy("h").limit(n + n // 10).dropDuplicates(["h"]).collect()][:n]


def _split(weights, key: str, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Scorer(weights.value)
        for batch in batches:
            for b in slices(batch, column):
                found = [spans(x, w) for x in b.column(column).to_pylist()]
                at = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32))
                ends = [pa.ListArray.from_arrays(at, pa.array([p[i] for f in found for p in f], pa.int64())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([b.column(key), b.column("h"), *ends], names=[key, "h", "starts", "ends"])

    return run


def split_sentences(df: DataFrame, key: str, column: str) -> DataFrame:
    """``key``, sent_start, sent_end: one row a sentence; positions are code points, the end exclusive.

    Rows with a null key or a null or blank text have none; repeated rows of a key count once (of different texts the one of the smallest hash); extra columns are ignored.
    Texts are split where they are read: what travels to find repeated rows are positions.
    """
    d = df.select(key, column).filter(F.col(key).isNotNull() & F.col(column).isNotNull() & (F.trim(column) != ""))
    w = df.sparkSession.sparkContext.broadcast(fit(sample_texts(d, column)))
    kind = df.schema[key].dataType.simpleString()
    split = d.withColumn("h", F.xxhash64(column)).mapInArrow(_split(w, key, column), f"`{key}` {kind}, h long, starts array<long>, ends array<long>")
    once = split.groupBy(key).agg(F.min_by(F.arrays_zip("starts", "ends"), "h").alias("s"))
    return once.select(key, F.explode("s").alias("s")).select(key, F.col("s.starts").alias("sent_start"), F.col("s.ends").alias("sent_end"))
