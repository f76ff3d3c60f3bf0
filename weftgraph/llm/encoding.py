"""Encoding of a corpus with a public byte-level BPE vocabulary, sharing work between documents.

Texts are cut into content-defined chunks: a rolling hash of the last code points picks the cuts, so equal
passages give equal chunks whatever stands around them. Each distinct chunk is encoded once. Most cuts lie where the
tokenizer's pattern must cut, too; chunk ids are then simply joined. A text that offers no such place for long is cut anywhere
(a soft cut), and such a join is repaired: a window around it is encoded again and widened until its
splits agree with the next chunk's own.

Null and empty texts have the empty list. Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from weftgraph.llm.codepoints import Table, decode, rolling, slices
from weftgraph.operators.hotcold import salted_join
from weftgraph.session import cut

#: Code points that the rolling hash sees.
WINDOW = 12
#: One in so many safe places is a cut.
ONE_IN = 16
#: A stretch of more code points without a safe cut gets soft cuts, about one in SOFT_IN.
SOFT_AFTER = 4096
SOFT_IN = 512


def _kind(c: str) -> int:
    """1 space, 2 letter, 3 punctuation or symbol but the apostrophe, 0 anything else."""
    if c == " ":
        return 1
    k = unicodedata.category(c)[0]
    return 2 if k == "L" else 3 if k in "PS" and c != "'" else 0


KIND = Table(_kind)


def cuts(cps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the chunk starts of all texts (text starts included) and which of them are soft.

    Safe places are before a space between letters or punctuation on the left and a letter on the right, and between punctuation
    and a letter: the pattern always has a border there, and it looks at most one code point ahead.
    """
    n = len(cps)
    begin = starts[:-1][np.diff(starts) > 0]
    if not n:
        return begin, np.zeros(0, dtype=bool)
    k = KIND(cps)
    safe = np.zeros(n, dtype=bool)
    if n > 2:
        left, here, right = k[:-2], k[1:-1], k[2:]
        safe[1:-1] = (left >= 2) & (here == 1) & (right == 2)
        safe[1:-1] |= (left == 3) & (here == 2)
    h = np.zeros(n, dtype=np.uint64)
    r = rolling(cps, WINDOW)
    h[WINDOW:] = r[: n - WINDOW] if n > WINDOW else 0
    # a window must not reach into another text: the first places of a text count with what they have, by position
    first = np.zeros(n, dtype=bool)
    for d in range(min(WINDOW, n)):
        at = begin + d
        first[at[at < n]] = True
    chosen = safe & (h % np.uint64(ONE_IN) == 0) & ~first
    chosen[begin] = True
    at = np.flatnonzero(chosen)
    gap = np.diff(np.append(at, n))
    soft: list[np.ndarray] = []
    for i in np.flatnonzero(gap > SOFT_AFTER):
        inner = np.arange(at[i] + WINDOW, at[i] + gap[i] - WINDOW)
        pick = inner[(h[inner] >> np.uint64(20)) % np.uint64(SOFT_IN) == 0]
        pick = pick[~safe[pick]]
        if len(pick):
            pick = pick[np.concatenate([[True], np.diff(pick) > 64])]
        soft.append(pick)
    extra = np.concatenate(soft) if soft else np.zeros(0, dtype=np.int64)
    allcuts = np.concatenate([at, extra])
    order = np.argsort(allcuts, kind="stable")
    return allcuts[order], np.concatenate([np.zeros(len(at), dtype=bool), np.ones(len(extra), dtype=bool)])[order]


def _chunks(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """(row, number in the text, chunk text, soft) of a batch's chunks."""
    cps, starts = decode(batch.column("text"))
    at, soft = cuts(cps, starts)
    row = np.searchsorted(starts, at, side="right") - 1
    whole = cps.tobytes().decode("utf-32-le", "surrogatepass")
    ends = np.append(at[1:], len(cps)) if len(at) else at
    texts = [whole[a:b] for a, b in zip(at.tolist(), ends.tolist())]
    first = np.searchsorted(row, row, side="left")
    return row, np.arange(len(at)) - first, texts, soft


def _digest(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = b"".join(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts)
    both = np.frombuffer(raw, dtype="<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _distinct_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch, "text"):
            _, _, texts, soft = _chunks(b)
            near = soft | np.append(soft[1:], False) if len(soft) else soft
            seen: dict[str, list] = {}
            for t, s in zip(texts, near.tolist()):
                x = seen.setdefault(t, [0, False])
                x[0] += 1
                x[1] |= s
            h1, h2 = _digest(list(seen))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1), pa.array(h2), pa.array(list(seen), pa.string()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.bool_())],
                names=["h1", "h2", "chunk", "n", "near_soft"],
            )


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch, "text"):
            row, number, texts, soft = _chunks(b)
            h1, h2 = _digest(texts)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("own").take(at), pa.array(number.astype(np.int32)), pa.array(h1), pa.array(h2), pa.array(soft)], names=["doc_id", "own", "pos", "h1", "h2", "soft"])


_LOADED: dict = {}
#: A tokenizer file, or that and a file of the same vocabulary as ranks, by which texts are then encoded, several times faster.
Files = str | tuple[str, str]
# Fixed value: the pattern by which such a vocabulary's texts are split before they are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def by_ranks(path: str):
    """The encoder of a file of ranks, loaded once a process."""
    if path not in _LOADED:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(n) for t, n in (line.split() for line in f if line.strip())}
        _LOADED[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def tokenizer(files: Files):
    """The tokenizer of a file, loaded once a process."""
    path = files if isinstance(files, str) else files[0]
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _LOADED[path] = t
    return _LOADED[path]


def encode_all(path: Files, texts: list[str]) -> list[list[int]]:
    if not isinstance(path, str):
        encode = by_ranks(path[1]).encode_ordinary
        return [encode(t) for t in texts]
    return [e.ids for e in tokenizer(path).encode_batch(texts, add_special_tokens=False)]


def _encoder(path: Files):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = encode_all(path, b.column("chunk").to_pylist())
            kept = [t if s else None for t, s in zip(b.column("chunk").to_pylist(), b.column("near_soft").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("h1"), b.column("h2"), b.column("n"), pa.array(ids, pa.list_(pa.int32())), pa.array(kept, pa.string())], names=["h1", "h2", "n", "ids", "chunk"])

    return run


def _borders(path: Files, text: str) -> list[int]:
    """Starts of the pieces into which the pattern splits a text."""
    return [a for _, (a, _) in tokenizer(path).pre_tokenizer.pre_tokenize_str(text)]


def _piecewise(path: Files, text: str, borders: list[int], end: int) -> list[int]:
    """Ids of text[:end], each piece by itself: cut off, white space would be split otherwise."""
    pieces = [text[a:b] for a, b in zip(borders, [*borders[1:], end])]
    return [i for ids in encode_all(path, pieces) for i in ids]


def repair(path: Files, left: str, left_ids: list[int], right: str, right_ids: list[int], reach: int = 64) -> tuple[str, list[int]]:
    """The end of the text from a true border on, as later joins need it, and the ids of left + right.

    ``left`` begins at a true border. The window starts three pieces before the cut (earlier pieces cannot depend on what follows) and is widened
    until one of its borders, two pieces before its own end, is also a border of the right chunk; from there on the chunk's own ids hold.
    """
    lb = _borders(path, left)
    s = lb[-3] if len(lb) >= 3 else 0
    tail = left[s:]
    head = left_ids[: len(left_ids) - len(encode_all(path, [tail])[0])]
    rb = set(_borders(path, right))
    while True:
        e = min(reach, len(right))
        window = tail + right[:e]
        wb = _borders(path, window)
        usable = [b - len(tail) for b in (wb if e == len(right) else wb[:-2]) if b > len(tail)]
        agree = [b for b in usable if b in rb]
        if agree:
            b = agree[0]
            rest = right_ids[len(_piecewise(path, right, [x for x in sorted(rb) if x < b], b)) :]
            return tail + right, head + _piecewise(path, window, [x for x in wb if x < len(tail) + b], len(tail) + b) + rest
        if e == len(right):
            return tail + right, head + encode_all(path, [window])[0]
        reach *= 4


def join_chunks(path: Files, parts: list[tuple[list[int], bool, str | None]]) -> list[int]:
    """Ids of a text from its chunks' (ids, soft cut before it, text where a soft cut is near), in order."""
    out: list[int] = []
    text = ""
    for ids, soft, chunk in parts:
        if soft:
            text, out = repair(path, text, out, chunk or "", ids)
        else:
            out = out + ids if out else list(ids)
            text = chunk or ""
    return out


def _assemble(path: Files):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for parts in b.column("parts").to_pylist():
                if any(p["soft"] for p in parts):
                    out.append(join_chunks(path, [(p["ids"], p["soft"], p["chunk"]) for p in parts]))
                else:
                    out.append([i for p in parts for i in p["ids"]])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def encode_corpus(docs: DataFrame, path: Files) -> DataFrame:
    """doc_id, ids (array<int>) of every document; ``path`` names tokenizer files that every executor can read.

    A null doc_id takes no part; a doc_id given several times counts once, of different texts the one of the smallest hash, and a null or empty one only where it has no other. Extra columns are ignored.
    """
    d = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull())
    some = d.filter(F.col("text").isNotNull() & (F.col("text") != "")).withColumn("own", F.xxhash64("text"))
    chunks = (
        some.mapInArrow(_distinct_chunks, "h1 long, h2 long, chunk string, n long, near_soft boolean")
        .groupBy("h1", "h2").agg(F.first("chunk").alias("chunk"), F.sum("n").alias("n"), F.bool_or("near_soft").alias("near_soft"))
        .mapInArrow(_encoder(path), "h1 long, h2 long, n long, ids array<int>, chunk string")
    )
    chunks = cut(chunks)
    refs = some.mapInArrow(_references, "doc_id long, own long, pos int, h1 long, h2 long, soft boolean")
    none = d.filter(F.col("text").isNull() | (F.col("text") == "")).select("doc_id", *[F.lit(None).cast(t).alias(k) for k, t in (("own", "long"), ("pos", "int"), ("soft", "boolean"), ("ids", "array<int>"), ("chunk", "string"))])
    found = salted_join(refs, chunks, ["h1", "h2"], "n").select("doc_id", "own", "pos", "soft", "ids", "chunk").unionByName(none)
    parts = found.groupBy("doc_id").agg(F.min("own").alias("first"), F.collect_set(F.when(F.col("own").isNotNull(), F.struct("pos", "soft", "ids", "chunk", "own"))).alias("parts"))
    parts = parts.select("doc_id", F.filter("parts", lambda p: p["own"] == F.col("first")).alias("parts"))
    in_order = F.array_sort(F.transform("parts", lambda p: F.struct(p["pos"].alias("pos"), p["soft"].alias("soft"), p["ids"].alias("ids"), p["chunk"].alias("chunk"))))
    plain = F.exists("parts", lambda p: p["soft"])
    done = parts.withColumn("parts", in_order)
    flat = done.filter(~plain).select("doc_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
    repaired = done.filter(plain).mapInArrow(_assemble(path), "doc_id long, ids array<int>")
    return flat.unionByName(repaired)
