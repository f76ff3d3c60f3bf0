"""Duplicates hidden by formatting: one record for all writings that differ in case, spacing, punctuation or field order.

Bytes stream through a skip-and-fold table into rolling polynomial hashes, one a field; the hash of a record is the
sum of its fields' scrambled hashes, so field order doesn't matter and no canonical string is made. Rows with equal
hashes are compared with a representative by two pointers that skip what the table skips; a row that differs (a
collision) gets a group of its own by its exact form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftgraph.llm.codepoints import Table, decode, fold_word_char, mix, powers, slices
from weftgraph.operators.hotcold import salted_join
from weftgraph.session import cut

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
SEPARATORS = "|;"


def _rule(c: str) -> int:
    return 1 if c in SEPARATORS else fold_word_char(c)


FOLD = Table(_rule)  # 0 skips, 1 separates fields


def record_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's fields, and the number of its non-empty fields."""
    cps, starts = decode(col)
    n = len(starts) - 1
    out = np.zeros((2, n), dtype=np.uint64)
    count = np.zeros(n, dtype=np.int64)
    if not len(cps):
        return out[0], out[1], count
    f = FOLD(cps)
    row = np.repeat(np.arange(n), np.diff(starts))
    field = np.cumsum(f == 1) + row  # grows at separators and at new rows
    keep = f > 1
    f, row, field = f[keep], row[keep], field[keep]
    if not len(f):
        return out[0], out[1], count
    begin = np.flatnonzero(np.concatenate([[True], (field[1:] != field[:-1]) | (row[1:] != row[:-1])]))
    size = np.diff(np.append(begin, len(f)))
    at = np.arange(len(f)) - np.repeat(begin, size)
    with np.errstate(over="ignore"):
        for k, base in enumerate(_BASES):
            h = np.add.reduceat(f.astype(np.uint64) * powers(base, int(size.max()))[at], begin)
            np.add.at(out[k], row[begin], mix(h ^ (size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))))
    np.add.at(count, row[begin], 1)
    return out[0], out[1], count


def _kept(text: str) -> Iterator[str]:
    """Letters and digits in lower case, '' between fields."""
    for c in text:
        if c in SEPARATORS:
            yield ""
        elif v := fold_word_char(c):
            yield chr(v)


def same_sequence(a: str, b: str) -> bool:
    """Two pointers over both texts, each skipping what the table skips; fields in the same order."""
    x, y = _kept(a), _kept(b)
    while True:
        c, d = next(x, None), next(y, None)
        if c != d:
            return False
        if c is None:
            return True


def same_sequences(x: pa.Array, y: pa.Array) -> np.ndarray:
    """``same_sequence`` of all pairs of a batch: what the table keeps of both columns, compared place by place."""
    kept = []
    for col in (x, y):
        cps, starts = decode(col)
        f = FOLD(cps)
        row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[f > 0]
        kept.append((f[f > 0], row, np.bincount(row, minlength=len(starts) - 1)))
    (f, r, m), (g, s, n) = kept
    same = m == n
    differ = f[same[r]] != g[same[s]]
    same[r[same[r]][differ]] = False
    return same


def _fields(text: str) -> list[str]:
    parts = text.replace(";", "|").split("|")
    return [p for p in parts if any(fold_word_char(c) for c in p)]


def _number(field: str) -> int:
    h = 0
    for c in _kept(field):
        h = (h * _BASES[0] + ord(c) + 1) % (1 << 64)
    return h


def same_record(a: str, b: str) -> bool:
    """Whether the fields agree in some order: in the given order first, else by pairs in the order of their hashes."""
    if a == b or same_sequence(a, b):
        return True
    x, y = (sorted(_fields(t), key=_number) for t in (a, b))
    return len(x) == len(y) and all(same_sequence(p, q) for p, q in zip(x, y))


def exact_form(text: str) -> str:
    """Digest of the fields, for rows whose hashes collide."""
    forms = sorted("".join(_kept(p)) for p in _fields(text))
    return hashlib.sha256("\n".join(forms).encode()).hexdigest()


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch, "label"):
            h1, h2, count = record_hashes(b.column("label"))
            keep = pa.array(count > 0)
            yield pa.RecordBatch.from_arrays([b.column("node_id"), b.column("label"), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=["node_id", "label", "h1", "h2"]).filter(keep)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = b.column("label"), b.column("rep_label")
        other: list[str | None] = [None] * b.num_rows
        for i in np.flatnonzero(~same_sequences(x, y)).tolist():
            p, q = x[i].as_py(), y[i].as_py()
            other[i] = None if same_record(p, q) else exact_form(p)
        yield pa.RecordBatch.from_arrays([b.column("node_id"), b.column("rep_id"), b.column("h1"), b.column("h2"), pa.array(other, pa.string())], names=["node_id", "rep_id", "h1", "h2", "other"])


def collapse(nodes: DataFrame) -> DataFrame:
    """node_id, keep_id, n_copies: the record of each node whose label has a letter or digit.

    keep_id is the record's smallest node_id, n_copies the number of its node_ids. Null ids and labels without letter or
    digit take no part; repeated rows of an id count once (of different labels the smallest); extra columns are ignored; an empty table gives no rows.
    """
    one = nodes.filter(F.col("node_id").isNotNull() & F.col("label").isNotNull()).groupBy("node_id").agg(F.min("label").alias("label"))
    hashed = one.mapInArrow(_hash, "node_id long, label string, h1 long, h2 long")
    reps = hashed.groupBy("h1", "h2").agg(F.min(F.struct("node_id", "label")).alias("rep"), F.count("*").alias("n")).select("h1", "h2", F.col("rep.node_id").alias("rep_id"), F.col("rep.label").alias("rep_label"), "n")
    reps = cut(reps)
    checked = salted_join(hashed, reps.filter("n > 1"), ["h1", "h2"], "n").mapInArrow(_verify, "node_id long, rep_id long, h1 long, h2 long, other string")
    checked = cut(checked)
    good = checked.filter("other is null")
    sizes = good.groupBy("h1", "h2", "rep_id").agg(F.count("*").alias("n_copies"))
    single = reps.filter("n = 1").select(F.col("rep_id").alias("node_id"), F.col("rep_id").alias("keep_id"), F.lit(1).cast("long").alias("n_copies"))
    joined = salted_join(good.select("node_id", "rep_id"), sizes.select("rep_id", "n_copies", F.col("n_copies").alias("n")), ["rep_id"], "n").select("node_id", F.col("rep_id").alias("keep_id"), "n_copies")
    bad = checked.filter("other is not null")
    rest = bad.groupBy("h1", "h2", "other").agg(F.min("node_id").alias("keep_id"), F.count("*").alias("n_copies"))
    collided = bad.join(rest, ["h1", "h2", "other"]).select("node_id", "keep_id", "n_copies")
    return single.unionByName(joined).unionByName(collided)


def duplicates(collapsed: DataFrame) -> DataFrame:
    """keep_id, node_id of every copy that isn't kept."""
    return collapsed.filter("node_id <> keep_id").select("keep_id", "node_id")
