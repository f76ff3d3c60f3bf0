"""Vectors of nodes: ranking, near duplicates, buckets. Products are blocks of a matrix product in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

c = F.col
#: Query vectors that are sent to every executor at most; more are taken in parts.
QUERIES_AT_ONCE = 4096
#: Rows of a block of near_pairs, and of a block's slice whose products are held at once.
BLOCK, SLICE = 8192, 512


def rank_by_cosine(vectors: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame:
    """query_id, node, cosine, rank_no: the k best vectors (node, v) for each query (query_id, v); cosine rounded to 1e-6, ties by node.

    The queries are a stated set, read and broadcast in parts of about QUERIES_AT_ONCE, each a pass over the vectors; every batch of vectors keeps only its own best k a query.
    """
    spark = vectors.sparkSession
    parts = max(1, -(-queries.count() // QUERIES_AT_ONCE))
    out = None
    for a in range(parts):
        part = queries.select("query_id", "v").filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == a).orderBy("query_id").collect()
        q = np.array([r.v for r in part], dtype=np.float64).reshape(-1, dim)
        n = np.linalg.norm(q, axis=1, keepdims=True)
        sent = spark.sparkContext.broadcast((np.array([r.query_id for r in part]), np.divide(q, n, out=np.zeros_like(q), where=n > 0)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            for b in batches:
                if not b.num_rows or not len(names):
                    continue
                v = np.asarray(b.column("v").flatten(), dtype=np.float64).reshape(-1, dim)
                n = np.linalg.norm(v, axis=1, keepdims=True)
                s = np.round(q @ np.divide(v, n, out=np.zeros_like(v), where=n > 0).T, 6)
                ids = np.asarray(b.column("node"))
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                r = np.repeat(np.arange(len(s)), order.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(names[r]), pa.array(ids[order.ravel()]), pa.array(s[r, order.ravel()])], names=["query_id", "node", "cosine"])

        kind = queries.schema["query_id"].dataType.simpleString()
        part_out = vectors.filter(F.size("v") == dim).select("node", "v").mapInArrow(run, f"query_id {kind}, node long, cosine double")
        out = part_out if out is None else out.unionByName(part_out)
    w = Window.partitionBy("query_id").orderBy(c("cosine").desc(), "node")
    return out.withColumn("rank_no", F.row_number().over(w)).filter(c("rank_no") <= k)


def near_pairs(vectors: DataFrame, least: float, dim: int) -> DataFrame:
    """a, b, cosine: all pairs a < b of vectors (node, v; a node once) whose cosine is at least ``least`` > 0.

    Exact: every block of vectors is multiplied with every other one, so the work grows with the square of their number. Vectors
    of another size than ``dim``, and zeros, are near nothing.
    """
    v = vectors.filter((F.size("v") == dim) & c("node").isNotNull()).select(c("node").cast("long").alias("node"), c("v").cast("array<double>").alias("v"))

    def run(t: pa.Table) -> pa.Table:
        i, j, p, xp, q, xq = _sides(t, dim)
        found = []
        for at in range(0, len(p), SLICE):
            s = xp[at : at + SLICE] @ xq.T
            r, o = np.nonzero(s >= least)
            found.append((p[at + r], q[o], s[r, o]))
        a, b, s = (np.concatenate(y) for y in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        keep = a < b if i == j else a != b
        return pa.table({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "cosine": s[keep]})

    return _dealt(v).groupBy("i", "j").applyInArrow(run, "a long, b long, cosine double")


def _dealt(v: DataFrame) -> DataFrame:
    """Vectors (node, v) dealt out so that every pair of blocks meets in one group (i, j)."""
    n = max(1, -(-v.count() // BLOCK))
    g = F.pmod(F.xxhash64("node"), F.lit(n)).cast("int")
    return v.withColumn("g", g).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(F.least("g", "k").alias("i"), F.greatest("g", "k").alias("j"), "g", "node", "v")


def _sides(t: pa.Table, dim: int) -> tuple:
    """(i, j, nodes and unit vectors of block i, those of block j) of a group."""
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    x = np.asarray(t.column("v").combine_chunks().flatten(), dtype=np.float64).reshape(-1, dim)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    node, left = t.column("node").to_numpy(), t.column("g").to_numpy() == i
    right = left if i == j else ~left
    return i, j, node[left], x[left], node[right], x[right]


def cosine_extremes(vectors: DataFrame, dim: int) -> DataFrame:
    """largest, smallest: cosines of pairs of different vectors (node, v; a node once), all pairs in blocks as in ``near_pairs``; null where there are not two."""
    v = vectors.filter((F.size("v") == dim) & c("node").isNotNull()).select(c("node").cast("long").alias("node"), c("v").cast("array<double>").alias("v"))

    def run(t: pa.Table) -> pa.Table:
        _, _, p, xp, q, xq = _sides(t, dim)
        high, low = -np.inf, np.inf
        for at in range(0, len(p), SLICE):
            s = xp[at : at + SLICE] @ xq.T
            other = p[at : at + SLICE][:, None] != q[None, :]
            if other.any():
                high, low = max(high, float(s[other].max())), min(low, float(s[other].min()))
        keep = high >= low
        return pa.table({"high": pa.array([high] if keep else [], pa.float64()), "low": pa.array([low] if keep else [], pa.float64())})

    return _dealt(v).groupBy("i", "j").applyInArrow(run, "high double, low double").agg(F.max("high").alias("largest"), F.min("low").alias("smallest"))


def sign_buckets(vectors: DataFrame, dim: int, tables: int = 8, planes: int = 16, seed: int = 42) -> DataFrame:
    """node, tab, bucket: signs of products with fixed random planes, one bucket a table."""
    p = np.random.RandomState(seed).randn(tables, planes, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.asarray(b.column("v").flatten(), dtype=np.float64).reshape(-1, dim)
            code = ((np.einsum("tpd,nd->ntp", p, v) > 0) << np.arange(planes)).sum(axis=2)
            n = len(v)
            yield pa.RecordBatch.from_arrays([b.column("node").take(pa.array(np.repeat(np.arange(n), tables))), pa.array(np.tile(np.arange(tables), n)), pa.array(code.ravel())], names=["node", "tab", "bucket"])

    return vectors.filter(F.size("v") == dim).select("node", "v").mapInArrow(run, "node long, tab long, bucket long")
