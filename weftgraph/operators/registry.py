"""Registries of entities and relations: new entries aligned with known ones by vectors, centroids that follow, names resolved in groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from weftgraph.functions.encoder import DIM, with_vectors
from weftgraph.operators.graph import components
from weftgraph.operators.vectors import near_pairs, sign_buckets
from weftgraph.session import cut

c = F.col
#: Rows of a block of new entries and of a block of the registry.
BLOCK, SLICE = 8192, 1024


def _matrix(t: pa.Table, dim: int) -> np.ndarray:
    x = np.asarray(t.column("v").combine_chunks().flatten(), dtype=np.float64).reshape(-1, dim)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def best_matches(new: DataFrame, registry: DataFrame, dim: int) -> DataFrame:
    """key, canonical, cosine: the most similar entry of the registry (canonical, v) for each row of ``new`` (key, v), all compared with the registry as it is.

    Cosines are rounded to 1e-6, of equal ones the smaller entry wins. Every block of new rows meets every block of the registry; neither is sent whole anywhere.
    """
    a = new.filter(F.size("v") == dim).select(c("key").cast("string").alias("key"), c("v").cast("array<double>").alias("v"))
    b = registry.filter(F.size("v") == dim).select(c("canonical").cast("string").alias("key"), c("v").cast("array<double>").alias("v"))
    na, nb = (max(1, -(-x.count() // BLOCK)) for x in (a, b))
    block = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    rows = a.select(block(na).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("j"), F.lit(0).alias("side"), "key", "v")
    rows = rows.unionByName(b.select(F.explode(F.sequence(F.lit(0), F.lit(na - 1))).alias("i"), block(nb).alias("j"), F.lit(1).alias("side"), "key", "v"))

    def run(t: pa.Table) -> pa.Table:
        x, side = _matrix(t, dim), t.column("side").to_numpy()
        keys = t.column("key").to_pylist()
        p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        q = q[np.argsort(np.array([keys[k] for k in q], dtype=object), kind="stable")] if len(q) else q
        if not len(p) or not len(q):
            return pa.table({"key": pa.array([], pa.string()), "canonical": pa.array([], pa.string()), "cosine": pa.array([], pa.float64())})
        at, best = [], []
        for k in range(0, len(p), SLICE):
            s = np.round(x[p[k : k + SLICE]] @ x[q].T, 6)
            at.append(s.argmax(axis=1))
            best.append(s.max(axis=1))
        at, best = np.concatenate(at), np.concatenate(best)
        return pa.table({"key": pa.array([keys[k] for k in p]), "canonical": pa.array([keys[q[k]] for k in at]), "cosine": pa.array(best)})

    found = rows.groupBy("i", "j").applyInArrow(run, "key string, canonical string, cosine double")
    return found.groupBy("key").agg(F.min(F.struct((-c("cosine")).alias("s"), "canonical")).alias("m")).select("key", "m.canonical", (-c("m.s")).alias("cosine"))


def align_batch(new: DataFrame, registry: DataFrame, threshold: float, dim: int) -> DataFrame:
    """key, canonical, cosine, is_new: entries under the threshold begin one of their own."""
    m = best_matches(new, registry, dim)
    fresh = c("cosine") < threshold
    return m.select("key", F.when(fresh, c("key")).otherwise(c("canonical")).alias("canonical"), "cosine", fresh.alias("is_new"))


def followed(centroids: DataFrame, members: DataFrame, keep: float = 0.85) -> DataFrame:
    """canonical, i, value: centroids (canonical, v) after their members (canonical, ord, v) in order, each moving it by 1 - ``keep``; unit length at the end.

    The recurrence is a weighted sum by each member's distance from the end, so nothing is folded one by one.
    """
    w = Window.partitionBy("canonical").orderBy(c("ord").desc())
    m = members.withColumn("back", F.row_number().over(w) - 1)
    n = members.groupBy("canonical").agg(F.count("*").alias("n"))
    rows = m.select("canonical", ((1 - keep) * F.pow(F.lit(keep), c("back"))).alias("weight"), "v")
    rows = rows.unionByName(centroids.join(n, "canonical", "left").select("canonical", F.pow(F.lit(keep), F.coalesce("n", F.lit(0))).alias("weight"), "v"))
    s = rows.select("canonical", "weight", F.posexplode("v").alias("i", "x")).groupBy("canonical", "i").agg(F.sum(c("weight") * c("x")).alias("x"))
    norm = F.sqrt(F.sum(c("x") * c("x")).over(Window.partitionBy("canonical")))
    return s.select("canonical", "i", F.when(norm > 0, c("x") / norm).otherwise(0.0).alias("value"))


def local_threshold(sims: DataFrame, by: str, order: list, base: float, window: int = 20, least: int = 3) -> DataFrame:
    """sims with threshold: mean - 1.5 population deviations of the ``window`` values before a row, where there are enough, and never under ``base``."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-window, -1)
    t = F.avg("value").over(w) - 1.5 * F.stddev_pop("value").over(w)
    return sims.withColumn("threshold", F.when(F.count("value").over(w) >= least, F.greatest(F.lit(base), t)).otherwise(F.lit(base)))


def absorb_entries(registry: DataFrame, other: DataFrame) -> DataFrame:
    """canonical, count of a registry with those of another put in: equal entries add up."""
    return registry.select("canonical", "n").unionByName(other.select("canonical", "n")).groupBy("canonical").agg(F.sum("n").alias("n"))


def _most_used(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """label, canonical: each label's group's most frequent member, of equals the smallest."""
    j = counts.join(groups, "label", "left").withColumn("g", F.coalesce("g", "label"))
    top = j.groupBy("g").agg(F.min(F.struct((-c("n")).alias("k"), "label")).alias("m")).select("g", c("m.label").alias("canonical"))
    return j.join(top, "g").select("label", "canonical", "n")


def _grouped(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    ids = labels.select("label", "id")
    comp = components(pairs.select("a", "b"))
    names = comp.join(ids.select(c("id").alias("component"), c("label").alias("g")), "component").select(c("node").alias("id"), "g")
    return ids.join(names, "id").select("label", "g")


def relation_registry(counts: DataFrame, threshold: float = 0.8) -> DataFrame:
    """label, canonical, n: relations (label, n) whose vectors are similar, chains closed, under their most frequent one. Relations are a vocabulary: all pairs are compared, in blocks."""
    v = cut(with_vectors(counts.select("label").distinct().withColumn("id", F.xxhash64("label")), "label"))
    return _most_used(_grouped(v, near_pairs(v.select(c("id").alias("node"), "v"), threshold, DIM)), counts)


def resolve_names(counts: DataFrame, threshold: float = 0.85, tables: int = 8, planes: int = 10) -> DataFrame:
    """label, canonical, n: names (label, n) in groups of similar vectors, under their most frequent one.

    Candidates are neighbours in the order of a bucket of one of the tables, and each member with the bucket's first, so a bucket of any size gives two pairs a member at most.
    """
    v = cut(with_vectors(counts.select("label").distinct().withColumn("id", F.xxhash64("label")), "label"))
    b = sign_buckets(v.select(c("id").alias("node"), "v"), DIM, tables, planes).join(v.select(c("id").alias("node"), "label"), "node")
    w = Window.partitionBy("tab", "bucket").orderBy("label")
    near = b.select("node", F.array_distinct(F.array(F.lag("node").over(w), F.first("node").over(w))).alias("o")).select(c("node").alias("a"), F.explode("o").alias("b")).filter("b is not null and a <> b").distinct()
    j = near.join(v.select(c("id").alias("a"), c("v").alias("va")), "a").join(v.select(c("id").alias("b"), c("v").alias("vb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x, y = (np.asarray(t.column(k).flatten(), dtype=np.float64).reshape(-1, DIM) for k in ("va", "vb"))
            keep = pa.array(np.einsum("ij,ij->i", x, y) >= threshold)
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], names=["a", "b"]).filter(keep)

    return _most_used(_grouped(v, cut(j.mapInArrow(verify, "a long, b long"))), counts)


def online_clusters(texts: DataFrame, start: float = 0.55, low: float = 0.35, high: float = 0.85) -> DataFrame:
    """label, cluster: relations (ord, label; a vocabulary, in order) put one after the other into the cluster of the nearest centroid, or into one of their own.

    The threshold falls with the number of clusters and rises where a cluster's last twenty members were close; a centroid is the running mean of its members. At the end
    clusters nearer than the threshold and a tenth become one. One after the other means one task; it holds one vector a cluster.
    """

    def run(t: pa.Table) -> pa.Table:
        x, labels = _matrix(t, DIM), t.column("label").to_pylist()
        centre = np.zeros((0, DIM))
        size: list[int] = []
        recent: list[list[float]] = []
        own = np.zeros(len(labels), dtype=np.int64)
        for r, v in enumerate(x):
            limit = float(np.clip(start - 0.05 * np.log1p(len(size)), low, high))
            k, s = -1, -1.0
            if size:
                sims = centre @ v
                k, s = int(sims.argmax()), float(sims.max())
                if len(recent[k]) >= 3:
                    limit = max(limit, float(np.mean(recent[k]) - 1.5 * (np.std(recent[k]) + 1e-6)))
            if k < 0 or s <= limit:
                own[r] = len(size)
                centre = np.concatenate([centre, v[None]])
                size.append(1)
                recent.append([1.0])
            else:
                own[r] = k
                m = (centre[k] * size[k] + v) / (size[k] + 1)
                centre[k] = m / (np.linalg.norm(m) + 1e-8)
                size[k] += 1
                recent[k] = [*recent[k], s][-20:]
        limit = float(np.clip(start - 0.05 * np.log1p(len(size)), low, high)) + 0.1
        root = np.arange(len(size))
        for k in np.argsort([-n for n in size], kind="stable").tolist():
            if root[k] == k:
                near = np.flatnonzero((centre @ centre[k] > limit) & (root == np.arange(len(size))))
                root[[n for n in near.tolist() if n != k and size[n] <= size[k]]] = k
        while (root[root] != root).any():
            root = root[root]
        return pa.table({"label": pa.array(labels), "cluster": pa.array(root[own] if len(own) else own)})

    v = with_vectors(texts.select("ord", "label"), "label")
    return v.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(lambda t: run(t.sort_by("ord")), "label string, cluster long")
