"""Most similar vectors of every vector, by learned partitions.

On a bounded sample a neighbour graph is built and cut into balanced parts; a small network learns which parts a
vector's neighbours lie in. Every vector is then indexed in its most probable part and searched in the few parts
that the network finds probable; in a part all scores are computed as blocks of a matrix product and only the best few of a query leave it. Large parts are
split into blocks of rows on both sides, so no task grows with the densest region. Equal vectors are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from weftgraph.operators.hotcold import salted_join

DIM = 64
#: Deals of the members of a class of equal vectors.
DEALS = 64


@dataclass(frozen=True)
class Settings:
    """sample: vectors the router is fitted on. part_rows: vectors wanted in a part. max_parts: parts at most.
    probes and least_p: parts searched beside a vector's own, at most, and how probable each must be.
    block: rows of one side in a search task at most."""

    sample: int = 40_000
    part_rows: int = 1_500
    max_parts: int = 256
    probes: int = 3
    least_p: float = 0.05
    block: int = 40_000
    hidden: int = 128
    seed: int = 11


@dataclass
class Router:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def probabilities(self, v: np.ndarray) -> np.ndarray:
        z = np.maximum(v @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1 in float32."""
    w = v.astype(np.float64)
    return (w / np.linalg.norm(w, axis=1, keepdims=True)).astype(np.float32)


def neighbour_graph(v: np.ndarray, k: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(n, k) indices and scores of each row's most similar other rows, by blocks."""
    n = len(v)
    k = min(k, n - 1)
    near, score = np.zeros((n, k), dtype=np.int64), np.zeros((n, k), dtype=np.float32)
    for a in range(0, n, 128):  # small blocks: the driver has little memory
        s = v[a : a + 128] @ v.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        top = np.argpartition(s, n - k, axis=1)[:, n - k :]
        near[a : a + 128], score[a : a + 128] = top, np.take_along_axis(s, top, axis=1)
    return near, score


def balanced_parts(v: np.ndarray, near: np.ndarray, score: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Part of each row: few graph edges between parts, no part over a tenth above the mean.

    A start from spherical centres with room limits, then rounds in which a vertex moves to the part of most of its neighbours' weight that has room.
    """
    n = len(v)
    room = int(np.ceil(1.1 * n / parts))
    centre = v[rng.choice(n, parts, replace=False)]
    for _ in range(6):
        best = np.concatenate([np.argmax(v[a : a + 2048] @ centre.T, axis=1) for a in range(0, n, 2048)])
        sums = np.zeros_like(centre)
        np.add.at(sums, best, v)
        empty = ~sums.any(axis=1)
        sums[empty] = v[rng.choice(n, int(empty.sum()))]
        centre = unit(sums)
    part = np.full(n, -1)
    size = np.zeros(parts, dtype=np.int64)
    order = rng.permutation(n)
    for a in range(0, n, 2048):
        rows = order[a : a + 2048]
        liked = np.argsort(-(v[rows] @ centre.T), axis=1)
        for r, want in zip(rows.tolist(), liked.tolist()):
            for p in want:
                if size[p] < room:
                    part[r] = p
                    size[p] += 1
                    break
    weight = np.maximum(score, 0) ** 2
    for _ in range(4):
        moved = 0
        for r in rng.permutation(n).tolist():
            own = int(part[r])
            gain: dict[int, float] = {}
            for p, w in zip(part[near[r]].tolist(), weight[r].tolist()):
                gain[p] = gain.get(p, 0.0) + w
            stay = gain.get(own, 0.0)
            for p, w in gain.items():
                if w > stay and p != own and size[p] < room:
                    own, stay = p, w
            if own != part[r]:
                size[part[r]] -= 1
                size[own] += 1
                part[r] = own
                moved += 1
        if moved < n / 100:
            break
    return part


def fit_router(v: np.ndarray, near: np.ndarray, part: np.ndarray, parts: int, hidden: int, rng: np.random.Generator, epochs: int = 12) -> Router:
    """A network of one hidden layer, by Adam on cross-entropy against the parts of a row and its neighbours."""
    n, d = v.shape
    w = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    w = [x.astype(np.float32) for x in w]
    m, u = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    labels = np.concatenate([np.repeat(part[:, None], 4, axis=1), part[near]], axis=1)
    share = np.float32(1 / labels.shape[1])
    t = 0
    for epoch in range(epochs):
        rate = 0.006 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(n)
        for a in range(0, n, 256):
            rows = order[a : a + 256]
            x = v[rows] + rng.normal(0, 0.03, (len(rows), d)).astype(np.float32)
            h = np.maximum(x @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            z -= z.max(axis=1, keepdims=True)
            e = np.exp(z)
            e /= e.sum(axis=1, keepdims=True)
            np.subtract.at(e, (np.arange(len(rows))[:, None], labels[rows]), share)
            e /= len(rows)
            back = (e @ w[2].T) * (h > 0)
            grads = [x.T @ back, back.sum(0), h.T @ e, e.sum(0)]
            t += 1
            for i, g in enumerate(grads):
                m[i] += 0.1 * (g - m[i])
                u[i] += 0.001 * (g * g - u[i])
                w[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(u[i] / (1 - 0.999**t)) + 1e-8)
    return Router(*w)


def fit(sample: np.ndarray, rows: int, s: Settings) -> Router:
    """The router for a collection of ``rows`` vectors, from unit vectors of a sample (in fixed order)."""
    rng = np.random.default_rng(s.seed)
    parts = int(min(s.max_parts, max(1, rows // s.part_rows), max(1, len(sample) // 8)))
    if parts == 1 or len(sample) < 3:
        return Router(np.zeros((sample.shape[1], 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32))
    near, score = neighbour_graph(sample)
    part = balanced_parts(sample, near, score, parts, rng)
    return fit_router(sample, near, part, parts, s.hidden, rng)


def to_matrix(col: pa.Array | pa.ChunkedArray, dim: int = DIM) -> np.ndarray:
    """Vectors kept as bytes, as rows."""
    return np.frombuffer(b"".join(col.to_pylist()), dtype=np.float32).reshape(-1, dim)


def _route(router, blocks, probes: int, least_p: float, dim: int):
    """Rows of search tasks (part, ib, qb): each vector in its own part, and as a query in the other probable ones.

    role is 0 for an indexed row, 1 for a query, 2 for both. In a part of several blocks an indexed row goes to its index
    block under every query block, and a query to its query block under every index block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, many = router.value, blocks.value
        for b in batches:
            for a in range(0, b.num_rows, 2048):
                c = b.slice(a, 2048)
                v = unit(np.asarray(c.column("v").flatten(), dtype=np.float32).reshape(-1, dim))
                ids = np.asarray(c.column("node_id"))
                asked = np.asarray(c.column("is_query").to_numpy(zero_copy_only=False), dtype=bool)
                p = net.probabilities(v)
                k = min(probes + 1, p.shape[1])
                top = np.argpartition(-p, k - 1, axis=1)[:, :k]
                prob = np.take_along_axis(p, top, axis=1)
                own = top[np.arange(len(p)), prob.argmax(axis=1)]
                row, j = np.nonzero((prob >= least_p) | (top == own[:, None]))
                part = top[row, j]
                home = part == own[row]
                keep = home | asked[row]
                row, part, home = row[keep], part[keep], home[keep]
                n = many[part]
                block = (ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n
                one = n == 1
                role = np.where(home, np.where(asked[row], 2, 0), 1)
                out = [(row[one], part[one], block[one], block[one], role[one])]
                for is_index, pick in ((True, ~one & home), (False, ~one & asked[row])):
                    r = np.repeat(np.flatnonzero(pick), n[pick])
                    each = np.arange(len(r)) - np.repeat(np.cumsum(n[pick]) - n[pick], n[pick])
                    out.append((row[r], part[r], block[r] if is_index else each, each if is_index else block[r], np.full(len(r), 0 if is_index else 1)))
                row, part, ib, qb, role = (np.concatenate(z) for z in zip(*out))
                vec = pa.array([x.tobytes() for x in v], pa.binary()).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*(pa.array(z.astype(np.int32)) for z in (part, ib, qb, role)), pa.array(ids[row]), vec], names=["part", "ib", "qb", "role", "node_id", "vec"])

    return run


#: Scores of a block of products, and exact cosines, that a search task holds at once.
SCORES, PAIRS = 2_000_000, 50_000


def _best(s: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of scores that may be among a row's k best and are ``least`` or more; -2 is none. Single precision decides nothing within 1e-5."""
    floor = np.full((len(s), 1), max(least - 1e-5, -1.5), dtype=np.float32)
    crowded = np.flatnonzero((s >= floor).sum(axis=1) > k)
    if len(crowded):
        n = s.shape[1]
        floor[crowded, 0] = np.maximum(floor[crowded, 0], np.partition(s[crowded], n - k, axis=1)[:, n - k] - 1e-5)
    return np.nonzero(s >= floor)


def _search(k: int, least: float, dim: int):
    """The k best index rows of each query of one (part, index block, query block), of cosine ``least`` or more; memory is bounded by SCORES and PAIRS, however dense the part is."""

    def run(t: pa.Table) -> pa.Table:
        ids = np.asarray(t.column("node_id").combine_chunks())
        role = np.asarray(t.column("role").combine_chunks())
        v = to_matrix(t.column("vec"), dim)
        xi, qi = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
        x, q = v[xi], v[qi]
        out = []
        step = max(1, SCORES // max(1, len(xi)))
        for a in range(0, len(qi) if len(xi) else 0, step):
            s = q[a : a + step] @ x.T
            s[ids[qi[a : a + step]][:, None] == ids[xi][None, :]] = -2
            r, c = _best(s, k, least)
            if not len(r):
                continue
            cos = np.concatenate([np.einsum("ij,ij->i", q[a + r[i : i + PAIRS]].astype(np.float64), x[c[i : i + PAIRS]].astype(np.float64)) for i in range(0, len(r), PAIRS)])
            keep = cos >= least
            r, c, cos = r[keep], c[keep], cos[keep]
            order = np.lexsort((ids[xi[c]], -cos, r))
            r, c, cos = r[order], c[order], cos[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r, side="left")
            keep = rank < k
            out.append((ids[qi[a + r[keep]]], ids[xi[c[keep]]], cos[keep]))
        cat = [np.concatenate(z) for z in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"node_id": pa.array(cat[0], pa.int64()), "other": pa.array(cat[1], pa.int64()), "cosine": pa.array(cat[2], pa.float64())})

    return run


def current_vectors(emb: DataFrame, dim: int = DIM) -> DataFrame:
    """node_id, emb_id, h1, h2 of every node's latest row, where that row has a proper vector (``dim`` finite numbers, not all 0).

    ``vector`` counts, or ``embedding`` where that is null; of equal times the largest emb_id; a null time is the oldest; a null node_id takes no part.
    The vectors themselves stay behind: only their hashes travel.
    """
    v = F.coalesce("vector", "embedding")
    proper = (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    small = emb.filter(F.col("node_id").isNotNull()).select("node_id", "saved_at", "emb_id", F.coalesce(proper, F.lit(False)).alias("proper"), F.xxhash64(v).alias("h1"), F.xxhash64(v, F.lit(1)).alias("h2"))
    w = Window.partitionBy("node_id").orderBy(F.col("saved_at").desc_nulls_last(), F.col("emb_id").desc())
    return small.withColumn("rn", F.row_number().over(w)).filter("rn = 1 and proper").select("node_id", "emb_id", "h1", "h2")


def similar(emb: DataFrame, k: int = 10, least: float = -1.0, query_mod: int = 1, s: Settings = Settings(), dim: int = DIM) -> DataFrame:
    """node_id, other, cosine, rank_no: the k most similar other nodes of each node (equal cosines: smaller id first).

    Only pairs with cosine ``least`` or more; with ``query_mod`` m only node ids divisible by m ask. An empty table gives no rows. Nodes with equal vectors stand for
    each other: one of them is searched, and all of them come out.
    """
    spark = emb.sparkSession
    now = current_vectors(emb, dim)
    asks = F.col("node_id") % query_mod == 0
    classes = now.groupBy("h1", "h2").agg(F.min(F.struct("node_id", "emb_id")).alias("rep"), F.count("*").alias("n"), F.bool_or(asks).alias("is_query"))
    reps = classes.select(F.col("rep.node_id").alias("node_id"), F.col("rep.emb_id").alias("emb_id"), "h1", "h2", "n", "is_query")
    full = emb.select("emb_id", F.coalesce("vector", "embedding").alias("v"))
    vectors = reps.select("node_id", "emb_id", "is_query").hint("shuffle_hash").join(full, "emb_id").select("node_id", "is_query", "v")

    rows = emb.count()
    share = min(1.0, 1.15 * s.sample / max(1, rows))
    picked = full.filter((F.pmod(F.xxhash64("emb_id", F.lit(s.seed)), F.lit(1_000_000)) < int(share * 1_000_000)) & (F.size("v") == dim)).orderBy(F.xxhash64("emb_id")).limit(s.sample).toArrow()
    sample = np.asarray(picked.column("v").combine_chunks().flatten(), dtype=np.float32).reshape(-1, dim) if picked.num_rows else np.zeros((0, dim), np.float32)
    sample = sample[np.isfinite(sample).all(axis=1) & sample.any(axis=1)]
    router = fit(unit(sample), rows, s) if len(sample) else fit(np.zeros((0, dim), np.float32), 0, s)
    # Rows a part will have, from the sample: this only balances the work. A part that would be too large for a task has blocks.
    parts = len(router.b2)
    seen = np.bincount(router.probabilities(unit(sample)).argmax(axis=1), minlength=parts) if len(sample) else np.zeros(parts)
    blocks = np.maximum(1, np.ceil(seen * (rows / max(1, len(sample))) / s.block)).astype(np.int64)
    net, many = spark.sparkContext.broadcast(router), spark.sparkContext.broadcast(blocks)
    tasks = vectors.mapInArrow(_route(net, many, s.probes, s.least_p, dim), "part int, ib int, qb int, role int, node_id long, vec binary")
    one_way = tasks.groupBy("part", "ib", "qb").applyInArrow(_search(k, least, dim), "node_id long, other long, cosine double")
    found = one_way
    if query_mod == 1:  # what one of two finds, both know
        found = one_way.unionByName(one_way.select(F.col("other").alias("node_id"), F.col("node_id").alias("other"), "cosine")).distinct()
    best = Window.partitionBy("node_id").orderBy(F.col("cosine").desc(), "other")
    by_rep = found.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k).select(F.col("node_id").alias("rep"), F.col("other").alias("other_rep"), "cosine")

    # Back from representatives to nodes. Most classes have one member; only larger ones take part in joins, dealt out by their number of members.
    dup = reps.filter("n > 1").select("h1", "h2", F.col("node_id").alias("rep"), "n", F.col("n").alias("members"))
    members = salted_join(now.select("node_id", "h1", "h2"), dup, ["h1", "h2"], "members").select("rep", "node_id", "n")
    # the first k + 1 of a class: of each of its deals first, so that no task sorts a whole class
    part = members.withColumn("deal", F.pmod(F.xxhash64("node_id"), F.lit(DEALS)))
    part = part.withColumn("at", F.row_number().over(Window.partitionBy("rep", "deal").orderBy("node_id"))).filter(F.col("at") <= k + 1)
    heads = part.withColumn("at", F.row_number().over(Window.partitionBy("rep").orderBy("node_id"))).filter(F.col("at") <= k + 1).select("rep", "node_id", "n")
    listed = heads.groupBy("rep", "n").agg(F.sort_array(F.collect_list("node_id")).alias("ids"))
    asking = members.filter(F.col("node_id") % query_mod == 0).select("rep", "node_id")
    own = salted_join(asking, listed, ["rep"], "n").select("node_id", F.explode("ids").alias("other"), F.lit(1.0).alias("cosine")).filter("node_id <> other")
    # a node of a class of more than k members has no place left for others
    small = members.filter(F.col("n") <= k).select("rep", "node_id")
    big = dup.filter(F.col("n") > k).select("rep")
    a = by_rep.join(big, "rep", "left_anti").join(small, "rep", "left").select(F.coalesce("node_id", "rep").alias("node_id"), "other_rep", "cosine").filter(F.col("node_id") % query_mod == 0)
    b = a.join(listed.select(F.col("rep").alias("other_rep"), "ids"), "other_rep", "left").select("node_id", F.explode(F.coalesce("ids", F.array("other_rep"))).alias("other"), "cosine")
    w = Window.partitionBy("node_id").orderBy(F.col("cosine").desc(), "other")
    return b.unionByName(own.filter(F.lit(least) <= 1.0)).withColumn("rank_no", F.row_number().over(w)).filter(F.col("rank_no") <= k)


def close_pairs(emb: DataFrame, k: int = 10, least: float = 0.9, s: Settings = Settings()) -> DataFrame:
    """node_a < node_b: pairs with cosine ``least`` or more of which one is among the other's k most similar."""
    r = similar(emb, k, least, 1, s)
    return r.select(F.least("node_id", "other").alias("node_a"), F.greatest("node_id", "other").alias("node_b")).distinct()
