"""Small models on bounded samples: an intent classifier, clusters of vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

c = F.col
#: Rows that a classifier is fitted on, at most.
SAMPLE = 20_000
# The intent that an edge's relation stands for; 1 for the others.
RELATION_INTENT = {"is_a": 0, "has_property": 13, "causes": 2, "caused_by": 2, "follows": 14, "precedes": 14, "contradicts": 4, "supports": 8, "example_of": 7, "part_of": 6, "synonym": 5, "antonym": 4}


def intent_of(relation):
    table = F.create_map(*[x for k, v in RELATION_INTENT.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(table[relation], F.lit(1))


@dataclass
class Mlp:
    """Layers of a network with ReLU between them."""

    weights: list[np.ndarray]
    biases: list[np.ndarray]

    def logits(self, x: np.ndarray) -> np.ndarray:
        for i, (w, b) in enumerate(zip(self.weights, self.biases)):
            x = x @ w + b
            if i + 1 < len(self.weights):
                x = np.maximum(x, 0)
        return x


def expanded(m: Mlp, classes: int, seed: int = 42) -> Mlp:
    """The network with outputs for more classes; the old ones are as they were."""
    w, b = m.weights[-1], m.biases[-1]
    more = max(0, classes - w.shape[1])
    new = np.random.default_rng(seed).normal(0, np.sqrt(2 / w.shape[0]), (w.shape[0], more))
    return Mlp([*m.weights[:-1], np.concatenate([w, new], axis=1)], [*m.biases[:-1], np.concatenate([b, np.zeros(more)])])


def slopes(z: np.ndarray, y: np.ndarray, focal: float = 0.0) -> np.ndarray:
    """The loss's slope by each row's outputs, for cross-entropy, or, with ``focal`` > 0, for one in which rows that are right already weigh less."""
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    own = np.arange(len(y))
    sure = np.clip(p[own, y], 1e-9, 1 - 1e-9)
    p[own, y] -= 1
    if focal:
        p *= ((1 - sure) ** (focal - 1) * (1 - sure - focal * sure * np.log(sure)))[:, None]
    return p


def fit_mlp(x: np.ndarray, y: np.ndarray, classes: int, hidden: tuple[int, ...] = (128, 64), epochs: int = 10, seed: int = 42, rate: float = 0.003, start: Mlp | None = None, focal: float = 0.0, clip: float = 1e9, cosine: bool = False, patience: int = 3, settle: float = 0.0) -> Mlp:
    """Cross-entropy by Adam; stops when a tenth held back hasn't improved for ``patience`` epochs.

    From ``start`` on, if there is one (rows of earlier rounds among ``x`` keep what it knows). ``focal`` is the focusing power of the loss, ``clip`` the most a step's slopes may measure,
    ``cosine`` lets the rate fall to nothing along a cosine. With ``settle``, training ends after five steps in a row whose slopes measure less, ten steps at least.
    """
    rng = np.random.default_rng(seed)
    sizes = [x.shape[1], *hidden, classes]
    fresh = lambda: Mlp([rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:])], [np.zeros(b) for b in sizes[1:]])
    m = fresh() if start is None else expanded(Mlp([w.copy() for w in start.weights], [b.copy() for b in start.biases]), classes)
    order = rng.permutation(len(x))
    held, used = order[: len(x) // 10], order[len(x) // 10 :]
    flat = [*m.weights, *m.biases]
    g1, g2 = [np.zeros_like(p) for p in flat], [np.zeros_like(p) for p in flat]
    best, since, t, still = np.inf, 0, 0, 0
    steps = epochs * max(1, len(used) // 128)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(used), max(1, len(used) // 128)):
            acts = [x[part]]
            for i, (w, b) in enumerate(zip(m.weights, m.biases)):
                z = acts[-1] @ w + b
                acts.append(np.maximum(z, 0) if i + 1 < len(m.weights) else z)
            d = slopes(acts[-1], y[part], focal) / len(part)
            gw, gb = [None] * len(m.weights), [None] * len(m.weights)
            for i in reversed(range(len(m.weights))):
                gw[i], gb[i] = acts[i].T @ d, d.sum(0)
                if i:
                    d = (d @ m.weights[i].T) * (acts[i] > 0)
            size = float(np.sqrt(sum(float((g * g).sum()) for g in [*gw, *gb])))
            still = still + 1 if size < settle else 0
            if still >= 5 and t >= 10:
                return m
            if size > clip:
                gw, gb = [g * (clip / size) for g in gw], [g * (clip / size) for g in gb]
            now = rate * 0.5 * (1 + np.cos(np.pi * min(1.0, t / steps))) if cosine else rate
            t += 1
            for k, (q, g) in enumerate(zip(flat, [*gw, *gb])):
                g1[k] += 0.1 * (g - g1[k])
                g2[k] += 0.001 * (g * g - g2[k])
                q -= now * (g1[k] / (1 - 0.9**t)) / (np.sqrt(g2[k] / (1 - 0.999**t)) + 1e-8)
        if len(held):
            z = m.logits(x[held])
            z -= z.max(axis=1, keepdims=True)
            loss = float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(held)), y[held]]).mean())
            best, since = (loss, 0) if loss < best - 1e-4 else (best, since + 1)
            if since >= patience:
                break
    return m


def classify(rows: DataFrame, model: Mlp, k: int = 5) -> DataFrame:
    """row_id, rank_no, predicted: the k most probable classes of each row (row_id, features)."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column("features").flatten(), dtype=float).reshape(b.num_rows, -1)
            top = np.argsort(-sent.value.logits(x), axis=1, kind="stable")[:, :k]
            n = top.shape[1]
            yield pa.RecordBatch.from_arrays([b.column("row_id").take(pa.array(np.repeat(np.arange(b.num_rows), n))), pa.array(np.tile(np.arange(1, n + 1), b.num_rows)), pa.array(top.ravel())], names=["row_id", "rank_no", "predicted"])

    return rows.select("row_id", "features").mapInArrow(run, "row_id long, rank_no long, predicted long")


def top_k_accuracy(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """Shares of rows whose class (row_id, actual) is among the first 1, 3 and 5."""
    j = truth.join(ranked.filter(c("rank_no") <= 5), "row_id").groupBy("row_id", "actual").agg(F.min(F.when(c("predicted") == c("actual"), c("rank_no"))).alias("at"))
    return j.agg(F.count("*").alias("n"), *[F.round(F.avg(F.when(c("at") <= k, 1.0).otherwise(0.0)), 6).alias(f"top_{k}") for k in (1, 3, 5)])


def silhouettes(vectors: DataFrame, ks: tuple[int, ...], seed: int = 1) -> DataFrame:
    """k, silhouette of clusterings of (node, v) into each number of clusters; the best is the one to choose."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    x = vectors.select("node", array_to_vector(F.transform("v", lambda e: e.cast("double"))).alias("features"))
    score = ClusteringEvaluator()
    rows = [(k, float(score.evaluate(KMeans(k=k, seed=seed).fit(x).transform(x)))) for k in ks]
    return vectors.sparkSession.createDataFrame(rows, "k int, silhouette double")


def clusters(vectors: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """node, cluster by k-means over (node, v)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = vectors.select("node", array_to_vector(F.transform("v", lambda e: e.cast("double"))).alias("features"))
    return KMeans(k=k, seed=seed).fit(x).transform(x).select("node", c("prediction").alias("cluster"))
