"""Rewards: their mixture, an estimate from a walk, small networks that judge vectors, tasks that fall due."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weftgraph.operators.graph import clamp

c = F.col
# After how many queries each task falls due.
INTERVALS = {"decay": 1000, "compression": 5000, "replay": 100, "audit": 10000, "save": 5000}


def total_reward(external: Column, human: Column, internal: Column) -> Column:
    return 0.4 * external + 0.3 * human + 0.3 * internal


def estimated_internal(activations: Column, confidences: Column, energy: Column) -> Column:
    """From the mean activation, mean confidence and energy of a result, within [0, 1]; 0 without activations."""
    mean = lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda s, y: s + y) / F.size(x)).otherwise(0.0)
    v = 0.4 * mean(activations) + 0.3 * mean(confidences) + 0.3 * F.least(energy / 10, F.lit(1.0))
    return F.when(F.size(activations) > 0, clamp(v, 0.0, 1.0)).otherwise(0.0)


def time_factor(seconds: Column, strength: float = 0.5) -> Column:
    """How much a lapse of time leaves: 1 for none."""
    t = F.abs(seconds)
    return F.when(t < 1e-6, 1.0).otherwise(1.0 / (1.0 + strength * F.log1p(t)))


class Judge:
    """A network with one output in (0, 1); weights by He's rule from a fixed seed, so the same everywhere until it is trained."""

    def __init__(self, inputs: int, hidden: tuple[int, ...] = (64, 32), seed: int = 42):
        rng = np.random.RandomState(seed)
        sizes = [inputs, *hidden, 1]
        self.layers = [(rng.randn(a, b).astype(np.float32) * np.float32(np.sqrt(2.0 / a)), np.zeros(b, np.float32)) for a, b in zip(sizes, sizes[1:])]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for w, b in self.layers[:-1]:
            x = np.maximum(x @ w + b, 0)
        w, b = self.layers[-1]
        return 1 / (1 + np.exp(-np.clip(x @ w + b, -15, 15)))[:, 0]


def judged(rows: DataFrame, parts: dict[str, tuple[list[str], float]], hidden: tuple[int, ...] = (64, 32)) -> DataFrame:
    """row_id, one column a part, and reward, their weighted sum: each part is a network over the named vector columns side by side; rows of a column have equal lengths."""
    columns = sorted({k for names, _ in parts.values() for k in names})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, Judge] = {}
        for b in batches:
            if not b.num_rows:
                continue
            v = {k: np.asarray(b.column(k).flatten(), dtype=np.float32).reshape(b.num_rows, -1) for k in columns}
            out = {}
            for part, (names, _) in parts.items():
                x = np.concatenate([v[k] for k in names], axis=1)
                out[part] = made.setdefault(part, Judge(x.shape[1], hidden))(x).astype(float)
            total = sum(weight * out[part] for part, (_, weight) in parts.items())
            yield pa.RecordBatch.from_arrays([b.column("row_id"), *[pa.array(out[p]) for p in parts], pa.array(total)], names=["row_id", *parts, "reward"])

    return rows.select("row_id", *columns).mapInArrow(run, "row_id long, " + ", ".join(f"{p} double" for p in parts) + ", reward double")


def due_tasks(counts: DataFrame, intervals: dict[str, int] = INTERVALS) -> DataFrame:
    """key, task, times: how often each task has fallen due after so many queries (key, before, after: counts before and after a batch)."""
    tasks = F.array(*[F.struct(F.lit(k).alias("task"), F.lit(n).alias("every")) for k, n in intervals.items()])
    x = counts.select("key", "before", "after", F.explode(tasks).alias("t")).select("key", "t.task", (F.floor(c("after") / c("t.every")) - F.floor(c("before") / c("t.every"))).alias("times"))
    return x.filter("times > 0")
