"""Recurrences over ordered rows of a key, one row after the other, in constant memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, key: str, order: list[str], value: str, start: Callable[[], dict], step: Callable[[dict, float], float], out: str, keep: str) -> DataFrame:
    """key, ``keep``, ``out``: what ``step`` returns for each row of a key in order, given a state that it changes.

    Rows of a key stream through one task, sorted by Spark and never held together.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), {}
        for b in batches:
            res = []
            for k, v in zip(b.column(key).to_pylist(), b.column(value).to_pylist()):
                if k != now:
                    now, state = k, start()
                res.append(step(state, v))
            yield pa.RecordBatch.from_arrays([b.column(key), b.column(keep), pa.array(res, pa.float64())], names=[key, keep, out])

    cols = list(dict.fromkeys([key, keep, value, *order]))
    return df.select(*cols).repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, f"`{key}` {kinds[key]}, `{keep}` {kinds[keep]}, `{out}` double")


def ema_z(alpha: float = 0.1) -> tuple[Callable[[], dict], Callable[[dict, float], float]]:
    """Rewards as deviations from a running mean, in running deviations; the variance takes the mean after its own update."""

    def step(s: dict, x: float) -> float:
        if not s:
            s |= {"m": x, "v": 1.0}
        else:
            s["m"] = (1 - alpha) * s["m"] + alpha * x
            s["v"] = (1 - alpha) * s["v"] + alpha * (x - s["m"]) ** 2
        return (x - s["m"]) / max(s["v"] ** 0.5, 1e-8)

    return dict, step


def bias_reward(first: float, rate: float = 0.01) -> tuple[Callable[[], dict], Callable[[dict, float], float]]:
    """An intent's preference for a relation after each reward: the step shrinks as the preference grows, within [0.1, 3]."""

    def step(s: dict, r: float) -> float:
        b = s.get("b", first)
        if b <= 0:
            b = 1.0
        s["b"] = max(0.1, min(3.0, b + rate * r * (1 - b / 3.0)))
        return s["b"]

    return dict, step
