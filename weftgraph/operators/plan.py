"""Plans of intents: by rules over a subgraph's features, or by beam search over scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weftgraph.params import INTENTS

c = F.col
# Rules in order, as a condition on features and the plan it gives.
RULES: tuple[tuple[str, tuple[int, ...]], ...] = (
    ("n_nodes <= 3", (0,)),
    ("causes > 0", (1, 2, 7)),
    ("contradicts > 0", (4, 1, 7)),
    ("n_nodes >= 10", (6, 12, 8)),
    ("avg_conf < 0.5", (10, 11)),
)
#: Rules of a table that are read at most.
MOST_RULES = 10_000


def query_contains(word: str) -> str:
    """A rule's condition: the column query_text holds the word, in any case."""
    quoted = word.lower().replace("\\", "\\\\").replace("'", "\\'")
    return f"coalesce(contains(lower(query_text), '{quoted}'), false)"


def rules_of(table: DataFrame) -> tuple[tuple[str, tuple[int, ...]], ...]:
    """Rules of a table (ord, condition, intents), in order, to be used with or in place of RULES."""
    rows = table.select("ord", "condition", "intents").orderBy("ord").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return tuple((r.condition, tuple(r.intents)) for r in rows)


def rule_plan(features: DataFrame, rules: Sequence[tuple[str, tuple[int, ...]]] = RULES) -> DataFrame:
    """features with intents (joined by commas) and plan_confidence 0.5 of the first rule that holds; null if none does.

    A condition is SQL over the feature columns, checked by Spark's analyser; nothing is evaluated in Python.
    """
    plan: Column | None = None
    for condition, intents in rules:
        text = F.lit(",".join(map(str, intents)))
        plan = F.when(F.expr(condition), text) if plan is None else plan.when(F.expr(condition), text)
    return features.withColumn("intents", plan if plan is not None else F.lit(None).cast("string")).withColumn("plan_confidence", F.when(c("intents").isNotNull(), 0.5))


def intent_names(intents: Column) -> Column:
    """Names of an array of intents."""
    names = F.array(*[F.lit(x) for x in INTENTS])
    return F.transform(intents, lambda i: F.get(names, i))


def masked(logits: Column, allowed: Sequence[int]) -> Column:
    """Scores with those of intents that aren't allowed put out of reach."""
    keep = F.array(*[F.lit(i) for i in allowed])
    return F.transform(logits, lambda x, i: F.when(F.array_contains(keep, i), x.cast("double")).otherwise(F.lit(-1e9)))


def beam_all(logits: np.ndarray, width: int = 2, length: int = 8, penalty: float = 1.2, temperature: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(n, length) best sequences and (n,) confidences of n rows of scores, all rows, beams and tokens in one pass a step.

    A token that a beam has used is lowered by the penalty; of equal scores the earlier beam goes first, then the larger token.
    """
    n, t = logits.shape
    base = (logits / temperature)[:, None, ::-1]  # tokens from the largest down, so that a stable order prefers the larger
    base = base - base.max(axis=2, keepdims=True)
    base = base - np.log(np.exp(base).sum(axis=2, keepdims=True))
    used = np.zeros((n, 1, t), dtype=bool)
    score = np.zeros((n, 1))
    seq = np.zeros((n, 1, 0), dtype=np.int64)
    row = np.arange(n)[:, None]
    for _ in range(length):
        p = np.exp(base - penalty * used)
        p /= p.sum(axis=2, keepdims=True)
        total = (score[:, :, None] + np.log(np.maximum(p, 1e-10))).reshape(n, -1)
        best = np.argsort(-total, axis=1, kind="stable")[:, :width]
        parent, token = best // t, best % t
        score = np.take_along_axis(total, best, axis=1)
        seq = np.concatenate([seq[row, parent], (t - 1 - token)[:, :, None]], axis=2)
        used = used[row, parent]
        used[row, np.arange(used.shape[1])[None, :], token] = True
    return seq[:, 0], np.clip(np.exp(score[:, 0] / max(1, length)), 0, 1)


def beam_plans(queries: DataFrame, width: int = 2, length: int = 8) -> DataFrame:
    """query_id, intents, plan_confidence from (query_id, logits); every query needs as many scores as the others of its batch, none of them null."""
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column("logits").flatten(), dtype=float).reshape(b.num_rows, -1)
            seq, conf = beam_all(x, width, length)
            plans = pa.ListArray.from_arrays(np.arange(0, seq.size + 1, length, dtype=np.int32), seq.ravel().astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("query_id"), plans, pa.array(conf)], names=["query_id", "intents", "plan_confidence"])

    return queries.select("query_id", "logits").filter("logits is not null").mapInArrow(run, f"query_id {kind}, intents array<int>, plan_confidence double")
