"""Per-key results when a few keys hold most records.

The rows are range-partitioned on the composite (keys, order) with sampled quantiles, so a heavy key is
spread over as many partitions as its rows need. Every partition folds its sorted run of each key into one
partial state; only the first and the last key of a partition can continue elsewhere, so only those partial
states (two a partition at most) are stitched, in order. The other keys are final where they stand.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from weftgraph.session import cut, shuffle_partitions

#: Stands for a first or, negative, a last order where a run has none.
_NONE = (1 << 63) - 1
_STATE = ["n", "n_value", "sum_value", "min_value", "max_value", "first_order", "last_order"]


def _runs(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Starts of the runs of equal keys in a sorted batch; null keys are equal to each other."""
    n = batch.num_rows
    change = np.zeros(n, dtype=bool)
    change[0] = True
    for k in keys:
        col = batch.column(k)
        if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
            col = col.dictionary_encode().indices
        null = np.asarray(pc.is_null(col))
        val = np.asarray(col.fill_null(0))
        change[1:] |= (val[1:] != val[:-1]) | (null[1:] != null[:-1])
    return np.flatnonzero(change)


def _fold(keys: Sequence[str], out: pa.Schema):
    """Folds the sorted rows of one partition into a state for each key, marking first and last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None  # the state of the run not yet ended
        first = True

        def emit(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=out)

        for b in batches:
            if not b.num_rows:
                continue
            starts = _runs(b, keys)
            v = np.asarray(b.column("__value").fill_null(np.nan), dtype=float)
            ok = np.isfinite(v)
            o, real = np.asarray(b.column("__order")), np.asarray(b.column("__real").to_numpy(zero_copy_only=False), dtype=bool)
            ends = np.append(starts[1:], b.num_rows) - 1
            cols = {k: b.column(k).take(pa.array(starts)) for k in keys}
            state = {
                "n": ends - starts + 1,
                "n_value": np.add.reduceat(ok.astype(np.int64), starts),
                "sum_value": np.add.reduceat(np.where(ok, v, 0.0), starts),
                "min_value": np.minimum.reduceat(np.where(ok, v, np.inf), starts),
                "max_value": np.maximum.reduceat(np.where(ok, v, -np.inf), starts),
                "first_order": np.minimum.reduceat(np.where(real, o, _NONE), starts),
                "last_order": np.maximum.reduceat(np.where(real, o, -_NONE), starts),
            }
            at = lambda i: {k: cols[k][i].as_py() for k in keys} | {k: state[k][i].item() for k in _STATE}
            lo, hi = 0, len(starts) - 1
            head = at(0)
            if held is not None:
                if all(held[k] == head[k] for k in keys):
                    held = _merge(held, head)
                    lo = 1
                if lo <= hi:
                    yield emit([held | {"edge_of_range": first}])
                    first, held = False, None
            if lo > hi:
                continue
            if hi > lo:
                body = {k: cols[k].slice(lo, hi - lo) for k in keys} | {k: pa.array(state[k][lo:hi]) for k in _STATE}
                flag = np.zeros(hi - lo, dtype=bool)
                flag[0] = first
                first = False
                yield pa.RecordBatch.from_arrays([body[f.name].cast(f.type) if f.name != "edge_of_range" else pa.array(flag) for f in out], schema=out)
            held = at(hi)
        if held is not None:
            yield emit([held | {"edge_of_range": True}])

    return run


def _merge(a: dict, b: dict) -> dict:
    return a | {
        "n": a["n"] + b["n"],
        "n_value": a["n_value"] + b["n_value"],
        "sum_value": a["sum_value"] + b["sum_value"],
        "min_value": min(a["min_value"], b["min_value"]),
        "max_value": max(a["max_value"], b["max_value"]),
        "first_order": min(a["first_order"], b["first_order"]),
        "last_order": max(a["last_order"], b["last_order"]),
    }


def balanced_profile(df: DataFrame, keys: Sequence[str], order: str, value: str, partitions: int | None = None) -> DataFrame:
    """One row a key: n, n_value, sum_value, min_value, max_value (over finite values), first_order, last_order.

    ``order`` is a long that spreads the rows of a key (unique is best); rows where it is null count, are spread by their hash, and are neither first nor last. Null keys form a key of their own;
    null, NaN and infinite values count in n only; a key without a finite value has null sum, min and max.
    An empty table gives no rows. Other columns are dropped, so clashing names don't matter.
    """
    spark = df.sparkSession
    n = partitions or 2 * shuffle_partitions(spark)
    o, v = F.col(order).cast("long"), F.col(value).cast("double")
    rows = df.select(*keys, F.coalesce(o, F.xxhash64(*df.columns)).alias("__order"), o.isNotNull().alias("__real"), v.alias("__value"))
    spread = rows.repartitionByRange(n, *keys, "__order").sortWithinPartitions(*keys, "__order")
    fields = [rows.schema[k] for k in keys]
    schema = T.StructType(
        [T.StructField(f.name, f.dataType, True) for f in fields]
        + [T.StructField(k, T.DoubleType() if k.endswith("_value") and k != "n_value" else T.LongType(), True) for k in _STATE]
        + [T.StructField("edge_of_range", T.BooleanType(), True)]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    # The states are few against the rows, and both halves below read them: written once, the rows are sorted once.
    parts = cut(spread.mapInArrow(_fold(keys, to_arrow_schema(schema)), schema))
    inner = parts.filter(~F.col("edge_of_range")).select(*keys, *_STATE)
    ends = (
        parts.filter("edge_of_range")
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("n"),
            F.sum("n_value").alias("n_value"),
            F.sum("sum_value").alias("sum_value"),
            F.min("min_value").alias("min_value"),
            F.max("max_value").alias("max_value"),
            F.min("first_order").alias("first_order"),
            F.max("last_order").alias("last_order"),
        )
    )
    some = F.col("n_value") > 0
    known = {k: F.when(some, F.col(k)) for k in ("sum_value", "min_value", "max_value")}
    return inner.unionByName(ends).withColumns(known | {"first_order": F.when(F.col("first_order") < _NONE, F.col("first_order")), "last_order": F.when(F.col("last_order") > -_NONE, F.col("last_order"))})


def both_ends(edges: DataFrame, *more: str) -> DataFrame:
    """edges unpivoted: ref_field ('source' or 'target'), node_id and the columns asked for; null ids left out."""
    return (
        edges.select(F.explode(F.array(*[F.struct(F.lit(f).alias("ref_field"), F.col(f).alias("node_id")) for f in ("source", "target")])).alias("r"), *more)
        .select("r.ref_field", "r.node_id", *more)
        .filter(F.col("node_id").isNotNull())
    )


def heavy_keys(profile: DataFrame, total: int, share: float = 0.02) -> DataFrame:
    """Keys that hold at least ``share`` of ``total`` rows; total 0 gives none."""
    return profile.filter(F.lit(total > 0) & (F.col("n") >= F.lit(share * total)))
