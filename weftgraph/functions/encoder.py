"""A deterministic encoder of short texts: hashed character n-grams, of unit length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DIM = 128
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def encode(texts: list[str | None], dim: int = DIM) -> np.ndarray:
    """Rows of length 1; null and empty texts give zeros. Words count with their borders, by n-grams of 2 to 4 characters."""
    padded = [f" {' '.join((t or '').lower().split())} " for t in texts]
    padded = [s if len(s) > 2 else "" for s in padded]
    cps = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), [len(s) for s in padded])
    out = np.zeros(len(texts) * dim)
    h = cps + np.uint64(1)
    for n in (2, 3, 4):  # the hashes of n characters are those of n - 1 and the next
        h = h[:-1] * BASE + cps[n - 1 :]
        inside = row[: len(h)] == row[n - 1 :]
        g = h ^ (h >> np.uint64(29))
        g = g * MIX
        g ^= g >> np.uint64(32)
        at = row[: len(h)] * dim + (g % np.uint64(dim)).astype(np.int64)
        sign = np.where(g >> np.uint64(31) & np.uint64(1), 1.0, -1.0)
        out += np.bincount(at[inside], sign[inside], len(out)) if len(h) else 0.0
    out = out.reshape(len(texts), dim).astype(np.float32)
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, n, out=out, where=n > 0)


def with_vectors(df: DataFrame, text: str, dim: int = DIM) -> DataFrame:
    """df's key columns with ``v``: every column must be a string or a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                b = batch.slice(at, 2_000)
                v = encode(b.column(text).to_pylist(), dim)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), dim).cast(pa.list_(pa.float32()))], names=[*b.schema.names, "v"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, v array<float>")
