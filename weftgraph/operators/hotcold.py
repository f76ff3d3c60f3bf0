"""Join of many rows with a unique key table whose keys may be very unevenly referenced."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key is hot if it has more than total / HOT_PARTS rows, so there are fewer than HOT_PARTS hot keys.
HOT_PARTS = 2000


def hot_cold_join(rows: DataFrame, keyed: DataFrame, key: str, count_col: str, hot_rows: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed`` (unique ``key``, exact row counts in ``count_col``).

    Keys with more than ``hot_rows`` rows are broadcast: there are at most all rows / hot_rows of them. The
    others are joined by a shuffle in which no key has more than hot_rows rows. Null keys match nothing.
    """
    hot = keyed.filter(F.col(count_col) > hot_rows).drop(count_col)
    cold = keyed.filter(F.col(count_col) <= hot_rows).drop(count_col)
    a = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return a.unionByName(rest.join(cold, key))


def salted_join(rows: DataFrame, keyed: DataFrame, keys: list[str], count_col: str, per_salt: int = 50_000) -> DataFrame:
    """Inner join of ``rows`` with ``keyed`` (unique keys, exact row counts in ``count_col``, which is dropped).

    A key with more than ``per_salt`` rows is written as count / per_salt copies with a salt each, and its rows
    are dealt out over the salts. The broadcast list holds only those keys: at most all rows / per_salt. Null keys match nothing.
    """
    salts = F.ceil(F.col(count_col) / per_salt).cast("int")
    few = keyed.filter(F.col(count_col) > per_salt).select(*keys, salts.alias("__salts"))
    spread = rows.join(F.broadcast(few), keys, "left").withColumn("__salt", F.when(F.col("__salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.col("__salts")))).drop("__salts")
    copies = keyed.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1))).drop(count_col)
    return spread.join(copies, [*keys, "__salt"]).drop("__salt")
