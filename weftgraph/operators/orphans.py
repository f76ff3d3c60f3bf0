"""References to records that do not exist.

The maintained state has, per key and creation time, signed counts: ``refs`` (references to it), ``exist`` (records of that
time) and ``gone`` (deletions known of it). It is the sum of change deltas, so a batch of new deltas is added by the same aggregation (``apply_deltas``) and
a retraction takes back what was added, times included. ``summary`` sums it up per key; a key whose refs are positive and whose
exist is zero is an orphan. Only rows of orphan or possibly late keys are then read again for the report.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from weftgraph.operators.hotcold import HOT_PARTS, hot_cold_join
from weftgraph.session import cut

PERIOD_S = 2592000
_DELTA = "node_id long, refs long, exist long, gone long, first_ref double, created double, null_created boolean"


def reference_deltas(refs: DataFrame, sign: int = 1) -> DataFrame:
    """Deltas of references (node_id, at): pre-aggregated per key before they travel."""
    t = F.col("at")
    return (
        refs.filter(F.col("node_id").isNotNull())
        .groupBy("node_id")
        .agg(F.count("*").alias("n"), F.min(F.when(~F.isnan(t), t)).alias("first_ref"))
        .select("node_id", (F.lit(sign) * F.col("n")).cast("long").alias("refs"), F.lit(0).cast("long").alias("exist"), F.lit(0).cast("long").alias("gone"), "first_ref", F.lit(None).cast("double").alias("created"), F.lit(False).alias("null_created"))
    )


def existence_deltas(nodes: DataFrame, sign: int = 1) -> DataFrame:
    """Deltas of records: exist counts rows; a null create_time means always there."""
    return nodes.filter(F.col("node_id").isNotNull()).select(
        "node_id", F.lit(0).cast("long").alias("refs"), F.lit(sign).cast("long").alias("exist"), F.lit(0).cast("long").alias("gone"),
        F.lit(None).cast("double").alias("first_ref"), F.col("create_time").cast("double").alias("created"), F.col("create_time").isNull().alias("null_created"),
    )


def deletion_deltas(deletions: DataFrame, sign: int = 1) -> DataFrame:
    none = F.lit(None).cast("double")
    return deletions.filter(F.col("node_id").isNotNull()).select(
        "node_id", F.lit(0).cast("long").alias("refs"), F.lit(0).cast("long").alias("exist"), F.lit(sign).cast("long").alias("gone"), none.alias("first_ref"), none.alias("created"), F.lit(False).alias("null_created")
    )


def apply_deltas(*deltas: DataFrame) -> DataFrame:
    """Sums deltas and earlier states into a state; what has nothing left (all counts zero) drops out.

    first_ref is a bound (the earliest ever seen), which only decides which rows are looked at again; creation times are part of the key, so they go with their records.
    """
    return (
        reduce(DataFrame.unionByName, deltas)
        .groupBy("node_id", "created", "null_created")
        .agg(F.sum("refs").alias("refs"), F.sum("exist").alias("exist"), F.sum("gone").alias("gone"), F.min("first_ref").alias("first_ref"))
        .filter((F.col("refs") != 0) | (F.col("exist") != 0) | (F.col("gone") != 0))
        .select(*[x.split()[0] for x in _DELTA.split(", ")])
    )


def summary(*deltas: DataFrame) -> DataFrame:
    """One row a key of a state, or of deltas none of which takes anything back: counts, first_ref, created (the earliest of its records) and null_created."""
    there = F.col("exist") > 0
    return (
        reduce(DataFrame.unionByName, deltas)
        .groupBy("node_id")
        .agg(
            F.sum("refs").alias("refs"), F.sum("exist").alias("exist"), F.sum("gone").alias("gone"), F.min("first_ref").alias("first_ref"),
            F.min(F.when(there, F.col("created"))).alias("created"), F.bool_or(there & F.col("null_created")).alias("null_created"),
        )
    )


def current_orphans(state: DataFrame) -> DataFrame:
    """node_id, refs, orphan_kind of the keys with references but no record."""
    return summary(state).filter((F.col("refs") > 0) & (F.col("exist") <= 0)).select("node_id", "refs", F.when(F.col("gone") > 0, "deleted").otherwise("missing").alias("orphan_kind"))


def references(edges: DataFrame, embeddings: DataFrame) -> DataFrame:
    """All references as rows: table_name, ref_field, row_id, node_id, at."""
    e = edges.select(
        F.lit("edges").alias("table_name"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("ref_field"), F.col(f).alias("node_id")) for f in ("source", "target")])).alias("r"),
        F.col("edge_id").alias("row_id"), F.col("last_used").alias("at"),
    ).select("table_name", "r.ref_field", "row_id", "r.node_id", "at")
    v = embeddings.select(F.lit("node_embeddings").alias("table_name"), F.lit("node_id").alias("ref_field"), F.col("emb_id").alias("row_id"), "node_id", F.col("saved_at").alias("at"))
    return e.unionByName(v).filter(F.col("node_id").isNotNull())


def orphan_rows(edges: DataFrame, embeddings: DataFrame, nodes: DataFrame, deletions: DataFrame) -> DataFrame:
    """table_name, ref_field, row_id, period_no, orphan_kind: one row for each orphan reference.

    Null references are none; a null or NaN time has period -1 and is never late; a record delivered several times counts
    as created at its earliest create_time, or always if one of them is null. Empty tables give no rows.
    """
    refs = references(edges, embeddings)
    return rows_of(refs, summary(reference_deltas(refs), existence_deltas(nodes), deletion_deltas(deletions)))


def rows_of(refs: DataFrame, keys: DataFrame) -> DataFrame:
    """The orphan rows of ``refs`` (all references) by the ``keys`` of a state's summary."""
    c = F.col
    late = (c("exist") > 0) & ~c("null_created") & (c("created") > c("first_ref"))
    suspects = keys.filter((c("refs") > 0) & ((c("exist") <= 0) | late)).select(
        "node_id", "refs", F.when(c("exist") > 0, "late").when(c("gone") > 0, "deleted").otherwise("missing").alias("orphan_kind"), F.when(c("exist") > 0, c("created")).alias("created")
    )
    suspects = cut(suspects)
    total = suspects.agg(F.sum("refs")).first()[0] or 0
    found = hot_cold_join(refs, suspects, "node_id", "refs", max(10_000, total // HOT_PARTS))
    t = F.when(~F.isnan("at"), c("at"))
    return found.filter((c("orphan_kind") != "late") | (c("created") > t)).select(
        "table_name", "ref_field", "row_id", F.coalesce(F.floor(t / PERIOD_S), F.lit(-1)).cast("long").alias("period_no"), "orphan_kind"
    )


def orphan_report(rows: DataFrame) -> DataFrame:
    """Orphan references per table, field, period and kind."""
    return rows.groupBy("table_name", "ref_field", "period_no", "orphan_kind").agg(F.count("*").alias("n_refs"))
