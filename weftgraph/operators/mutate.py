"""Changes to a graph in batches: nodes, vectors, removals, increments, and the merging of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftgraph.operators.graph import clamp, new_ids
from weftgraph.params import NODE_TYPES

c = F.col


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """node_id, label, node_type, activation, error_code of every id of ``new``: null if it is added, else why not.

    E003: no label or one over 256 characters; E004: an unknown type; E001: the id is there already. Of several rows of an id the smallest counts; activation is put within [0.01, 1].
    """
    one = new.filter(c("node_id").isNotNull()).groupBy("node_id").agg(F.min(F.struct("label", "node_type", "activation")).alias("r")).select("node_id", "r.*")
    j = one.join(nodes.select("node_id", F.lit(True).alias("there")), "node_id", "left")
    why = F.when(c("label").isNull() | (F.length("label") > 256), "E003").when(c("node_type").isNull() | ~c("node_type").isin(*NODE_TYPES), "E004").when(c("there"), "E001")
    return j.select("node_id", "label", "node_type", clamp(F.coalesce("activation", F.lit(0.5)), 0.01, 1.0).alias("activation"), why.alias("error_code"))


def update_vectors(vectors: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors (node_id, v) with changes put over them, and the changes of nodes that have none, with error E001."""
    new = changes.select("node_id", c("v").alias("__v"))
    updated = vectors.join(new, "node_id", "left").select("node_id", F.coalesce("__v", "v").alias("v"), c("__v").isNotNull().alias("changed"))
    return updated, changes.join(vectors.select("node_id"), "node_id", "left_anti").select("node_id", F.lit("E001").alias("error_code"))


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the ids of ``gone`` (node_id) and what touches them."""
    ids = gone.select("node_id").distinct()
    left = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_anti").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_anti")
    return nodes.join(ids, "node_id", "left_anti"), left.select(*edges.columns)


def remove_edges(edges: DataFrame, keys: DataFrame) -> DataFrame:
    return edges.join(keys.select("src", "dst", "relation"), ["src", "dst", "relation"], "left_anti").select(*edges.columns)


def append_triples(nodes: DataFrame, triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New nodes (label, node_id) and appended edges (src, dst, relation) of triples (s, rel, o): ends are matched by label, new labels are numbered after the largest id, loops left out, repeated edges kept."""
    fresh = new_ids(triples.select(F.explode(F.array("s", "o")).alias("label")), nodes.select("node_id", "label"))
    known = nodes.filter("label is not null").groupBy("label").agg(F.min("node_id").alias("node_id")).unionByName(fresh)
    j = triples.join(known.select(c("label").alias("s"), c("node_id").alias("src")), "s").join(known.select(c("label").alias("o"), c("node_id").alias("dst")), "o")
    return fresh, j.filter("src <> dst").select("src", "dst", c("rel").alias("relation"))


def merge_labelled(*graphs: DataFrame) -> DataFrame:
    """s, rel, o, strength, confidence, frequency, n_graphs: edges of several graphs by the labels of their ends, equal ones merged with their largest weights; loops left out."""
    rows = None
    for i, g in enumerate(graphs):
        x = g.select("s", "rel", "o", "strength", "confidence", "frequency", F.lit(i).alias("graph"))
        rows = x if rows is None else rows.unionByName(x)
    rows = rows.filter("s <> '' and o <> '' and rel <> '' and s <> o")
    return rows.groupBy("s", "rel", "o").agg(F.least(F.lit(1.0), F.max("strength")).alias("strength"), F.max("confidence").alias("confidence"), F.sum("frequency").alias("frequency"), F.countDistinct("graph").alias("n_graphs"))


def newest(df: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The last ``most`` rows of each key, as a buffer of that size keeps them."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(c("__rn") <= most).drop("__rn")
