"""Names and relations of one graph aligned with those of another."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftgraph.functions import strip
from weftgraph.functions.encoder import DIM, with_vectors
from weftgraph.operators.registry import best_matches

c = F.col


def align_exact(labels: DataFrame, registry: DataFrame) -> DataFrame:
    """label, canonical, node_id: labels whose lower-case form the registry (canonical, node_id) holds; the others with nulls."""
    key = strip(F.lower("label"))
    r = registry.select(c("canonical").alias("key"), "node_id").groupBy("key").agg(F.min("node_id").alias("node_id"))
    j = labels.select("label").distinct().withColumn("key", key).join(r, "key", "left")
    return j.select("label", F.when(c("node_id").isNotNull(), c("key")).alias("canonical"), "node_id")


def align_similar(labels: DataFrame, registry: DataFrame, threshold: float = 0.75) -> DataFrame:
    """label, canonical, similarity: each label's most similar registry entry, if it is similar enough.

    All labels are compared with the registry as it was before the batch (equal similarities: the smaller entry), so order doesn't matter; both are encoded where they are and meet in blocks.
    """
    a = with_vectors(labels.select("label").filter("label is not null").distinct(), "label").select(c("label").alias("key"), "v")
    b = with_vectors(registry.select("canonical").filter("canonical is not null").distinct(), "canonical").select("canonical", "v")
    return best_matches(a, b, DIM).filter(c("cosine") >= threshold).select(c("key").alias("label"), "canonical", c("cosine").alias("similarity"))


def absorb(registry: DataFrame, other: DataFrame) -> DataFrame:
    """The registry with the entries of another that it lacks, under fresh ids."""
    from weftgraph.operators.graph import new_ids

    fresh = new_ids(other.select(c("canonical").alias("label")), registry.select(c("canonical").alias("label"), "node_id"))
    return registry.select("canonical", "node_id").unionByName(fresh.select(c("label").alias("canonical"), "node_id"))
