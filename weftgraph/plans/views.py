"""The tables as a graph, in Spark and as the same common table expressions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from weftgraph.operators import graph
from weftgraph.session import table

c = F.col


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.clean_nodes(table(spark, sf, "nodes"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.clean_edges(table(spark, sf, "edges"))


def seeds(spark: SparkSession, sf: str, k: int = 3, e: DataFrame | None = None) -> DataFrame:
    """One query a node type (in lower case), from its k most active nodes that have an edge (``e``: the edges, if they are at hand)."""
    linked = (edges(spark, sf) if e is None else e).select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    n = nodes(spark, sf).filter("node_type is not null").join(linked, "node_id", "left_semi")
    w = Window.partitionBy("query_id").orderBy(c("activation").desc(), "node_id")
    return n.select(F.lower("node_type").alias("query_id"), "node_id", "activation").withColumn("rn", F.row_number().over(w)).filter(c("rn") <= k).select("query_id", c("node_id").alias("node"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(c("vec_id").alias("node"), c("embedding").alias("v"), "label")


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """One query a cluster label: its first vector."""
    return vectors(spark, sf).groupBy(c("label").cast("long").alias("query_id")).agg(F.min_by("v", "node").alias("v"))


def log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as what was walked: context, item, reward, ord."""
    return table(spark, sf, "events").select(c("user_id").alias("context"), c("event_type").alias("item"), c("value").alias("reward"), F.struct("ts", "event_id").alias("ord"), "ts", "event_id")


# Common table expressions: e edges, n nodes, a adjacency, s seeds, l log, v vectors, q vector queries.
E = """e AS (SELECT source AS src, target AS dst, relation, strength, confidence, frequency, last_used FROM edges
 WHERE source IS NOT NULL AND target IS NOT NULL AND relation IS NOT NULL AND isfinite(strength) AND strength BETWEEN 0 AND 1 AND isfinite(confidence) AND confidence BETWEEN 0 AND 1
 QUALIFY row_number() OVER (PARTITION BY source, target, relation ORDER BY edge_id DESC) = 1)"""
N = """n AS (SELECT node_id, min(label) AS label, min(node_type) AS node_type, least(greatest(coalesce(min(activation), 0.5), 0.01), 1.0) AS activation FROM nodes WHERE node_id IS NOT NULL GROUP BY 1)"""
A = """a AS (SELECT src AS node, dst AS other, relation, strength, confidence FROM e UNION ALL SELECT dst, src, relation, strength, confidence FROM e WHERE src <> dst)"""
S = """s AS (SELECT lower(node_type) AS query_id, node_id AS node FROM n WHERE node_type IS NOT NULL AND node_id IN (SELECT src FROM e UNION SELECT dst FROM e)
 QUALIFY row_number() OVER (PARTITION BY lower(node_type) ORDER BY activation DESC, node_id) <= 3)"""
L = """l AS (SELECT user_id AS context, event_type AS item, value AS reward, ts, event_id FROM events)"""
V = """v AS (SELECT vec_id AS node, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"""
Q = """q AS (SELECT CAST(label AS BIGINT) AS query_id, arg_min(v, node) AS v FROM v GROUP BY 1)"""


def sql(*parts: str) -> str:
    """WITH of the parts but the last, which is the query."""
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]
