"""Queries of the general problems, with the SQL that defines their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftgraph.operators import orphans, skew
from weftgraph.session import cut, table


def p2_key_profile(spark: SparkSession, sf: str) -> DataFrame:
    rows = skew.both_ends(table(spark, sf, "edges").select("source", "target", "edge_id", "strength"), "edge_id", "strength")
    p = skew.balanced_profile(rows, ["ref_field", "node_id"], "edge_id", "strength")
    return p.select("ref_field", "node_id", F.col("n").alias("n_rows"), "n_value", F.round("sum_value", 4).alias("sum_value"), "min_value", "max_value", F.col("first_order").alias("first_edge"), F.col("last_order").alias("last_edge"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "edges").select("source", "target", "edge_id", "strength")
    p = skew.balanced_profile(skew.both_ends(edges, "edge_id", "strength"), ["ref_field", "node_id"], "edge_id", "strength")
    return skew.heavy_keys(p, edges.count()).select("ref_field", "node_id")


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_rows(*[table(spark, sf, t) for t in ("edges", "node_embeddings", "nodes", "node_deletions")])


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, sf))


def p3_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The orphan rows from a state that was saved before half of the edges came and is kept by deltas since: what is put in wrongly in between is taken back."""
    edges, emb, nodes, deletions = (table(spark, sf, t) for t in ("edges", "node_embeddings", "nodes", "node_deletions"))
    middle = edges.agg(F.expr("percentile_approx(ingested_at, 0.5)")).first()[0]
    early = F.coalesce(F.col("ingested_at") <= F.lit(middle), F.lit(True)) if middle is not None else F.lit(True)
    first = orphans.apply_deltas(orphans.reference_deltas(orphans.references(edges.filter(early), emb)), orphans.existence_deltas(nodes), orphans.deletion_deltas(deletions))
    state = cut(first)
    # a batch: the later edges, and deleted nodes as if they had come back; then that is found wrong
    again = deletions.select("node_id", F.lit(0.0).alias("create_time"))
    state = cut(orphans.apply_deltas(state, orphans.reference_deltas(orphans.references(edges.filter(~early), emb.limit(0))), orphans.existence_deltas(again)))
    state = cut(orphans.apply_deltas(state, orphans.existence_deltas(again, -1)))
    return orphans.rows_of(orphans.references(edges, emb), orphans.summary(state))


QUERIES = {"p3_incremental": p3_incremental, "p2_found": p2_found, "p2_key_profile": p2_key_profile, "p3_found": _orphans, "p3_report": p3_report}

_P3 = """
WITH r AS (SELECT 'edges' AS table_name, 'source' AS ref_field, edge_id AS row_id, source AS node_id, last_used AS t FROM edges
 UNION ALL SELECT 'edges', 'target', edge_id, target, last_used FROM edges
 UNION ALL SELECT 'node_embeddings', 'node_id', emb_id, node_id, saved_at FROM node_embeddings),
n AS (SELECT node_id, min(create_time) AS created, bool_or(create_time IS NULL) AS ever FROM nodes GROUP BY 1),
d AS (SELECT DISTINCT node_id FROM node_deletions),
j AS (SELECT r.table_name, r.ref_field, r.row_id, CAST(coalesce(floor(r.t / 2592000), -1) AS BIGINT) AS period_no,
 CASE WHEN n.node_id IS NULL AND d.node_id IS NOT NULL THEN 'deleted' WHEN n.node_id IS NULL THEN 'missing' WHEN NOT n.ever AND n.created > r.t THEN 'late' END AS orphan_kind
 FROM r LEFT JOIN n ON r.node_id = n.node_id LEFT JOIN d ON r.node_id = d.node_id WHERE r.node_id IS NOT NULL),
f AS (SELECT * FROM j WHERE orphan_kind IS NOT NULL)
"""
_P2 = "WITH r AS (SELECT 'source' AS ref_field, source AS node_id, edge_id, strength FROM edges UNION ALL SELECT 'target', target, edge_id, strength FROM edges)"
SQL = {
    "p2_found": _P2 + " SELECT ref_field, node_id FROM r WHERE node_id IS NOT NULL GROUP BY ALL HAVING count(*) >= 0.02 * (SELECT count(*) FROM edges)",
    "p2_key_profile": _P2 + """, v AS (SELECT ref_field, node_id, edge_id, CASE WHEN isfinite(strength) THEN strength END AS s FROM r WHERE node_id IS NOT NULL)
 SELECT ref_field, node_id, count(*) AS n_rows, count(s) AS n_value, round(sum(s), 4) AS sum_value, min(s) AS min_value, max(s) AS max_value, min(edge_id) AS first_edge, max(edge_id) AS last_edge FROM v GROUP BY 1, 2""",
    "p3_found": _P3 + "SELECT * FROM f",
    "p3_incremental": _P3 + "SELECT * FROM f",
    "p3_report": _P3 + "SELECT table_name, ref_field, period_no, orphan_kind, count(*) AS n_refs FROM f GROUP BY 1, 2, 3, 4",
}
