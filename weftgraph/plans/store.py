"""Queries of the graph store: reading, statistics, changes, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftgraph import functions as X
from weftgraph.operators import graph as G
from weftgraph.plans.views import A, E, N, S, edges, nodes, seeds, sql
from weftgraph.session import table

c = F.col
_PART = ("is_a", "part_of")


def neighbors_undirected(spark: SparkSession, sf: str) -> DataFrame:
    return G.adjacency(edges(spark, sf)).join(seeds(spark, sf), "node").select("query_id", "node", "other", "relation", "strength", "confidence")


def neighbors_filtered(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf).filter(c("relation").isin(*_PART))
    return G.adjacency(e).groupBy("node").agg(F.count("*").alias("n_links"), F.countDistinct("other").alias("n_others"))


def edge_labels(spark: SparkSession, sf: str) -> DataFrame:
    e = G.labelled_edges(edges(spark, sf), nodes(spark, sf))
    return e.groupBy("src_label", "relation").agg(F.count("*").alias("n"), F.min("dst_label").alias("first_label"))


def two_hop(spark: SparkSession, sf: str) -> DataFrame:
    return G.two_hop_counts(edges(spark, sf)).select("node", "n_in", "n_out", "walks")


def hub_two_hop(spark: SparkSession, sf: str) -> DataFrame:
    return G.hub_two_hop(edges(spark, sf))


def degree_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return G.degree_summary(edges(spark, sf))


def degree_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return G.degrees(edges(spark, sf)).groupBy("degree").agg(F.count("*").alias("n_nodes"))


def top_hubs(spark: SparkSession, sf: str) -> DataFrame:
    return G.top_hubs(edges(spark, sf))


def relation_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return G.relation_distribution(edges(spark, sf))


def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    return G.graph_stats(nodes(spark, sf), edges(spark, sf), table(spark, sf, "node_embeddings"))


def dangling_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.dangling(edges(spark, sf), nodes(spark, sf)).select("src", "dst", "relation", "missing_end")


def missing_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return nodes(spark, sf).join(table(spark, sf, "node_embeddings").select("node_id"), "node_id", "left_anti").select("node_id")


def induced_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    return G.inside(edges(spark, sf), nodes(spark, sf).filter("activation >= 0.5")).select("src", "dst", "relation")


def prune_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return G.prune(nodes(spark, sf), edges(spark, sf), 0.05)[0].select("node_id", "activation")


def prune_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.prune(nodes(spark, sf), edges(spark, sf), 0.05)[1].select("src", "dst", "relation")


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    """Changes to the graph: what knowledge of low confidence would become, turned round."""
    e = edges(spark, sf).filter("confidence < 0.5")
    return e.select(c("dst").alias("src"), c("src").alias("dst"), "relation", (c("strength") / 2).alias("strength"), "confidence", F.lit(1).cast("long").alias("frequency"), "last_used").dropDuplicates(["src", "dst", "relation"])


def edge_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return G.upsert(edges(spark, sf), _changes(spark, sf)).groupBy("relation").agg(F.count("*").alias("n"), F.round(F.sum("strength"), 4).alias("strength"), F.sum("frequency").alias("frequency"))


def edge_weight_update(spark: SparkSession, sf: str) -> DataFrame:
    e = G.update_weights(edges(spark, sf), _changes(spark, sf), 2.0e9)
    return e.filter("last_used = 2.0e9").select("src", "dst", "relation", F.round("strength", 6).alias("strength"), "confidence", "frequency")


def missing_edge_updates(spark: SparkSession, sf: str) -> DataFrame:
    return G.missing_updates(edges(spark, sf), _changes(spark, sf)).select("src", "dst", "relation", "error_code")


def graph_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of one label in any letter case become the one of smallest id; their edges are merged."""
    n = nodes(spark, sf).filter("label <> ''").select("node_id", F.lower("label").alias("key"))
    keep = n.groupBy("key").agg(F.min("node_id").alias("component"), F.count("*").alias("k")).filter("k > 1")
    m = n.join(keep, "key").filter("node_id <> component").select(c("node_id").alias("node"), "component")
    return G.remap(edges(spark, sf), m).select("src", "dst", "relation", F.round("strength", 6).alias("strength"), F.round("confidence", 6).alias("confidence"), "frequency")


def label_components(spark: SparkSession, sf: str) -> DataFrame:
    """Connected components of the synonym edges."""
    e = edges(spark, sf).filter("relation = 'synonym' and strength * confidence >= 0.5 and src <> dst")
    return G.components(e.select(c("src").alias("a"), c("dst").alias("b"))).select("node", "component")


def reverse_edge_union(spark: SparkSession, sf: str) -> DataFrame:
    return G.reverse_union(edges(spark, sf)).groupBy("src").agg(F.count("*").alias("n"), F.round(F.sum("strength"), 4).alias("strength"))


def jaccard_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    return G.jaccard(e, e.filter("relation = 'synonym'").select(c("src").alias("a"), c("dst").alias("b"))).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def bfs_depth2(spark: SparkSession, sf: str) -> DataFrame:
    return G.bfs(edges(spark, sf), nodes(spark, sf), seeds(spark, sf), 2, 0.5).groupBy("query_id", "depth").agg(F.count("*").alias("n_nodes"), F.min("node").alias("first_node"))


def schema_violations(spark: SparkSession, sf: str) -> DataFrame:
    return G.violations(table(spark, sf, "nodes"), table(spark, sf, "edges"))


def new_node_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids for the names of triples that no node carries."""
    t = table(spark, sf, "kg_build_results")
    names = t.select(F.explode(F.array("source", "target")).alias("label"))
    return G.new_ids(names, table(spark, sf, "nodes").select("node_id", "label"))


def label_search(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes whose label holds 'river', with their number of edges."""
    n = nodes(spark, sf).filter(F.contains(F.lower("label"), F.lit("river")))
    d = G.degrees(edges(spark, sf)).withColumnRenamed("node", "node_id")
    return n.join(d, "node_id").select("node_id", "label", "degree")


def edge_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Edges by their written key."""
    e = edges(spark, sf)
    return e.filter("strength = 1.0 and confidence >= 0.9").select(X.edge_key(c("src"), c("dst"), c("relation")).alias("edge_key"), "frequency")


def recent_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Capped scan: the ten last used edges of each relation."""
    from pyspark.sql import Window

    w = Window.partitionBy("relation").orderBy(c("last_used").desc_nulls_last(), "src", "dst")
    return edges(spark, sf).withColumn("rank_no", F.row_number().over(w)).filter("rank_no <= 10").select("relation", c("rank_no").cast("long").alias("rank_no"), "src", "dst")


def node_labels(spark: SparkSession, sf: str) -> DataFrame:
    return nodes(spark, sf).select("node_id", F.coalesce("label", F.concat(F.lit("node_"), c("node_id").cast("string"))).alias("label"))


QUERIES = {f.__name__: f for f in (
    neighbors_undirected, neighbors_filtered, edge_labels, two_hop, hub_two_hop, degree_distribution, degree_histogram, top_hubs, relation_distribution, graph_stats, dangling_edges, missing_embeddings,
    induced_subgraph, prune_nodes, prune_edges, edge_upsert, edge_weight_update, missing_edge_updates, graph_merge, label_components, reverse_edge_union, jaccard_neighbors, bfs_depth2, schema_violations,
    new_node_ids, label_search, edge_lookup, recent_edges, node_labels,
)}
_D = "d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1)"
_U = "u AS (SELECT dst AS src, src AS dst, relation, strength / 2 AS strength, confidence, 1 AS frequency, last_used FROM e WHERE confidence < 0.5)"
SQL = {
    "neighbors_undirected": sql(E, N, S, A, "SELECT query_id, node, other, relation, strength, confidence FROM a JOIN s USING (node)"),
    "neighbors_filtered": sql(E, A, "SELECT node, count(*) AS n_links, count(DISTINCT other) AS n_others FROM a WHERE relation IN ('is_a', 'part_of') GROUP BY 1"),
    "edge_labels": sql(E, N, "SELECT x.label AS src_label, relation, count(*) AS n, min(y.label) AS first_label FROM e JOIN n x ON src = x.node_id JOIN n y ON dst = y.node_id GROUP BY 1, 2"),
    "two_hop": sql(E, "i AS (SELECT dst AS node, count(*) AS n_in FROM e GROUP BY 1)", "o AS (SELECT src AS node, count(*) AS n_out FROM e GROUP BY 1)", "SELECT node, n_in, n_out, n_in * n_out AS walks FROM i JOIN o USING (node)"),
    "hub_two_hop": sql(E, _D, "h AS (SELECT node AS hub FROM d ORDER BY degree DESC, node LIMIT 5)", "x AS (SELECT DISTINCT src, dst FROM e)",
        "m AS (SELECT hub, dst AS mid FROM h JOIN x ON hub = src QUALIFY row_number() OVER (PARTITION BY hub ORDER BY dst) <= 3)",
        "SELECT hub, mid, dst AS \"end\" FROM m JOIN x ON mid = src WHERE dst <> hub QUALIFY row_number() OVER (PARTITION BY hub, mid ORDER BY dst) <= 3 ORDER BY 1, 2, 3 LIMIT 12"),
    "degree_distribution": sql(E, _D, """SELECT max(degree) AS max_degree, round(avg(degree), 6) AS mean_degree, (list_sort(list(degree)))[count(*) // 2 + 1] AS median_degree,
 count(*) FILTER (degree = 1) AS deg_1, count(*) FILTER (degree = 2) AS deg_2, count(*) FILTER (degree > 2) AS deg_3plus FROM d"""),
    "degree_histogram": sql(E, _D, "SELECT degree, count(*) AS n_nodes FROM d GROUP BY 1"),
    "top_hubs": sql(E, _D, "SELECT node, degree FROM d ORDER BY degree DESC, node LIMIT 8"),
    "relation_distribution": sql(E, "SELECT relation, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct, CASE WHEN count(*) >= 10 THEN '10+' WHEN count(*) >= 2 THEN '2-9' ELSE '1' END AS bucket FROM e GROUP BY 1"),
    "graph_stats": sql(E, N, """SELECT nn AS n_nodes, ne AS n_edges, nr AS n_relations, nl AS self_loops, round(ne / nn, 6) AS edges_per_node, round(ne / (nn * (nn - 1) / 2), 12) AS density, round(100.0 * ni / nn, 6) AS embedded_pct
 FROM (SELECT count(*) AS nn FROM n), (SELECT count(*) AS ne, count(DISTINCT relation) AS nr, count(*) FILTER (src = dst) AS nl FROM e), (SELECT count(*) AS ni FROM n WHERE node_id IN (SELECT node_id FROM node_embeddings))"""),
    "dangling_edges": sql(E, N, """SELECT src, dst, relation, CASE WHEN x.node_id IS NULL AND y.node_id IS NULL THEN 'both' WHEN x.node_id IS NULL THEN 'src' ELSE 'dst' END AS missing_end
 FROM e LEFT JOIN n x ON src = x.node_id LEFT JOIN n y ON dst = y.node_id WHERE x.node_id IS NULL OR y.node_id IS NULL"""),
    "missing_embeddings": sql(N, "SELECT node_id FROM n WHERE node_id NOT IN (SELECT node_id FROM node_embeddings WHERE node_id IS NOT NULL)"),
    "induced_subgraph": sql(E, N, "SELECT src, dst, relation FROM e WHERE src IN (SELECT node_id FROM n WHERE activation >= 0.5) AND dst IN (SELECT node_id FROM n WHERE activation >= 0.5)"),
    "prune_nodes": sql(N, "SELECT node_id, activation FROM n WHERE activation >= 0.05 - 1e-6"),
    "prune_edges": sql(E, N, "SELECT src, dst, relation FROM e WHERE src IN (SELECT node_id FROM n WHERE activation >= 0.05 - 1e-6) AND dst IN (SELECT node_id FROM n WHERE activation >= 0.05 - 1e-6)"),
    "edge_upsert": sql(E, _U, """SELECT relation, count(*) AS n, round(sum(strength), 4) AS strength, CAST(sum(frequency) AS BIGINT) AS frequency FROM (SELECT src, dst, relation, strength, frequency FROM u
 UNION ALL SELECT src, dst, relation, strength, frequency FROM e WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.src = e.src AND u.dst = e.dst AND u.relation = e.relation)) GROUP BY 1"""),
    "edge_weight_update": sql(E, _U, "SELECT e.src, e.dst, e.relation, round(u.strength, 6) AS strength, u.confidence, e.frequency + 1 AS frequency FROM e JOIN u USING (src, dst, relation)"),
    "missing_edge_updates": sql(E, _U, "SELECT src, dst, relation, 'E002' AS error_code FROM u ANTI JOIN e USING (src, dst, relation)"),
    "graph_merge": sql(E, N, "k AS (SELECT node_id AS node, min(node_id) OVER (PARTITION BY lower(label)) AS component FROM n WHERE label <> '')", "m AS (SELECT * FROM k WHERE node <> component)",
        """r AS (SELECT coalesce(x.component, src) AS src, coalesce(y.component, dst) AS dst, relation, strength, confidence, x.node IS NOT NULL OR y.node IS NOT NULL AS moved FROM e LEFT JOIN m x ON src = x.node LEFT JOIN m y ON dst = y.node)""",
        "SELECT src, dst, relation, round(least(1.0, max(strength)), 6) AS strength, round(max(confidence), 6) AS confidence, count(*) AS frequency FROM r WHERE src <> dst OR NOT moved GROUP BY 1, 2, 3"),
    "reverse_edge_union": sql(E, """r AS (SELECT dst AS src, src AS dst, relation, strength FROM e UNION ALL SELECT src, dst, relation, strength FROM e x WHERE NOT EXISTS (SELECT 1 FROM e y WHERE y.dst = x.src AND y.src = x.dst AND y.relation = x.relation))""",
        "SELECT src, count(*) AS n, round(sum(strength), 4) AS strength FROM r GROUP BY 1"),
    "jaccard_neighbors": sql(E, A, "b AS (SELECT DISTINCT node, other FROM a WHERE confidence >= 0.5)", "p AS (SELECT DISTINCT src AS a, dst AS b FROM e WHERE relation = 'synonym')", "g AS (SELECT node, count(*) AS d FROM b GROUP BY 1)",
        "k AS (SELECT p.a, p.b, count(*) AS k FROM p JOIN b x ON p.a = x.node JOIN b y ON p.b = y.node AND x.other = y.other GROUP BY 1, 2)",
        "SELECT p.a, p.b, round(CASE WHEN coalesce(x.d, 0) + coalesce(y.d, 0) > 0 THEN coalesce(k, 0) / (coalesce(x.d, 0) + coalesce(y.d, 0) - coalesce(k, 0)) ELSE 0 END, 6) AS jaccard FROM p LEFT JOIN k ON p.a = k.a AND p.b = k.b LEFT JOIN g x ON p.a = x.node LEFT JOIN g y ON p.b = y.node"),
    "bfs_depth2": sql(E, N, S, A, "h AS (SELECT DISTINCT a.node, a.other FROM a JOIN n ON a.other = n.node_id WHERE n.activation >= 0.5)", "f AS (SELECT query_id, node FROM s JOIN n ON node = node_id WHERE activation >= 0.5)",
        "g AS (SELECT DISTINCT query_id, other AS node FROM f JOIN h USING (node) WHERE (query_id, other) NOT IN (SELECT (query_id, node) FROM f))",
        "i AS (SELECT DISTINCT query_id, other AS node FROM g JOIN h USING (node) WHERE (query_id, other) NOT IN (SELECT (query_id, node) FROM f UNION ALL SELECT (query_id, node) FROM g))",
        "SELECT query_id, depth, count(*) AS n_nodes, min(node) AS first_node FROM (SELECT *, 0 AS depth FROM f UNION ALL SELECT *, 1 FROM g UNION ALL SELECT *, 2 FROM i) GROUP BY 1, 2"),
    "schema_violations": """SELECT 'E003' AS error_code, 'label' AS field, count(*) FILTER (label IS NULL OR length(label) > 256) AS n FROM nodes
 UNION ALL SELECT 'E004', 'node_type', count(*) FILTER (node_type IS NULL OR node_type NOT IN ('Concept', 'Entity', 'TemporalAnchor', 'LinguisticToken', 'ContextLabel', 'Pattern')) FROM nodes
 UNION ALL SELECT 'E005', 'activation', count(*) FILTER (NOT activation BETWEEN 0 AND 1 OR isnan(activation)) FROM nodes
 UNION ALL SELECT 'E006', 'strength', count(*) FILTER (isnan(strength) OR NOT strength BETWEEN 0 AND 1) FROM edges UNION ALL SELECT 'E006', 'confidence', count(*) FILTER (isnan(confidence) OR NOT confidence BETWEEN 0 AND 1) FROM edges""",
    "new_node_ids": """WITH x AS (SELECT source AS label FROM kg_build_results UNION SELECT target FROM kg_build_results), y AS (SELECT label FROM x WHERE label IS NOT NULL AND label NOT IN (SELECT label FROM nodes WHERE label IS NOT NULL))
 SELECT label, (SELECT max(node_id) FROM nodes) + row_number() OVER (ORDER BY label) AS node_id FROM y""",
    "label_search": sql(E, N, _D, "SELECT node_id, label, degree FROM n JOIN d ON node_id = node WHERE contains(lower(label), 'river')"),
    "edge_lookup": sql(E, "SELECT concat_ws(':', src, dst, relation) AS edge_key, frequency FROM e WHERE strength = 1.0 AND confidence >= 0.9"),
    "recent_edges": sql(E, "SELECT relation, row_number() OVER (PARTITION BY relation ORDER BY last_used DESC NULLS LAST, src, dst) AS rank_no, src, dst FROM e QUALIFY rank_no <= 10"),
    "node_labels": sql(N, "SELECT node_id, coalesce(label, 'node_' || node_id) AS label FROM n"),
    "label_components": sql("RECURSIVE " + E, "p AS (SELECT DISTINCT greatest(src, dst) AS u, least(src, dst) AS v FROM e WHERE relation = 'synonym' AND strength * confidence >= 0.5 AND src <> dst)", "b AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p)",
        "r AS (SELECT u AS node, u AS root FROM b UNION SELECT b.v, r.root FROM r JOIN b ON r.node = b.u WHERE b.v > r.root)", "SELECT node, min(root) AS component FROM r GROUP BY 1"),
}
del SQL["label_components"]  # its recursion lists every pair of a component: too slow on whole tables; tested against brute force instead
