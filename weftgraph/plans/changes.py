"""Queries of changes to the graph, of buffers and samples, and of capped scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from weftgraph.operators import graph as G, kg as T, learning as H, mutate as U, rewards as B, training as M, vectors as V
from weftgraph.operators.evolution import normal, uniform
from weftgraph.plans import learning, views as W
from weftgraph.plans.reasoning import _md5, _normal
from weftgraph.plans.views import E, L, N, S, sql
from weftgraph.session import cut, table

c = F.col


def node_additions(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of the node table put into a graph that has the more active half already: added or why not."""
    r = U.add_nodes(W.nodes(spark, sf).filter("activation >= 0.5"), table(spark, sf, "nodes"))
    return r.select("node_id", F.round("activation", 6).alias("activation"), "error_code")


def _latest(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "node_embeddings").filter("node_id is not null").select("node_id", "saved_at", "emb_id", F.coalesce("vector", "embedding").alias("v"))
    return e.groupBy("node_id").agg(F.max_by("v", F.struct(F.coalesce("saved_at", F.lit(-1.0)), "emb_id")).alias("v"))


def vector_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of nodes replaced by those of the same number in another table, and the numbers that are no nodes."""
    new = W.vectors(spark, sf).select(c("node").alias("node_id"), c("v"))
    updated, missing = U.update_vectors(_latest(spark, sf), new)
    return updated.filter("changed").select("node_id", F.lit("updated").alias("outcome")).unionByName(missing.select("node_id", c("error_code").alias("outcome")))


def deleted_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of nodes and edges without the deleted nodes, by node type and relation."""
    n, e = U.remove_nodes(W.nodes(spark, sf), W.edges(spark, sf), table(spark, sf, "node_deletions").filter("node_id is not null"))
    a = n.groupBy(F.lower("node_type").alias("name")).agg(F.lit("nodes").alias("kind"), F.count("*").alias("n"))
    return a.unionByName(e.groupBy(c("relation").alias("name")).agg(F.lit("edges").alias("kind"), F.count("*").alias("n")))


def removed_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges left without those of low confidence, removed by key."""
    e = W.edges(spark, sf)
    return U.remove_edges(e, e.filter("confidence < 0.4")).groupBy("relation").agg(F.count("*").alias("n"))


def _named(spark: SparkSession, sf: str) -> DataFrame:
    return T.once(table(spark, sf, "kg_build_results")).select(c("source").alias("s"), "rel", c("target").alias("o"), "doc_index")


def incremental_build(spark: SparkSession, sf: str) -> DataFrame:
    """Edges appended for the triples: known labels keep their ids, others get the next ones."""
    n = table(spark, sf, "nodes").filter("node_id is not null").select("node_id", "label").distinct()
    _, e = U.append_triples(n, _named(spark, sf))
    return e.groupBy("src", "dst", "relation").agg(F.count("*").alias("n"))


def chunk_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Graphs built from four chunks of documents, each scored alone, merged by label."""
    t = T.once(table(spark, sf, "kg_build_results"))
    chunks = [T.scored_edges(t.filter(F.coalesce(F.pmod("doc_index", F.lit(4)), F.lit(0)) == i), 0.0).withColumnRenamed("freq", "frequency") for i in range(4)]
    return U.merge_labelled(*chunks).select("s", "rel", "o", F.round("strength", 6).alias("strength"), "confidence", "frequency", "n_graphs")


def merge_two_graphs(spark: SparkSession, sf: str) -> DataFrame:
    """The stored graph and the one of the triples, merged by normalised labels and relations."""
    a = G.labelled_edges(W.edges(spark, sf), W.nodes(spark, sf).filter("label is not null"))
    a = a.select(T.normalize_label(c("src_label")).alias("s"), F.replace(F.lower("relation"), F.lit("_"), F.lit(" ")).alias("rel"), T.normalize_label(c("dst_label")).alias("o"), "strength", "confidence", "frequency")
    b = T.scored_edges(T.once(table(spark, sf, "kg_build_results")), 0.0).select("s", F.replace("rel", F.lit("_"), F.lit(" ")).alias("rel"), "o", "strength", "confidence", c("freq").alias("frequency"))
    m = U.merge_labelled(a, b)
    return m.groupBy("rel").agg(F.count("*").alias("n"), F.count_if(c("n_graphs") == 2).alias("n_shared"), F.round(F.sum("strength"), 3).alias("strength"), F.sum("frequency").alias("frequency"))


def near_duplicate_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Edges after near duplicates of vectors have become one node, chains closed."""
    from weftgraph.plans.reasoning import near_dup_components

    return G.remap(W.edges(spark, sf), cut(near_dup_components(spark, sf))).select("src", "dst", "relation", F.round("strength", 6).alias("strength"), F.round("confidence", 6).alias("confidence"), "frequency")


def embedding_extremes(spark: SparkSession, sf: str) -> DataFrame:
    """The largest and the smallest cosine between two different vectors."""
    return V.cosine_extremes(W.vectors(spark, sf), 64).select(F.round("largest", 6).alias("largest"), F.round("smallest", 6).alias("smallest"))


def node_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The hubs' nodes by id, with how often they have been asked for: edges that name them."""
    d = G.top_hubs(W.edges(spark, sf), 50).withColumnRenamed("node", "node_id")
    return d.join(W.nodes(spark, sf), "node_id", "left").select("node_id", "label", "node_type", c("degree").alias("use_count"))


def edge_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """Edges looked up by the keys of the triples whose ends are nodes."""
    from weftgraph.plans.building import dataset_edges

    e = W.edges(spark, sf)
    keys = dataset_edges(spark, sf).select("src", "dst", "relation").unionByName(e.filter("strength >= 0.99").select("src", "dst", "relation"))
    return keys.join(e, ["src", "dst", "relation"]).select("src", "dst", "relation", "strength", "confidence", "frequency")


def capped_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Capped scan: the first two hundred distinct pairs of each relation, with dense ids of their names."""
    t = T.once(table(spark, sf, "kg_build_results")).select("rel", "s", "o").distinct()
    w = Window.partitionBy("rel").orderBy("s", "o")
    t = t.withColumn("place", F.row_number().over(w)).filter("place <= 200")
    ids = G.numbered(t.select(F.explode(F.array("s", "o")).alias("label")).distinct(), ["label"], 0, "id")
    return t.join(ids.select(c("label").alias("s"), c("id").alias("src")), "s").join(ids.select(c("label").alias("o"), c("id").alias("dst")), "o").select("rel", c("place").cast("long").alias("place"), "src", "dst")


def two_hop_list(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred two-step walks by their nodes: only the first pairs that go on are joined."""
    e = W.edges(spark, sf).select("src", "dst").distinct()
    first = e.join(e.select(c("src").alias("dst")).distinct(), "dst", "left_semi").orderBy("src", "dst").limit(100)
    return first.join(e.select(c("src").alias("dst"), c("dst").alias("end")), "dst").select("src", c("dst").alias("mid"), "end").orderBy("src", "mid", "end").limit(100)


def degree_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Of the first 150 nodes by id the fifty with the most neighbours."""
    ids = W.nodes(spark, sf).select(c("node_id").alias("node")).orderBy("node").limit(150)
    n = G.adjacency(W.edges(spark, sf)).join(F.broadcast(ids), "node").groupBy("node").agg(F.countDistinct("other").alias("n_others"))
    return ids.join(n, "node", "left").select("node", F.coalesce("n_others", F.lit(0)).alias("n_others")).orderBy(c("n_others").desc(), "node").limit(50)


def recent_rewards(spark: SparkSession, sf: str) -> DataFrame:
    """Each kind's last five hundred rewards, as a bounded buffer keeps them."""
    r = U.newest(W.log(spark, sf), ["item"], [c("ts").desc(), c("event_id").desc()], 500)
    return r.groupBy("item").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.round(F.sum("reward"), 4).alias("total"))


def replay_buffer(spark: SparkSession, sf: str) -> DataFrame:
    """A thousand past edges, as random replacement would keep them: those of the smallest hash."""
    e = W.edges(spark, sf).select("src", "dst", "relation", uniform(F.lit("replay"), c("src"), c("dst"), c("relation")).alias("u"))
    return e.orderBy("u", "src", "dst", "relation").limit(1000).select("src", "dst", "relation")


def replay_update(spark: SparkSession, sf: str) -> DataFrame:
    """Thirty-two of the past experiences lived through again: a small reward for each."""
    e = W.edges(spark, sf)
    kept = e.select("src", "dst", "relation", uniform(F.lit("again"), c("src"), c("dst"), c("relation")).alias("u")).orderBy("u", "src", "dst", "relation").limit(32)
    h = H.hebbian(e, kept.select("src", "dst", "relation", F.lit(1.0).alias("eligibility")), F.lit(0.5), 0.5, 0.5)
    return h.select("src", "dst", "relation", F.round("strength", 6).alias("strength"), F.round("confidence", 6).alias("confidence"))


def augmented_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Training edges of some confidence, each also with a tenth of noise on its weights."""
    e = W.edges(spark, sf).filter("confidence > 0.3")
    noise = lambda k: 0.9 + 0.2 * uniform(F.lit(k), c("src"), c("dst"), c("relation"))
    x = e.select("relation", "strength", "confidence").unionByName(e.select("relation", G.clamp(c("strength") * noise("s"), 0.0, 1.0).alias("strength"), G.clamp(c("confidence") * noise("c"), 0.0, 1.0).alias("confidence")))
    return x.groupBy("relation").agg(F.count("*").alias("n"), F.round(F.sum("strength"), 4).alias("strength"), F.round(F.sum("confidence"), 4).alias("confidence"))


def sampled_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Five hundred random edges as training rows: features of both ends and the relation's intent."""
    e = W.edges(spark, sf).withColumn("u", uniform(F.lit("rows"), c("src"), c("dst"), c("relation"))).orderBy("u", "src", "dst", "relation").limit(500)
    a = W.nodes(spark, sf).select("node_id", "activation")
    j = e.join(a.select(c("node_id").alias("src"), c("activation").alias("x")), "src", "left").join(a.select(c("node_id").alias("dst"), c("activation").alias("y")), "dst", "left")
    return j.select("src", "dst", "relation", F.coalesce("x", F.lit(0.01)).alias("act_src"), F.coalesce("y", F.lit(0.01)).alias("act_dst"), "strength", "confidence", M.intent_of(c("relation")).alias("intent"))


def due_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """The tasks that each day's events let fall due."""
    d = W.log(spark, sf).groupBy(F.to_date("ts").alias("key")).agg(F.count("*").alias("n"))
    w = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)  # over one row a day
    d = d.select("key", F.sum("n").over(w).alias("after"), (F.sum("n").over(w) - c("n")).alias("before"))
    return B.due_tasks(d).select(c("key").cast("string").alias("day"), "task", "times")


def readout(spark: SparkSession, sf: str) -> DataFrame:
    """Each query's activations as eight numbers: a fixed random projection, squashed."""
    act = W.seeds(spark, sf).select("query_id", "node", F.lit(1.0).alias("activation"))
    x = act.select("query_id", "activation", "node", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    return x.groupBy("query_id", "i").agg(F.round(F.tanh(F.sum(c("activation") * normal(F.lit("readout"), c("node"), c("i")))), 6).alias("value"))


def edge_stamps(spark: SparkSession, sf: str) -> DataFrame:
    """When each relation was last used, as a UTC stamp."""
    g = W.edges(spark, sf).groupBy("relation").agg(F.max("last_used").alias("t"))
    return g.select("relation", F.date_format(F.timestamp_seconds(F.floor("t")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"))


def time_factors(spark: SparkSession, sf: str) -> DataFrame:
    """What learning leaves of each user's events by their distance from its last one."""
    l = W.log(spark, sf)
    at = F.unix_micros(c("ts").cast("timestamp"))
    last = F.max(at).over(Window.partitionBy("context"))
    x = l.select("context", B.time_factor((last - at) / 1e6).alias("f"))
    return x.groupBy("context").agg(F.round(F.sum("f"), 5).alias("factor"))


QUERIES = {f.__name__: f for f in (
    node_additions, vector_updates, deleted_nodes, removed_edges, incremental_build, chunk_merge, merge_two_graphs, near_duplicate_merge, embedding_extremes, node_lookup, edge_by_key, capped_pairs, two_hop_list, degree_sample,
    recent_rewards, replay_buffer, replay_update, augmented_edges, sampled_rows, due_tasks, readout, edge_stamps, time_factors,
)}
_TYPES = "'Concept', 'Entity', 'TemporalAnchor', 'LinguisticToken', 'ContextLabel', 'Pattern'"
_DEL = "SELECT node_id FROM node_deletions WHERE node_id IS NOT NULL"
_T, _F, _G, _norm = learning._T, learning._F, learning._G, learning._norm
_NM = "nm AS (SELECT source AS s, rel, target AS o FROM (SELECT DISTINCT triple_id, source, target FROM kg_build_results) JOIN u USING (triple_id))"
_U = lambda tag: _md5(f"'{tag}'", "src", "dst", "relation")
_K = "CASE first_level WHEN 'svo' THEN 0.95 WHEN 'prep' THEN 0.75 WHEN 'conj' THEN 0.45 ELSE 0.5 END"
SQL = {
    "node_additions": sql(N, "m AS (SELECT DISTINCT ON (node_id) node_id, label, node_type, activation FROM nodes WHERE node_id IS NOT NULL ORDER BY node_id, label NULLS FIRST, node_type NULLS FIRST, activation NULLS FIRST)",
        f"SELECT node_id, round(least(greatest(coalesce(m.activation, 0.5), 0.01), 1.0), 6) AS activation, CASE WHEN m.label IS NULL OR length(m.label) > 256 THEN 'E003' WHEN m.node_type IS NULL OR m.node_type NOT IN ({_TYPES}) THEN 'E004' WHEN n.activation >= 0.5 THEN 'E001' END AS error_code FROM m JOIN n USING (node_id)"),
    "vector_updates": "WITH k AS (SELECT DISTINCT node_id FROM node_embeddings WHERE node_id IS NOT NULL) SELECT vec_id AS node_id, CASE WHEN k.node_id IS NULL THEN 'E001' ELSE 'updated' END AS outcome FROM embeddings LEFT JOIN k ON vec_id = k.node_id",
    "deleted_nodes": sql(E, N, f"SELECT lower(node_type) AS name, 'nodes' AS kind, count(*) AS n FROM n WHERE node_id NOT IN ({_DEL}) GROUP BY 1 UNION ALL SELECT relation, 'edges', count(*) FROM e WHERE src NOT IN ({_DEL}) AND dst NOT IN ({_DEL}) GROUP BY 1"),
    "removed_edges": sql(E, "SELECT relation, count(*) AS n FROM e WHERE NOT confidence < 0.4 GROUP BY 1"),
    "incremental_build": sql(_T, _NM, "k AS (SELECT label, min(node_id) AS id FROM nodes WHERE node_id IS NOT NULL AND label IS NOT NULL GROUP BY 1)", "f AS (SELECT label, (SELECT max(node_id) FROM nodes) + row_number() OVER (ORDER BY label) AS id FROM (SELECT s AS label FROM nm UNION SELECT o FROM nm) WHERE label NOT IN (SELECT label FROM k))",
        "a AS (SELECT * FROM k UNION ALL SELECT * FROM f)", "SELECT x.id AS src, y.id AS dst, rel AS relation, count(*) AS n FROM nm JOIN a x ON s = x.label JOIN a y ON o = y.label WHERE x.id <> y.id GROUP BY 1, 2, 3"),
    "chunk_merge": sql(_T, f"f AS (SELECT coalesce(((doc_index % 4) + 4) % 4, 0) AS ch, s, rel, o, count(*) AS freq, arg_min(pattern_level, triple_id) AS first_level FROM u GROUP BY 1, 2, 3, 4)", f"g AS (SELECT *, least(1.0, freq / 5.0) AS strength, round((0.5 * {_K} + 0.3 * 0.6 + 0.2 * (1 - 1 / (freq + 1))) * 1.0, 4) AS confidence FROM f)",
        "SELECT s, rel, o, round(max(strength), 6) AS strength, max(confidence) AS confidence, CAST(sum(freq) AS BIGINT) AS frequency, count(DISTINCT ch) AS n_graphs FROM g GROUP BY 1, 2, 3"),
    "merge_two_graphs": sql(E, N, _T, _F, _G, f"m AS (SELECT 0 AS g, {_norm('x.label')} AS s, replace(lower(relation), '_', ' ') AS rel, {_norm('y.label')} AS o, strength, confidence, frequency FROM e JOIN n x ON src = x.node_id JOIN n y ON dst = y.node_id WHERE x.label IS NOT NULL AND y.label IS NOT NULL UNION ALL SELECT 1, s, replace(rel, '_', ' '), o, strength, confidence, freq FROM g)",
        "k AS (SELECT s, rel, o, least(1.0, max(strength)) AS st, sum(frequency) AS fr, count(DISTINCT g) AS ng FROM m WHERE s <> '' AND o <> '' AND rel <> '' AND s <> o GROUP BY 1, 2, 3)", "SELECT rel, count(*) AS n, count(*) FILTER (ng = 2) AS n_shared, round(sum(st), 3) AS strength, CAST(sum(fr) AS BIGINT) AS frequency FROM k GROUP BY 1"),
    "embedding_extremes": sql(W.V, "SELECT round(max(list_cosine_similarity(a.v, b.v)), 6) AS largest, round(min(list_cosine_similarity(a.v, b.v)), 6) AS smallest FROM v a JOIN v b ON a.node < b.node"),
    "near_duplicate_merge": sql("RECURSIVE " + E, W.V, "np AS (SELECT a.node AS a, b.node AS b FROM v a JOIN v b ON a.node < b.node AND list_cosine_similarity(a.v, b.v) >= 0.4)", "b AS (SELECT a AS u, b AS w FROM np UNION ALL SELECT b, a FROM np)",
        "r AS (SELECT u AS node, u AS root FROM b UNION SELECT b.w, r.root FROM r JOIN b ON r.node = b.u WHERE b.w > r.root)", "m AS (SELECT node, min(root) AS component FROM r GROUP BY 1)",
        "x AS (SELECT coalesce(p.component, src) AS src, coalesce(q.component, dst) AS dst, relation, strength, confidence, p.node IS NOT NULL OR q.node IS NOT NULL AS moved FROM e LEFT JOIN m p ON src = p.node LEFT JOIN m q ON dst = q.node)",
        "SELECT src, dst, relation, round(least(1.0, max(strength)), 6) AS strength, round(max(confidence), 6) AS confidence, count(*) AS frequency FROM x WHERE src <> dst OR NOT moved GROUP BY 1, 2, 3"),
    "node_lookup": sql(E, N, "d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1 ORDER BY degree DESC, node LIMIT 50)", "SELECT node AS node_id, label, node_type, degree AS use_count FROM d LEFT JOIN n ON node = node_id"),
    "edge_by_key": sql(E, "SELECT src, dst, relation, strength, confidence, frequency FROM e WHERE strength >= 0.99"),
    "capped_pairs": sql(_T, "p AS (SELECT rel, s, o, row_number() OVER (PARTITION BY rel ORDER BY s, o) AS place FROM (SELECT DISTINCT rel, s, o FROM u) QUALIFY place <= 200)", "i AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS id FROM (SELECT s AS label FROM p UNION SELECT o FROM p))",
        "SELECT rel, place, x.id AS src, y.id AS dst FROM p JOIN i x ON s = x.label JOIN i y ON o = y.label"),
    "two_hop_list": sql(E, "d AS (SELECT DISTINCT src, dst FROM e)", "f AS (SELECT src, dst FROM d WHERE dst IN (SELECT src FROM d) ORDER BY 1, 2 LIMIT 100)", 'SELECT f.src, f.dst AS mid, d.dst AS "end" FROM f JOIN d ON f.dst = d.src ORDER BY 1, 2, 3 LIMIT 100'),
    "degree_sample": sql(E, N, W.A, "i AS (SELECT node_id AS node FROM n ORDER BY 1 LIMIT 150)", "SELECT i.node, count(DISTINCT other) AS n_others FROM i LEFT JOIN a USING (node) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50"),
    "recent_rewards": sql(L, "r AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY item ORDER BY ts DESC, event_id DESC) <= 500)", "SELECT item, count(*) AS n, min(event_id) AS first_event, round(sum(reward), 4) AS total FROM r GROUP BY 1"),
    "replay_buffer": sql(E, f"SELECT src, dst, relation FROM e ORDER BY {_U('replay')}, src, dst, relation LIMIT 1000"),
    "replay_update": sql(E, f"k AS (SELECT * FROM e ORDER BY {_U('again')}, src, dst, relation LIMIT 32)", "SELECT src, dst, relation, round(least(greatest(strength + 0.05 * 0.375, 0), 1), 6) AS strength, round(least(greatest(confidence + 0.02 * 0.375 * 0.75, 0), 1), 6) AS confidence FROM k"),
    "augmented_edges": sql(E, f"x AS (SELECT relation, strength, confidence FROM e WHERE confidence > 0.3 UNION ALL SELECT relation, least(greatest(strength * (0.9 + 0.2 * {_U('s')}), 0), 1), least(greatest(confidence * (0.9 + 0.2 * {_U('c')}), 0), 1) FROM e WHERE confidence > 0.3)", "SELECT relation, count(*) AS n, round(sum(strength), 4) AS strength, round(sum(confidence), 4) AS confidence FROM x GROUP BY 1"),
    "sampled_rows": sql(E, N, f"k AS (SELECT * FROM e ORDER BY {_U('rows')}, src, dst, relation LIMIT 500)", "SELECT src, dst, relation, coalesce(x.activation, 0.01) AS act_src, coalesce(y.activation, 0.01) AS act_dst, strength, confidence, CASE relation " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in M.RELATION_INTENT.items()) + " ELSE 1 END AS intent FROM k LEFT JOIN n x ON src = x.node_id LEFT JOIN n y ON dst = y.node_id"),
    "due_tasks": sql(L, "d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM l GROUP BY 1)", "q AS (SELECT day, sum(n) OVER (ORDER BY day) AS b, sum(n) OVER (ORDER BY day) - n AS a FROM d)", "SELECT CAST(day AS VARCHAR) AS day, task, CAST(floor(b / every) - floor(a / every) AS BIGINT) AS times FROM q, (VALUES ('decay', 1000), ('compression', 5000), ('replay', 100), ('audit', 10000), ('save', 5000)) t(task, every) WHERE floor(b / every) > floor(a / every)"),
    "readout": sql(E, N, S, f"SELECT query_id, CAST(i AS INTEGER) AS i, round(tanh(sum({_normal(chr(39) + 'readout' + chr(39), 'node', 'i')})), 6) AS value FROM s, range(8) r(i) GROUP BY 1, 2"),
    "edge_stamps": sql(E, "SELECT relation, strftime(make_timestamp(CAST(floor(max(last_used)) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM e GROUP BY 1"),
    "time_factors": sql(L, "x AS (SELECT context, (max(epoch_us(ts)) OVER (PARTITION BY context) - epoch_us(ts)) / 1e6 AS t FROM l)", "SELECT context, round(sum(CASE WHEN t < 1e-6 THEN 1.0 ELSE 1 / (1 + 0.5 * ln(1 + t)) END), 5) AS factor FROM x GROUP BY 1"),
}
