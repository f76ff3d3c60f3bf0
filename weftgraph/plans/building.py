"""Queries of extraction, alignment, analogy, patterns and small models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from weftgraph import functions as X
from weftgraph.operators import align, evolution as S, extract, fold, graph as G, learning as H, training as M, vectors as V
from weftgraph.params import RELATION_BIAS
from weftgraph.plans import reasoning, views as W
from weftgraph.plans.views import E, L, sql
from weftgraph.session import cut, table

c = F.col


def extracted_triples(spark: SparkSession, sf: str) -> DataFrame:
    """Triples found in documents by patterns, with how often they occur."""
    t = extract.triples(extract.sentences(table(spark, sf, "documents").select("doc_id", "text")))
    return t.groupBy("s", "rel", "o").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def sentence_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Triples of neighbouring sentences of a document by the same relation word."""
    t = extract.triples(extract.sentences(table(spark, sf, "documents").select("doc_id", "text")))
    w = Window.partitionBy("doc_id").orderBy("sent_idx")
    t = t.withColumn("p", F.lag("rel").over(w)).withColumn("i", F.lag("sent_idx").over(w)).filter("p = rel and sent_idx - i = 1")
    return t.groupBy("rel").agg(F.count("*").alias("n"))


def entity_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Names of triples against the node labels: exact alignment."""
    t = table(spark, sf, "kg_build_results").select(F.explode(F.array("source", "target")).alias("label")).filter("label is not null")
    n = table(spark, sf, "nodes").filter("label is not null").select(F.lower("label").alias("canonical"), "node_id")
    return align.align_exact(t, n).filter("node_id is not null").select("label", "node_id")


def relation_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Connectors of triples against the relation vocabulary, by similar spelling."""
    known = spark.createDataFrame([(r.replace("_", " "),) for r in RELATION_BIAS], "canonical string")
    t = table(spark, sf, "kg_build_results").select(F.lower("relation").alias("label"))
    return align.align_similar(t, known, 0.3).select("label", "canonical", F.round("similarity", 4).alias("similarity"))


def analogy_leaps(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes in a bucket with a seed whose neighbours overlap: the five most similar of each."""
    emb = table(spark, sf, "node_embeddings").select("node_id", "saved_at", "emb_id", F.coalesce("vector", "embedding").alias("v")).filter(F.size("v") == 64)
    v = emb.groupBy(c("node_id").alias("node")).agg(F.max_by("v", F.struct("saved_at", "emb_id")).alias("v")).filter(~F.exists("v", lambda x: F.isnan(x) | x.isNull()))
    s = cut(W.seeds(spark, sf))
    sv = F.broadcast(s.join(v, "node").select("query_id", c("node").alias("seed"), c("v").alias("sv")))
    b = V.sign_buckets(v, 64, 8, 8)
    sb = F.broadcast(b.join(F.broadcast(s), "node").select("query_id", c("node").alias("seed"), "tab", "bucket"))
    pairs = cut(b.join(sb, ["tab", "bucket"]).filter("node <> seed").select("query_id", "seed", "node").distinct())
    scored = pairs.join(v, "node").join(sv, ["query_id", "seed"]).select("query_id", "seed", "node", F.round(X.cosine(c("v"), c("sv")), 6).alias("cosine")).filter("cosine >= 0.3")
    j = G.jaccard(W.edges(spark, sf), scored.select(c("seed").alias("a"), c("node").alias("b"))).filter("jaccard > 0")
    out = scored.join(j.select(c("a").alias("seed"), c("b").alias("node"), "jaccard"), ["seed", "node"])
    w = Window.partitionBy("query_id").orderBy(c("cosine").desc(), "node")
    return out.withColumn("rank_no", F.row_number().over(w)).filter("rank_no <= 5").select("query_id", "seed", "node", "cosine", F.round("jaccard", 6).alias("jaccard"))


def dataset_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A data set of triples put into the graph: ends are matched by label in any case, weights are the defaults, and keys that are there already stay out."""
    t = table(spark, sf, "kg_build_results").select(F.lower("source").alias("s"), F.replace(F.lower("relation"), F.lit(" "), F.lit("_")).alias("relation"), F.lower("target").alias("o")).distinct()
    n = table(spark, sf, "nodes").filter("label is not null").groupBy(F.lower("label").alias("key")).agg(F.min("node_id").alias("id"))
    j = t.join(n.select(c("key").alias("s"), c("id").alias("src")), "s").join(n.select(c("key").alias("o"), c("id").alias("dst")), "o").filter("src <> dst and relation is not null")
    new = j.select("src", "dst", "relation").distinct().join(W.edges(spark, sf).select("src", "dst", "relation"), ["src", "dst", "relation"], "left_anti")
    return new.select("src", "dst", "relation", F.lit(0.9).alias("strength"), F.lit(0.8).alias("confidence"))


def reward_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Running total of each user's rewards at its last event, and its largest step up."""
    w = Window.partitionBy("context").orderBy("ts", "event_id")
    x = W.log(spark, sf).withColumn("up", c("reward") - F.lag("reward").over(w))
    return x.groupBy("context").agg(F.round(F.sum("reward"), 4).alias("total"), F.round(F.max("up"), 4).alias("largest_step"))


def replay_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Thirty-two past experiences of each kind, drawn by hash."""
    h = F.md5(F.concat_ws(":", F.lit("7"), c("event_id").cast("string")))
    w = Window.partitionBy("event_type").orderBy("h", "event_id")
    return table(spark, sf, "events").withColumn("h", h).withColumn("rn", F.row_number().over(w)).filter("rn <= 32").select("event_type", "event_id")


def reward_ema(spark: SparkSession, sf: str) -> DataFrame:
    start, step = fold.ema_z()
    d = fold.ordered_fold(W.log(spark, sf).select("context", "ts", "event_id", "reward"), "context", ["ts", "event_id"], "reward", start, step, "z", "event_id")
    return d.groupBy("context").agg(F.count("*").alias("n"), F.round(F.sum("z"), 4).alias("total"))


def intent_bias_learning(spark: SparkSession, sf: str) -> DataFrame:
    """A preference after all rewards of a kind of event."""
    start, step = fold.bias_reward(1.0)
    e = W.log(spark, sf).select("item", "ts", "event_id", (c("reward") / 100).alias("reward"))
    d = fold.ordered_fold(e, "item", ["ts", "event_id"], "reward", start, step, "bias", "event_id")
    return d.groupBy("item").agg(F.round(F.max("bias"), 6).alias("highest"), F.round(F.min("bias"), 6).alias("lowest"))


def pattern_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """A node for each frequent pair of events, with an edge to either."""
    p = G.numbered(H.coactivation(W.log(spark, sf)), [c("n").desc(), "a", "b"], 1 << 60, "pattern_id")
    ends = F.explode(F.array("a", "b")).alias("target")
    return p.select("pattern_id", ends, F.lit("associated_with").alias("relation"), F.lit(0.9).alias("strength"), F.lit(0.9).alias("confidence"))


def mean_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The mean of each cluster's quantised vectors, position by position."""
    v = W.vectors(spark, sf).select("label", F.posexplode(X.quantize(c("v"))).alias("i", "x"))
    return v.groupBy("label", "i").agg(F.round(F.avg("x"), 6).alias("mean"))


def training_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Edges as examples of intents."""
    return W.edges(spark, sf).groupBy(M.intent_of(c("relation")).alias("intent"), "relation").agg(F.count("*").alias("n"))


def intent_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """A network that tells the cluster of a vector, fitted on a bounded sample: its accuracy over all rows."""
    rows = W.vectors(spark, sf).select(c("node").alias("row_id"), c("v").alias("features"), c("label").cast("long").alias("actual"))
    sample = rows.orderBy(F.xxhash64("row_id")).limit(M.SAMPLE).collect()
    x, y = np.array([r.features for r in sample], dtype=float), np.array([r.actual for r in sample])
    model = M.fit_mlp(x, y, int(y.max()) + 1 if len(y) else 1)
    return M.top_k_accuracy(M.classify(rows, model), rows.select("row_id", "actual"))


def vector_clusters(spark: SparkSession, sf: str) -> DataFrame:
    k = M.clusters(W.vectors(spark, sf), 10)
    return k.join(W.vectors(spark, sf).select("node", "label"), "node").groupBy("cluster", "label").agg(F.count("*").alias("n"))


def es_propose(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters to try next, after each user has tried a set and its mean reward has moved their mean."""
    rewards = cut(W.log(spark, sf).groupBy(c("context").alias("trial")).agg(F.avg("reward").alias("reward")))
    theta = S.parameters(spark)
    new = cut(S.move(theta, S.propose(theta, rewards), rewards))
    tried = S.propose(new, spark.range(4).withColumnRenamed("id", "trial"), S.next_sigma(S.SIGMA), 1)
    return tried.select(c("trial").alias("proposal"), "dim", F.round("value", 6).alias("value"))


def question_links(spark: SparkSession, sf: str) -> DataFrame:
    """The node that a question names: by a common word of six letters or more, the longest label that the question holds, then the smallest id."""
    words = lambda x: F.filter(F.split(F.lower(x), r"[^a-z]+"), lambda t: F.length(t) >= 6)
    q = table(spark, sf, "benchmark").filter("item_kind = 'question'").select("item_id", F.lower("text").alias("text"), F.explode(F.array_distinct(words("text"))).alias("t"))
    n = W.nodes(spark, sf).filter("label is not null").select("node_id", F.lower("label").alias("label"), F.explode(F.array_distinct(words("label"))).alias("t"))
    j = q.join(n, "t").select("item_id", "node_id", F.length("label").alias("size"), F.contains("text", "label").alias("whole")).distinct()
    w = Window.partitionBy("item_id").orderBy(c("whole").desc(), c("size").desc(), "node_id")
    return j.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("item_id", "node_id", "whole")


QUERIES = {f.__name__: f for f in (
    extracted_triples, sentence_chain, entity_alignment, relation_alignment, analogy_leaps, dataset_edges, reward_totals, replay_sample, reward_ema, intent_bias_learning, pattern_nodes, mean_vectors, training_rows, intent_classifier, vector_clusters, es_propose, question_links,
)}
_SP = r"[\t\n\x0B\f\r\x1c-\x1f\x85\p{Z}]+"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SP}|{_SP}$', '', 'g')"


_SENT = rf"""sp AS (SELECT doc_id, string_split_regex(text, '[.!?\n]+') AS p FROM documents WHERE text IS NOT NULL), se AS (SELECT doc_id, unnest(range(0, len(p))) AS sent_idx, unnest(p) AS s0 FROM sp), st AS (SELECT doc_id, sent_idx, {_strip('s0')} AS x FROM se)"""
_ONCE = " ".join(f"WHEN len(string_split(x, '{p}')) = 2" + (" AND NOT starts_with(string_split(x, ' is ')[2], 'the ')" if p == " is " else "") + f" THEN {{'s': string_split(x, '{p}')[1], 'rel': '{extract._relation(p)}', 'o': string_split(x, '{p}')[2]}}" for p in extract.ONCE)
_VERB = " ".join(f"WHEN contains(x, ' {v} ') THEN {{'s': substr(x, 1, instr(x, ' {v} ') - 1), 'rel': '{v}', 'o': substr(x, instr(x, ' {v} ') + {len(v) + 2})}}" for v in extract.VERBS)
_TR = f"tr AS (SELECT doc_id, sent_idx, CASE {_ONCE} {_VERB} END AS t FROM st WHERE x <> ''), tt AS (SELECT doc_id, sent_idx, {_strip('lower(t.s)')} AS s, t.rel AS rel, {_strip('lower(t.o)')} AS o FROM tr WHERE t IS NOT NULL), tu AS (SELECT * FROM tt WHERE s <> '' AND o <> '' AND s <> o)"
SQL = {
    "extracted_triples": sql(_SENT, _TR, "SELECT s, rel, o, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM tu GROUP BY 1, 2, 3"),
    "sentence_chain": sql(_SENT, _TR, "q AS (SELECT rel, sent_idx, lag(rel) OVER w AS p, lag(sent_idx) OVER w AS i FROM tu WINDOW w AS (PARTITION BY doc_id ORDER BY sent_idx))", "SELECT rel, count(*) AS n FROM q WHERE p = rel AND sent_idx - i = 1 GROUP BY 1"),
    "entity_alignment": f"WITH r AS (SELECT lower(label) AS k, min(node_id) AS node_id FROM nodes WHERE label IS NOT NULL GROUP BY 1), l AS (SELECT source AS label FROM kg_build_results UNION SELECT target FROM kg_build_results) SELECT label, node_id FROM l JOIN r ON {_strip('lower(label)')} = k",
    "dataset_edges": sql(E, "t AS (SELECT DISTINCT lower(source) AS s, replace(lower(relation), ' ', '_') AS relation, lower(target) AS o FROM kg_build_results)", "k AS (SELECT lower(label) AS k, min(node_id) AS id FROM nodes WHERE label IS NOT NULL GROUP BY 1)",
        "j AS (SELECT DISTINCT x.id AS src, y.id AS dst, relation FROM t JOIN k x ON s = x.k JOIN k y ON o = y.k WHERE x.id <> y.id AND relation IS NOT NULL)", "SELECT src, dst, relation, CAST(0.9 AS DOUBLE) AS strength, CAST(0.8 AS DOUBLE) AS confidence FROM j ANTI JOIN e USING (src, dst, relation)"),
    "reward_totals": sql(L, "x AS (SELECT context, reward, reward - lag(reward) OVER (PARTITION BY context ORDER BY ts, event_id) AS up FROM l)", "SELECT context, round(sum(reward), 4) AS total, round(max(up), 4) AS largest_step FROM x GROUP BY 1"),
    "replay_sample": "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('7:' || event_id), event_id) <= 32",
    "pattern_nodes": sql(L, "nx AS (SELECT *, lead(item) OVER (PARTITION BY context ORDER BY ts, event_id) AS nxt FROM l)", "g AS (SELECT least(item, nxt) AS a, greatest(item, nxt) AS b, count(*) AS n FROM nx WHERE nxt <> item GROUP BY 1, 2 HAVING count(*) >= 5 AND count(DISTINCT context) >= 5)",
        "p AS (SELECT 1152921504606846976 + row_number() OVER (ORDER BY n DESC, a, b) - 1 AS pattern_id, a, b FROM g)", "SELECT CAST(pattern_id AS BIGINT) AS pattern_id, unnest([a, b]) AS target, 'associated_with' AS relation, CAST(0.9 AS DOUBLE) AS strength, CAST(0.9 AS DOUBLE) AS confidence FROM p"),
    "mean_vectors": "WITH x AS (SELECT label, unnest(range(0, len(embedding))) AS i, unnest(list_transform(CAST(embedding AS DOUBLE[]), lambda y: round_even(least(greatest(y, -1), 1) * 127, 0))) AS x FROM embeddings) SELECT label, CAST(i AS INTEGER) AS i, round(avg(x), 6) AS mean FROM x GROUP BY 1, 2",
    "training_rows": sql(E, "SELECT CASE relation " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in M.RELATION_INTENT.items()) + " ELSE 1 END AS intent, relation, count(*) AS n FROM e GROUP BY 1, 2"),
    "question_links": sql(W.N, "q AS (SELECT item_id, lower(text) AS text, unnest(list_distinct(string_split_regex(lower(text), '[^a-z]+'))) AS t FROM benchmark WHERE item_kind = 'question')", "m AS (SELECT node_id, lower(label) AS label, unnest(list_distinct(string_split_regex(lower(label), '[^a-z]+'))) AS t FROM n WHERE label IS NOT NULL)",
        "j AS (SELECT DISTINCT item_id, node_id, length(label) AS size, contains(text, label) AS whole FROM q JOIN m USING (t) WHERE length(t) >= 6)", "SELECT item_id, node_id, whole FROM j QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY whole DESC, size DESC, node_id) = 1"),
}
_Z = reasoning._normal
_LP = "pl AS (SELECT * FROM (VALUES " + ", ".join(f"({t}, {k}, [{', '.join(repr(float(x)) for x in p)}])" for t, table_ in enumerate(np.random.RandomState(42).randn(8, 8, 64)) for k, p in enumerate(table_)) + ") AS p(tab, plane, p))"
SQL |= {
    "reward_ema": sql(L, "k AS (SELECT context, list({'m': reward, 'v': CAST(1.0 AS DOUBLE), 's': CAST(0.0 AS DOUBLE)} ORDER BY ts, event_id) AS xs FROM l GROUP BY 1)",
        "r AS (SELECT context, len(xs) AS n, list_reduce(xs, lambda a, x: {'m': 0.9 * a.m + 0.1 * x.m, 'v': 0.9 * a.v + 0.1 * power(x.m - (0.9 * a.m + 0.1 * x.m), 2), 's': a.s + (x.m - (0.9 * a.m + 0.1 * x.m)) / greatest(sqrt(0.9 * a.v + 0.1 * power(x.m - (0.9 * a.m + 0.1 * x.m), 2)), 1e-8)}) AS z FROM k)",
        "SELECT context, n, round(z.s, 4) AS total FROM r"),
    "intent_bias_learning": sql(L, "k AS (SELECT item, list_prepend({'b': CAST(1.0 AS DOUBLE), 'hi': CAST(-1e9 AS DOUBLE), 'lo': CAST(1e9 AS DOUBLE)}, list({'b': reward / 100, 'hi': CAST(0 AS DOUBLE), 'lo': CAST(0 AS DOUBLE)} ORDER BY ts, event_id)) AS xs FROM l GROUP BY 1)",
        "r AS (SELECT item, list_reduce(xs, lambda a, x: {'b': greatest(0.1, least(3.0, a.b + 0.01 * x.b * (1 - a.b / 3))), 'hi': greatest(a.hi, greatest(0.1, least(3.0, a.b + 0.01 * x.b * (1 - a.b / 3)))), 'lo': least(a.lo, greatest(0.1, least(3.0, a.b + 0.01 * x.b * (1 - a.b / 3))))}) AS z FROM k)",
        "SELECT item, round(z.hi, 6) AS highest, round(z.lo, 6) AS lowest FROM r"),
    "es_propose": sql(L, reasoning._THETA, "w AS (SELECT context AS trial, avg(reward) AS reward FROM l GROUP BY 1)", f"p AS (SELECT trial, dim, mu, least(greatest(mu + 0.01 * {_Z('0', 'trial', 'dim')}, low), high) AS value FROM w, th)",
        "z AS (SELECT trial, (reward - avg(reward) OVER ()) / CASE WHEN stddev_pop(reward) OVER () > 1e-8 THEN stddev_pop(reward) OVER () ELSE 1 END AS z FROM w)", "d AS (SELECT dim, avg(z * (value - mu)) AS step FROM p JOIN z USING (trial) GROUP BY 1)",
        "t AS (SELECT dim, least(greatest(mu + 0.02 * step - 0.001 * (mu + 0.02 * step - mu), low), high) AS mu, low, high FROM th JOIN d USING (dim))",
        f"SELECT trial AS proposal, dim, round(least(greatest(mu + 0.01 * 0.9 * {_Z('1', 'trial', 'dim')}, low), high), 6) AS value FROM t, range(4) r(trial)"),
}
SQL["analogy_leaps"] = sql(E, W.N, W.S, W.A, _LP, "lv AS (SELECT node_id, coalesce(vector, embedding) AS v FROM node_embeddings WHERE len(coalesce(vector, embedding)) = 64 QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY saved_at DESC NULLS LAST, emb_id DESC) = 1)",
    "vv AS (SELECT node_id AS node, CAST(v AS DOUBLE[]) AS v FROM lv WHERE NOT list_bool_or(list_transform(v, lambda x: x IS NULL OR isnan(x))))", f"bu AS (SELECT node, tab, sum(CASE WHEN {reasoning._DOT.format('p', 'v')} > 0 THEN 1 << plane ELSE 0 END) AS bucket FROM vv, pl GROUP BY 1, 2)",
    "pa AS (SELECT DISTINCT query_id, y.node AS seed, x.node FROM bu x JOIN bu y USING (tab, bucket) JOIN s ON s.node = y.node WHERE x.node <> y.node)", "sc AS (SELECT query_id, seed, pa.node, round(coalesce(list_cosine_similarity(x.v, y.v), 0), 6) AS cosine FROM pa JOIN vv x ON x.node = pa.node JOIN vv y ON y.node = seed)",
    "ne AS (SELECT DISTINCT node, other FROM a WHERE confidence >= 0.5)", "de AS (SELECT node, count(*) AS d FROM ne GROUP BY 1)", "jk AS (SELECT seed, sc.node, count(*) AS k FROM (SELECT DISTINCT seed, node FROM sc WHERE cosine >= 0.3) sc JOIN ne x ON x.node = seed JOIN ne y ON y.node = sc.node AND x.other = y.other GROUP BY 1, 2)",
    "ja AS (SELECT seed, jk.node, k / (x.d + y.d - k) AS jaccard FROM jk JOIN de x ON x.node = seed JOIN de y ON y.node = jk.node)", "SELECT query_id, seed, sc.node, cosine, round(jaccard, 6) AS jaccard FROM sc JOIN ja USING (seed, node) WHERE cosine >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, sc.node) <= 5")
