"""Queries of learning, audits, knowledge extraction and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from weftgraph import functions as X
from weftgraph.operators import kg as T, learning as H
from weftgraph.params import Learning
from weftgraph.plans import views as W
from weftgraph.plans.views import E, L, N, S, sql
from weftgraph.session import table

c = F.col


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    """Each seed's edges as the steps of a walk, strongest first."""
    s = W.seeds(spark, sf)
    w = Window.partitionBy("query_id").orderBy(c("strength").desc(), c("confidence").desc(), "src", "dst", "relation")
    e = W.edges(spark, sf).join(s.withColumnRenamed("node", "src"), "src").withColumn("t", F.row_number().over(w) - 1)
    n = W.nodes(spark, sf).select(c("node_id").alias("src"), c("activation").alias("act_src"))
    return e.join(n, "src").select("query_id", "t", "src", "dst", "relation", "act_src", F.count("*").over(Window.partitionBy("query_id")).alias("length"))


def eligibility_learning(spark: SparkSession, sf: str) -> DataFrame:
    return H.learning_eligibility(_steps(spark, sf), W.edges(spark, sf)).select("query_id", "src", "dst", "relation", F.round("eligibility", 6).alias("eligibility"))


def hebbian_update(spark: SparkSession, sf: str) -> DataFrame:
    """One update of each seed's edges; a query's reward is +1 or -0.5 by its first letter."""
    t = H.learning_eligibility(_steps(spark, sf), W.edges(spark, sf))
    reward = F.when(F.substring("query_id", 1, 1) < "l", 1.0).otherwise(-0.5)
    h = t.withColumn("reward", reward).groupBy("src", "dst", "relation").agg(F.sum("eligibility").alias("eligibility"), F.max("reward").alias("reward"))
    return H.hebbian(W.edges(spark, sf), h, c("reward")).select("src", "dst", "relation", F.round("strength", 6).alias("strength"), F.round("confidence", 6).alias("confidence"))


def global_decay(spark: SparkSession, sf: str) -> DataFrame:
    d = H.decay(W.edges(spark, sf))
    return d.groupBy("relation").agg(F.count("*").alias("n"), F.round(F.sum("new_strength"), 4).alias("strength"))


def coactivation_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return H.coactivation(W.log(spark, sf)).select("a", "b", "n", "contexts", F.round("reward", 4).alias("reward"))


def frequent_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return H.frequent_sequences(W.log(spark, sf), 3, 10)


def markov_next(spark: SparkSession, sf: str) -> DataFrame:
    return H.markov_next(W.log(spark, sf)).select("history", "nxt", "n", c("rank_no").cast("long").alias("rank_no"))


def contradictions(spark: SparkSession, sf: str) -> DataFrame:
    return H.contradictions(W.edges(spark, sf)).select("src", "dst", "relation", F.round("score", 6).alias("score"))


def low_confidence_edges(spark: SparkSession, sf: str) -> DataFrame:
    return H.low_confidence(W.edges(spark, sf)).select("src", "dst", "relation", "confidence", F.round("below_by", 6).alias("below_by"))


def audit_report(spark: SparkSession, sf: str) -> DataFrame:
    """Number and worst case of each kind of finding, by relation."""
    e = W.edges(spark, sf)
    a = H.contradictions(e).groupBy("relation").agg(F.lit("contradiction").alias("kind"), F.count("*").alias("n"), F.round(F.max("score"), 6).alias("worst"))
    b = H.low_confidence(e).groupBy("relation").agg(F.lit("low_confidence").alias("kind"), F.count("*").alias("n"), F.round(F.max("below_by"), 6).alias("worst"))
    return a.unionByName(b)


def weak_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Names most often in triples that were hardly believed: the twenty first."""
    t = table(spark, sf, "kg_build_results").filter("source is not null and confidence is not null")
    return H.weak_entities(t.select(c("source").alias("entity"), (c("confidence") < 0.5).alias("failed")), 20)


def reward_minmax(spark: SparkSession, sf: str) -> DataFrame:
    l = W.log(spark, sf)
    return H.reward_min_max(l, "context", ["ts", "event_id"]).select("context", "event_id", F.round("scaled", 6).alias("scaled"))


def adaptive_threshold(spark: SparkSession, sf: str) -> DataFrame:
    v = W.log(spark, sf).select("item", "ts", "event_id", (c("reward") / 100).alias("value"))
    return H.adaptive_threshold(v, "item", ["ts", "event_id"], 200, 50, 0.05, 0.95).groupBy("item").agg(F.count("threshold").alias("n"), F.round(F.avg("threshold"), 6).alias("mean_threshold"))


def internal_reward(spark: SparkSession, sf: str) -> DataFrame:
    """Per seed query: activations, confidences and energy mixed .4, .3, .3, within [0, 1]."""
    s = _steps(spark, sf).join(W.edges(spark, sf), ["src", "dst", "relation"])
    g = s.groupBy("query_id").agg(F.avg("act_src").alias("a"), F.avg("confidence").alias("q"), F.sum(c("act_src") * c("strength") * c("confidence")).alias("e"))
    v = 0.4 * c("a") + 0.3 * c("q") + 0.3 * F.least(c("e") / 10, F.lit(1.0))
    return g.select("query_id", F.round(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)), 6).alias("reward"))


def effective_reward(spark: SparkSession, sf: str) -> DataFrame:
    """External, human and internal parts mixed .4, .3, .3 from a user's events."""
    part = lambda k: F.coalesce(F.avg(F.when(c("item") == k, c("reward"))), F.lit(0.0))
    return W.log(spark, sf).groupBy("context").agg(F.round(0.4 * part("purchase") + 0.3 * part("click") + 0.3 * part("view"), 6).alias("reward"))


def label_normalize(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "kg_build_results")
    n = t.select(F.explode(F.array("source", "target")).alias("x")).filter("x is not null").select(T.normalize_label(c("x")).alias("name"))
    return n.groupBy("name").agg(F.count("*").alias("n"))


def _triples(spark: SparkSession, sf: str) -> DataFrame:
    return T.once(table(spark, sf, "kg_build_results"))


def triple_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return T.frequency(_triples(spark, sf)).select("s", "rel", "o", "freq", "first_level", "first_id")


def kg_edges_scored(spark: SparkSession, sf: str) -> DataFrame:
    return T.scored_edges(_triples(spark, sf), 0.5)


def score_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = T.scored_edges(_triples(spark, sf), 0.0)
    p = lambda q: F.round(F.percentile("confidence", q), 6)
    return s.agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"), p(0.5).alias("median"), p(0.25).alias("p25"), p(0.75).alias("p75"), F.min("confidence").alias("low"), F.max("confidence").alias("high"))


def cross_sentence_chain(spark: SparkSession, sf: str) -> DataFrame:
    return T.chains(_triples(spark, sf))


def distinct_triples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "kg_build_results").select("source", "relation", "target").dropDuplicates()


def relation_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Connectors by their first word: count, variants, the most frequent one and up to ten samples."""
    t = table(spark, sf, "kg_build_results").filter("relation is not null").select(F.trim(F.lower("relation")).alias("r"))
    n = t.groupBy("r").agg(F.count("*").alias("n")).withColumn("head", F.element_at(F.split("r", " "), 1))
    g = n.groupBy("head").agg(F.sum("n").alias("n"), F.count("*").alias("variants"), F.max_by("r", F.struct("n", "r")).alias("mode"), F.array_join(F.slice(F.array_sort(F.collect_list("r")), 1, 10), "|").alias("samples"))
    return g


def kg_build_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = T.scored_edges(_triples(spark, sf), 0.0)
    n = s.select(F.explode(F.array("s", "o")).alias("x")).agg(F.countDistinct("x").alias("n_names"))
    e = s.agg(F.count("*").alias("n_edges"), F.count_if(c("freq") > 1).alias("n_repeated"), F.countDistinct("rel").alias("n_relations"))
    return e.crossJoin(n).select("n_edges", "n_names", "n_repeated", "n_relations", F.round(c("n_edges") / c("n_names"), 6).alias("edges_per_name"))


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Level of extraction against what the confidence alone would say."""
    t = _triples(spark, sf).filter("confidence is not null and pattern_level is not null")
    guess = F.when(c("confidence") >= 0.8, "svo").when(c("confidence") >= 0.6, "prep").when(c("confidence") >= 0.4, "conj").otherwise("cross")
    return t.groupBy(c("pattern_level").alias("actual"), guess.alias("predicted")).agg(F.count("*").alias("n"))


def per_class_prf(spark: SparkSession, sf: str) -> DataFrame:
    m = confusion_matrix(spark, sf)
    k = m.select(F.explode(F.array(F.struct(c("actual").alias("label"), c("n").alias("support"), F.lit(0).alias("guessed"), F.when(c("actual") == c("predicted"), c("n")).otherwise(0).alias("hit")), F.struct(c("predicted").alias("label"), F.lit(0).alias("support"), c("n").alias("guessed"), F.lit(0).alias("hit")))).alias("x")).select("x.*")
    g = k.groupBy("label").agg(F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("hit"))
    p, r = F.when(c("guessed") > 0, c("hit") / c("guessed")).otherwise(0.0), F.when(c("support") > 0, c("hit") / c("support")).otherwise(0.0)
    return g.select("label", "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def qa_substring_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Share of triples whose target holds the last word of their source, by level."""
    t = _triples(spark, sf)
    return t.groupBy("pattern_level").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.contains("o", F.element_at(F.split("s", " "), -1)), 1.0).otherwise(0.0)), 6).alias("accuracy"))


def label_initial_uri(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes as URIs and back: language and label parts, of labels of plain letters and spaces only; ``label_uris`` takes all."""
    u = F.concat(F.lit("/c/en/"), F.replace(F.lower("label"), F.lit(" "), F.lit("_")))
    n = W.nodes(spark, sf).filter("label rlike '^[A-Za-z ]+$'").select("node_id", u.alias("uri"))
    return n.select("node_id", X.uri_part(c("uri"), 2).alias("lang"), X.uri_part(c("uri"), 3).alias("label"))


def label_uris(spark: SparkSession, sf: str) -> DataFrame:
    """All nodes with a label as URIs and back. No SQL: engines differ in the lower case of some scripts."""
    n = W.nodes(spark, sf).filter("label is not null").select("node_id", X.label_uri(F.lit("en"), c("label")).alias("uri"))
    return n.select("node_id", "uri", X.uri_part(c("uri"), 2).alias("lang"), X.uri_label(c("uri")).alias("label"))


def output_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as answers: how many of a kind pass the checks against the words that answers must mention."""
    d = table(spark, sf, "documents").filter("text is not null")
    ok = X.valid_output(c("text"), F.array(F.lit("the"), F.lit("la")), 5, 500)
    return d.groupBy("doc_kind").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_valid"))


def nodes_mentioned(spark: SparkSession, sf: str) -> DataFrame:
    """How often each relation word is mentioned in documents; ``walk_mentions`` has the nodes that a walk's text mentions."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z_]+"), lambda w: w != ""))
    d = table(spark, sf, "documents").filter("text is not null").select(F.explode(words).alias("relation"))
    r = W.edges(spark, sf).select("relation").distinct()
    return d.join(F.broadcast(r), "relation").groupBy("relation").agg(F.count("*").alias("n_docs"))


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Feedback in hours of event time, by kind."""
    e = table(spark, sf, "events")
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(c("w.start").alias("hour"), "event_type", "n", "total")


QUERIES = {f.__name__: f for f in (
    eligibility_learning, hebbian_update, global_decay, coactivation_pairs, frequent_sequences, markov_next, contradictions, low_confidence_edges, audit_report, weak_entities, reward_minmax, adaptive_threshold, internal_reward,
    effective_reward, label_normalize, triple_frequency, kg_edges_scored, score_stats, cross_sentence_chain, distinct_triples, relation_clusters, kg_build_stats, confusion_matrix, per_class_prf, qa_substring_accuracy, label_initial_uri, label_uris,
    output_validation, nodes_mentioned, event_windows,
)}
_P = Learning()
_W = """w AS (SELECT query_id, src, dst, relation, n.activation AS act_src, row_number() OVER (PARTITION BY query_id ORDER BY strength DESC, confidence DESC, src, dst, relation) - 1 AS t, count(*) OVER (PARTITION BY query_id) AS len
 FROM e JOIN s ON src = s.node JOIN n ON src = n.node_id)"""
_EL = "el AS (SELECT query_id, src, dst, relation, sum(power(0.9, t * (1 + 0.5 * t / greatest(len, 1))) * act_src * strength * confidence) AS el FROM w JOIN e USING (src, dst, relation) GROUP BY 1, 2, 3, 4)"
_NX = "nx AS (SELECT *, lead(item) OVER (PARTITION BY context ORDER BY ts, event_id) AS nxt FROM l)"
_SP = r"[\t\n\x0B\f\r\x1c-\x1f\x85\p{Z}]+"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SP}|{_SP}$', '', 'g')"


def _norm(x: str) -> str:
    b = _strip(f"lower({x})")
    return _strip(f"CASE WHEN {b} LIKE '%''s' THEN regexp_replace({b}, '''s$', '') WHEN {b} LIKE '%s''' THEN regexp_replace({b}, '''$', '') ELSE {b} END")


_T = f"""t AS (SELECT DISTINCT triple_id, {_norm('source')} AS s, {_strip('lower(relation)')} AS rel, {_norm('target')} AS o, pattern_level, confidence, doc_index FROM kg_build_results WHERE triple_id IS NOT NULL),
 u AS (SELECT * FROM t WHERE s <> '' AND o <> '' AND rel <> '' AND s <> o)"""
_F = "f AS (SELECT s, rel, o, count(*) AS freq, arg_min(pattern_level, triple_id) AS first_level, min(triple_id) AS first_id FROM u GROUP BY 1, 2, 3)"
_G = "g AS (SELECT s, rel, o, freq, least(1.0, freq / 5.0) AS strength, round((0.5 * CASE first_level WHEN 'svo' THEN 0.95 WHEN 'prep' THEN 0.75 WHEN 'conj' THEN 0.45 ELSE 0.5 END + 0.3 * 0.6 + 0.2 * (1 - 1 / (freq + 1))) * 1.0, 4) AS confidence FROM f)"
_C = """cm AS (SELECT pattern_level AS actual, CASE WHEN confidence >= 0.8 THEN 'svo' WHEN confidence >= 0.6 THEN 'prep' WHEN confidence >= 0.4 THEN 'conj' ELSE 'cross' END AS predicted, count(*) AS n FROM u WHERE confidence IS NOT NULL AND pattern_level IS NOT NULL GROUP BY 1, 2)"""
_CO = """op AS (SELECT src, sum(strength * confidence) AS sup FROM e GROUP BY 1), co AS (SELECT e.src, e.dst, relation, abs(coalesce(x.sup, 0) - coalesce(y.sup, 0)) / greatest(coalesce(x.sup, 0) + coalesce(y.sup, 0), 1e-8) AS score FROM e LEFT JOIN op x ON e.src = x.src LEFT JOIN op y ON e.dst = y.src WHERE relation IN ('contradicts', 'antonym'))"""
SQL = {
    "eligibility_learning": sql(E, N, S, _W, _EL, "SELECT query_id, src, dst, relation, round(el, 6) AS eligibility FROM el"),
    "hebbian_update": sql(E, N, S, _W, _EL, "h AS (SELECT src, dst, relation, sum(el) AS el, max(CASE WHEN substr(query_id, 1, 1) < 'l' THEN 1.0 ELSE -0.5 END) AS r FROM el GROUP BY 1, 2, 3)",
        "SELECT src, dst, relation, round(least(greatest(strength + 0.05 * r * el, 0.0), 1.0), 6) AS strength, round(least(greatest(confidence + 0.02 * abs(r) * el * 0.75, 0.0), 1.0), 6) AS confidence FROM e JOIN h USING (src, dst, relation)"),
    "global_decay": sql(E, "d AS (SELECT relation, strength, greatest(0.01, strength * (1 - 0.001 / (1 + least(50.0, frequency) / 50))) AS ns FROM e)", "SELECT relation, count(*) AS n, round(sum(ns), 4) AS strength FROM d WHERE ns < strength GROUP BY 1"),
    "coactivation_pairs": sql(L, _NX, "SELECT least(item, nxt) AS a, greatest(item, nxt) AS b, count(*) AS n, count(DISTINCT context) AS contexts, round(avg(reward), 4) AS reward FROM nx WHERE nxt <> item GROUP BY 1, 2 HAVING count(*) >= 5 AND count(DISTINCT context) >= 5"),
    "frequent_sequences": sql(L, _NX, "n2 AS (SELECT *, lead(item, 2) OVER (PARTITION BY context ORDER BY ts, event_id) AS n3 FROM nx)", "SELECT item || '>' || nxt || '>' || n3 AS pattern, count(*) AS n FROM n2 WHERE n3 IS NOT NULL GROUP BY 1 HAVING count(*) >= 10"),
    "markov_next": sql(L, "h AS (SELECT item AS nxt, lag(item, 3) OVER q AS a, lag(item, 2) OVER q AS b, lag(item, 1) OVER q AS c FROM l WINDOW q AS (PARTITION BY context ORDER BY ts, event_id))", "g AS (SELECT a || '>' || b || '>' || c AS history, nxt, count(*) AS n FROM h WHERE a IS NOT NULL GROUP BY 1, 2)",
        "SELECT history, nxt, n, row_number() OVER (PARTITION BY history ORDER BY n DESC, nxt) AS rank_no FROM g QUALIFY rank_no <= 3"),
    "contradictions": sql(E, _CO, "SELECT src, dst, relation, round(score, 6) AS score FROM co WHERE score >= 0.3"),
    "low_confidence_edges": sql(E, "SELECT src, dst, relation, confidence, round(0.4 - confidence, 6) AS below_by FROM e WHERE confidence < 0.4"),
    "audit_report": sql(E, _CO, "SELECT relation, 'contradiction' AS kind, count(*) AS n, round(max(score), 6) AS worst FROM co WHERE score >= 0.3 GROUP BY 1 UNION ALL SELECT relation, 'low_confidence', count(*), round(max(0.4 - confidence), 6) FROM e WHERE confidence < 0.4 GROUP BY 1"),
    "weak_entities": "SELECT lower(source) AS entity, count(*) AS failures FROM kg_build_results WHERE source IS NOT NULL AND confidence < 0.5 GROUP BY 1 ORDER BY failures DESC, entity LIMIT 20",
    "reward_minmax": sql(L, "x AS (SELECT context, event_id, reward, min(reward) OVER q AS lo, max(reward) OVER q AS hi FROM l WINDOW q AS (PARTITION BY context ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))", "SELECT context, event_id, round(CASE WHEN hi > lo THEN 2 * (reward - lo) / (hi - lo) - 1 ELSE 0 END, 6) AS scaled FROM x"),
    "adaptive_threshold": sql(L, "x AS (SELECT item, count(reward) OVER q AS k, least(greatest(avg(reward / 100) OVER q - 1.5 * stddev_pop(reward / 100) OVER q, 0.05), 0.95) AS th FROM l WINDOW q AS (PARTITION BY item ORDER BY ts, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))",
        "SELECT item, count(*) FILTER (k >= 50) AS n, round(avg(th) FILTER (k >= 50), 6) AS mean_threshold FROM x GROUP BY 1"),
    "internal_reward": sql(E, N, S, _W, "SELECT query_id, round(least(greatest(0.4 * avg(act_src) + 0.3 * avg(confidence) + 0.3 * least(sum(act_src * strength * confidence) / 10, 1.0), 0.0), 1.0), 6) AS reward FROM w JOIN e USING (src, dst, relation) GROUP BY 1"),
    "effective_reward": sql(L, "SELECT context, round(0.4 * coalesce(avg(reward) FILTER (item = 'purchase'), 0) + 0.3 * coalesce(avg(reward) FILTER (item = 'click'), 0) + 0.3 * coalesce(avg(reward) FILTER (item = 'view'), 0), 6) AS reward FROM l GROUP BY 1"),
    "label_normalize": f"SELECT {_norm('x')} AS name, count(*) AS n FROM (SELECT source AS x FROM kg_build_results UNION ALL SELECT target FROM kg_build_results) WHERE x IS NOT NULL GROUP BY 1",
    "triple_frequency": sql(_T, _F, "SELECT s, rel, o, freq, first_level, first_id FROM f"),
    "kg_edges_scored": sql(_T, _F, _G, "SELECT s, rel, o, freq, strength, confidence FROM g WHERE confidence >= 0.5"),
    "score_stats": sql(_T, _F, _G, "SELECT count(*) AS n, round(avg(confidence), 6) AS mean, round(quantile_cont(confidence, 0.5), 6) AS median, round(quantile_cont(confidence, 0.25), 6) AS p25, round(quantile_cont(confidence, 0.75), 6) AS p75, min(confidence) AS low, max(confidence) AS high FROM g"),
    "cross_sentence_chain": sql(_T, "p AS (SELECT *, lag(s) OVER q AS ps, lag(rel) OVER q AS pr, lag(o) OVER q AS po FROM u WHERE doc_index IS NOT NULL WINDOW q AS (PARTITION BY doc_index ORDER BY triple_id))",
        "SELECT doc_index, s, rel, o, count(*) AS n FROM (SELECT doc_index, ps AS s, pr || '→' || rel AS rel, o FROM p WHERE po = s AND ps <> o UNION ALL SELECT doc_index, s, rel || '→' || pr, po FROM p WHERE o = ps AND s <> po) GROUP BY 1, 2, 3, 4"),
    "distinct_triples": "SELECT DISTINCT source, relation, target FROM kg_build_results",
    "relation_clusters": "WITH n AS (SELECT trim(lower(relation)) AS r, count(*) AS n FROM kg_build_results WHERE relation IS NOT NULL GROUP BY 1) SELECT split_part(r, ' ', 1) AS head, CAST(sum(n) AS BIGINT) AS n, count(*) AS variants, arg_max(r, (n, r)) AS mode, array_to_string(list_sort(list(r))[1:10], '|') AS samples FROM n GROUP BY 1",
    "kg_build_stats": sql(_T, _F, _G, "SELECT n_edges, n_names, n_repeated, n_relations, round(n_edges / n_names, 6) AS edges_per_name FROM (SELECT count(*) AS n_edges, count(*) FILTER (freq > 1) AS n_repeated, count(DISTINCT rel) AS n_relations FROM g), (SELECT count(DISTINCT x) AS n_names FROM (SELECT s AS x FROM g UNION ALL SELECT o FROM g))"),
    "confusion_matrix": sql(_T, _C, "SELECT * FROM cm"),
    "per_class_prf": sql(_T, _C, "k AS (SELECT label, CAST(sum(su) AS BIGINT) AS support, sum(gu) AS guessed, sum(hi) AS hit FROM (SELECT actual AS label, n AS su, 0 AS gu, CASE WHEN actual = predicted THEN n ELSE 0 END AS hi FROM cm UNION ALL SELECT predicted, 0, n, 0 FROM cm) GROUP BY 1)",
        "r AS (SELECT label, support, CASE WHEN guessed > 0 THEN hit / guessed ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS r FROM k)", 'SELECT label, support, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM r'),
    "qa_substring_accuracy": sql(_T, "SELECT pattern_level, count(*) AS n, round(avg(CASE WHEN contains(o, split_part(s, ' ', -1)) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM u GROUP BY 1"),
    "label_initial_uri": sql(N, "SELECT node_id, 'en' AS lang, lower(label) AS label FROM n WHERE regexp_full_match(label, '[A-Za-z ]+')"),
    "output_validation": "SELECT doc_kind, count(*) AS n, count(*) FILTER (length(text) BETWEEN 5 AND 500 AND (contains(lower(text), 'the') OR contains(lower(text), 'la')) AND NOT contains(text, ': intent=') AND NOT contains(text, 'intent=') AND NOT contains(text, '->') AND NOT contains(text, 'generate:')) AS n_valid FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "nodes_mentioned": sql(E, "r AS (SELECT DISTINCT relation FROM e)", "d AS (SELECT unnest(list_distinct(string_split_regex(lower(text), '[^a-z_]+'))) AS relation FROM documents WHERE text IS NOT NULL)", "SELECT relation, count(*) AS n_docs FROM d JOIN r USING (relation) GROUP BY 1"),
    "event_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
