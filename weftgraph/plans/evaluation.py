"""Queries of registries, rewards, evaluation and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from weftgraph import functions as X
from weftgraph.operators import decode as D, evaluate as Q, extract, graph as G, kg as T, learning as H, plan as P, registry as Y, rewards as B, training as M, walk as K
from weftgraph.plans import building, learning, reasoning, views as W
from weftgraph.plans.views import E, L, N, S, V, sql
from weftgraph.session import cut, table

c = F.col


def _centroids(spark: SparkSession, sf: str) -> DataFrame:
    """The mean vector of each cluster, as a registry."""
    m = W.vectors(spark, sf).select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg(c("x").cast("double")).alias("x"))
    return m.groupBy(c("label").cast("string").alias("canonical")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("v"))


def entity_batch(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors aligned in one batch with the registry of cluster means; those far from all begin entries of their own."""
    r = Y.align_batch(W.vectors(spark, sf).select(c("node").alias("key"), "v"), _centroids(spark, sf), 0.5, 64)
    return r.select("key", "canonical", "cosine", "is_new")


def registry_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """The registry's vectors after following their members in order."""
    m = W.vectors(spark, sf).select(c("label").cast("string").alias("canonical"), c("node").alias("ord"), "v")
    return Y.followed(_centroids(spark, sf), m).select("canonical", "i", F.round("value", 6).alias("value"))


def cluster_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """Each kind's threshold from its last twenty values, on average and at most."""
    v = W.log(spark, sf).select("item", "ts", "event_id", (c("reward") / 100).alias("value"))
    return Y.local_threshold(v, "item", ["ts", "event_id"], 0.2).groupBy("item").agg(F.count("*").alias("n"), F.round(F.avg("threshold"), 6).alias("mean_threshold"), F.round(F.max("threshold"), 6).alias("highest"))


def registry_absorb(spark: SparkSession, sf: str) -> DataFrame:
    """The names of sources as a registry that takes in those of targets."""
    t = T.once(table(spark, sf, "kg_build_results"))
    a, b = (t.groupBy(c(k).alias("canonical")).agg(F.count("*").alias("n")) for k in ("s", "o"))
    return Y.absorb_entries(a, b)


def _relations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "kg_build_results").filter("relation is not null").groupBy(X.strip(F.lower("relation")).alias("label")).agg(F.count("*").alias("n"), F.min("triple_id").alias("ord"))


def relation_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Every connector of the triples under the most frequent one that is spelled alike."""
    return Y.relation_registry(_relations(spark, sf).select("label", "n"))


def relation_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Connectors put into groups one after the other, as they first occur."""
    return Y.online_clusters(_relations(spark, sf).select("ord", "label"))


def entity_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Every name of the triples under the most frequent one that is spelled alike."""
    t = T.once(table(spark, sf, "kg_build_results"))
    return Y.resolve_names(t.select(F.explode(F.array("s", "o")).alias("label")).groupBy("label").agg(F.count("*").alias("n")))


def total_rewards(spark: SparkSession, sf: str) -> DataFrame:
    """External, human and internal rewards of each user mixed: buying, clicking, viewing."""
    part = lambda k: F.coalesce(F.avg(F.when(c("item") == k, c("reward"))), F.lit(0.0))
    g = W.log(spark, sf).groupBy("context").agg(part("purchase").alias("a"), part("click").alias("b"), part("view").alias("d"))
    return g.select("context", F.round(B.total_reward(c("a"), c("b"), c("d")), 6).alias("reward"))


def walk_rewards(spark: SparkSession, sf: str) -> DataFrame:
    """An estimate of each walk's worth from its activations, confidences and length."""
    w = reasoning._walks(spark, sf)
    return w.select("query_id", F.round(B.estimated_internal(c("activations"), c("confidences"), F.size("relations").cast("double")), 6).alias("reward"))


def judged_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """What three small networks think of every vector beside its cluster's mean."""
    v = W.vectors(spark, sf).select(c("node").alias("row_id"), c("v").cast("array<double>").alias("action"), c("label").cast("string").alias("canonical")).join(_centroids(spark, sf).withColumnRenamed("v", "goal"), "canonical")
    r = B.judged(v, {"aligned": (["action", "goal"], 0.4), "valued": (["action"], 0.3), "steady": (["goal"], 0.3)})
    return r.select("row_id", *[F.round(k, 5).alias(k) for k in ("aligned", "valued", "steady", "reward")])


def extraction_prf(spark: SparkSession, sf: str) -> DataFrame:
    """Triples of the looser patterns against those of the strict one: right if equal, or of the same relation with ends that hold each other."""
    t = T.once(table(spark, sf, "kg_build_results"))
    strict = c("pattern_level") == "svo"
    return Q.extraction_scores(cut(t.filter(~strict).select("s", "rel", "o").distinct()), cut(t.filter(strict).select("s", "rel", "o").distinct()))


def centroid_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """How often a vector's cluster is among the nearest means, batch by batch."""
    m = _centroids(spark, sf)
    v = W.vectors(spark, sf).select(c("node").alias("row_id"), c("label").cast("string").alias("actual"), "v")
    x = v.crossJoin(F.broadcast(m.withColumnRenamed("v", "m"))).select("row_id", "actual", "canonical", F.round(X.cosine(c("v"), c("m")), 9).alias("s"))
    own = x.filter("actual = canonical").select("row_id", c("s").alias("own"), "actual")
    at = x.join(own, ["row_id", "actual"]).groupBy("row_id").agg((F.count_if((c("s") > c("own")) | ((c("s") == c("own")) & (c("canonical") < c("actual")))) + 1).alias("at"))
    return Q.batch_top_k(at)


def answer_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Edges at the seeds as answers: by how the relation is spelled against the query, with a bonus for the direction, then confidence."""
    s = W.seeds(spark, sf)
    e = W.edges(spark, sf)
    like = lambda x: 1 - F.levenshtein("query_id", x) / F.greatest(F.length("query_id"), F.length(x))
    out = e.join(s.withColumnRenamed("node", "src"), "src").select("query_id", "src", "dst", "relation", "confidence", F.lit(0.1).alias("bonus"))
    into = e.join(s.withColumnRenamed("node", "dst"), "dst").select("query_id", "src", "dst", "relation", "confidence", F.lit(0.05).alias("bonus"))
    x = out.unionByName(into).groupBy("query_id", "src", "dst", "relation", "confidence").agg(F.max("bonus").alias("bonus"))
    x = x.withColumn("similarity", F.round(like("relation") + c("bonus"), 6))
    return Q.ranked_answers(x).select("query_id", c("rank_no").cast("long").alias("rank_no"), "src", "dst", "relation", "similarity")


def qa_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Share of answers whose text or path names the target of their start's strongest edge."""
    got, _, _ = reasoning._walk_texts(spark, sf)
    got = cut(got.select("query_id", "text", "labels", F.element_at("path", 1).alias("src")))
    w = Window.partitionBy("src").orderBy(c("strength").desc(), c("confidence").desc(), "dst", "relation")
    e = W.edges(spark, sf).join(F.broadcast(got.select("src").distinct()), "src").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("src", c("dst").alias("node_id"))
    want = e.join(W.nodes(spark, sf), "node_id").select("src", F.coalesce("label", F.concat(F.lit("node_"), c("node_id").cast("string"))).alias("want"))
    hit = F.contains(F.lower("text"), F.lower("want")) | F.exists("labels", lambda x: F.contains(F.lower(x), F.lower("want")))
    return got.join(want, "src").agg(F.count("*").alias("n"), F.count_if(hit).alias("n_right"), F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 6).alias("accuracy"))


def kg_density(spark: SparkSession, sf: str) -> DataFrame:
    """Density of the built graph, groups of names that differ in case and signs only, and the share of names they merge."""
    s = T.scored_edges(T.once(table(spark, sf, "kg_build_results")), 0.0)
    n = s.select(F.explode(F.array("s", "o")).alias("x")).distinct().withColumn("k", F.regexp_replace("x", r"[^\p{L}\p{Nd}]", ""))
    g = n.groupBy("k").agg(F.count("*").alias("m")).agg(F.sum("m").alias("n_names"), F.count("*").alias("n_forms"), F.count_if(c("m") > 1).alias("n_groups"))
    j = g.crossJoin(s.agg(F.count("*").alias("n_edges")))
    return j.select("n_names", "n_edges", "n_groups", F.round(c("n_edges") / (c("n_names") * (c("n_names") - 1) / 2), 12).alias("density"), F.round(c("n_names") / c("n_forms"), 6).alias("merge_ratio"))


def uncertain_plans(spark: SparkSession, sf: str) -> DataFrame:
    """Every source's rule plan, counted; the uncertain ones are those an audit reports."""
    f = W.edges(spark, sf).groupBy("src").agg((F.countDistinct("dst") + 1).alias("n_nodes"), F.count_if(c("relation") == "causes").alias("causes"), F.count_if(c("relation") == "contradicts").alias("contradicts"), F.avg("confidence").alias("avg_conf"))
    p = P.rule_plan(f)
    unsure = F.arrays_overlap(F.split("intents", ","), F.array(F.lit("10"), F.lit("11")))
    return p.groupBy(F.coalesce("intents", F.lit("none")).alias("intents")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(unsure, F.lit(False))).alias("n_uncertain"))


def rules_by_text(spark: SparkSession, sf: str) -> DataFrame:
    """Plans for the benchmark's texts by rules over their words."""
    rules = ((P.query_contains("why"), (2, 3)), (P.query_contains("what"), (0, 1)), ("length(query_text) > 200", (12,)))
    f = table(spark, sf, "benchmark").select("item_id", c("text").alias("query_text"))
    return P.rule_plan(f, rules).select("item_id", "intents", "plan_confidence")


def named_plans(spark: SparkSession, sf: str) -> DataFrame:
    """Rule plans of the queries by the names of their intents."""
    p = reasoning.rule_planner(spark, sf).filter("intents is not null")
    return p.select("query_id", F.array_join(P.intent_names(F.transform(F.split("intents", ","), lambda x: x.cast("int"))), " > ").alias("names"))


def question_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of capitalised words in the benchmark's texts, counted."""
    t = table(spark, sf, "benchmark").filter("text is not null").select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]+(?: [A-Z][a-z]+)*"), F.lit(0))).alias("entity"))
    return t.groupBy("entity").agg(F.count("*").alias("n"))


def kept_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences worth parsing, by kind of document: those of ten characters or more, and shorter ones that name something."""
    d = table(spark, sf, "documents").select("doc_id", "text", "doc_kind")
    s = extract.sentences(d.select("doc_id", "text")).join(d.select("doc_id", "doc_kind"), "doc_id")
    keep = (F.length("sentence") >= 10) | c("sentence").rlike("[A-Z][a-z]")
    return s.groupBy("doc_kind").agg(F.count("*").alias("n"), F.count_if(keep).alias("n_kept"))


def subgraph_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Rules of subgraphs and how often the raw rows around the queries' seeds break them."""
    s = W.seeds(spark, sf)
    raw = table(spark, sf, "edges").select(c("source").alias("src"), c("target").alias("dst"), "strength", "confidence").join(s.withColumnRenamed("node", "src"), "src")
    act = s.join(table(spark, sf, "nodes").select(c("node_id").alias("node"), "activation").distinct(), "node").select("query_id", "node", "activation")
    return Q.subgraph_violations(act, raw, s)


def walk_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Rules of walks and how often those of the queries break them."""
    return Q.walk_violations(reasoning._walks(spark, sf))


def walk_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """What a text generator would be given for each walk."""
    return reasoning._labels(spark, sf, reasoning.PLAN).select("query_id", D.prompt(c("labels"), c("relations"), F.array(*[F.lit(i) for i in reasoning.PLAN])).alias("prompt"))


def bias_table(spark: SparkSession, sf: str) -> DataFrame:
    """The preferences of intents as a table, with the relations' mean confidences put over those of one intent."""
    rows = [(i, r, float(v)) for i, m in K.INTENT_BIAS.items() for r, v in m.items()]
    new = W.edges(spark, sf).groupBy("relation").agg(F.round(4 * F.avg("confidence"), 6).alias("b")).select(F.lit(2).alias("intent"), "relation", "b")
    return K.update_bias(spark.createDataFrame(rows, "intent int, relation string, b double"), new)


def vector_additions(spark: SparkSession, sf: str) -> DataFrame:
    """Cluster means put in as vectors: each takes the id of one that is nearly the same, or the next free one."""
    v = W.vectors(spark, sf)
    m = Y.best_matches(_centroids(spark, sf).select(c("canonical").alias("key"), "v"), v.select(c("node").alias("canonical"), "v"), 64)
    top = v.agg(F.max("node")).first()[0] or 0
    fresh = G.numbered(m.filter("cosine < 0.92").select("key"), ["key"], top + 1, "node_id")
    return m.filter("cosine >= 0.92").select("key", c("canonical").cast("long").alias("node_id"), F.lit(False).alias("is_new")).unionByName(fresh.select("key", "node_id", F.lit(True).alias("is_new")))


def walk_log(spark: SparkSession, sf: str) -> DataFrame:
    """Every decision of the walks, step by step."""
    return K.steps(reasoning._walks(spark, sf)).select("query_id", c("t").cast("long").alias("t"), "src", "dst", "relation", F.round("act_src", 6).alias("act_src"))


def weak_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels on walks that count as failed: built, asked, and what was weak."""
    walks = reasoning._walks(spark, sf)
    w = walks.select("query_id", K.walk_confidence(c("confidences")).alias("walk"))
    bad = reasoning._labels(spark, sf, reasoning.PLAN, walks).join(w, "query_id").filter(H.failed(D.render(F.array(F.lit(5)), c("labels"), c("relations")), c("walk"), F.lit(1.0), 0.95))
    return H.weak_entities(bad.select(F.explode("labels").alias("entity"), F.lit(True).alias("failed")), 20)


def safe_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of the documents, with abbreviations and decimals left whole, by kind."""
    d = table(spark, sf, "documents").select("doc_id", "text", "doc_kind")
    s = extract.safe_sentences(d.select("doc_id", "text")).join(d.select("doc_id", "doc_kind"), "doc_id")
    return s.groupBy("doc_kind").agg(F.count("*").alias("n"), F.sum(F.length("sentence")).alias("n_chars"))


def cluster_choice(spark: SparkSession, sf: str) -> DataFrame:
    """How well the vectors fall into five, ten and fifteen clusters."""
    return M.silhouettes(W.vectors(spark, sf), (5, 10, 15))


QUERIES = {f.__name__: f for f in (
    vector_additions, walk_log, weak_labels, safe_sentences, cluster_choice, entity_batch, registry_centroids, cluster_thresholds, registry_absorb, relation_registry, relation_groups, entity_resolution, total_rewards, walk_rewards, judged_vectors, extraction_prf, centroid_top_k, answer_ranking, qa_accuracy, kg_density,
    uncertain_plans, rules_by_text, named_plans, question_entities, kept_sentences, subgraph_faults, walk_faults, walk_prompts, bias_table,
)}
_T, _F, _G = learning._T, learning._F, learning._G
_CE = "ce AS (SELECT label, list(x ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(v) AS x FROM v) GROUP BY 1, 2) GROUP BY 1)"
_HOLDS = "(contains(' ' || {0} || ' ', ' ' || {1} || ' ') OR contains(' ' || {1} || ' ', ' ' || {0} || ' '))"
_SAME = f"p.rel = tr.rel AND {_HOLDS.format('p.s', 'tr.s')} AND {_HOLDS.format('p.o', 'tr.o')}"
_RULES = "CASE WHEN nn <= 3 THEN '0' WHEN ca > 0 THEN '1,2,7' WHEN co > 0 THEN '4,1,7' WHEN nn >= 10 THEN '6,12,8' WHEN ac < 0.5 THEN '10,11' END"
_NAMES = "[" + ", ".join(f"'{x}'" for x in P.INTENTS) + "]"
_OUT = "({0} IS NULL OR isnan({0}) OR NOT {0} BETWEEN {1} AND {2})"
_SHORT = "|".join(extract.SHORTENED)
SQL = {
    "vector_additions": sql(V, _CE, "x AS (SELECT CAST(ce.label AS VARCHAR) AS key, v.node, round(list_cosine_similarity(v.v, m), 6) AS s FROM v, ce)", "b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY key ORDER BY s DESC, CAST(node AS VARCHAR)) = 1)",
        "SELECT key, node AS node_id, false AS is_new FROM b WHERE s >= 0.92 UNION ALL SELECT key, (SELECT max(node) FROM v) + row_number() OVER (ORDER BY key), true FROM b WHERE s < 0.92"),
    "walk_log": sql(*reasoning._walk_sql(5), reasoning._STEPS, "SELECT query_id, t, src, dst, relation, round(act_src, 6) AS act_src FROM su"),
    "weak_labels": sql(*reasoning._walk_sql(5), reasoning._LB, f"q AS (SELECT labels FROM w5 JOIN lb USING (query_id) WHERE {reasoning._rendered((5,))} IS NULL OR {reasoning._CONF} < 0.95)", "SELECT lower(x) AS entity, count(*) AS failures FROM (SELECT unnest(labels) AS x FROM q) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"),
    "safe_sentences": sql(rf"h AS (SELECT doc_kind, string_split(regexp_replace(regexp_replace(text, '\b({_SHORT}|[A-Z])\.', '\1' || chr(1), 'g'), '([.!?]+)[ \t\n\r]+', '\1' || chr(10), 'g'), chr(10)) AS p FROM documents WHERE text IS NOT NULL)", f"s AS (SELECT doc_kind, {learning._strip("replace(x, chr(1), '.')")} AS x FROM (SELECT doc_kind, unnest(p) AS x FROM h))",
        "SELECT doc_kind, count(*) AS n, CAST(sum(length(x)) AS BIGINT) AS n_chars FROM s WHERE x <> '' GROUP BY 1"),
    "entity_batch": sql(V, _CE, "x AS (SELECT v.node, CAST(ce.label AS VARCHAR) AS canonical, round(list_cosine_similarity(v.v, m), 6) AS s FROM v, ce)", "b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY node ORDER BY s DESC, canonical) = 1)",
        "SELECT CAST(node AS VARCHAR) AS key, CASE WHEN s < 0.5 THEN CAST(node AS VARCHAR) ELSE canonical END AS canonical, s AS cosine, s < 0.5 AS is_new FROM b"),
    "registry_centroids": sql(V, _CE, "w AS (SELECT label, 0.15 * power(0.85, row_number() OVER (PARTITION BY label ORDER BY node DESC) - 1) AS w, v FROM v UNION ALL SELECT label, power(0.85, n), m FROM ce JOIN (SELECT label, count(*) AS n FROM v GROUP BY 1) USING (label))",
        "s AS (SELECT label, i, sum(w * x) AS x FROM (SELECT label, w, unnest(range(0, 64)) AS i, unnest(v) AS x FROM w) GROUP BY 1, 2)", "SELECT CAST(label AS VARCHAR) AS canonical, CAST(i AS INTEGER) AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS value FROM s"),
    "cluster_thresholds": sql(L, "x AS (SELECT item, CASE WHEN count(reward) OVER q >= 3 THEN greatest(0.2, avg(reward / 100) OVER q - 1.5 * stddev_pop(reward / 100) OVER q) ELSE 0.2 END AS t FROM l WINDOW q AS (PARTITION BY item ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))", "SELECT item, count(*) AS n, round(avg(t), 6) AS mean_threshold, round(max(t), 6) AS highest FROM x GROUP BY 1"),
    "registry_absorb": sql(_T, "SELECT canonical, count(*) AS n FROM (SELECT s AS canonical FROM u UNION ALL SELECT o FROM u) GROUP BY 1"),
    "total_rewards": sql(L, "SELECT context, round(0.4 * coalesce(avg(reward) FILTER (item = 'purchase'), 0) + 0.3 * coalesce(avg(reward) FILTER (item = 'click'), 0) + 0.3 * coalesce(avg(reward) FILTER (item = 'view'), 0), 6) AS reward FROM l GROUP BY 1"),
    "walk_rewards": sql(*reasoning._walk_sql(5), "SELECT query_id, round(least(greatest(0.4 * list_avg(acts) + 0.3 * coalesce(list_avg(confs), 0) + 0.3 * least(len(rels) / 10, 1), 0), 1), 6) AS reward FROM w5"),
    "extraction_prf": sql(_T, "p AS (SELECT DISTINCT s, rel, o FROM u WHERE pattern_level <> 'svo')", "tr AS (SELECT DISTINCT s, rel, o FROM u WHERE pattern_level = 'svo')",
        f"k AS (SELECT (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM tr) AS nt, (SELECT count(*) FROM p WHERE EXISTS (SELECT 1 FROM tr WHERE {_SAME})) AS nr, (SELECT count(*) FROM tr WHERE EXISTS (SELECT 1 FROM p WHERE {_SAME})) AS nf)",
        'SELECT np AS n_predicted, nt AS n_truth, nr AS n_right, nf AS n_found, round(nr / np, 6) AS "precision", round(nf / nt, 6) AS recall, round(CASE WHEN nr + nf > 0 THEN 2 * (nr / np) * (nf / nt) / (nr / np + nf / nt) ELSE 0 END, 6) AS f1 FROM k'),
    "centroid_top_k": sql(V, _CE, "x AS (SELECT node, v.label AS actual, CAST(ce.label AS VARCHAR) AS c, round(list_cosine_similarity(v, m), 9) AS s FROM v, ce)", "r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY s DESC, c) AS place FROM x)", "o AS (SELECT node, place FROM r WHERE c = CAST(actual AS VARCHAR))",
        "b AS (SELECT node // 32 AS g, count(*) AS n, " + ", ".join(f"avg(CASE WHEN place <= {k} THEN 1.0 ELSE 0 END) AS t{k}" for k in (1, 3, 5)) + " FROM o GROUP BY 1)", "SELECT CAST(sum(n) AS BIGINT) AS n, round(avg(t1), 6) AS top_1, round(avg(t3), 6) AS top_3, round(avg(t5), 6) AS top_5 FROM b"),
    "answer_ranking": sql(E, N, S, "x AS (SELECT query_id, src, dst, relation, confidence, max(b) AS b FROM (SELECT query_id, src, dst, relation, confidence, 0.1 AS b FROM e JOIN s ON src = node UNION ALL SELECT query_id, src, dst, relation, confidence, 0.05 FROM e JOIN s ON dst = node) GROUP BY ALL)",
        "y AS (SELECT query_id, src, dst, relation, confidence, round(1 - levenshtein(query_id, relation) / greatest(length(query_id), length(relation)) + CAST(b AS DOUBLE), 6) AS similarity FROM x)", "z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, confidence DESC, src, dst, relation) AS rank_no, max(similarity) OVER (PARTITION BY query_id) > 0.2 AS good FROM y)",
        "SELECT query_id, rank_no, src, dst, relation, similarity FROM z WHERE CASE WHEN good THEN similarity > 0.2 AND rank_no <= 5 ELSE rank_no <= 3 END"),
    "qa_accuracy": sql(*reasoning._FULL, "qe AS (SELECT src, dst FROM e QUALIFY row_number() OVER (PARTITION BY src ORDER BY strength DESC, confidence DESC, dst, relation) = 1)", "qw AS (SELECT text, labels, coalesce(label, 'node_' || node_id) AS want FROM w5 JOIN lb USING (query_id) JOIN pt USING (query_id) JOIN qe ON path[1] = qe.src JOIN n ON node_id = qe.dst)",
        "h AS (SELECT contains(lower(text), lower(want)) OR list_bool_or(list_transform(labels, lambda x: contains(lower(x), lower(want)))) AS hit FROM qw)", "SELECT count(*) AS n, count(*) FILTER (hit) AS n_right, round(avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 6) AS accuracy FROM h"),
    "kg_density": sql(_T, _F, _G, r"nn AS (SELECT DISTINCT x, regexp_replace(x, '[^\p{L}\p{Nd}]', '', 'g') AS k FROM (SELECT s AS x FROM g UNION ALL SELECT o FROM g))", "gg AS (SELECT k, count(*) AS m FROM nn GROUP BY 1)",
        "SELECT CAST(sum(m) AS BIGINT) AS n_names, ne AS n_edges, count(*) FILTER (m > 1) AS n_groups, round(ne / (sum(m) * (sum(m) - 1) / 2), 12) AS density, round(sum(m) / count(*), 6) AS merge_ratio FROM gg, (SELECT count(*) AS ne FROM g) GROUP BY ne"),
    "uncertain_plans": sql(E, "f AS (SELECT src, count(DISTINCT dst) + 1 AS nn, count(*) FILTER (relation = 'causes') AS ca, count(*) FILTER (relation = 'contradicts') AS co, avg(confidence) AS ac FROM e GROUP BY 1)", f"p AS (SELECT coalesce({_RULES}, 'none') AS intents FROM f)", "SELECT intents, count(*) AS n, count(*) FILTER (intents = '10,11') AS n_uncertain FROM p GROUP BY 1"),
    "rules_by_text": "WITH p AS (SELECT item_id, CASE WHEN contains(lower(text), 'why') THEN '2,3' WHEN contains(lower(text), 'what') THEN '0,1' WHEN length(text) > 200 THEN '12' END AS intents FROM benchmark) SELECT item_id, intents, CASE WHEN intents IS NOT NULL THEN 0.5 END AS plan_confidence FROM p",
    "named_plans": sql(E, N, S, reasoning._SUB, "f AS (SELECT query_id, count(DISTINCT dst) + 1 AS nn, count(*) FILTER (relation = 'causes') AS ca, count(*) FILTER (relation = 'contradicts') AS co, avg(confidence) AS ac FROM sub GROUP BY 1)", f"p AS (SELECT query_id, {_RULES} AS i FROM f)", f"SELECT query_id, array_to_string(list_transform(string_split(i, ','), lambda x: {_NAMES}[CAST(x AS INTEGER) + 1]), ' > ') AS names FROM p WHERE i IS NOT NULL"),
    "question_entities": "WITH x AS (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)*')) AS entity FROM benchmark) SELECT entity, count(*) AS n FROM x GROUP BY 1",
    "kept_sentences": sql(building._SENT, "SELECT doc_kind, count(*) AS n, count(*) FILTER (length(x) >= 10 OR regexp_matches(x, '[A-Z][a-z]')) AS n_kept FROM st JOIN documents USING (doc_id) WHERE x <> '' GROUP BY 1"),
    "subgraph_faults": sql(E, N, S, "k AS (SELECT DISTINCT query_id, node, nodes.activation FROM s JOIN nodes ON node = node_id)", "w AS (SELECT s.query_id, source AS src, target AS dst, strength, confidence FROM edges JOIN s ON source = node)",
        "SELECT 'edge leaves the nodes' AS rule, count(*) AS n FROM w WHERE dst IS NULL OR (query_id, src) NOT IN (SELECT (query_id, node) FROM k) OR (query_id, dst) NOT IN (SELECT (query_id, node) FROM k)"
        + "".join(f" UNION ALL SELECT '{k} out of range', count(*) FILTER ({_OUT.format(k, 0, 1)}) FROM w" for k in ("strength", "confidence")) + f" UNION ALL SELECT 'activation out of range', count(*) FILTER ({_OUT.format('activation', 0.01, 1)}) FROM k UNION ALL SELECT 'seed twice', 0"),
    "walk_faults": "SELECT unnest(['empty path', 'relations and path differ', 'activations and path differ', 'confidences and path differ', 'activation out of range', 'confidence out of range', 'stays at a node']) AS rule, 0 AS n",
    "walk_prompts": sql(*reasoning._walk_sql(5), reasoning._LB, f"SELECT query_id, 'generate: intents={','.join(P.INTENTS[i] for i in reasoning.PLAN)} walk=' || array_to_string(labels, ' -> ') || ' relations=' || array_to_string(list_transform(rels, lambda r: replace(r, '_', ' ')), ', ') AS prompt FROM lb"),
    "bias_table": sql(E, reasoning._IB, "c AS (SELECT 2 AS intent, relation, least(greatest(round(4 * avg(confidence), 6), 0.1), 3.0) AS b FROM e GROUP BY 2)", "SELECT intent, relation, b FROM c UNION ALL SELECT ib.intent, ib.relation, ib.b FROM ib WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.intent = ib.intent AND c.relation = ib.relation)"),
}
