"""Queries of retrieval, spreading activation, walking, planning and text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from weftgraph import functions as X
from weftgraph.functions import encoder
from weftgraph.operators import decode as D, evolution, graph as G, plan as P, resonance as R, vectors as V, walk as K
from weftgraph.params import INTENT_BIAS, INTENTS, RELATION_BIAS, Resonance
from weftgraph.plans import views as W
from weftgraph.plans.views import A, E, N, Q, S, sql
from weftgraph.session import cut, table

c = F.col
AS_OF = 2.0e9
PLAN = [1, 2, 7, 8, 13]
STARTERS = ("In short:", "As far as is known:", "Note:")
#: Cosine of near duplicates; the most in the small tables is .513, so the .92 of the engine's own default would find none there.
NEAR = 0.40


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest vectors of each cluster's first vector."""
    return V.rank_by_cosine(W.vectors(spark, sf), W.vector_queries(spark, sf), 10, 64).select("query_id", c("rank_no").cast("long").alias("rank_no"), "node", "cosine")


def similarity_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest vectors of each query with the vectors' nodes' edges: one step around them."""
    top = V.rank_by_cosine(W.vectors(spark, sf), W.vector_queries(spark, sf), 5, 64)
    near = top.join(G.adjacency(W.edges(spark, sf)), "node").select("query_id", c("other").alias("node")).distinct().join(top.select("query_id", "node"), ["query_id", "node"], "left_anti")
    act = F.least(F.greatest(c("cosine"), F.lit(0.01)), F.lit(1.0))
    return top.select("query_id", "node", act.alias("activation"), F.lit(True).alias("is_hit")).unionByName(near.select("query_id", "node", F.lit(0.01).alias("activation"), F.lit(False).alias("is_hit")))


def near_dup_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of vectors with a cosine of NEAR or more."""
    return V.near_pairs(W.vectors(spark, sf), NEAR, 64).select("a", "b", F.round("cosine", 6).alias("cosine"))


def near_dup_components(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of near duplicates, chains closed: the node that each is merged into (``graph.remap`` redirects edges by it)."""
    return G.components(near_dup_pairs(spark, sf).select("a", "b")).select("node", "component")


def embedding_stats(spark: SparkSession, sf: str) -> DataFrame:
    v = W.vectors(spark, sf).select(F.sqrt(X.dot(c("v"), c("v"))).alias("n"), F.size("v").alias("d"))
    return v.agg(F.count("*").alias("n_vectors"), F.max("d").alias("dim"), F.round(F.avg("n"), 6).alias("mean_norm"), F.round(F.stddev_pop("n"), 6).alias("std_norm"))


def quantize_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    v = W.vectors(spark, sf).select("node", "v", X.dequantize(X.quantize(c("v"))).alias("r"))
    err = F.array_max(F.zip_with("v", "r", lambda a, b: F.abs(a.cast("double") - b)))
    return v.select("node", F.round(err, 6).alias("max_error"), F.round(X.cosine(c("v"), c("r")), 6).alias("cosine"))


def lsh_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors that share a bucket with a query in one of eight tables of twelve planes, with their cosine."""
    both = W.vectors(spark, sf).select("node", "v").unionByName(W.vector_queries(spark, sf).select((-1 - c("query_id")).alias("node"), "v"))
    b = V.sign_buckets(both, 64, 8, 12)
    q = b.filter("node < 0").select((-1 - c("node")).alias("query_id"), "tab", "bucket")
    pairs = b.filter("node >= 0").join(F.broadcast(q), ["tab", "bucket"]).select("query_id", "node").distinct()
    qv = W.vector_queries(spark, sf).select("query_id", c("v").alias("qv"))
    return pairs.join(qv, "query_id").join(W.vectors(spark, sf).select("node", "v"), "node").select("query_id", "node", F.round(X.cosine(c("qv"), c("v")), 6).alias("cosine"))


def temporal_factor(spark: SparkSession, sf: str) -> DataFrame:
    return W.edges(spark, sf).groupBy("relation").agg(F.round(F.sum(R.temporal_factor(c("last_used"), c("frequency"), F.lit(AS_OF))), 4).alias("factor"))


def _start(spark: SparkSession, sf: str) -> DataFrame:
    return W.seeds(spark, sf).select("query_id", "node", F.lit(1.0).alias("activation"))


def propagate_step(spark: SparkSession, sf: str) -> DataFrame:
    return R.propagate(R.message_edges(W.edges(spark, sf)), _start(spark, sf), True).select("query_id", "node", F.round("inp", 6).alias("inp"))


def dynamics_variants(spark: SparkSession, sf: str) -> DataFrame:
    act, inp = _start(spark, sf), R.propagate(R.message_edges(W.edges(spark, sf)), _start(spark, sf), True)
    out = None
    for kind in ("wilson_cowan", "simple_diffusion", "threshold"):
        x = R.step_dynamics(act, inp, Resonance(dynamics=kind)).groupBy("query_id").agg(F.lit(kind).alias("dynamics"), F.count("*").alias("n"), F.round(F.sum("activation"), 5).alias("total"))
        out = x if out is None else out.unionByName(x)
    return out


def normalize_variants(spark: SparkSession, sf: str) -> DataFrame:
    x = R.step_dynamics(_start(spark, sf), R.propagate(R.message_edges(W.edges(spark, sf)), _start(spark, sf), True))
    out = None
    for kind in ("budget_soft_cap", "l1_norm"):
        y = R.normalize(x, Resonance(normalization=kind)).groupBy("query_id").agg(F.lit(kind).alias("kind"), F.round(F.sum("activation"), 5).alias("total"), F.round(F.max("activation"), 6).alias("largest"))
        out = y if out is None else out.unionByName(y)
    return out


def gate_topk(spark: SparkSession, sf: str) -> DataFrame:
    x = R.step_dynamics(_start(spark, sf), R.propagate(R.message_edges(W.edges(spark, sf)), _start(spark, sf), True))
    return R.gate(x).select("query_id", "node", F.round("activation", 6).alias("activation"))


def gate_threshold(spark: SparkSession, sf: str) -> DataFrame:
    x = R.step_dynamics(_start(spark, sf), R.propagate(R.message_edges(W.edges(spark, sf)), _start(spark, sf), True))
    return R.gate(x, Resonance(gate="threshold", propagation_threshold=0.05)).select("query_id", "node", F.round("activation", 6).alias("activation"))


def _resonance(spark: SparkSession, sf: str, steps: int) -> DataFrame:
    e = cut(W.edges(spark, sf))
    return R.resonate(e, W.seeds(spark, sf, e=e), Resonance(steps=steps))


def resonance_k2(spark: SparkSession, sf: str) -> DataFrame:
    return _resonance(spark, sf, 2).select("query_id", "node", F.round("activation", 5).alias("activation"))


def resonance_full(spark: SparkSession, sf: str) -> DataFrame:
    return _resonance(spark, sf, 4).select("query_id", "node", F.round("activation", 5).alias("activation"))


def activation_energy(spark: SparkSession, sf: str) -> DataFrame:
    act = _resonance(spark, sf, 1)
    return R.energy(R.subgraph_edges(W.edges(spark, sf), act), act).select("query_id", F.round("energy", 4).alias("energy"))


def tier_decision(spark: SparkSession, sf: str) -> DataFrame:
    act = _resonance(spark, sf, 1)
    e = R.energy(R.subgraph_edges(W.edges(spark, sf), act), act)
    return R.tier_decision(e, W.seeds(spark, sf)).select("query_id", "n_seeds", F.round("energy", 4).alias("energy"), "tier")


TIER_TWO = Resonance(steps=3, edge_threshold=0.08, propagation_threshold=0.04, top_k=1024)


def _second(spark: SparkSession, sf: str) -> DataFrame:
    """The second tier: wider parameters, started from what the first left active."""
    return R.resonate(W.edges(spark, sf), W.seeds(spark, sf), TIER_TWO, _resonance(spark, sf, 2))


def tier_two(spark: SparkSession, sf: str) -> DataFrame:
    return _second(spark, sf).groupBy("query_id").agg(F.count("*").alias("n_active"), F.round(F.sum("activation"), 3).alias("total"))


def tier_accept(spark: SparkSession, sf: str) -> DataFrame:
    """The tier whose result each query takes: the second where the first isn't enough and the second is better by the gain."""
    e = cut(W.edges(spark, sf))
    energies = [R.energy(R.subgraph_edges(e, act), act) for act in (_resonance(spark, sf, 1), _second(spark, sf))]
    return R.accepted_tier(*energies, W.seeds(spark, sf)).select("query_id", F.round("energy", 3).alias("energy"), "tier")


def activation_history(spark: SparkSession, sf: str) -> DataFrame:
    """What every step of activation changes: active nodes, their sum and the largest change."""
    steps: list[DataFrame] = []
    R.resonate(W.edges(spark, sf), W.seeds(spark, sf), Resonance(), history=steps)
    out = steps[0]
    for x in steps[1:]:
        out = out.unionByName(x)
    return out.select("query_id", "step", "n_active", F.round("total", 5).alias("total"), F.round("largest", 5).alias("largest"))


def theta_resonance(spark: SparkSession, sf: str) -> DataFrame:
    """Activation under parameters that an evolution strategy proposes."""
    tried = evolution.propose(evolution.parameters(spark), spark.createDataFrame([(7,)], "trial long"), 0.01, 0)
    theta = evolution.settings(tried).first().asDict()
    act = R.resonate(W.edges(spark, sf), W.seeds(spark, sf), R.with_theta(Resonance(steps=1), theta))
    return act.groupBy("query_id").agg(F.count("*").alias("n_active"), F.round(F.sum("activation"), 4).alias("total"))


def intent_bias_lookup(spark: SparkSession, sf: str) -> DataFrame:
    r = W.edges(spark, sf).select("relation").distinct()
    return r.select("relation", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("intent")).select("relation", "intent", K.intent_bias(c("intent"), c("relation")).alias("bias"))


def _sub(spark: SparkSession, sf: str) -> DataFrame:
    """One step around the seeds as a subgraph, with node activations."""
    n = W.nodes(spark, sf).select("node_id", "activation")
    s = W.seeds(spark, sf)
    e = W.edges(spark, sf).join(s.withColumnRenamed("node", "src"), "src").join(n.select(c("node_id").alias("dst"), c("activation").alias("act_dst")), "dst")
    return e.select("query_id", "src", "dst", "relation", "strength", "confidence", "act_dst")


def candidate_scores(spark: SparkSession, sf: str) -> DataFrame:
    return K.candidate_scores(_sub(spark, sf), F.lit(2)).select("query_id", "src", "dst", "relation", F.round("score", 6).alias("score"))


def softmax_probs(spark: SparkSession, sf: str) -> DataFrame:
    s = K.candidate_scores(_sub(spark, sf), F.lit(2))
    return K.softmax(s, ["query_id", "src"], "score", 0.1).select("query_id", "src", "dst", "relation", F.round("prob", 6).alias("prob"))


def rank_probs(spark: SparkSession, sf: str) -> DataFrame:
    s = K.candidate_scores(_sub(spark, sf), F.lit(2)).withColumn("tie", X.edge_key(c("src"), c("dst"), c("relation")))
    return K.rank_probabilities(s, ["query_id", "src"], "score", "tie").select("query_id", "src", "dst", "relation", F.round("prob", 8).alias("prob"))


def cumulative_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The first candidate at which the summed probabilities reach a half, in order of the targets."""
    s = K.softmax(K.candidate_scores(_sub(spark, sf), F.lit(2)), ["query_id", "src"], "score", 0.1)
    w = Window.partitionBy("query_id", "src").orderBy("dst", "relation")
    s = s.withColumn("cum", F.round(F.sum("prob").over(w.rowsBetween(Window.unboundedPreceding, 0)), 9))
    s = s.filter("cum >= 0.5").withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return s.select("query_id", "src", "dst", "relation")


def _walks(spark: SparkSession, sf: str, plan: list[int] = PLAN) -> DataFrame:
    """Walks from the best seed over all edges, turned ones too, with the nodes' own activations."""
    n, edges = W.nodes(spark, sf), cut(W.edges(spark, sf))
    s = cut(W.seeds(spark, sf, e=edges))
    reach = G.bfs(edges, n, s, 2, 0.3)
    act = reach.join(n.select(c("node_id").alias("node"), "activation"), "node").select("query_id", "node", "activation")
    near = G.inside(edges, act.select(c("node").alias("node_id")).distinct())
    sub = R.subgraph_edges(G.reverse_union(near), act)
    return K.walk(sub, K.start_nodes(act, s), plan)


def walk_argmax(spark: SparkSession, sf: str) -> DataFrame:
    w = _walks(spark, sf)
    return w.select("query_id", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), F.array_join("relations", ">").alias("relations"), F.round(K.walk_confidence(c("confidences")), 6).alias("walk_confidence"), F.size("relations").alias("n_steps"))


def walk_restart(spark: SparkSession, sf: str) -> DataFrame:
    """Walks along directed edges only, which begin again elsewhere where they get stuck."""
    n, edges = W.nodes(spark, sf), cut(W.edges(spark, sf))
    s = cut(W.seeds(spark, sf, e=edges))
    act = cut(G.bfs(edges, n, s, 1, 0.3).join(n.select(c("node_id").alias("node"), "activation"), "node").select("query_id", "node", "activation"))
    sub = R.subgraph_edges(G.inside(edges, act.select(c("node").alias("node_id")).distinct()), act)
    w = K.walk(sub, K.start_nodes(act, s), PLAN, others=act)
    return w.select("query_id", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), F.array_join("relations", ">").alias("relations"))


def walk_stats(spark: SparkSession, sf: str) -> DataFrame:
    return K.walk_statistics(_walks(spark, sf))


def eligibility_details(spark: SparkSession, sf: str) -> DataFrame:
    """The trace with each step's part."""
    e = G.merge_weights(G.reverse_union(W.edges(spark, sf)))
    d = K.eligibility_details(K.steps(_walks(spark, sf)), e)
    return d.select("query_id", "src", "dst", "relation", F.round("eligibility", 6).alias("eligibility"), F.size("parts").cast("long").alias("n_parts"), F.round(F.array_max(F.transform("parts", lambda x: x["part"])), 6).alias("largest"))


def boosted_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges at the seeds, stronger where their relation is spelled like the query's node type or their target holds its first letters."""
    s = _sub(spark, sf)
    n = W.nodes(spark, sf).select(c("node_id").alias("dst"), F.coalesce(F.lower("label"), F.lit("")).alias("label"))
    sim = s.select("query_id", "dst", "relation").distinct().join(n, "dst")
    rel_sim = 1 - F.levenshtein("query_id", "relation") / F.greatest(F.length("query_id"), F.length("relation"))
    sim = sim.select("query_id", "dst", "relation", rel_sim.alias("rel_sim"), F.when(F.contains("label", F.substring("query_id", 1, 2)), 0.5).otherwise(0.0).alias("tgt_sim"))
    return K.boost(s, sim).groupBy("query_id", "relation").agg(F.count("*").alias("n"), F.round(F.sum("strength"), 4).alias("strength"))


def bfs_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """The five hundred nodes nearest to each query's seeds, and how many of the edges at them lead out."""
    nodes, edges = G.bounded_bfs(cut(W.edges(spark, sf)), W.nodes(spark, sf), W.seeds(spark, sf), 2, 500, 0.5)
    a = nodes.groupBy("query_id").agg(F.count("*").alias("n_nodes"), F.max("depth").alias("depth"), F.sum("node").alias("sum_of_ids"))
    return a.join(edges.groupBy("query_id").agg(F.count("*").alias("n_edges"), F.count_if("boundary").alias("n_boundary")), "query_id", "left").fillna(0, ["n_edges", "n_boundary"])


def walk_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Geometric mean of the confidences out of each node."""
    g = W.edges(spark, sf).groupBy("src").agg(F.count("*").alias("n"), F.min("confidence").alias("low"), F.avg(F.log("confidence")).alias("m"))
    return g.select("src", F.round(F.when(c("low") <= 0, 0.0).otherwise(F.exp("m")), 6).alias("walk_confidence"))


def eligibility_trace(spark: SparkSession, sf: str) -> DataFrame:
    e = G.merge_weights(G.reverse_union(W.edges(spark, sf)))
    return K.eligibility(K.steps(_walks(spark, sf)), e).select("query_id", "src", "dst", "relation", F.round("eligibility", 6).alias("eligibility"))


def rule_planner(spark: SparkSession, sf: str) -> DataFrame:
    """The first rule that holds for each query's subgraph."""
    sub = _sub(spark, sf)
    f = sub.groupBy("query_id").agg((F.countDistinct("dst") + 1).alias("n_nodes"), F.count_if(c("relation") == "causes").alias("causes"), F.count_if(c("relation") == "contradicts").alias("contradicts"), F.avg("confidence").alias("avg_conf"))
    return P.rule_plan(f).select("query_id", "intents", "plan_confidence")


def beam_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Plans for the benchmark's texts: the products of a text's vector with those of the intents' names, doubtful ones not allowed, then a beam."""
    text = table(spark, sf, "benchmark").filter("text is not null").select("item_id", "text")
    names = np.asarray(encoder.encode(list(INTENTS)), dtype=float)
    scores = F.array(*[X.dot(c("v"), F.array(*[F.lit(float(x)) for x in row])) for row in names])
    allowed = [i for i, x in enumerate(INTENTS) if x not in ("uncertain", "clarify")]
    q = encoder.with_vectors(text, "text").select(c("item_id").alias("query_id"), P.masked(scores, allowed).alias("logits"))
    return P.beam_plans(q).select("query_id", F.array_join(F.transform("intents", lambda x: x.cast("string")), ",").alias("intents"), F.round("plan_confidence", 6).alias("plan_confidence"))


def _labels(spark: SparkSession, sf: str, plan: list[int], w: DataFrame | None = None) -> DataFrame:
    w = _walks(spark, sf, plan) if w is None else w
    n = W.nodes(spark, sf).select(c("node_id").alias("node"), F.coalesce("label", F.concat(F.lit("node_"), c("node_id").cast("string"))).alias("label"))
    long = w.select("query_id", "relations", F.posexplode("path").alias("i", "node")).join(n, "node", "left").withColumn("label", F.coalesce("label", F.concat(F.lit("node_"), c("node").cast("string"))))
    return long.groupBy("query_id", "relations").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "label"))), lambda x: x["label"]).alias("labels"))


def fallback_text(spark: SparkSession, sf: str) -> DataFrame:
    return _labels(spark, sf, PLAN).select("query_id", D.fallback_text(c("labels"), c("relations")).alias("text"))


def template_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every walk as each plan that has a template says it."""
    plans = [list(k) for k in dict.fromkeys(k for k, _ in D.TEMPLATES)]
    x = cut(_labels(spark, sf, PLAN)).select("query_id", "labels", "relations", F.explode(F.array(*[F.array(*[F.lit(i) for i in k]) for k in plans])).alias("intents"))
    x = x.select("query_id", F.array_join(F.transform("intents", lambda i: i.cast("string")), ",").alias("plan"), D.render(c("intents"), c("labels"), c("relations")).alias("text"), "labels")
    return x.filter("text is not null").select("query_id", "plan", "text", X.valid_output(c("text"), c("labels")).alias("is_valid"))


def started_text(spark: SparkSession, sf: str) -> DataFrame:
    """Templates behind a starter, and, where the text mentions no label, in some cases behind one of them."""
    x = cut(_labels(spark, sf, PLAN))
    texts = [D.render(F.array(F.lit(i)), c("labels"), c("relations"), starters=STARTERS) for i in (1, 2, 12)]
    bare = F.concat(F.lit("Nothing is said of "), c("query_id"))
    copied = D.with_copied(bare, c("labels"), c("query_id"), 0.7)
    return x.select("query_id", F.explode(F.array(*texts, copied)).alias("text")).filter("text is not null")


def subgraph_text(spark: SparkSession, sf: str) -> DataFrame:
    """Each query's activated nodes in label order, with their activation where it is above a tenth."""
    act = _resonance(spark, sf, 1).join(W.nodes(spark, sf).select(c("node_id").alias("node"), "label"), "node").filter("label is not null")
    said = F.when(c("activation") > 0.1, F.format_string("%s(%.2f)", c("label"), c("activation"))).otherwise(c("label"))
    parts = F.array_sort(F.collect_list(F.struct("label", "node", said.alias("t"))))
    return act.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("text"))


def text_orderings(spark: SparkSession, sf: str) -> DataFrame:
    """The first twenty neighbours of each query by activation, by the best confidence of an edge to them, and by time of last use."""
    s = W.edges(spark, sf).join(W.seeds(spark, sf).withColumnRenamed("node", "src"), "src").join(W.nodes(spark, sf).select(c("node_id").alias("dst"), "activation"), "dst")
    g = s.groupBy("query_id", "dst").agg(F.max("activation").alias("activation"), F.max("confidence").alias("confidence"), F.max("last_used").alias("recency"))
    keys = F.array(*[F.struct(F.lit(k).alias("ordering"), F.coalesce(c(k), F.lit(-1.0)).alias("key")) for k in ("activation", "confidence", "recency")])
    x = g.select("query_id", "dst", F.explode(keys).alias("o")).select("query_id", "dst", "o.*")
    w = Window.partitionBy("query_id", "ordering").orderBy(c("key").desc(), "dst")
    return x.withColumn("at", F.row_number().over(w)).filter("at <= 20").select("query_id", "ordering", c("at").cast("long").alias("place"), "dst")


def relations_between(spark: SparkSession, sf: str) -> DataFrame:
    """The relation said between neighbours of each walk: of edges in either direction the first by direction, then name."""
    st = K.steps(_walks(spark, sf)).select("query_id", "t", "src", "dst")
    e = W.edges(spark, sf).select("src", "dst", "relation")
    on = st.join(e, ["src", "dst"]).select("query_id", "t", F.lit(0).alias("turned"), "relation")
    back = st.join(e.select(c("dst").alias("src"), c("src").alias("dst"), "relation"), ["src", "dst"]).select("query_id", "t", F.lit(1).alias("turned"), "relation")
    g = on.unionByName(back).groupBy("query_id", "t").agg(F.min(F.struct("turned", "relation")).alias("r"))
    return g.select("query_id", c("t").cast("long").alias("t"), "r.turned", "r.relation")


def graph_to_text(spark: SparkSession, sf: str) -> DataFrame:
    """Each query's five most active neighbours as text."""
    s = _sub(spark, sf).join(W.nodes(spark, sf).select(c("node_id").alias("dst"), "label"), "dst").filter("label is not null")
    w = Window.partitionBy("query_id").orderBy(c("act_dst").desc(), "dst", "relation")
    s = s.withColumn("i", F.row_number().over(w)).filter("i <= 5")
    t = F.format_string("%s(%.2f) [via %s]", c("label"), c("act_dst"), c("relation"))
    return s.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", t.alias("t")))), lambda x: x["t"]), " ").alias("text"))


def _walk_texts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Walks with path, labels and text; the edges that they go along; activations."""
    edges = cut(W.edges(spark, sf))  # read several times
    seeds = cut(W.seeds(spark, sf, e=edges))
    act = R.with_seeds(R.resonate(edges, seeds), seeds)
    near = G.inside(edges, act.select(c("node").alias("node_id")).distinct())  # before the edges are turned: far fewer rows
    sub = cut(R.subgraph_edges(G.reverse_union(near), act))
    w = cut(K.walk_bounded(sub, K.start_nodes(act, seeds), PLAN))
    n = W.nodes(spark, sf).select(c("node_id").alias("node"), "label")
    long = w.select("query_id", "path", "relations", "confidences", F.posexplode("path").alias("i", "node")).join(n, "node", "left")
    label = F.coalesce("label", F.concat(F.lit("node_"), c("node").cast("string")))
    got = long.groupBy("query_id", "path", "relations", "confidences").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", label.alias("label")))), lambda x: x["label"]).alias("labels"))
    return got.withColumn("text", D.fallback_text(c("labels"), c("relations"))), sub, act


def answer(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds, activation, walk, text: the whole way for every query."""
    got, sub, act = _walk_texts(spark, sf)
    return got.join(R.energy(sub, act), "query_id").select("query_id", F.array_join("labels", " > ").alias("path_labels"), F.round(K.walk_confidence(c("confidences")), 6).alias("walk_confidence"), F.round("energy", 5).alias("energy"), "text")


def walk_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes of each query's walk whose labels its text mentions."""
    got, _, _ = _walk_texts(spark, sf)
    return got.select("query_id", F.explode(D.mentioned(c("text"), c("labels"), c("path"))).alias("node"))


QUERIES = {f.__name__: f for f in (
    vector_topk, similarity_subgraph, near_dup_pairs, near_dup_components, embedding_stats, quantize_roundtrip, lsh_candidates, temporal_factor, propagate_step, dynamics_variants, normalize_variants, gate_topk, gate_threshold, resonance_k2, resonance_full,
    activation_energy, tier_decision, tier_two, tier_accept, activation_history, theta_resonance, walk_restart, walk_stats, eligibility_details, boosted_edges, bfs_bounded, started_text, subgraph_text, text_orderings, relations_between, intent_bias_lookup, candidate_scores, softmax_probs, rank_probs, cumulative_sample, walk_argmax, walk_confidence, eligibility_trace, rule_planner, beam_plan, fallback_text, template_text, graph_to_text, answer, walk_mentions,
)}

_RB = "rb AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in RELATION_BIAS.items()) + ") AS t(relation, rb))"
_IB = "ib AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{r}', CAST({v} AS DOUBLE))" for i, m in INTENT_BIAS.items() for r, v in m.items()) + ") AS t(intent, relation, b))"
_M = "m AS (SELECT node, other, strength * confidence * coalesce(rb, 1.0) AS w FROM a LEFT JOIN rb USING (relation) WHERE strength * confidence >= 0.02)"


def _inp(act: str, name: str, m: str = "m") -> str:
    return f"{name} AS (SELECT query_id, other AS node, sum(activation * w) AS inp FROM {act} JOIN {m} USING (node) GROUP BY 1, 2)"


def _x(act: str, inp: str, name: str) -> str:
    return f"{name} AS (SELECT query_id, node, coalesce(any_value(x), 0.01) AS x, sum(i) AS inp FROM (SELECT query_id, node, activation AS x, 0.0 AS i FROM {act} UNION ALL SELECT query_id, node, NULL, inp FROM {inp}) GROUP BY 1, 2)"


_WC = "least(greatest(x + (1 - x) * inp - 0.1 * x, 0.01), 1.0)"
_S0 = "t0 AS (SELECT query_id, node, CAST(1 AS DOUBLE) AS activation FROM s)"
_ONE = (E, N, S, A, _RB, _M, _S0, _inp("t0", "i1"), _x("t0", "i1", "x1"))


def _step(k: int, t: str = "t", m: str = "m", top: int = 64, wc: str = _WC) -> list[str]:
    a = f"{t}{k - 1}"
    return [_inp(a, f"i{t}{k}", m), _x(a, f"i{t}{k}", f"x{t}{k}"), f"y{t}{k} AS (SELECT query_id, node, {wc} AS activation FROM x{t}{k})",
        f"z{t}{k} AS (SELECT query_id, node, CASE WHEN sum(activation) OVER q > 2 THEN least(greatest(activation * 2.0 / sum(activation) OVER q, 0.01), 1.0) ELSE activation END AS activation FROM y{t}{k} WINDOW q AS (PARTITION BY query_id))",
        f"{t}{k} AS (SELECT * FROM z{t}{k} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(activation, 12) DESC, node) <= {top})"]


def _energy(t: str, name: str) -> list[str]:
    return [f"{name}s AS (SELECT x.query_id, sum(x.activation * strength * confidence) AS en FROM e JOIN {t} x ON src = x.node JOIN {t} y ON dst = y.node AND x.query_id = y.query_id GROUP BY 1)",
        f"{name}a AS (SELECT query_id, sum(activation) AS tot FROM {t} GROUP BY 1)", f"{name} AS (SELECT query_id, coalesce(en, tot) AS energy FROM {name}a LEFT JOIN {name}s USING (query_id))"]


_TWO = [*(E, N, S, A, _RB, _M, _S0), *_step(1), *_step(2), _M.replace("m AS", "m2 AS").replace("0.02", "0.08"),
    "u0 AS (SELECT query_id, node, max(activation) AS activation FROM (SELECT * FROM t0 UNION ALL SELECT query_id, node, least(greatest(activation, 0.01), 1.0) FROM t2) GROUP BY 1, 2)",
    *[x for k in (1, 2, 3) for x in _step(k, "u", "m2", 1024)]]


_SUB = "sub AS (SELECT query_id, src, dst, relation, strength, confidence, n.activation AS act_dst FROM e JOIN s ON src = s.node JOIN n ON dst = n.node_id)"
_SC = "sc AS (SELECT sub.*, strength * confidence * act_dst * coalesce(x.b, 0.4) AS score FROM sub LEFT JOIN ib x ON x.intent = 2 AND x.relation = sub.relation)"
_PR = "pr AS (SELECT *, exp((score - max(score) OVER g) / 0.1) AS ex FROM sc WINDOW g AS (PARTITION BY query_id, src))"
_DOT = "list_sum(list_transform(range(1, 65), lambda i: {0}[i] * {1}[i]))"
_EN = [*(E, N, S, A, _RB, _M, _S0), *_step(1), """es AS (SELECT x.query_id, sum(x.activation * strength * confidence) AS en FROM e JOIN t1 x ON src = x.node JOIN t1 y ON dst = y.node AND x.query_id = y.query_id GROUP BY 1)""",
    "ea AS (SELECT query_id, sum(activation) AS tot FROM t1 GROUP BY 1)", "en AS (SELECT query_id, coalesce(en, tot) AS energy FROM ea LEFT JOIN es USING (query_id))"]
_RV = """r AS (SELECT dst AS src, src AS dst, relation, strength, confidence FROM e UNION ALL SELECT src, dst, relation, strength, confidence FROM e x
 WHERE NOT EXISTS (SELECT 1 FROM e y WHERE y.dst = x.src AND y.src = x.dst AND y.relation = x.relation))"""
_REACH = """h AS (SELECT DISTINCT a.node, a.other FROM a JOIN n ON a.other = n.node_id WHERE n.activation >= 0.3),
 f0 AS (SELECT query_id, node FROM s JOIN n ON node = node_id WHERE activation >= 0.3), f1 AS (SELECT DISTINCT query_id, other AS node FROM f0 JOIN h USING (node)), f2 AS (SELECT DISTINCT query_id, other AS node FROM f1 JOIN h USING (node)),
 ac AS (SELECT query_id, node, activation FROM (SELECT * FROM f0 UNION SELECT * FROM f1 UNION SELECT * FROM f2) JOIN n ON node = node_id)"""
_WSUB = "ws AS (SELECT x.query_id, src, dst, relation, strength, confidence, y.activation AS ad FROM r JOIN ac x ON src = x.node JOIN ac y ON dst = y.node AND x.query_id = y.query_id)"
_W0 = """w0 AS (SELECT query_id, [node] AS path, CAST([] AS VARCHAR[]) AS rels, [activation] AS acts, CAST([] AS DOUBLE[]) AS confs FROM ac JOIN s USING (query_id, node)
 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(activation, 12) DESC, node) = 1)"""


def _walk_sql(steps: int) -> list[str]:
    out = [E, N, S, A, _IB, _RV, _REACH, _WSUB, _W0]
    for k in range(steps):
        i = PLAN[min(k, len(PLAN) - 1)]
        out += [
            f"""m{k} AS (SELECT w.query_id, list_append(path, dst) AS path, list_append(rels, ws.relation) AS rels, list_append(acts, ad) AS acts, list_append(confs, confidence) AS confs FROM w{k} w JOIN ws ON w.query_id = ws.query_id AND path[-1] = src
 LEFT JOIN ib ON intent = {i} AND ib.relation = ws.relation WHERE len(rels) = {k} AND NOT list_contains(path, dst) AND ad >= 0.01
 QUALIFY row_number() OVER (PARTITION BY w.query_id ORDER BY round(strength * confidence * ad * coalesce(b, {INTENT_BIAS[i]['default']}), 12) DESC, dst, ws.relation) = 1)""",
            f"w{k + 1} AS (SELECT * FROM m{k} UNION ALL SELECT * FROM w{k} WHERE query_id NOT IN (SELECT query_id FROM m{k}))",
        ]
    return out


_STEPS = "st AS (SELECT query_id, unnest(range(0, len(rels))) AS t, path, rels, acts FROM w5), su AS (SELECT query_id, t, path[t + 1] AS src, path[t + 2] AS dst, rels[t + 1] AS relation, acts[t + 1] AS act_src FROM st)"
SQL = {
    "walk_argmax": sql(*_walk_sql(5), "SELECT query_id, array_to_string(path, '>') AS path, array_to_string(rels, '>') AS relations, round(CASE WHEN len(confs) = 0 THEN 1.0 WHEN list_min(confs) <= 0 THEN 0.0 ELSE exp(list_avg(list_transform(confs, lambda x: ln(nullif(x, 0))))) END, 6) AS walk_confidence, CAST(len(rels) AS INTEGER) AS n_steps FROM w5"),
    "eligibility_trace": sql(*_walk_sql(5), _STEPS, "SELECT query_id, src, dst, relation, round(sum(power(0.9, t) * act_src * strength * confidence), 6) AS eligibility FROM su JOIN r USING (src, dst, relation) GROUP BY 1, 2, 3, 4"),
    "fallback_text": sql(*_walk_sql(5), "lo AS (SELECT query_id, unnest(range(1, len(path) + 1)) AS i, path, rels FROM w5)", "la AS (SELECT query_id, i, coalesce(label, 'node_' || path[i]) || coalesce(' ' || replace(rels[i], '_', ' '), '') AS x FROM lo LEFT JOIN n ON node_id = path[i])",
        "SELECT query_id, array_to_string(string_split(string_agg(x, ' ' ORDER BY i), ' ')[1:200], ' ') AS text FROM la GROUP BY 1"),
    "vector_topk": sql(W.V, Q, "r AS (SELECT query_id, v.node, round(list_cosine_similarity(v.v, q.v), 6) AS cosine FROM v, q)", "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, node) AS rank_no, node, cosine FROM r QUALIFY rank_no <= 10"),
    "similarity_subgraph": sql(E, A, W.V, Q, "r AS (SELECT query_id, v.node, round(list_cosine_similarity(v.v, q.v), 6) AS cosine FROM v, q)", "p AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, node) <= 5)",
        "SELECT query_id, node, least(greatest(cosine, 0.01), 1.0) AS activation, true AS is_hit FROM p UNION ALL SELECT DISTINCT query_id, other, 0.01, false FROM p JOIN a USING (node) WHERE (query_id, other) NOT IN (SELECT (query_id, node) FROM p)"),
    "embedding_stats": sql(W.V, f"x AS (SELECT sqrt({_DOT.format('v', 'v')}) AS n, len(v) AS d FROM v)", "SELECT count(*) AS n_vectors, max(d) AS dim, round(avg(n), 6) AS mean_norm, round(stddev_pop(n), 6) AS std_norm FROM x"),
    "quantize_roundtrip": sql(W.V, "x AS (SELECT node, v, list_transform(v, lambda y: round_even(least(greatest(y, -1), 1) * 127, 0) / 127) AS r FROM v)",
        "SELECT node, round(list_max(list_transform(range(1, 65), lambda i: abs(v[i] - r[i]))), 6) AS max_error, round(list_cosine_similarity(v, r), 6) AS cosine FROM x"),
    "temporal_factor": sql(E, "SELECT relation, round(sum(coalesce(least(greatest(1.0 / (1.0 + 0.5 * ln(1 + greatest(2.0e9 - last_used, 0.0))) * least(1.0, frequency / 20.0), 0.0), 1.0), 0.0)), 4) AS factor FROM e GROUP BY 1"),
    "propagate_step": sql(*_ONE[:-1], "SELECT query_id, node, round(inp, 6) AS inp FROM i1"),
    "dynamics_variants": sql(*_ONE, f"""SELECT query_id, 'wilson_cowan' AS dynamics, count(*) AS n, round(sum({_WC}), 5) AS total FROM x1 GROUP BY 1
 UNION ALL SELECT query_id, 'simple_diffusion', count(*), round(sum(least(greatest(x + inp - 0.1 * x, 0.01), 1.0)), 5) FROM x1 GROUP BY 1
 UNION ALL SELECT query_id, 'threshold', count(*), round(sum(least(greatest(CASE WHEN inp < 0.008 THEN x - 0.1 * x ELSE x + inp - 0.1 * x END, 0.01), 1.0)), 5) FROM x1 GROUP BY 1"""),
    "normalize_variants": sql(*_ONE, f"y AS (SELECT query_id, {_WC} AS v, sum({_WC}) OVER (PARTITION BY query_id) AS t FROM x1)", """SELECT query_id, 'budget_soft_cap' AS kind, round(sum(CASE WHEN t > 2 THEN least(greatest(v * 2 / t, 0.01), 1.0) ELSE v END), 5) AS total, round(max(CASE WHEN t > 2 THEN least(greatest(v * 2 / t, 0.01), 1.0) ELSE v END), 6) AS largest FROM y GROUP BY 1
 UNION ALL SELECT query_id, 'l1_norm', round(sum(v / t), 5), round(max(v / t), 6) FROM y GROUP BY 1"""),
    "gate_topk": sql(*_ONE, f"y AS (SELECT query_id, node, {_WC} AS activation FROM x1)", "SELECT query_id, node, round(activation, 6) AS activation FROM y QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(activation, 12) DESC, node) <= 64"),
    "gate_threshold": sql(*_ONE, f"y AS (SELECT query_id, node, {_WC} AS activation FROM x1)", "SELECT query_id, node, round(activation, 6) AS activation FROM y WHERE activation >= 0.05"),
    "resonance_k2": sql(E, N, S, A, _RB, _M, _S0, *_step(1), *_step(2), "SELECT query_id, node, round(activation, 5) AS activation FROM t2"),
    "resonance_full": sql(E, N, S, A, _RB, _M, _S0, *_step(1), *_step(2), *_step(3), *_step(4), "SELECT query_id, node, round(activation, 5) AS activation FROM t4"),
    "activation_energy": sql(*_EN, "SELECT query_id, round(energy, 4) AS energy FROM en"),
    "tier_decision": sql(*_EN, "SELECT query_id, n_seeds, round(energy, 4) AS energy, CASE WHEN energy > 0.4 * n_seeds THEN 1 ELSE 2 END AS tier FROM en JOIN (SELECT query_id, count(*) AS n_seeds FROM s GROUP BY 1) USING (query_id)"),
    "intent_bias_lookup": sql(E, _IB, "r AS (SELECT DISTINCT relation FROM e)", "SELECT r.relation, CAST(i AS INTEGER) AS intent, coalesce(x.b, y.b) AS bias FROM r, range(16) t(i) LEFT JOIN ib x ON x.intent = i AND x.relation = r.relation LEFT JOIN ib y ON y.intent = i AND y.relation = 'default'"),
    "candidate_scores": sql(E, N, S, _IB, _SUB, _SC, "SELECT query_id, src, dst, relation, round(score, 6) AS score FROM sc"),
    "softmax_probs": sql(E, N, S, _IB, _SUB, _SC, _PR, "SELECT query_id, src, dst, relation, round(ex / sum(ex) OVER (PARTITION BY query_id, src), 6) AS prob FROM pr"),
    "rank_probs": sql(E, N, S, _IB, _SUB, _SC, "r AS (SELECT *, 1.0 / row_number() OVER (PARTITION BY query_id, src ORDER BY round(score, 12) DESC, concat_ws(':', src, dst, relation) DESC) AS w FROM sc)", "SELECT query_id, src, dst, relation, round(w / sum(w) OVER (PARTITION BY query_id, src), 8) AS prob FROM r"),
    "cumulative_sample": sql(E, N, S, _IB, _SUB, _SC, _PR, "p AS (SELECT *, ex / sum(ex) OVER (PARTITION BY query_id, src) AS prob FROM pr)", "k AS (SELECT *, round(sum(prob) OVER (PARTITION BY query_id, src ORDER BY dst, relation ROWS UNBOUNDED PRECEDING), 9) AS cum FROM p)",
        "SELECT query_id, src, dst, relation FROM k WHERE cum >= 0.5 QUALIFY row_number() OVER (PARTITION BY query_id, src ORDER BY dst, relation) = 1"),
    "walk_confidence": sql(E, "SELECT src, round(CASE WHEN min(confidence) <= 0 THEN 0 ELSE exp(avg(ln(nullif(confidence, 0)))) END, 6) AS walk_confidence FROM e GROUP BY 1"),
    "rule_planner": sql(E, N, S, _SUB, "f AS (SELECT query_id, count(DISTINCT dst) + 1 AS nn, count(*) FILTER (relation = 'causes') AS ca, count(*) FILTER (relation = 'contradicts') AS co, avg(confidence) AS ac FROM sub GROUP BY 1)",
        "SELECT query_id, CASE WHEN nn <= 3 THEN '0' WHEN ca > 0 THEN '1,2,7' WHEN co > 0 THEN '4,1,7' WHEN nn >= 10 THEN '6,12,8' WHEN ac < 0.5 THEN '10,11' END AS intents, CASE WHEN nn <= 3 OR ca > 0 OR co > 0 OR nn >= 10 OR ac < 0.5 THEN 0.5 END AS plan_confidence FROM f"),
    "graph_to_text": sql(E, N, S, _SUB, "k AS (SELECT query_id, format('{}({:.2f}) [via {}]', label, act_dst, relation) AS t, row_number() OVER (PARTITION BY query_id ORDER BY act_dst DESC, dst, relation) AS i FROM sub JOIN n ON dst = node_id WHERE label IS NOT NULL)",
        "SELECT query_id, string_agg(t, ' ' ORDER BY i) AS text FROM k WHERE i <= 5 GROUP BY 1"),
}


def _md5(*parts: str) -> str:
    """The number within (0, 1) that ``evolution.uniform`` gives."""
    return "((CAST('0x' || substr(md5(concat_ws(':', " + ", ".join(parts) + ")), 1, 8) AS BIGINT) + 0.5) / 4294967296.0)"


def _normal(*parts: str) -> str:
    return f"(sqrt(-2 * ln({_md5(chr(39) + 'a' + chr(39), *parts)})) * cos(2 * pi() * {_md5(chr(39) + 'b' + chr(39), *parts)}))"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _filled(template: str) -> str:
    out = _quoted(template)
    for i in range(5):
        if f"{{node{i}}}" in template:
            out = f"replace({out}, '{{node{i}}}', labels[{i + 1}])"
        if f"{{relation{i}}}" in template:
            out = f"replace({out}, '{{relation{i}}}', said[{i + 1}])"
    return out


def _rendered(plan: tuple[int, ...]) -> str:
    return "coalesce(" + ", ".join(_filled(t) for k, t in D.TEMPLATES if k == plan) + ", NULL)"


_FREE = (0.0, "-1e300", "1e300")
_THETA = "th AS (SELECT dim, mu, low, high FROM (VALUES " + ", ".join(f"({i}, CAST({m} AS DOUBLE), CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for i, (m, a, b) in enumerate([*evolution.FIRST, *[(x, 0.0, 3.0) for x in RELATION_BIAS.values()], *[_FREE] * 28])) + ") AS v(dim, mu, low, high))"
_TRIED = f"tr AS (SELECT dim, least(greatest(mu + 0.01 * {_normal('0', '7', 'dim')}, low), high) AS value FROM th)"
_LB = "lo AS (SELECT query_id, rels, unnest(range(1, len(path) + 1)) AS i, unnest(path) AS node FROM w5), lb AS (SELECT query_id, rels, list_transform(rels, lambda r: CASE r " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D.PHRASES.items()) + " ELSE replace(r, '_', ' ') END) AS said, list(coalesce(label, 'node_' || node) ORDER BY i) AS labels FROM lo LEFT JOIN n ON node_id = node GROUP BY 1, 2, 3)"
_PLANS = list(dict.fromkeys(k for k, _ in D.TEMPLATES))
_TX = "tx AS (" + " UNION ALL ".join(f"SELECT query_id, '{','.join(map(str, k))}' AS plan, {_rendered(k)} AS text, labels FROM lb" for k in _PLANS) + ")"
_HIT = "list_bool_or(list_transform(labels, lambda x: contains(lower({0}), lower(x))))"
_BARE = "'Nothing is said of ' || query_id"
_FULL = [E, N, S, A, _RB, _M, _S0, *[x for k in (1, 2, 3, 4) for x in _step(k)], "ac AS (SELECT query_id, node, activation FROM t4 UNION ALL SELECT DISTINCT query_id, node, 0.01 FROM s WHERE (query_id, node) NOT IN (SELECT (query_id, node) FROM t4))",
    *[x for x in _walk_sql(5) if not x.startswith(("e AS", "n AS", "s AS", "a AS", "h AS"))], _LB,
    "px AS (SELECT query_id, i, coalesce(label, 'node_' || node) || coalesce(' ' || replace(rels[i], '_', ' '), '') AS x FROM lo LEFT JOIN n ON node_id = node)",
    "pt AS (SELECT query_id, array_to_string(string_split(string_agg(x, ' ' ORDER BY i), ' ')[1:200], ' ') AS text FROM px GROUP BY 1)",
    "es AS (SELECT x.query_id, sum(x.activation * strength * confidence) AS en FROM r JOIN ac x ON src = x.node JOIN ac y ON dst = y.node AND x.query_id = y.query_id GROUP BY 1)", "ea AS (SELECT query_id, sum(activation) AS tot FROM ac GROUP BY 1)"]
_CONF = "CASE WHEN len(confs) = 0 THEN 1.0 WHEN list_min(confs) <= 0 THEN 0.0 ELSE exp(list_avg(list_transform(confs, lambda x: ln(nullif(x, 0))))) END"
_PLANES = np.random.RandomState(42).randn(8, 12, 64)
_BUCKET = "pl AS (SELECT * FROM (VALUES " + ", ".join(f"({t}, {k}, [{', '.join(repr(float(x)) for x in _PLANES[t, k])}])" for t in range(8) for k in range(12)) + ") AS p(tab, plane, p))"
_PAIRS = f"np AS (SELECT a.node AS a, b.node AS b, list_cosine_similarity(a.v, b.v) AS s FROM v a JOIN v b ON a.node < b.node AND list_cosine_similarity(a.v, b.v) >= {NEAR})"
_NEAREST = "(SELECT query_id, dst, max(activation) AS activation, max(confidence) AS confidence, max(last_used) AS recency FROM e JOIN s ON src = s.node JOIN n ON dst = n.node_id GROUP BY 1, 2)"
SQL |= {
    "near_dup_pairs": sql(W.V, _PAIRS, "SELECT a, b, round(s, 6) AS cosine FROM np"),
    "near_dup_components": sql("RECURSIVE " + W.V, _PAIRS, "b AS (SELECT a AS u, b AS w FROM np UNION ALL SELECT b, a FROM np)", "r AS (SELECT u AS node, u AS root FROM b UNION SELECT b.w, r.root FROM r JOIN b ON r.node = b.u WHERE b.w > r.root)", "SELECT node, min(root) AS component FROM r GROUP BY 1"),
    "tier_two": sql(*_TWO, "SELECT query_id, count(*) AS n_active, round(sum(activation), 3) AS total FROM u3 GROUP BY 1"),
    "tier_accept": sql(*_TWO, *_energy("t1", "ea1"), *_energy("u3", "eb1"), "q AS (SELECT a.query_id, a.energy AS e1, b.energy AS e2, CASE WHEN a.energy > 0.4 * k THEN 1 ELSE 2 END AS t FROM ea1 a LEFT JOIN eb1 b USING (query_id) JOIN (SELECT query_id, count(*) AS k FROM s GROUP BY 1) USING (query_id))",
        "SELECT query_id, round(CASE WHEN t = 2 AND e2 >= e1 + 0.2 THEN e2 ELSE e1 END, 3) AS energy, CASE WHEN t = 2 AND e2 >= e1 + 0.2 THEN 2 ELSE 1 END AS tier FROM q"),
    "activation_history": sql(E, N, S, A, _RB, _M, _S0, *[x for k in (1, 2, 3, 4) for x in _step(k)], " UNION ALL ".join(
        f"SELECT query_id, {k} AS step, count(*) FILTER (x > 0) AS n_active, round(sum(x), 5) AS total, round(max(abs(x - y)), 5) AS largest FROM (SELECT query_id, node, sum(x) AS x, sum(y) AS y FROM (SELECT query_id, node, activation AS x, 0.0 AS y FROM t{k} UNION ALL SELECT query_id, node, 0.0, activation FROM t{k - 1}) GROUP BY 1, 2) GROUP BY 1" for k in (1, 2, 3, 4))),
    "theta_resonance": sql(E, N, S, A, _THETA, _TRIED, "rb AS (SELECT relation, value AS rb FROM (VALUES " + ", ".join(f"('{k}', {i + 4})" for i, k in enumerate(RELATION_BIAS)) + ") AS r(relation, dim) JOIN tr USING (dim))",
        _M.replace("0.02", "(SELECT value FROM tr WHERE dim = 1)"), _S0, *_step(1, wc=_WC.replace("0.1 * x", "(SELECT value FROM tr WHERE dim = 2) * x")), "SELECT query_id, count(*) AS n_active, round(sum(activation), 4) AS total FROM t1 GROUP BY 1"),
    "walk_stats": sql(*_walk_sql(5), f"SELECT count(*) AS n_walks, CAST(sum(len(rels)) AS BIGINT) AS n_steps, round(avg(len(rels)), 6) AS mean_steps, round(avg({_CONF}), 6) AS mean_confidence FROM w5"),
    "eligibility_details": sql(*_walk_sql(5), _STEPS, "p AS (SELECT query_id, src, dst, relation, power(0.9, t) * act_src * strength * confidence AS p FROM su JOIN r USING (src, dst, relation))", "SELECT query_id, src, dst, relation, round(sum(p), 6) AS eligibility, count(*) AS n_parts, round(max(p), 6) AS largest FROM p GROUP BY 1, 2, 3, 4"),
    "boosted_edges": sql(E, N, S, _SUB, "b AS (SELECT sub.query_id, relation, strength * (1 + 2 * greatest(0, 1 - levenshtein(query_id, relation) / greatest(length(query_id), length(relation)) - 0.15) + 0.5 * CASE WHEN contains(coalesce(lower(label), ''), substr(query_id, 1, 2)) THEN 0.35 ELSE 0 END) AS st FROM sub JOIN n ON dst = node_id)",
        "SELECT query_id, relation, count(*) AS n, round(sum(st), 4) AS strength FROM b GROUP BY 1, 2"),
    "bfs_bounded": sql(E, N, S, A, "h AS (SELECT DISTINCT a.node, a.other FROM a JOIN n ON a.other = n.node_id WHERE n.activation >= 0.5)", "f AS (SELECT query_id, node FROM s JOIN n ON node = node_id WHERE activation >= 0.5)",
        "g AS (SELECT DISTINCT query_id, other AS node FROM f JOIN h USING (node) WHERE (query_id, other) NOT IN (SELECT (query_id, node) FROM f))",
        "i AS (SELECT DISTINCT query_id, other AS node FROM g JOIN h USING (node) WHERE (query_id, other) NOT IN (SELECT (query_id, node) FROM f UNION ALL SELECT (query_id, node) FROM g))",
        "k AS (SELECT * FROM (SELECT *, 0 AS depth FROM f UNION ALL SELECT *, 1 FROM g UNION ALL SELECT *, 2 FROM i) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY depth, node) <= 500)",
        "t AS (SELECT query_id, src, dst, relation, count(*) AS ends FROM (SELECT query_id, src, dst, relation FROM e JOIN k ON src = node UNION ALL SELECT query_id, src, dst, relation FROM e JOIN k ON dst = node) GROUP BY 1, 2, 3, 4)",
        "SELECT query_id, n_nodes, depth, sum_of_ids, coalesce(n_edges, 0) AS n_edges, coalesce(n_boundary, 0) AS n_boundary FROM (SELECT query_id, count(*) AS n_nodes, max(depth) AS depth, CAST(sum(node) AS BIGINT) AS sum_of_ids FROM k GROUP BY 1) LEFT JOIN (SELECT query_id, count(*) AS n_edges, count(*) FILTER (ends < 2) AS n_boundary FROM t GROUP BY 1) USING (query_id)"),
    "template_text": sql(*_walk_sql(5), _LB, _TX, f"SELECT query_id, plan, text, length(text) BETWEEN 5 AND 500 AND {_HIT.format('text')} AND NOT contains(text, 'intent=') AND NOT contains(text, '->') AND NOT contains(text, 'generate:') AS is_valid FROM tx WHERE text IS NOT NULL"),
    "started_text": sql(*_walk_sql(5), _LB, "tx AS (" + " UNION ALL ".join(f"SELECT query_id, '{STARTERS[i % 3]} ' || {_rendered((i,))} AS text FROM lb" for i in (1, 2, 12))
        + f" UNION ALL SELECT query_id, CASE WHEN NOT {_HIT.format(_BARE)} AND len(labels) > 0 AND {_md5(chr(39) + 'copy' + chr(39), 'query_id')} <= 0.7 THEN labels[CAST(floor({_md5(chr(39) + 'label' + chr(39), 'query_id')} * len(labels)) AS INTEGER) + 1] || ' ' || {_BARE} ELSE {_BARE} END FROM lb)", "SELECT query_id, text FROM tx WHERE text IS NOT NULL"),
    "subgraph_text": sql(*_EN[:-3], "SELECT query_id, string_agg(CASE WHEN t1.activation > 0.1 THEN format('{}({:.2f})', label, t1.activation) ELSE label END, ' ' ORDER BY label, node) AS text FROM t1 JOIN n ON node = node_id WHERE label IS NOT NULL GROUP BY 1"),
    "text_orderings": sql(E, N, S, f"g AS {_NEAREST}", "x AS (" + " UNION ALL ".join(f"SELECT query_id, dst, '{k}' AS ordering, coalesce({k}, -1.0) AS key FROM g" for k in ("activation", "confidence", "recency")) + ")",
        "SELECT query_id, ordering, row_number() OVER (PARTITION BY query_id, ordering ORDER BY key DESC, dst) AS place, dst FROM x QUALIFY place <= 20"),
    "relations_between": sql(*_walk_sql(5), _STEPS, "b AS (SELECT query_id, t, 0 AS turned, e.relation FROM su JOIN e USING (src, dst) UNION ALL SELECT query_id, t, 1, e.relation FROM su JOIN e ON e.src = su.dst AND e.dst = su.src)",
        "SELECT query_id, t, turned, relation FROM b QUALIFY row_number() OVER (PARTITION BY query_id, t ORDER BY turned, relation) = 1"),
    "answer": sql(*_FULL, f"SELECT query_id, array_to_string(labels, ' > ') AS path_labels, round({_CONF}, 6) AS walk_confidence, round(coalesce(en, tot), 5) AS energy, text FROM w5 JOIN lb USING (query_id) JOIN pt USING (query_id) JOIN ea USING (query_id) LEFT JOIN es USING (query_id)"),
    "walk_mentions": sql(*_FULL, "SELECT query_id, lo.node FROM lo LEFT JOIN n ON node_id = lo.node JOIN pt USING (query_id) WHERE contains(lower(text), lower(coalesce(label, 'node_' || lo.node)))"),
    "lsh_candidates": sql(W.V, Q, _BUCKET, "w AS (SELECT node, v FROM v UNION ALL SELECT -1 - query_id, v FROM q)", f"b AS (SELECT node, tab, sum(CASE WHEN {_DOT.format('p', 'v')} > 0 THEN 1 << plane ELSE 0 END) AS bucket FROM w, pl GROUP BY 1, 2)",
        "c AS (SELECT DISTINCT -1 - y.node AS query_id, x.node FROM b x JOIN b y USING (tab, bucket) WHERE x.node >= 0 AND y.node < 0)", "SELECT query_id, c.node, round(list_cosine_similarity(q.v, v.v), 6) AS cosine FROM c JOIN q USING (query_id) JOIN v ON v.node = c.node"),
}
