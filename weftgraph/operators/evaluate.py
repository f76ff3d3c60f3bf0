"""How good results are: extracted triples against true ones, ranked classes, ranked answers, rules that results must keep."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftgraph.params import INTENT_BIAS, INTENTS, RELATION_BIAS, Resonance

c = F.col


def _words(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(x, " "), lambda w: w != ""))


def _holds(a: Column, b: Column) -> Column:
    """One of two names stands in the other, word by word."""
    pad = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    return F.contains(pad(a), pad(b)) | F.contains(pad(b), pad(a))


def matched(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """predicted (s, rel, o; distinct) with ``is_true``: the same triple is true, or one of the same relation whose ends hold its ends, or stand in them.

    Candidates share a word at both ends, so a relation's triples are never compared all with all.
    """
    key = ["s", "rel", "o"]
    cross = lambda d, a, b: d.select("rel", c("s").alias(a), c("o").alias(b), F.explode(_words(c("s"))).alias("w1")).select("rel", a, b, "w1", F.explode(_words(c(b))).alias("w2"))
    p, t = cross(predicted.select(*key), "s", "o"), cross(truth.select(*key).distinct(), "ts", "to")
    hits = p.join(t, ["rel", "w1", "w2"]).filter(_holds(c("s"), c("ts")) & _holds(c("o"), c("to"))).select(*key).distinct()
    return predicted.join(hits.withColumn("__hit", F.lit(True)), key, "left").withColumn("is_true", F.coalesce("__hit", F.lit(False))).drop("__hit")


def extraction_scores(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """n_predicted, n_truth, n_right, n_found, precision, recall, f1."""
    p = matched(predicted, truth).agg(F.count("*").alias("n_predicted"), F.count_if("is_true").alias("n_right"))
    t = matched(truth, predicted).agg(F.count("*").alias("n_truth"), F.count_if("is_true").alias("n_found"))
    j = p.crossJoin(t)
    share = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(0.0)
    x, y = share("n_right", "n_predicted"), share("n_found", "n_truth")
    return j.select("n_predicted", "n_truth", "n_right", "n_found", F.round(x, 6).alias("precision"), F.round(y, 6).alias("recall"), F.round(F.when(x + y > 0, 2 * x * y / (x + y)).otherwise(0.0), 6).alias("f1"))


def batch_top_k(ranked: DataFrame, batch: int = 32) -> DataFrame:
    """top_1, top_3, top_5 of ranked (row_id, at: the rank of the right class or null), as the mean over batches of ``batch`` consecutive rows."""
    b = ranked.groupBy(F.floor(c("row_id") / batch).alias("g")).agg(*[F.avg(F.when(c("at") <= k, 1.0).otherwise(0.0)).alias(f"top_{k}") for k in (1, 3, 5)], F.count("*").alias("n"))
    return b.agg(F.sum("n").alias("n"), *[F.round(F.avg(f"top_{k}"), 6).alias(f"top_{k}") for k in (1, 3, 5)])


def ranked_answers(candidates: DataFrame, good: float = 0.2, most: int = 5, otherwise: int = 3) -> DataFrame:
    """candidates (query_id, src, dst, relation, similarity, confidence) with rank_no: the best ``most`` above ``good``, or the first ``otherwise`` of a query that has none."""
    w = Window.partitionBy("query_id").orderBy(F.round("similarity", 6).desc(), c("confidence").desc(), "src", "dst", "relation")
    r = candidates.withColumn("rank_no", F.row_number().over(w)).filter(c("rank_no") <= max(most, otherwise))
    any_good = F.max(c("similarity") > good).over(Window.partitionBy("query_id"))
    return r.withColumn("__any", any_good).filter(F.when(c("__any"), (c("similarity") > good) & (c("rank_no") <= most)).otherwise(c("rank_no") <= otherwise)).drop("__any")


def subgraph_violations(act: DataFrame, sub: DataFrame, seeds: DataFrame, low: float = 0.01, high: float = 1.0) -> DataFrame:
    """rule, n: activations (query_id, node, activation), edges (query_id, src, dst, strength, confidence) and seeds (query_id, node) that break a rule of subgraphs."""
    ids = act.select("query_id", "node").withColumn("there", F.lit(True))
    ends = sub.join(ids.select("query_id", c("node").alias("src"), c("there").alias("a")), ["query_id", "src"], "left").join(ids.select("query_id", c("node").alias("dst"), c("there").alias("b")), ["query_id", "dst"], "left")
    bad = lambda k, a, b: c(k).isNull() | F.isnan(k) | ~c(k).between(a, b)
    e = ends.agg(F.count_if(c("a").isNull() | c("b").isNull()).alias("edge leaves the nodes"), F.count_if(bad("strength", 0, 1)).alias("strength out of range"), F.count_if(bad("confidence", 0, 1)).alias("confidence out of range"))
    n = act.agg(F.count_if(bad("activation", low, high)).alias("activation out of range"))
    s = seeds.groupBy("query_id", "node").agg(F.count("*").alias("k")).agg(F.count_if(c("k") > 1).alias("seed twice"))
    one = e.crossJoin(n).crossJoin(s)
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), c(f"`{k}`").alias("n")) for k in one.columns])).alias("v")).select("v.*")


def walk_violations(walks: DataFrame, low: float = 0.01, high: float = 1.0) -> DataFrame:
    """rule, n: walks (path, relations, activations, confidences) that break a rule."""
    size = F.size("path")
    rules = {
        "empty path": size < 1, "relations and path differ": F.size("relations") != size - 1, "activations and path differ": F.size("activations") != size, "confidences and path differ": F.size("confidences") != size - 1,
        "activation out of range": F.exists("activations", lambda x: ~x.between(low, high)), "confidence out of range": F.exists("confidences", lambda x: ~x.between(0, 1)),
        "stays at a node": F.exists(F.zip_with(F.slice("path", 1, F.greatest(size - 1, F.lit(0))), F.slice("path", 2, F.greatest(size - 1, F.lit(0))), lambda a, b: a == b), lambda x: x),
    }
    one = walks.agg(*[F.count_if(rule).alias(k) for k, rule in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), c(f"`{k}`").alias("n")) for k in rules])).alias("v")).select("v.*")


def plan_violations(plans: DataFrame, longest: int = 8) -> DataFrame:
    """plans (intents, plan_confidence) with the first rule that they break, those that break none left out."""
    n = F.size("intents")
    why = F.when(n < 1, "empty").when(n > longest, "too long").when(F.exists("intents", lambda i: ~i.between(0, len(INTENTS) - 1)), "unknown intent").when(c("plan_confidence").isNull() | ~c("plan_confidence").between(0, 1), "confidence out of range")
    return plans.withColumn("rule", why).filter("rule is not null")


# What activation's parameters may be.
RANGES = {"edge_threshold": (0.0, 1.0), "propagation_threshold": (0.0, 1.0), "decay": (0.0, 0.99), "top_k": (1, 4096), "steps": (1, 100), "floor": (0.0, 1.0), "ceiling": (0.0, 1.0), "budget": (0.0, 1e9), "gamma": (0.0, 100.0), "frequency_scale": (1e-9, 1e9), "confidence_share": (0.0, 1.0)}
CHOICES = {"dynamics": ("wilson_cowan", "simple_diffusion", "threshold"), "normalization": ("budget_soft_cap", "l1_norm", "none"), "gate": ("top_k", "threshold", "none")}


def parameters(values: dict) -> Resonance:
    """Activation's parameters from a mapping; ValueError lists every unknown name and every value out of range."""
    names = {f.name for f in fields(Resonance)}
    wrong = [f"unknown parameter {k}" for k in sorted(set(values) - names)]
    p = Resonance(**{k: v for k, v in values.items() if k in names})
    wrong += [f"{k} must be within [{a}, {b}]" for k, (a, b) in RANGES.items() if not a <= getattr(p, k) <= b]
    wrong += [f"{k} must be one of {', '.join(x)}" for k, x in CHOICES.items() if getattr(p, k) not in x]
    wrong += [f"weight of {k} must be within [0, 3]" for k, v in p.relation_bias.items() if not 0 <= v <= 3]
    if p.floor >= p.ceiling:
        wrong.append("floor must be under ceiling")
    if wrong:
        raise ValueError("; ".join(wrong))
    return p


def vocabulary_faults() -> list[str]:
    """What in the fixed vocabularies doesn't fit together; nothing, unless they have been changed."""
    faults = [f"intent {i} has no preferences" for i in range(len(INTENTS)) if i not in INTENT_BIAS]
    faults += [f"intent {i} has no default" for i, m in INTENT_BIAS.items() if "default" not in m]
    return faults + [f"intent {i} prefers unknown relation {r}" for i, m in INTENT_BIAS.items() for r in m if r != "default" and r not in RELATION_BIAS]
