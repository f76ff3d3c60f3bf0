"""Learning from feedback: traces, weight changes, decay, patterns, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftgraph.operators.graph import clamp
from weftgraph.params import Learning

c = F.col


def learning_eligibility(steps: DataFrame, edges: DataFrame, p: Learning = Learning()) -> DataFrame:
    """Like the walker's trace, with a discount that grows along the walk and 0.5 for the weights of unknown edges."""
    j = steps.join(edges.select("src", "dst", "relation", "strength", "confidence"), ["src", "dst", "relation"], "left")
    t, n = c("t"), F.greatest(c("length"), F.lit(1))
    discount = F.pow(F.lit(p.gamma), t * (1 + p.temporal_strength * t / n))
    x = discount * c("act_src") * F.coalesce("strength", F.lit(0.5)) * F.coalesce("confidence", F.lit(0.5)) / (1 + p.length_penalty * c("length"))
    return j.groupBy("query_id", "src", "dst", "relation").agg(F.sum(x).alias("eligibility"))


def hebbian(edges: DataFrame, traces: DataFrame, reward: Column, model_quality: float = 1.0, walk_confidence: float = 0.5, p: Learning = Learning()) -> DataFrame:
    """src, dst, relation, strength, confidence of the edges that traces (with their reward columns) change."""
    r = reward * (0.5 + 0.5 * model_quality)
    j = edges.select("src", "dst", "relation", "strength", "confidence").join(traces, ["src", "dst", "relation"])
    s = clamp(c("strength") + p.alpha * r * c("eligibility"), 0.0, 1.0)
    q = clamp(c("confidence") + p.beta * F.abs(r) * c("eligibility") * (0.5 + 0.5 * walk_confidence), 0.0, 1.0)
    return j.select("src", "dst", "relation", s.alias("strength"), q.alias("confidence"))


def decay(edges: DataFrame, p: Learning = Learning()) -> DataFrame:
    """Edges whose strength the decay lowers; frequent ones are protected."""
    s = F.greatest(F.lit(p.min_strength), c("strength") * (1 - p.decay / (1 + F.least(F.lit(50.0), c("frequency")) / 50)))
    return edges.withColumn("new_strength", s).filter("new_strength < strength")


def coactivation(events: DataFrame, p: Learning = Learning()) -> DataFrame:
    """a, b, n, contexts, reward: pairs of items that follow each other (context, item, reward, ord), seen often and in different contexts."""
    w = Window.partitionBy("context").orderBy("ord")
    nxt = events.withColumn("nxt", F.lead("item").over(w)).filter("nxt is not null and nxt <> item")
    g = nxt.groupBy(F.least("item", "nxt").alias("a"), F.greatest("item", "nxt").alias("b")).agg(F.count("*").alias("n"), F.countDistinct("context").alias("contexts"), F.avg("reward").alias("reward"))
    return g.filter((c("n") >= p.co_activation) & (c("contexts") >= p.contexts))


def frequent_sequences(events: DataFrame, length: int, least: int) -> DataFrame:
    """pattern, n: runs of ``length`` items in a context that occur at least ``least`` times."""
    w = Window.partitionBy("context").orderBy("ord")
    parts = [F.lead("item", i).over(w).alias(f"i{i}") for i in range(length)]
    e = events.select(*parts).filter(f"i{length - 1} is not null")
    return e.groupBy(F.concat_ws(">", *[f"i{i}" for i in range(length)]).alias("pattern")).agg(F.count("*").alias("n")).filter(c("n") >= least)


def markov_next(events: DataFrame, order: int = 3, k: int = 3) -> DataFrame:
    """history, nxt, n, rank_no: the k most frequent items after each history of ``order`` items."""
    w = Window.partitionBy("context").orderBy("ord")
    h = F.concat_ws(">", *[F.lag("item", i).over(w) for i in range(order, 0, -1)])
    e = events.select(h.alias("history"), F.lag("item", order).over(w).alias("first"), c("item").alias("nxt")).filter("first is not null")
    g = e.groupBy("history", "nxt").agg(F.count("*").alias("n"))
    return g.withColumn("rank_no", F.row_number().over(Window.partitionBy("history").orderBy(c("n").desc(), "nxt"))).filter(c("rank_no") <= k)


def contradictions(edges: DataFrame, p: Learning = Learning()) -> DataFrame:
    """src, dst, relation, score: opposed pairs whose supports differ by at least the threshold's share of their sum."""
    out = edges.groupBy("src").agg(F.sum(c("strength") * c("confidence")).alias("support"))
    j = edges.filter(c("relation").isin("contradicts", "antonym")).select("src", "dst", "relation")
    j = j.join(out.select("src", c("support").alias("sa")), "src", "left").join(out.select(c("src").alias("dst"), c("support").alias("sb")), "dst", "left")
    a, b = F.coalesce("sa", F.lit(0.0)), F.coalesce("sb", F.lit(0.0))
    return j.select("src", "dst", "relation", (F.abs(a - b) / F.greatest(a + b, F.lit(1e-8))).alias("score")).filter(c("score") >= p.contradiction)


def low_confidence(edges: DataFrame, p: Learning = Learning()) -> DataFrame:
    return edges.filter(c("confidence") < p.low_confidence).withColumn("below_by", p.low_confidence - c("confidence"))


def failed(template: Column, walk_confidence: Column, plan_confidence: Column, least: float = 0.3) -> Column:
    """Whether an answer counts as failed: no template fitted, else the walk was doubtful, else the plan was."""
    return template.isNull() | (walk_confidence < least) | (plan_confidence < least)


def weak_entities(queries: DataFrame, k: int) -> DataFrame:
    """entity, failures: entities of failed queries (entity, failed), most failures first."""
    g = queries.filter("failed").groupBy(F.lower("entity").alias("entity")).agg(F.count("*").alias("failures"))
    return g.orderBy(c("failures").desc(), "entity").limit(k)


def reward_min_max(rewards: DataFrame, by: str, order: list, window: int = 100) -> DataFrame:
    """Each reward scaled to [-1, 1] by the least and the largest of the last ``window`` ones of its key; 0 where they agree."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-(window - 1), 0)
    lo, hi = F.min("reward").over(w), F.max("reward").over(w)
    return rewards.withColumn("scaled", F.when(hi > lo, 2 * (c("reward") - lo) / (hi - lo) - 1).otherwise(0.0))


def adaptive_threshold(values: DataFrame, by: str, order: list, window: int, least: int, low: float, high: float) -> DataFrame:
    """mean - 1.5 population deviations of the last ``window`` values of a key, within bounds; null before ``least`` values."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-(window - 1), 0)
    t = clamp(F.avg("value").over(w) - 1.5 * F.stddev_pop("value").over(w), low, high)
    return values.withColumn("threshold", F.when(F.count("value").over(w) >= least, t))
