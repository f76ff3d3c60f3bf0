"""An evolution strategy over a table of parameters: proposals by hashed normal noise, and moves of the mean by aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftgraph.params import RELATION_BIAS

c = F.col
# The first parameters are thresholds, decay and top_k with their bounds, then one weight a relation within [0, 3]; the others are free.
FIRST = ((0.008, 0.0001, 1.0), (0.02, 0.0001, 1.0), (0.1, 0.001, 0.99), (64.0, 1.0, 4096.0))
DIMS = 48
SIGMA, RATE, DECAY, ANCHOR = 0.01, 0.02, 0.1, 0.001


def parameters(spark: SparkSession) -> DataFrame:
    """dim, mu, start, low, high: the parameters before any reward."""
    free = float("inf")
    rows = [*FIRST, *[(x, 0.0, 3.0) for x in RELATION_BIAS.values()]]
    rows += [(0.0, -free, free)] * (DIMS - len(rows))
    return spark.createDataFrame([(i, m, m, a, b) for i, (m, a, b) in enumerate(rows)], "dim int, mu double, start double, low double, high double")


def uniform(*parts: Column) -> Column:
    """A number within (0, 1) from the md5 of the parts: the same on every engine."""
    digest = F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / 4294967296.0


def normal(*parts: Column) -> Column:
    return F.sqrt(-2 * F.log(uniform(F.lit("a"), *parts))) * F.cos(2 * F.pi() * uniform(F.lit("b"), *parts))


def propose(theta: DataFrame, trials: DataFrame, sigma: float = SIGMA, seed: int = 0) -> DataFrame:
    """trial, dim, value: parameters to try, one set a row of ``trials`` (trial), within bounds; theta has DIMS rows."""
    value = c("mu") + sigma * normal(F.lit(seed), c("trial"), c("dim"))
    grid = trials.select("trial", F.explode(F.sequence(F.lit(0), F.lit(DIMS - 1))).alias("dim"))
    return grid.join(F.broadcast(theta), "dim").select("trial", "dim", F.least(F.greatest(value, c("low")), c("high")).alias("value"))


def move(theta: DataFrame, tried: DataFrame, rewards: DataFrame) -> DataFrame:
    """theta after the rewards (trial, reward) of what was tried: the mean goes along the deviations, weighted by standardised rewards, then a little back to its start.

    A reward that isn't finite counts as 0; equal rewards move nothing but that little.
    """
    r = rewards.select("trial", F.coalesce(F.when(F.abs("reward") < float("inf"), c("reward")), F.lit(0.0)).alias("reward"))
    spread = r.agg(F.avg("reward").alias("mean"), F.stddev_pop("reward").alias("dev"))
    z = r.crossJoin(F.broadcast(spread)).select("trial", ((c("reward") - c("mean")) / F.when(c("dev") > 1e-8, c("dev")).otherwise(1.0)).alias("z"))
    step = tried.join(z, "trial").join(F.broadcast(theta.select("dim", "mu")), "dim").groupBy("dim").agg(F.avg(c("z") * (c("value") - c("mu"))).alias("step"))
    m = c("mu") + RATE * F.coalesce("step", F.lit(0.0))
    return theta.join(step, "dim", "left").select("dim", F.least(F.greatest(m - ANCHOR * (m - c("start")), c("low")), c("high")).alias("mu"), "start", "low", "high")


def settings(theta: DataFrame, who: str = "trial", value: str = "value") -> DataFrame:
    """One row a set of parameters: propagation_threshold, edge_threshold, decay, top_k and a map of relation weights, as activation takes them."""
    pick = lambda i: F.max(F.when(c("dim") == i, c(value)))
    bias = F.create_map(*[x for i, r in enumerate(RELATION_BIAS) for x in (F.lit(r), pick(len(FIRST) + i))])
    return theta.groupBy(who).agg(pick(0).alias("propagation_threshold"), pick(1).alias("edge_threshold"), pick(2).alias("decay"), F.round(pick(3)).cast("int").alias("top_k"), bias.alias("relation_bias"))


def next_sigma(sigma: float) -> float:
    return max(1e-12, sigma * (1 - DECAY))
