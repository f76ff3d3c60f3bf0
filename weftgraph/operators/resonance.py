"""Spreading activation for many queries at once.

Activations are rows (query_id, node, activation). A step joins the edges with the active nodes of all queries, sums messages, applies
the dynamics, normalises and gates. With the top-k gate at most k rows a query are active, so that side's size is known: it is broadcast while it is small and
shuffled beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftgraph.operators.graph import adjacency, clamp
from weftgraph.params import Resonance
from weftgraph.session import cut

c = F.col
#: Active rows that are broadcast at most.
BROADCAST_ROWS = 200_000


def temporal_factor(last_used: Column, frequency: Column, as_of: Column, p: Resonance = Resonance()) -> Column:
    """1 / (1 + gamma ln(1 + age)) times the share of the frequency scale, within [0, 1]; 0 where unknown."""
    age = F.greatest(as_of - last_used, F.lit(0.0))
    v = 1.0 / (1.0 + p.gamma * F.log1p(age)) * F.least(F.lit(1.0), frequency / p.frequency_scale)
    return F.coalesce(F.when(~F.isnan(v), clamp(v, 0.0, 1.0)), F.lit(0.0))


def relation_weight(relation: Column, bias: dict[str, float]) -> Column:
    table = F.create_map(*[x for k, v in sorted(bias.items()) for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(table[relation], F.lit(1.0))


def message_edges(edges: DataFrame, p: Resonance = Resonance()) -> DataFrame:
    """node, other, w: what a unit of activation sends along each edge; edges under the threshold send nothing."""
    sc = c("strength") * c("confidence")
    return adjacency(edges.filter(sc >= p.edge_threshold)).select("node", "other", (sc * relation_weight(c("relation"), p.relation_bias)).alias("w"))


def propagate(messages: DataFrame, act: DataFrame, small: bool) -> DataFrame:
    """query_id, node, inp: sum of what reaches each node."""
    a = act.select("query_id", "node", "activation")
    j = messages.join(F.broadcast(a) if small else a, "node")
    return j.groupBy("query_id", c("other").alias("node")).agg(F.sum(c("activation") * c("w")).alias("inp"))


def dynamics(x: Column, inp: Column, p: Resonance = Resonance()) -> Column:
    if p.dynamics == "wilson_cowan":
        v = x + (1 - x) * inp - p.decay * x
    elif p.dynamics == "simple_diffusion":
        v = x + inp - p.decay * x
    else:
        v = F.when(inp < p.propagation_threshold, x - p.decay * x).otherwise(x + inp - p.decay * x)
    return clamp(v, p.floor, p.ceiling)


def step_dynamics(act: DataFrame, inp: DataFrame, p: Resonance = Resonance()) -> DataFrame:
    """Next activations of every node that is active or reached; rows of both sides are summed, not joined."""
    rows = act.select("query_id", "node", c("activation").alias("x"), F.lit(0.0).alias("inp")).unionByName(inp.select("query_id", "node", F.lit(None).cast("double").alias("x"), "inp"))
    g = rows.groupBy("query_id", "node").agg(F.max("x").alias("x"), F.sum("inp").alias("inp"))
    return g.select("query_id", "node", dynamics(F.coalesce("x", F.lit(p.floor)), c("inp"), p).alias("activation"))


def normalize(act: DataFrame, p: Resonance = Resonance()) -> DataFrame:
    if p.normalization == "none":
        return act
    total = act.groupBy("query_id").agg(F.sum("activation").alias("__total"))
    j = act.join(F.broadcast(total), "query_id")
    x, t = c("activation"), c("__total")
    v = F.when(t > 0, x / t).otherwise(x) if p.normalization == "l1_norm" else F.when(t > p.budget, clamp(x * p.budget / t, p.floor, p.ceiling)).otherwise(x)
    return j.select("query_id", "node", v.alias("activation"))


def gate(act: DataFrame, p: Resonance = Resonance()) -> DataFrame:
    """top_k by activation rounded to 1e-12 (ties: smaller node first), by threshold, or all."""
    if p.gate == "none":
        return act
    if p.gate == "threshold":
        return act.filter(c("activation") >= p.propagation_threshold)
    w = Window.partitionBy("query_id").orderBy(F.round("activation", 12).desc(), "node")
    return act.withColumn("__rn", F.row_number().over(w)).filter(c("__rn") <= p.top_k).drop("__rn")


def change(before: DataFrame, after: DataFrame) -> DataFrame:
    """query_id, n_active, total, largest: active nodes and their sum after a step, and the largest change of an activation, where one isn't active from 0."""
    rows = after.select("query_id", "node", c("activation").alias("x"), F.lit(0.0).alias("y")).unionByName(before.select("query_id", "node", F.lit(0.0).alias("x"), c("activation").alias("y")))
    g = rows.groupBy("query_id", "node").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return g.groupBy("query_id").agg(F.count_if(c("x") > 0).alias("n_active"), F.sum("x").alias("total"), F.max(F.abs(c("x") - c("y"))).alias("largest"))


def resonate(edges: DataFrame, seeds: DataFrame, p: Resonance = Resonance(), initial: DataFrame | None = None, epsilon: float = 0.0, history: list[DataFrame] | None = None) -> DataFrame:
    """query_id, node, activation after ``p.steps`` steps from seeds (query_id, node) at full activation.

    With ``epsilon``, steps end when no activation of any query changes by as much. ``history`` is filled with ``change`` of every step. What the
    top-k gate lets through at most is known beforehand, so its steps count nothing.
    """
    act = seeds.select("query_id", "node", F.lit(p.ceiling).alias("activation"))
    if initial is not None:
        act = act.unionByName(initial.select("query_id", "node", clamp(c("activation"), p.floor, p.ceiling).alias("activation")))
    act = cut(act.groupBy("query_id", "node").agg(F.max("activation").alias("activation")))
    messages = cut(message_edges(edges, p))  # read by every step
    queries, most = act.agg(F.countDistinct("query_id"), F.count("*")).first()
    for _ in range(p.steps):
        if p.gate != "top_k":
            most = act.limit(BROADCAST_ROWS + 1).count()
        new = cut(gate(normalize(step_dynamics(act, propagate(messages, act, most <= BROADCAST_ROWS), p), p), p))
        most = queries * p.top_k
        if history is not None or epsilon:
            moved = change(act, new)
            if history is not None:
                history.append(moved.withColumn("step", F.lit(len(history) + 1)))
            if epsilon and (moved.agg(F.max("largest")).first()[0] or 0.0) < epsilon:
                return new
        act = new
    return act


def with_theta(p: Resonance, theta: dict) -> Resonance:
    """Parameters with those of a set of an evolution strategy (``evolution.settings``) put over them."""
    from dataclasses import replace

    return replace(p, **{k: v for k, v in theta.items() if k in ("propagation_threshold", "edge_threshold", "decay", "top_k", "relation_bias")})


def with_seeds(act: DataFrame, seeds: DataFrame, p: Resonance = Resonance()) -> DataFrame:
    """Activations with the seeds that the gate dropped, at the floor."""
    lost = seeds.select("query_id", "node").distinct().join(act.select("query_id", "node"), ["query_id", "node"], "left_anti")
    return act.unionByName(lost.select("query_id", "node", F.lit(p.floor).alias("activation")))


def subgraph_edges(edges: DataFrame, act: DataFrame) -> DataFrame:
    """query_id, src, dst, relation, strength, confidence of edges whose ends are both active in a query, with their activations."""
    a = act.select("query_id", c("node").alias("src"), c("activation").alias("act_src"))
    b = act.select("query_id", c("node").alias("dst"), c("activation").alias("act_dst"))
    return edges.join(a, "src").join(b, ["query_id", "dst"]).select("query_id", "src", "dst", "relation", "strength", "confidence", "act_src", "act_dst")


def energy(sub: DataFrame, act: DataFrame) -> DataFrame:
    """query_id, energy: sum over edges of the source's activation, strength and confidence; of the activations where there is no edge."""
    e = sub.groupBy("query_id").agg(F.sum(c("act_src") * c("strength") * c("confidence")).alias("e"))
    a = act.groupBy("query_id").agg(F.sum("activation").alias("a"))
    return a.join(e, "query_id", "left").select("query_id", F.coalesce("e", "a").alias("energy"))


def tier_decision(energies: DataFrame, seeds: DataFrame, p: Resonance = Resonance()) -> DataFrame:
    """Whether the first tier's energy suffices for the query's number of seeds."""
    n = seeds.groupBy("query_id").agg(F.count("*").alias("n_seeds"))
    j = energies.join(n, "query_id")
    need = p.confidence_share * c("n_seeds") * p.ceiling
    return j.select("query_id", "n_seeds", "energy", F.when(c("energy") > need, 1).otherwise(2).alias("tier"))


def accepted_tier(first: DataFrame, second: DataFrame, seeds: DataFrame, p: Resonance = Resonance(), gain: float = 0.2) -> DataFrame:
    """query_id, energy, tier: the second tier's energy where the first one's didn't suffice and the second is better by ``gain``; else the first one's."""
    j = tier_decision(first, seeds, p).join(second.select("query_id", c("energy").alias("e2")), "query_id", "left")
    better = (c("tier") == 2) & (c("e2") >= c("energy") + gain)
    return j.select("query_id", F.when(better, c("e2")).otherwise(c("energy")).alias("energy"), F.when(better, 2).otherwise(1).alias("tier"))
