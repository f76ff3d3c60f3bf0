"""Guided walks for many queries at once, and what is computed along them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from weftgraph.params import INTENT_BIAS, Walk
from weftgraph.session import cut

c = F.col


def intent_bias(intent: Column, relation: Column) -> Column:
    """An intent's preference for a relation, its default, or 1."""
    table = F.create_map(*[x for i, m in INTENT_BIAS.items() for r, v in m.items() for x in (F.lit(f"{i}:{r}"), F.lit(v))])
    return F.coalesce(table[F.concat_ws(":", intent.cast("string"), relation)], table[F.concat(intent.cast("string"), F.lit(":default"))], F.lit(1.0))


def candidate_scores(sub: DataFrame, intent: Column) -> DataFrame:
    """sub (with act_dst) with score: strength, confidence, target activation and intent preference multiplied."""
    return sub.withColumn("score", c("strength") * c("confidence") * c("act_dst") * intent_bias(intent, c("relation")))


def softmax(df: DataFrame, by: list[str], score: str, temperature: float) -> DataFrame:
    w = Window.partitionBy(*by)
    e = F.exp((c(score) - F.max(score).over(w)) / temperature)
    return df.withColumn("__e", e).withColumn("prob", c("__e") / F.sum("__e").over(w)).drop("__e")


def rank_probabilities(df: DataFrame, by: list[str], score: str, tie: str) -> DataFrame:
    """1 / rank over its sum; of equal scores the larger ``tie`` ranks first."""
    w = Window.partitionBy(*by).orderBy(F.round(score, 12).desc(), c(tie).desc())
    r = df.withColumn("__w", 1.0 / F.row_number().over(w))
    return r.withColumn("prob", c("__w") / F.sum("__w").over(Window.partitionBy(*by))).drop("__w")


def start_nodes(act: DataFrame, seeds: DataFrame) -> DataFrame:
    """query_id, node, activation: each query's most active seed (smallest id of equals)."""
    j = act.join(seeds.select("query_id", "node").distinct(), ["query_id", "node"], "left_semi")
    w = Window.partitionBy("query_id").orderBy(F.round("activation", 12).desc(), "node")
    return j.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").select("query_id", "node", "activation")


def walk(sub: DataFrame, start: DataFrame, plan: list[int], p: Walk = Walk(), others: DataFrame | None = None) -> DataFrame:
    """query_id, path, relations, activations, confidences: the best-scored step each time, along edges, never back to a node of the path.

    A walk stops where no step is left. Of equal scores the smaller target, then relation, is taken. With ``others`` (query_id, node, activation: where a walk
    may start again) a walk without a step is dropped and begins at the most active node that it hasn't seen. A step is one join and one aggregation
    of the candidates; edges are dealt out by query and source once.
    """
    restart = others is not None
    none = F.array().cast("array<string>"), F.array().cast("array<double>")
    state = start.filter(c("activation") >= p.min_activation).select("query_id", F.array("node").alias("path"), none[0].alias("relations"), F.array("activation").alias("activations"), none[1].alias("confidences"), F.array("node").alias("seen"))
    state = cut(state)
    edges = cut(sub.filter(c("act_dst") >= p.min_activation).repartition("query_id", "src"))
    bias = F.create_map(*[x for i in range(p.max_steps) for x in (F.lit(i), F.lit(plan[min(i, len(plan) - 1)]))])
    kept = ["path", "relations", "activations", "confidences", "seen"]
    for _ in range(p.max_steps if not restart else 2 * p.max_steps):
        going = state.withColumn("src", F.element_at("path", -1)).filter(F.size("relations") < p.max_steps)
        j = going.join(edges.select("query_id", "src", "dst", "relation", "strength", "confidence", "act_dst"), ["query_id", "src"])
        j = candidate_scores(j.filter(~F.array_contains("seen", c("dst"))), bias[F.size("relations")])
        best = j.groupBy("query_id").agg(F.min(F.struct((-F.round("score", 12)).alias("s"), "dst", "relation", "act_dst", "confidence")).alias("b"))
        state = state.join(best, "query_id", "left")
        on = c("b").isNotNull()
        grow = lambda name, x: F.when(on, F.concat(name, F.array(x))).otherwise(c(name)).alias(name)
        state = state.select("query_id", grow("path", c("b.dst")), grow("relations", c("b.relation")), grow("activations", c("b.act_dst")), grow("confidences", c("b.confidence")), grow("seen", c("b.dst")), (~on & (F.size("relations") < p.max_steps)).alias("stuck"))
        if restart:
            free = state.filter("stuck").join(others.filter(c("activation") >= p.min_activation).select("query_id", "node", "activation"), "query_id").filter(~F.array_contains("seen", c("node")))
            first = free.groupBy("query_id").agg(F.min(F.struct((-F.round("activation", 12)).alias("a"), "node", "activation")).alias("f"))
            state = state.join(first, "query_id", "left")
            again = c("f").isNotNull()
            state = state.select("query_id", F.when(again, F.array("f.node")).otherwise(c("path")).alias("path"), F.when(again, none[0]).otherwise(c("relations")).alias("relations"), F.when(again, F.array("f.activation")).otherwise(c("activations")).alias("activations"),
                F.when(again, none[1]).otherwise(c("confidences")).alias("confidences"), F.when(again, F.concat("seen", F.array("f.node"))).otherwise(c("seen")).alias("seen"))
        state = cut(state.select("query_id", *kept))
    return state.drop("seen")


def walk_bounded(sub: DataFrame, start: DataFrame, plan: list[int], p: Walk = Walk()) -> DataFrame:
    """As ``walk``, for subgraphs whose size a gate bounds (top_k nodes a query): each query's edges come together once and all steps are taken there, in one shuffle."""
    kind = start.schema["query_id"].dataType.simpleString()
    names = ["query_id", "src", "dst", "relation", "strength", "confidence", "act"]
    rows = sub.filter(c("act_dst") >= p.min_activation).select(*names[:6], c("act_dst").alias("act"))
    begin = start.filter(c("activation") >= p.min_activation).select("query_id", c("node").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(None).cast("string").alias("relation"), *[F.lit(None).cast("double").alias(k) for k in names[4:6]], c("activation").alias("act"))

    def bias(intent: int, relation: str) -> float:
        own = INTENT_BIAS.get(intent, {})
        return own.get(relation, own.get("default", 1.0))

    def run(t: pa.Table) -> pa.Table:
        col = {k: np.asarray(t.column(k).to_numpy()) for k in ("src", "act", "strength", "confidence")}
        first = np.asarray(t.column("dst").is_null())
        if not first.any():
            return t.select(["query_id"]).slice(0, 0).append_column("path", pa.array([], pa.list_(pa.int64()))).append_column("relations", pa.array([], pa.list_(pa.string()))).append_column("activations", pa.array([], pa.list_(pa.float64()))).append_column("confidences", pa.array([], pa.list_(pa.float64())))
        dst, relation = np.asarray(t.column("dst").combine_chunks().fill_null(-1)), np.array(t.column("relation").to_pylist(), dtype=object)
        at = int(np.flatnonzero(first)[0])
        path, relations, activations, confidences = [int(col["src"][at])], [], [float(col["act"][at])], []
        for step in range(p.max_steps):
            go = np.flatnonzero(~first & (col["src"] == path[-1]) & ~np.isin(dst, path))
            if not len(go):
                break
            intent = plan[min(step, len(plan) - 1)]
            score = col["strength"][go] * col["confidence"][go] * col["act"][go] * np.array([bias(intent, r) for r in relation[go]])
            k = min(range(len(go)), key=lambda i: (-round(float(score[i]), 12), int(dst[go[i]]), relation[go[i]]))
            e = go[k]
            path.append(int(dst[e]))
            relations.append(relation[e])
            activations.append(float(col["act"][e]))
            confidences.append(float(col["confidence"][e]))
        lists = {"path": ([path], pa.int64()), "relations": ([relations], pa.string()), "activations": ([activations], pa.float64()), "confidences": ([confidences], pa.float64())}
        return pa.table({"query_id": t.column("query_id").slice(0, 1)} | {k: pa.array(v, pa.list_(kind)) for k, (v, kind) in lists.items()})

    return rows.unionByName(begin).groupBy("query_id").applyInArrow(run, f"query_id {kind}, path array<long>, relations array<string>, activations array<double>, confidences array<double>")


def boost(edges: DataFrame, similarity: DataFrame, floor: float = 0.15) -> DataFrame:
    """Edges with their strength raised by how similar their relation and target are to the query: similarity has (query_id, dst, relation, rel_sim, tgt_sim). Strength may pass 1."""
    over = lambda x: F.greatest(F.lit(0.0), c(x) - floor)
    j = edges.join(similarity, ["query_id", "dst", "relation"], "left")
    factor = 1 + 2 * F.coalesce(over("rel_sim"), F.lit(0.0)) + 0.5 * F.coalesce(over("tgt_sim"), F.lit(0.0))
    return j.select(*edges.columns[: edges.columns.index("strength")], (c("strength") * factor).alias("strength"), *edges.columns[edges.columns.index("strength") + 1 :])


def walk_statistics(walks: DataFrame) -> DataFrame:
    """Number of walks, their steps in all and on average, and their mean confidence."""
    n = F.size("relations")
    return walks.agg(F.count("*").alias("n_walks"), F.sum(n).alias("n_steps"), F.round(F.avg(n), 6).alias("mean_steps"), F.round(F.avg(walk_confidence(c("confidences"))), 6).alias("mean_confidence"))


def update_bias(bias: DataFrame, changes: DataFrame) -> DataFrame:
    """A table of preferences (intent, relation, b) with changes put over it, within [0.1, 3]."""
    key = ["intent", "relation"]
    new = changes.select(*key, F.least(F.greatest("b", F.lit(0.1)), F.lit(3.0)).alias("b"))
    return bias.join(new.select(*key), key, "left_anti").unionByName(new)


def walk_confidence(confidences: Column) -> Column:
    """Geometric mean; 1 of nothing, 0 if one is not positive."""
    total = F.aggregate(confidences, F.lit(0.0), lambda a, x: a + F.log(x))
    return F.when(F.size(confidences) == 0, 1.0).when(F.exists(confidences, lambda x: x <= 0), 0.0).otherwise(F.exp(total / F.size(confidences)))


def steps(walks: DataFrame) -> DataFrame:
    """query_id, t, src, dst, relation, act_src, length: one row a step."""
    s = walks.select("query_id", "path", "activations", F.size("relations").alias("length"), F.posexplode("relations").alias("t", "relation"))
    return s.select("query_id", "t", F.element_at("path", c("t") + 1).alias("src"), F.element_at("path", c("t") + 2).alias("dst"), "relation", F.element_at("activations", c("t") + 1).alias("act_src"), "length")


def eligibility(walk_steps: DataFrame, edges: DataFrame, gamma: float = 0.9) -> DataFrame:
    """query_id, src, dst, relation, eligibility: discounted activation times edge weight, summed over an edge's steps."""
    j = walk_steps.join(edges.select("src", "dst", "relation", "strength", "confidence"), ["src", "dst", "relation"])
    return j.groupBy("query_id", "src", "dst", "relation").agg(F.sum(F.pow(F.lit(gamma), c("t")) * c("act_src") * c("strength") * c("confidence")).alias("eligibility"))


def eligibility_details(walk_steps: DataFrame, edges: DataFrame, gamma: float = 0.9) -> DataFrame:
    """As ``eligibility``, with the contribution of each step, in order."""
    j = walk_steps.join(edges.select("src", "dst", "relation", "strength", "confidence"), ["src", "dst", "relation"])
    part = F.pow(F.lit(gamma), c("t")) * c("act_src") * c("strength") * c("confidence")
    return j.groupBy("query_id", "src", "dst", "relation").agg(F.sum(part).alias("eligibility"), F.array_sort(F.collect_list(F.struct("t", part.alias("part")))).alias("parts"))
