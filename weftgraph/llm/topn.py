"""The N best items of every group, however uneven the groups are.

Exact group counts split the groups: rows of heavy groups are sorted by range of (group, order), with sampled
quantiles, so that a group spans several partitions, of which each keeps its first N before anything else travels; light groups
are ranked by ordinary windows. The union is the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from weftgraph.session import cut, shuffle_partitions

#: Up to so many rows of a group are kept by each range for a last window.
FEW = 1_000


def best_rows(df: DataFrame, item: list[str], order: list) -> DataFrame:
    """One row of each item: the first by ``order``."""
    w = Window.partitionBy(*item).orderBy(*order)
    return df.withColumn("__first", F.row_number().over(w)).filter("__first = 1").drop("__first")


def top_n(df: DataFrame, group: str, order: list, n: int, heavy_rows: int = 100_000, rank: str = "rank_no") -> DataFrame:
    """``df``'s rows that are among the first ``n`` of their group, with their rank from 1.

    ``order`` must be total for a fixed result; equal rows get different ranks. The null group is a group. A group with more
    than ``heavy_rows`` rows is heavy: there are at most all rows / heavy_rows of these, so their list is broadcast. A small ``n`` of each range goes on to
    a last window; a large one is ranked range by range, by how many rows of its group stand in the ranges before, so that no task holds a heavy group.
    """
    key = F.col(group)
    heavy = df.groupBy(key.alias("__g")).agg(F.count("*").alias("__n")).filter(F.col("__n") > heavy_rows).select("__g")
    w = Window.partitionBy(group).orderBy(*order)
    same = df[group].eqNullSafe(heavy["__g"])
    hot = df.join(F.broadcast(heavy), same, "left_semi").repartitionByRange(2 * shuffle_partitions(df.sparkSession), F.col(group), *order)
    cold = df.join(F.broadcast(heavy), same, "left_anti")
    if n > FEW:
        return cold.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n).unionByName(_ranked_by_ranges(hot, group, order, n, rank))
    ranked = [x.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n) for x in (cold, hot)]
    return ranked[0].unionByName(ranked[1])


def _ranked_by_ranges(hot: DataFrame, group: str, order: list, n: int, rank: str) -> DataFrame:
    """Rows of range partitions with the rank in their group, up to ``n``."""
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = cut(hot.sortWithinPartitions(F.col(group), *order).withColumn("__pid", F.spark_partition_id()).withColumn("__at", at))
    runs = rows.groupBy(F.col(group).alias("__g"), F.col("__pid").alias("__p")).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a group
    runs = runs.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).filter(F.col("__before") < n).drop("__n")
    j = rows.join(F.broadcast(runs), rows[group].eqNullSafe(runs["__g"]) & (rows["__pid"] == runs["__p"]))
    j = j.withColumn(rank, (F.col("__before") + F.col("__at") - F.col("__first") + 1).cast("int")).filter(F.col(rank) <= n)
    return j.drop("__g", "__p", "__pid", "__at", "__first", "__before")


def valid_edges(edges: DataFrame) -> DataFrame:
    """Edges with both ends, and strength and confidence within [0, 1] (NaN and infinity are outside)."""
    ok = F.col("source").isNotNull() & F.col("target").isNotNull()
    for c in ("strength", "confidence"):
        ok = ok & F.col(c).between(0, 1) & ~F.isnan(c)
    return edges.filter(ok).select("source", "target", "relation", "strength", "confidence", "edge_id")


def strongest_edges(edges: DataFrame, n: int = 5) -> DataFrame:
    """source, rank_no, edge_id: each source's first n items (target, relation) by strength, confidence, target, relation.

    An item is shown by its row of highest strength, then confidence, then smallest edge_id. A null relation is a relation and comes first.
    """
    c = F.col
    items = best_rows(valid_edges(edges), ["source", "target", "relation"], [c("strength").desc(), c("confidence").desc(), c("edge_id").asc()])
    order = [c("strength").desc(), c("confidence").desc(), c("target").asc(), c("relation").asc()]
    return top_n(items, "source", order, n).select("source", c("rank_no").cast("long").alias("rank_no"), "edge_id")
