"""Feedback as a stream: windows over event time, and edge weights learned from rewards as they come."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftgraph.operators.learning import hebbian
from weftgraph.operators.orphans import apply_deltas
from weftgraph.sources import load_graph, save_graph

c = F.col


def windowed_feedback(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) per window and kind; later events than ``late`` are dropped."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(c("w.start").alias("start"), "event_type", "n", "total")


def feedback_step(edges: DataFrame, batch: DataFrame) -> DataFrame:
    """Edges after a batch of (src, dst, relation, eligibility, reward): sums an edge's rewards weighted by eligibility, so the order within a batch doesn't matter."""
    t = batch.groupBy("src", "dst", "relation").agg(F.sum(c("reward") * c("eligibility")).alias("moved"), F.lit(1.0).alias("eligibility"))
    changed = hebbian(edges, t, c("moved"))
    key = ["src", "dst", "relation"]
    new = changed.select(*key, c("strength").alias("s"), c("confidence").alias("q"))
    return edges.join(new, key, "left").select(*key, F.coalesce("s", "strength").alias("strength"), F.coalesce("q", "confidence").alias("confidence"))


def learn_from(stream: DataFrame, graph_path: str, checkpoint: str):
    """Starts a query that folds each micro-batch into the edges saved at ``graph_path``.

    The batch number is saved with the edges, so a batch that is delivered again after a failure changes nothing.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        edges = load_graph(spark, graph_path, "edges")
        done = load_graph(spark, graph_path, "batches").agg(F.max("number")).first()[0]
        if done is not None and done >= number:
            return
        save_graph(graph_path, edges=feedback_step(edges, batch), batches=spark.createDataFrame([(number,)], "number long"))

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", os.path.join(checkpoint, "feedback")).trigger(availableNow=True).start()


def maintain_orphans(stream: DataFrame, state_path: str, checkpoint: str):
    """Starts a query that adds each micro-batch of deltas (as ``orphans`` makes them) to the orphan state saved at ``state_path``.

    The batch number is saved with the state, so a batch that is delivered again changes nothing; a retraction is a batch of negative deltas.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        done = load_graph(spark, state_path, "batches").agg(F.max("number")).first()[0]
        if done is not None and done >= number:
            return
        state = apply_deltas(load_graph(spark, state_path, "state"), batch)
        save_graph(state_path, state=state, batches=spark.createDataFrame([(number,)], "number long"))

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", os.path.join(checkpoint, "orphans")).trigger(availableNow=True).start()


def counted(stream: DataFrame, key: str = "user_id") -> DataFrame:
    """Running counts a key, kept by the stream's own state."""
    return stream.groupBy(key).agg(F.count("*").alias("n"))
