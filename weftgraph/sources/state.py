"""What is kept between runs: graphs as JSON, metadata, learning state, registries, metrics; every write is whole or not there."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftgraph.sources import load_graph, save_graph

c = F.col


def save_json(path: str, **tables: DataFrame) -> None:
    """Writes tables as folders of JSON lines under a new version and makes it current at the end."""
    spark = next(iter(tables.values())).sparkSession
    version = f"v{time.time_ns()}"
    for name, df in tables.items():
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{version}/{name}")
        spark.createDataFrame([(name, df.schema.json())], "name string, schema string").coalesce(1).write.mode("append").json(f"{path}/{version}/_schemas")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").parquet(f"{path}/versions")


def load_json(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the last version that was written whole, with the types it was saved with."""
    from pyspark.sql.types import StructType
    import json

    version = spark.read.parquet(f"{path}/versions").agg(F.max("version")).first()[0]
    schema = spark.read.schema("name string, schema string").json(f"{path}/{version}/_schemas").filter(c("name") == name).first().schema
    return spark.read.schema(StructType.fromJson(json.loads(schema))).json(f"{path}/{version}/{name}")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """version, saved_at of everything saved at a path, oldest first."""
    v = spark.read.parquet(f"{path}/versions").distinct()
    return v.select("version", F.timestamp_micros((F.substring("version", 2, 30).cast("long") / 1000).cast("long")).alias("saved_at")).orderBy("version")


def set_metadata(spark: SparkSession, path: str, values: dict[str, str]) -> None:
    """Adds to the metadata at a path; the last value of a key counts."""
    now = time.time_ns()
    spark.createDataFrame([(k, str(v), now) for k, v in values.items()], "key string, value string, written long").coalesce(1).write.mode("append").parquet(f"{path}/metadata")


def get_metadata(spark: SparkSession, path: str) -> DataFrame:
    """key, value."""
    return spark.read.parquet(f"{path}/metadata").groupBy("key").agg(F.max_by("value", "written").alias("value"))


#: Parts of a learning state; others are refused.
PARTS = ("edges", "theta", "rewards", "patterns", "audits", "counters", "registry")


def save_state(path: str, **parts: DataFrame) -> None:
    """Saves parts of a learning state together."""
    if unknown := sorted(set(parts) - set(PARTS)):
        raise ValueError(f"unknown parts: {', '.join(unknown)}")
    save_graph(path, **parts)


def load_state(spark: SparkSession, path: str, part: str) -> DataFrame:
    if part not in PARTS:
        raise ValueError(f"unknown part: {part}")
    return load_graph(spark, path, part)


def last_audits(audits: DataFrame, n: int) -> DataFrame:
    """The last ``n`` audits by their time (at), newest first."""
    return audits.orderBy(c("at").desc()).limit(n)


def add_metrics(spark: SparkSession, path: str, run: str, values: dict[str, float]) -> None:
    """Appends the figures of a run, with the time, to the history at a path."""
    rows = [(run, k, float(v), time.time()) for k, v in values.items()]
    spark.createDataFrame(rows, "run string, name string, value double, at double").coalesce(1).write.mode("append").json(path)


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """run, name, value, at."""
    return spark.read.schema("run string, name string, value double, at double").json(path)
