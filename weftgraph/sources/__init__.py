"""Reading triples, sentences and documents from files of several formats, and keeping graphs on disk."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

c = F.col
# Format by extension.
FORMATS = {"json": "json", "jsonl": "json", "csv": "csv", "tsv": "csv", "parquet": "parquet", "db": "sqlite", "sqlite": "sqlite", "txt": "text", "text": "text"}
#: A document that comes in a row of fields is longer than this.
SHORTEST_DOCUMENT = 20


def detect_format(path: str) -> str:
    """The format of a path by its extension; ValueError for an unknown one."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
    if ext not in FORMATS:
        raise ValueError(f"unknown format: {ext!r} of {path}")
    return FORMATS[ext]


def _route(df: DataFrame, ordinal: Column) -> DataFrame:
    """Rows of fields as (ord, kind, h, r, t, text): a triple, else a sentence, else a document, by the fields that are filled."""
    have = {k.lower(): k for k in df.columns}
    get = lambda *names: F.coalesce(*[c(f"`{have[n]}`").cast("string") for n in names if n in have], F.lit(None).cast("string"))
    h, r, t = get("head", "subject"), get("relation", "predicate"), get("tail", "object")
    sentence, doc = get("sentence"), get("article", "document", "text")
    triple = h.isNotNull() & r.isNotNull() & t.isNotNull()
    kind = F.when(triple, "triple").when(sentence.isNotNull(), "sentence").when(F.length(doc) > SHORTEST_DOCUMENT, "document")
    return df.select(ordinal.alias("ord"), kind.alias("kind"), F.when(triple, h).alias("h"), F.when(triple, r).alias("r"), F.when(triple, t).alias("t"), F.when(~triple, F.coalesce(sentence, doc)).alias("text")).filter("kind is not null")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header first; a .tsv is separated by tabs."""
    return _route(spark.read.csv(path, header=True, sep="\t" if path.endswith(".tsv") else ",", multiLine=False), F.monotonically_increasing_id())


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array, one object, or an object a line; a line that isn't JSON is a document, and so is a bare string."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    first = lines.limit(1).collect()
    whole = bool(first) and first[0].value.lstrip()[:1] == "["
    fields = T.StructType([T.StructField(k, T.StringType()) for k in ("head", "relation", "tail", "subject", "predicate", "object", "sentence", "article", "document", "text")])
    if whole:
        doc = spark.read.text(path, wholetext=True)
        items = doc.select(F.posexplode(F.from_json("value", T.ArrayType(T.StringType()))).alias("ord", "value"))
    else:
        items = lines.select(F.monotonically_increasing_id().alias("ord"), "value")
    parsed = items.select("ord", "value", F.from_json("value", fields).alias("j"), F.trim("value").startswith("{").alias("is_object"))
    good = F.col("is_object") & F.try_parse_json("value").isNotNull()
    rows = _route(parsed.filter(good).select("ord", "j.*"), c("ord"))
    raw = parsed.filter(~good).select("ord", F.lit("document").alias("kind"), *[F.lit(None).cast("string").alias(k) for k in "hrt"], F.when(F.trim("value").rlike('^".*"$'), F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), "v string")["v"]).otherwise(c("value")).alias("text"))
    return rows.unionByName(raw)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A document a line, blank lines left out; ord counts all lines."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.trim("value").alias("text")).filter("text <> ''").select("ord", F.lit("document").alias("kind"), *[F.lit(None).cast("string").alias(k) for k in "hrt"], "text")


def read_triples(spark: SparkSession, path: str, lang: str | None = None, relation: str | None = None) -> DataFrame:
    """Distinct triples of a parquet of subject, predicate, object; URIs give their labels, and both ends must be of ``lang`` if that is asked."""
    from weftgraph.functions import uri_part

    df = spark.read.parquet(path).select("subject", "predicate", "object")
    uri = lambda x: c(x).rlike("^(https?:/)?/?")
    part = lambda x, i: F.when(c(x).contains("/c/"), uri_part(F.regexp_extract(c(x), "/c/.*", 0), i))
    if lang:
        df = df.filter((part("subject", 2) == lang) & (part("object", 2) == lang))
    del uri
    rel = F.replace(F.element_at(F.split(F.btrim("predicate", F.lit("/")), "/"), -1), F.lit("_"), F.lit(" "))
    out = df.select(F.coalesce(part("subject", 3), c("subject")).alias("h"), rel.alias("r"), F.coalesce(part("object", 3), c("object")).alias("t"))
    return (out.filter(c("r") == relation) if relation else out).dropDuplicates()


def first_kind(rows: DataFrame) -> DataFrame:
    """Of rows (kind, ...) those of the first kind there is: documents, else sentences, else triples."""
    have = {r.kind for r in rows.select("kind").distinct().collect()}
    kind = next((k for k in ("document", "sentence", "triple") if k in have), "document")
    return rows.filter(c("kind") == kind)


def read_any(spark: SparkSession, path: str, start: int = 0, end: int | None = None, max_entries: int | None = None) -> DataFrame:
    """(ord, kind, h, r, t, text) of a file, by its extension: with a range, rows [start, end) by position of the first kind there is; ``max_entries`` ends the range sooner."""
    if max_entries is not None:
        end = start + max_entries if end is None else min(end, start + max_entries)
    fmt = detect_format(path)
    if fmt == "csv":
        df = read_csv(spark, path)
    elif fmt == "json":
        df = read_json(spark, path)
    elif fmt == "text":
        df = read_text(spark, path)
    elif fmt == "sqlite":
        df = read_sqlite_triples(spark, path)
    else:
        df = read_triples(spark, path).select(F.monotonically_increasing_id().alias("ord"), F.lit("triple").alias("kind"), "h", "r", "t", F.lit(None).cast("string").alias("text"))
    if start == 0 and end is None:
        return df
    from weftgraph.session import cut

    df = first_kind(df)
    # positions: sizes of the partitions, then an offset for each; no row goes to one task
    d = cut(df.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    offsets = d.groupBy("__p").agg(F.count("*").alias("__n")).select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    pos = c("__before") + c("__i")
    return d.join(F.broadcast(offsets), "__p").filter((pos >= start) & (pos < (end if end is not None else 1 << 62))).select(*df.columns)


class SqliteSource:
    """Registers a Python data source 'sqlite_table' (options path, table) on a session."""

    @staticmethod
    def register(spark: SparkSession) -> None:
        from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

        class Reader(DataSourceReader):
            def __init__(self, schema, options):
                self.schema, self.options = schema, options

            def partitions(self):
                import sqlite3

                with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
                    low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.options["table"]}"').fetchone()
                if low is None:
                    return []
                n = max(1, min(int(self.options.get("partitions", 8)), (high - low) // 50_000 + 1))
                step = (high - low) // n + 1
                return [InputPartition((low + i * step, low + (i + 1) * step)) for i in range(n)]

            def read(self, partition):
                import sqlite3

                a, b = partition.value
                names = ", ".join(f'"{f}"' for f in self.schema.fieldNames())
                with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
                    yield from db.execute(f'SELECT {names} FROM "{self.options["table"]}" WHERE rowid >= ? AND rowid < ?', (a, b))

        class Source(DataSource):
            @classmethod
            def name(cls):
                return "sqlite_table"

            def schema(self):
                import sqlite3

                kinds = {"INTEGER": "long", "INT": "long", "REAL": "double", "BLOB": "binary"}
                with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
                    cols = db.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
                return ", ".join(f"`{x[1]}` {kinds.get(x[2].upper(), 'string')}" for x in cols)

            def reader(self, schema):
                return Reader(schema, self.options)

        spark.dataSource.register(Source)


def read_sqlite(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of a SQLite file, by ranges of rowid."""
    SqliteSource.register(spark)
    return spark.read.format("sqlite_table").option("path", path).option("table", table).load()


def read_sqlite_triples(spark: SparkSession, path: str) -> DataFrame:
    """The edges of a SQLite graph as triples of labels."""
    n, e = read_sqlite(spark, path, "nodes").select("id", "label"), read_sqlite(spark, path, "edges")
    src, dst = ("source_id", "target_id") if "source_id" in e.columns else ("source", "target")
    j = e.join(n.select(c("id").alias(src), c("label").alias("h")), src).join(n.select(c("id").alias(dst), c("label").alias("t")), dst)
    return j.select(F.monotonically_increasing_id().alias("ord"), F.lit("triple").alias("kind"), "h", c("relation").alias("r"), "t", F.lit(None).cast("string").alias("text"))


def save_graph(path: str, **tables: DataFrame) -> None:
    """Writes the tables of a graph under a new folder and makes it current at the end, so a broken write leaves the old one."""
    spark = next(iter(tables.values())).sparkSession
    import time

    version = f"v{time.time_ns()}"
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{version}/{name}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").parquet(f"{path}/versions")


def load_graph(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the last graph that was saved whole."""
    version = spark.read.parquet(f"{path}/versions").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{path}/{version}/{name}")


def ingest(spark: SparkSession, path: str, out: str) -> None:
    """File to graph: triples, given or found in sentences and documents by patterns, are counted, scored and numbered, and the node, edge and embedding tables saved."""
    from weftgraph.functions import encoder
    from weftgraph.operators import extract, graph, kg

    rows = read_any(spark, path)
    told = extract.triples(extract.sentences(rows.filter("kind <> 'triple'").select(c("ord").alias("doc_id"), "text")))
    told = told.select(F.xxhash64("s", "rel", "o", "doc_id", "sent_idx").alias("triple_id"), c("s").alias("source"), c("rel").alias("relation"), c("o").alias("target"), F.lit("svo").alias("pattern_level"), F.lit(None).cast("double").alias("confidence"), c("doc_id").alias("doc_index"))
    rows = rows.filter("kind = 'triple'")
    t = rows.select(F.xxhash64("h", "r", "t", "ord").alias("triple_id"), c("h").alias("source"), c("r").alias("relation"), c("t").alias("target"), F.lit("svo").alias("pattern_level"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("long").alias("doc_index"))
    edges = kg.scored_edges(kg.once(t.unionByName(told)))
    labels = edges.select(F.explode(F.array("s", "o")).alias("label"))
    nodes = graph.new_ids(labels, spark.createDataFrame([], "node_id long, label string"))
    ids = nodes.select(c("label").alias("s"), c("node_id").alias("src")), nodes.select(c("label").alias("o"), c("node_id").alias("dst"))
    linked = edges.join(ids[0], "s").join(ids[1], "o").select("src", "dst", c("rel").alias("relation"), "strength", "confidence", c("freq").alias("frequency"))
    save_graph(out, nodes=nodes, edges=linked, embeddings=encoder.with_vectors(nodes.select("node_id", "label"), "label").select("node_id", "v"))
