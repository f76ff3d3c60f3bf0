"""Queries of the training-data problems, with SQL where SQL can define their results."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftgraph.llm import canonical, encoding, language, leakage, names, neighbours, sentences, topn
from weftgraph.session import cut, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.close_pairs(table(spark, sf, "node_embeddings"))


def p1_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most similar nodes of every node whose id is divisible by 50."""
    r = neighbours.similar(table(spark, sf, "node_embeddings"), 10, -1.0, 50, neighbours.Settings(probes=19, least_p=0.0))
    return r.select("node_id", F.col("rank_no").cast("long").alias("rank_no"), "other", F.round("cosine", 4).alias("cosine"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.duplicates(canonical.collapse(table(spark, sf, "nodes").select("node_id", "label")))


def p4_records(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.collapse(table(spark, sf, "nodes").select("node_id", "label")).filter("node_id = keep_id").select("keep_id", "n_copies")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.split_sentences(table(spark, sf, "cnn_dailymail_train").select("id", "article"), "id", "article").select("id", "sent_start", "sent_end")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return topn.strongest_edges(table(spark, sf, "edges"))


#: Where the public tokenizers' files are; a parameter of the operators.
TOKENIZERS = os.environ.get("WEFT_TOKENIZERS", "/opt/tokenizers")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.link(*[table(spark, sf, t) for t in ("nodes", "kg_build_results", "name_aliases")])


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, sf, "documents").select("doc_id", "text"), (f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/byte_bpe_50k.tiktoken"))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark").select("item_id", "text"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).filter("edits = 0").select("doc_id", "item_id")


def p9_items(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents hold each leaked item, word by word and with small edits."""
    return _leaks(spark, sf).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.count_if(F.col("edits") == 0).alias("n_exact"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return language.wrong_labels(docs, cut(language.label_segments(docs)))


def p10_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Every segment of every document with its language and confidence."""
    found = language.label_segments(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "seg_no", "seg_start", "seg_end", "lang", F.round("confidence", 4).alias("confidence"))


QUERIES = {"p10_labels": p10_labels, "p1_found": p1_found, "p1_topk": p1_topk, "p4_found": p4_found, "p4_records": p4_records, "p5_found": p5_found, "p6_found": p6_found, "p7_found": p7_found, "p8_ids": p8_ids, "p9_found": p9_found, "p9_items": p9_items, "p10_found": p10_found}
_P4 = r"""
WITH n AS (SELECT DISTINCT node_id, label FROM nodes WHERE label IS NOT NULL AND node_id IS NOT NULL),
f AS (SELECT node_id, list_sort(list_filter(list_transform(string_split(replace(label, ';', '|'), '|'), lambda x: regexp_replace(lower(x), '[^\p{L}\p{Nd}]', '', 'g')), lambda x: x <> '')) AS f FROM n),
k AS (SELECT node_id, min(node_id) OVER (PARTITION BY f) AS keep_id FROM f WHERE len(f) > 0)
"""
_P9 = r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM benchmark),
iw AS (SELECT item_id, least(len(w), 13) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda k: list_slice(w, k, k + least(len(w), 13) - 1))) AS g FROM i WHERE len(w) > 0),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM documents WHERE text IS NOT NULL),
dw AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: list_slice(w, k, k + n - 1))) AS g FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
"""
_P1 = """
WITH l AS (SELECT node_id, coalesce(vector, embedding) AS v FROM node_embeddings WHERE node_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY saved_at DESC NULLS LAST, emb_id DESC) = 1),
w AS (SELECT node_id, CAST(v AS DOUBLE[64]) AS v FROM l WHERE len(v) = 64 AND NOT list_bool_or(list_transform(v, lambda x: x IS NULL OR NOT isfinite(x))) AND list_bool_or(list_transform(v, lambda x: x <> 0))),
c AS (SELECT a.node_id AS node_id, b.node_id AS other, array_cosine_similarity(a.v, b.v) AS cosine FROM w a JOIN w b ON a.node_id <> b.node_id{0})
"""
SQL = {
    "p1_found": _P1.format("") + "SELECT DISTINCT least(node_id, other) AS node_a, greatest(node_id, other) AS node_b FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY round(cosine, 9) DESC, other) <= 10) WHERE cosine >= 0.9",
    "p4_found": _P4 + "SELECT keep_id, node_id FROM k WHERE keep_id <> node_id",
    "p4_records": _P4 + "SELECT keep_id, count(*) AS n_copies FROM k GROUP BY 1",
    "p9_found": _P9 + "SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (n, g)",
    "p6_found": """
WITH v AS (SELECT * FROM edges WHERE source IS NOT NULL AND target IS NOT NULL AND isfinite(strength) AND isfinite(confidence) AND strength BETWEEN 0 AND 1 AND confidence BETWEEN 0 AND 1),
i AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY source, target, relation ORDER BY strength DESC, confidence DESC, edge_id) = 1)
SELECT source, row_number() OVER (PARTITION BY source ORDER BY strength DESC, confidence DESC, target, relation NULLS FIRST) AS rank_no, edge_id FROM i QUALIFY rank_no <= 5""",
}
