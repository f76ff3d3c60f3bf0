"""From triples of text to scored edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weftgraph.functions import strip

c = F.col
# Scores of extraction levels and of ways of resolution.
PATTERN_SCORE = {"svo": 0.95, "prep": 0.75, "conj": 0.45}
RESOLUTION_SCORE = {"exact": 1.0, "surface_form": 0.95, "embedding": 0.80, "graph": 0.70, "new": 0.60}


def normalize_label(x: Column) -> Column:
    """Lower case, trimmed, without a possessive ending."""
    s = strip(F.lower(x))
    return strip(F.when(s.endswith("'s"), F.regexp_replace(s, "'s$", "")).when(s.endswith("s'"), F.regexp_replace(s, "'$", "")).otherwise(s))


def once(triples: DataFrame) -> DataFrame:
    """Rows delivered twice once; triples without an end or relation, or from a thing to itself, left out."""
    t = triples.filter(c("triple_id").isNotNull()).groupBy("triple_id").agg(F.min(F.struct("source", "relation", "target", "pattern_level", "confidence", "doc_index")).alias("r")).select("triple_id", "r.*")
    t = t.withColumns({"s": normalize_label(c("source")), "rel": strip(F.lower(c("relation"))), "o": normalize_label(c("target"))})
    return t.filter("s <> '' and o <> '' and rel <> '' and s <> o")


def frequency(triples: DataFrame) -> DataFrame:
    """s, rel, o, freq, first_level, first_doc: distinct triples with the first one's level and document."""
    return triples.groupBy("s", "rel", "o").agg(F.count("*").alias("freq"), F.min_by("pattern_level", "triple_id").alias("first_level"), F.min_by("doc_index", "triple_id").alias("first_doc"), F.min("triple_id").alias("first_id"))


def table_score(x: Column, table: dict[str, float], other: float = 0.5) -> Column:
    return F.coalesce(F.create_map(*[y for k, v in table.items() for y in (F.lit(k), F.lit(v))])[x], F.lit(other))


def confidence_score(level: Column, method: Column, freq: Column, relation_confidence: Column) -> Column:
    p, r, f = table_score(level, PATTERN_SCORE), table_score(method, RESOLUTION_SCORE), 1 - 1 / (freq + 1)
    return F.round((0.5 * p + 0.3 * r + 0.2 * f) * relation_confidence, 4)


def scored_edges(triples: DataFrame, least: float = 0.2) -> DataFrame:
    """s, rel, o, freq, strength, confidence of triples of acceptable confidence."""
    f = frequency(triples)
    score = confidence_score(c("first_level"), F.lit("new"), c("freq"), F.lit(1.0))
    return f.select("s", "rel", "o", "freq", F.least(F.lit(1.0), c("freq") / 5.0).alias("strength"), score.alias("confidence")).filter(c("confidence") >= least)


def chains(triples: DataFrame) -> DataFrame:
    """doc_index, s, rel, o, n: triples that follow each other in a document and meet in a name give a joined one.

    Within a document, a triple's object is the next one's subject, or the other way round; by equal position, a window, not a self-join.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("doc_index").orderBy("triple_id")
    t = triples.filter("doc_index is not null").withColumns({f"p_{k}": F.lag(k).over(w) for k in ("s", "rel", "o")}).filter("p_s is not null")
    on = t.filter("p_o = s and p_s <> o").select("doc_index", c("p_s").alias("s"), F.concat("p_rel", F.lit("→"), "rel").alias("rel"), "o")
    back = t.filter("o = p_s and s <> p_o").select("doc_index", "s", F.concat("rel", F.lit("→"), "p_rel").alias("rel"), c("p_o").alias("o"))
    return on.unionByName(back).groupBy("doc_index", "s", "rel", "o").agg(F.count("*").alias("n"))
