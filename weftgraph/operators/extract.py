"""Triples from sentences by fixed patterns, for when no parser is at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weftgraph.functions import strip

c = F.col
# Patterns in order; the first five need exactly one occurrence, verbs split at their first one.
ONCE = (" is part of ", " is the opposite of ", " is in ", " is an ", " is a ", " is ")
VERBS = ("developed", "discovered", "formulated", "invented", "introduced", "established", "built", "originated in", "has", "causes", "caused")


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, sent_idx, sentence: pieces between end marks and line breaks, trimmed, empty ones left out."""
    s = docs.filter("text is not null").select("doc_id", F.posexplode(F.split("text", r"[.!?\n]+")).alias("sent_idx", "s"))
    return s.select("doc_id", "sent_idx", strip(c("s")).alias("sentence")).filter("sentence <> ''")


# What a period may stand behind without ending a sentence.
SHORTENED = ("Mr", "Mrs", "Ms", "Dr", "Prof", "St", "No", "vs", "etc", "Inc", "Ltd", "Jr", "Sr")


def safe_sentences(docs: DataFrame) -> DataFrame:
    """doc_id, sent_idx, sentence: as ``sentences``, but a mark ends one only before white space, with what it ends, and not behind an abbreviation or an initial."""
    held = F.regexp_replace("text", r"\b(" + "|".join(SHORTENED) + r"|[A-Z])\.", "$1\u0001")
    cut = F.split(F.regexp_replace(held, r"([.!?]+)[ \t\n\r]+", "$1\n"), "\n")
    s = docs.filter("text is not null").select("doc_id", F.posexplode(cut).alias("sent_idx", "s"))
    return s.select("doc_id", "sent_idx", strip(F.replace("s", F.lit("\u0001"), F.lit("."))).alias("sentence")).filter("sentence <> ''")


def _relation(pattern: str) -> str:
    return "is" if pattern in (" is an ", " is a ", " is ") else pattern.strip()


def triples(sents: DataFrame) -> DataFrame:
    """sents with s, rel, o of the first pattern that fits."""
    rule: Column = F.lit(None).cast("struct<s:string,rel:string,o:string>")
    options = []
    for p in ONCE:
        parts = F.split("sentence", p)
        ok = F.size(parts) == 2
        if p == " is ":
            ok = ok & ~F.element_at(parts, 2).startswith("the ")
        options.append(F.when(ok, F.struct(F.element_at(parts, 1).alias("s"), F.lit(_relation(p)).alias("rel"), F.element_at(parts, 2).alias("o"))))
    for v in VERBS:
        parts = F.split("sentence", f" {v} ", 2)
        options.append(F.when(F.size(parts) == 2, F.struct(F.element_at(parts, 1).alias("s"), F.lit(v).alias("rel"), F.element_at(parts, 2).alias("o"))))
    t = sents.withColumn("x", F.coalesce(*options, rule)).filter("x is not null")
    t = t.select(*sents.columns, strip(F.lower("x.s")).alias("s"), c("x.rel").alias("rel"), strip(F.lower("x.o")).alias("o"))
    return t.filter("s <> '' and o <> '' and s <> o")
