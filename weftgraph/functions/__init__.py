"""Scalar functions as column expressions, all inside code generation where Spark can."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if one has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def quantize(v: Column) -> Column:
    """[-1, 1] to whole numbers within [-127, 127], halves to even."""
    return F.transform(v, lambda x: F.rint(F.least(F.greatest(x.cast("double"), F.lit(-1.0)), F.lit(1.0)) * 127).cast("tinyint"))


def dequantize(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / 127)


def strip(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, r"^[\t\n\x0B\f\r\x1c-\x1f\x85\p{Z}]+|[\t\n\x0B\f\r\x1c-\x1f\x85\p{Z}]+$", "")


def uri_part(uri: Column, n: int) -> Column:
    """The n-th part of a path without outer slashes, underscores as spaces."""
    return F.replace(F.element_at(F.split(F.btrim(uri, F.lit("/")), "/"), n), F.lit("_"), F.lit(" "))


def label_uri(lang: Column, label: Column) -> Column:
    """/c/lang/label in lower case, spaces as underscores; slashes, underscores and per cent signs of the label are escaped."""
    x = F.lower(label)
    for a in "%/_":
        x = F.replace(x, F.lit(a), F.lit(f"%{ord(a):02X}"))
    return F.concat(F.lit("/c/"), lang, F.lit("/"), F.replace(x, F.lit(" "), F.lit("_")))


def uri_label(uri: Column) -> Column:
    """The label, in lower case, of a URI that ``label_uri`` made."""
    x = F.replace(F.element_at(F.split(uri, "/"), 4), F.lit("_"), F.lit(" "))
    for a in "_/%":
        x = F.replace(x, F.lit(f"%{ord(a):02X}"), F.lit(a))
    return x


def edge_key(src: Column, dst: Column, relation: Column) -> Column:
    return F.concat_ws(":", src.cast("string"), dst.cast("string"), relation)


def ngrams(words: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))


def valid_output(text: Column, labels: Column, low: int = 5, high: int = 500, repeats: int = 0) -> Column:
    """Length, a label mentioned, none of the patterns of raw output and, if asked, no n-gram twice."""
    bad = F.lit(False)
    for p in (": intent=", "intent=", "->", "generate:"):
        bad = bad | F.contains(text, F.lit(p))
    ok = F.length(text).between(low, high) & F.exists(labels, lambda x: F.contains(F.lower(text), F.lower(x))) & ~bad
    if repeats:
        g = ngrams(F.split(F.lower(text), " "), repeats)
        ok = ok & (F.size(g) == F.size(F.array_distinct(g)))
    return ok
