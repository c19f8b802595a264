"""Similarity of short texts: containment, shared tokens and character bigrams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal(c: Column) -> Column:
    return F.lower(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""))


def tokens(c: Column) -> Column:
    """Distinct words of a normalised text: what stands between blanks."""
    return F.array_distinct(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def bigrams(c: Column) -> Column:
    """All character bigrams of a normalised text, repeats included; a single character has none."""
    n = F.length(c)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(c, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def _counted(grams: Column) -> Column:
    """Distinct grams and how often each is there."""
    return F.transform(F.array_distinct(grams), lambda g: F.struct(g.alias("g"), F.size(F.filter(grams, lambda x: x == g)).cast("double").alias("n")))


def bigram_cosine(a: Column, b: Column) -> Column:
    """Cosine of bigram counts; 0 where a text has none."""
    x, y = _counted(a), _counted(b)
    dot = F.aggregate(x, F.lit(0.0), lambda s, e: s + e.n * F.coalesce(F.get(F.filter(y, lambda o: o.g == e.g), F.lit(0)).n, F.lit(0.0)))
    norm = lambda z: F.sqrt(F.aggregate(z, F.lit(0.0), lambda s, e: s + e.n * e.n))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), dot / (norm(x) * norm(y))).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    """Shared distinct elements over those of the smaller set."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(0.0)


def hybrid_score(a: Column, b: Column) -> Column:
    """Equal texts 1; else 0.4 containment + 0.3 token overlap (of bigrams where no token is shared) + 0.3 bigram cosine, 0.95 and more being 1. Of normalised texts."""
    shared = overlap(tokens(a), tokens(b))
    grams = overlap(F.array_distinct(bigrams(a)), F.array_distinct(bigrams(b)))
    return _hybrid(a, b, shared, grams, bigram_cosine(bigrams(a), bigrams(b)))


def prepared(c: Column) -> Column:
    """What hybrid_of needs of a normalised text, found once however many others it is held against."""
    counted = _counted(bigrams(c))
    return F.struct(
        c.alias("text"),
        tokens(c).alias("tokens"),
        F.array_distinct(bigrams(c)).alias("grams"),
        F.map_from_entries(counted).alias("bag"),
        F.sqrt(F.aggregate(counted, F.lit(0.0), lambda s, e: s + e.n * e.n)).alias("norm"),
    )


def hybrid_of(a: Column, b: Column) -> Column:
    """hybrid_score of two prepared texts."""
    dot = F.aggregate(a["grams"], F.lit(0.0), lambda s, g: s + F.try_element_at(a["bag"], g) * F.coalesce(F.try_element_at(b["bag"], g), F.lit(0.0)))
    cosine = F.when((a["norm"] > 0) & (b["norm"] > 0), dot / (a["norm"] * b["norm"])).otherwise(0.0)
    return _hybrid(a["text"], b["text"], overlap(a["tokens"], b["tokens"]), overlap(a["grams"], b["grams"]), cosine)


def _hybrid(a: Column, b: Column, shared: Column, grams: Column, cosine: Column) -> Column:
    contained = F.when(a.contains(b) | b.contains(a), 1.0).otherwise(0.0)
    score = 0.4 * contained + 0.3 * F.when(shared > 0, shared).otherwise(grams) + 0.3 * cosine
    return F.when((a == b) | (score >= 0.95), 1.0).otherwise(F.round(score, 6))
