"""Fuzzy standardisation of values and similarity joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import bigrams, hybrid_of, normal, prepared, tokens
from ..functions.tables import written


def map_lookup(df: DataFrame, mapping: DataFrame, key: str, value: str = "value", most: int = 200_000) -> DataFrame:
    """Left equi-join with a mapping (key, value); broadcast only up to `most` rows."""
    small = mapping.select(F.col("key").alias("__k"), F.col("value").alias(value))
    side = F.broadcast(small) if mapping.limit(most + 1).count() <= most else small
    return df.join(side, normal(F.col(key)) == F.col("__k"), "left").drop("__k")


def _ranked(texts: DataFrame, frequency: DataFrame) -> DataFrame:
    """(text, grams): the different bigrams of every text (none of a single character), rarest over all texts first, each with the share of the text's squared norm that it and those after it have."""
    counts = texts.select("text", F.explode(bigrams(F.col("text"))).alias("gram")).groupBy("text", "gram").agg(F.count("*").alias("n")).join(frequency, "gram")
    ranked = counts.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("texts", "gram", "n"))).alias("grams"))  # bounded by the text
    norm = "aggregate(grams, 0L, (s, g) -> s + g.n * g.n)"
    shares = F.expr(f"transform(grams, (g, k) -> named_struct('gram', g.gram, 'left', aggregate(slice(grams, k + 1, size(grams)), 0L, (s, o) -> s + o.n * o.n) / {norm}))")
    none = F.array().cast("array<struct<gram:string,left:double>>")
    return texts.join(ranked.select("text", shares.alias("grams")), "text", "left").select("text", F.coalesce("grams", none).alias("grams"), prepared(F.col("text")).alias("side"))


def ranked_texts(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides' texts with their bigrams, rarest over both sides first, and what their scores need."""
    grams = left.select("text").union(right.select("text")).select(F.explode(F.array_distinct(bigrams(F.col("text")))).alias("gram"))
    frequency = grams.groupBy("gram").agg(F.count("*").alias("texts"))
    return written(_ranked(left.select("text"), frequency), "ranked"), written(_ranked(right.select("text"), frequency), "ranked")


def candidates(x: DataFrame, y: DataFrame, t: float) -> DataFrame:
    """Pairs (a, b) of texts among which all are that have a hybrid score of t or more; x and y are from ranked_texts.

    Where one text contains the other, the shorter one's rarest bigram is in
    the longer. Else the score is at most 0.3 (overlap is of the smaller set, so
    it can be whole) and 0.3 times the cosine, so that the cosine is t / 0.3 - 1
    or more: the rarest bigram that the texts share is, on either side, among
    those without which the rest has too small a part of the norm. For t over
    0.6 only containment is left; for t of 0.3 and less every shared token and
    bigram counts. Texts of one character are looked up among the characters
    of all.
    """

    def keyed(df: DataFrame, name: str, keys: Column) -> DataFrame:
        return df.select(F.col("text").alias(name), F.explode(keys).alias("__key"))

    def met(a: Column, b: Column, left: DataFrame = x, right: DataFrame = y) -> DataFrame:
        return keyed(left, "a", a).join(keyed(right, "b", b), "__key").select("a", "b")

    letters, every = F.array_distinct(F.split("text", "")), F.transform("grams", lambda g: g["gram"])
    one, rarest = F.length("text") == 1, F.slice(every, 1, 1)
    pairs = met(F.array("text"), letters, left=x.filter(one)).union(met(letters, F.array("text"), right=y.filter(one)))
    cosine = t / 0.3 - 1
    if cosine <= 0:
        shared = F.array_union(tokens(F.col("text")), every)
        return pairs.union(met(shared, shared)).distinct()
    if cosine <= 1:
        # The part of the norm from a bigram on is a squared cosine's bound; a little slack for rounding.
        first = F.transform(F.filter("grams", lambda g: g["left"] >= cosine**2 - 1e-9), lambda g: g["gram"])
        pairs = pairs.union(met(first, first))
    return pairs.union(met(rarest, every)).union(met(every, rarest)).distinct()


def similarity_join(a: DataFrame, b: DataFrame, col_a: str, col_b: str, t: float) -> DataFrame:
    """Pairs of distinct texts of two columns with a hybrid score of t or more: a, b, score. No pair is lost for t > 0. Null and blank texts have none."""
    left, right = (df.select(normal(F.col(c)).alias("text")).filter("text is not null and text <> ''").distinct() for df, c in ((a, col_a), (b, col_b)))
    return _scored(*ranked_texts(left, right), t)


def _scored(x: DataFrame, y: DataFrame, t: float) -> DataFrame:
    """(a, b, score) of the candidates with a score of t or more."""
    one, two = x.select(F.col("text").alias("a"), F.col("side").alias("__a")), y.select(F.col("text").alias("b"), F.col("side").alias("__b"))
    scored = candidates(x, y, t).join(one, "a").join(two, "b")
    return scored.select("a", "b", hybrid_of(F.col("__a"), F.col("__b")).alias("score")).filter(F.col("score") >= t)


#: Scores down to which best matches are looked for one after the other: over 0.6 only texts that contain one another are met, down to 0.5 only those that share a rare bigram; what is left under 0.32 meets by every token and bigram.
LEVELS = (0.600001, 0.5, 0.32, 0.0)


def best_matches(values: DataFrame, keys: DataFrame) -> DataFrame:
    """(text, key, score): the key (text) with the greatest hybrid score for each value (text), of equals the smallest; values with none over 0 are left out.

    All pairs over a level are found before those under it are looked for, and
    a value whose best score is over the level takes no further part.
    """
    x, y = ranked_texts(values, keys)
    found, rest = [], x
    for k, t in enumerate(LEVELS):
        pairs = _scored(rest, y, t).filter("score > 0")
        best = pairs.groupBy("a").agg(F.min(F.struct((-F.col("score")).alias("under"), F.col("b").alias("key"))).alias("m"))
        found.append(written(best.select(F.col("a").alias("text"), "m.key", (-F.col("m.under")).alias("score")), "best"))
        if k + 1 < len(LEVELS):
            rest = written(rest.join(found[-1].select("text"), "text", "left_anti"), "rest")
            if rest.isEmpty():
                break
    return reduce(DataFrame.union, found)


def score_values(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Every distinct value of a column with its best key of the mapping: value, n, key, target, score, method.

    Exact matches first; only the rest is scored (best_matches), distinct
    values against keys. Ties go to the smallest key.
    """
    spark = df.sparkSession
    keys = spark.createDataFrame([(k.strip().lower(), v) for k, v in mapping.items()], "key string, target string")
    values = df.select(normal(F.col(column)).alias("value")).filter("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    exact = values.join(keys, values["value"] == keys["key"]).select("value", "n", "key", "target", F.lit(1.0).alias("score"), F.lit("exact").alias("method"))
    rest = written(values.join(keys, values["value"] == keys["key"], "left_anti"), "unmatched")
    best = best_matches(rest.select(F.col("value").alias("text")), keys.select(F.col("key").alias("text")).filter("text <> ''")).join(keys, "key")
    fuzzy = rest.join(best.select(F.col("text").alias("__v"), "key", "target", "score"), F.col("value") == F.col("__v"), "left").select("value", "n", "key", "target", F.coalesce("score", F.lit(0.0)).alias("score"), F.lit("fuzzy").alias("method"))
    return exact.unionByName(fuzzy)


def standardize(df: DataFrame, column: str, mapping: dict[str, str], threshold: float = 0.85, fallback: str | None = None, policy: str = "keep", version: str = "1", now: str = "2030-01-01", semantic_type: str = "category") -> DataFrame:
    """df and `<column>_semantic`: struct(category, confidence, method, version, processed_at, semantic_type).

    Values under the threshold keep their text, become null or the fallback, by policy (keep, null, fallback).
    """
    scored = score_values(df, column, mapping)
    low = {"keep": F.col("value"), "null": F.lit(None).cast("string"), "fallback": F.lit(fallback)}[policy]
    ok = F.col("score") >= threshold
    result = F.struct(F.when(ok, F.col("target")).otherwise(low).alias("category"), F.col("score").alias("confidence"), F.when(ok, F.col("method")).otherwise(F.lit("fallback")).alias("method"), F.lit(version).alias("version"), F.lit(now).cast("timestamp").alias("processed_at"), F.lit(semantic_type).alias("semantic_type"))
    side = scored.select(F.col("value").alias("__v"), result.alias(f"{column}_semantic"))
    return df.join(side, normal(F.col(column)) == F.col("__v"), "left").drop("__v")


def shape_output(df: DataFrame, column: str, mode: str, evolving: bool = False, fields: tuple[str, ...] = ("category", "confidence")) -> DataFrame:
    """How the result of standardize is laid out: enriched, json, semantic_overwrite, full, clean_only."""
    s = f"{column}_semantic"
    if mode == "enriched":
        return df
    if mode == "json":
        return df.withColumn(s, F.to_json(s))
    if mode == "semantic_overwrite":
        kept = df.withColumn(f"_raw_{column}", F.col(column)) if evolving else df
        return kept.withColumn(column, F.coalesce(F.col(f"{s}.category"), F.col(column))).drop(s)
    if mode == "full":
        return df.withColumns({f"{column}_{f}": F.col(f"{s}.{f}") for f in fields}).drop(s)
    if mode == "clean_only":
        return df.withColumn(column, normal(F.col(column))).drop(s)
    raise ValueError(f"no such mode: {mode}")


def mapping_stats(scored: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Rates over rows: matched, fallen back, mean confidence, drifted concepts; and unseen distinct values."""
    n, ok = F.col("n"), F.col("score") >= threshold
    rate = lambda c: F.round(F.sum(F.when(c, n).otherwise(0)) / F.greatest(F.sum(n), F.lit(1)), 6)
    return scored.agg(rate(ok).alias("match_rate"), rate(~ok).alias("fallback_rate"), F.round(F.sum(F.col("score") * n) / F.greatest(F.sum(n), F.lit(1)), 6).alias("mean_confidence"), rate(F.col("score") < threshold).alias("drift_rate"), F.count(F.when(F.col("method") != "exact", 1)).alias("unseen"))


def review_queue(scored: DataFrame) -> DataFrame:
    """Values to learn: over 0.90 at once, down to 0.60 as a suggestion, else other; the more frequent and doubtful first."""
    decision = F.when(F.col("score") > 0.90, "auto_learn").when(F.col("score") > 0.60, "suggest").otherwise("other")
    queue = scored.filter("method <> 'exact'")
    return queue.select("value", "n", "key", "score", decision.alias("decision"), F.round(F.col("n") * (1 - F.col("score")), 6).alias("priority"))


def apply_reviews(mapping: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """mapping (key, target) after reviews (key, decision: approve, override or reject; target), and the share of overrides."""
    r = reviews.select(F.col("key").alias("__k"), "decision", F.col("target").alias("__t"))
    joined = mapping.join(r, F.col("key") == F.col("__k"), "full_outer").filter("decision is null or decision <> 'reject'")
    out = joined.select(F.coalesce("key", "__k").alias("key"), F.when(F.col("decision") == "override", F.col("__t")).otherwise(F.coalesce("target", "__t")).alias("target"))
    return out, reviews.agg(F.round(F.coalesce(F.avg((F.col("decision") == "override").cast("int")), F.lit(0.0)), 6).alias("override_rate"))
