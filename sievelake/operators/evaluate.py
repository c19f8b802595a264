"""How well defects are found, and reports on groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.when(b > 0, a / F.greatest(b, F.lit(1))).otherwise(0.0), 6)


def outcomes(rows: DataFrame, zoned: DataFrame, truth: DataFrame, row_id: str, key: list[str]) -> DataFrame:
    """(row_id, error_type, outcome, reason, detected) of every labelled row.

    rows: the input, with its key; zoned: what a run made of it (row_id, zone,
    reject_reason); truth: (row_id, error_type), null for sound rows. A row
    that the run has neither clean nor quarantined is dropped. Where a key
    repeats and at most one of its rows is clean, a duplicate counts as
    detected, and sound rows of the key are no error. Else a row is detected
    if it is not clean. Counts of a key come by partial sums, so that a key
    with very many rows, null too, is no task of its own.
    """
    made = zoned.select(F.col(row_id).alias("of_row"), "zone", "reject_reason")
    own = rows.select(row_id, *key).join(made, F.col(row_id) == F.col("of_row"), "left").withColumn("outcome", F.coalesce("zone", F.lit("dropped")))
    groups = own.groupBy(*[F.col(c).alias(f"of_{c}") for c in key]).agg(F.count("*").alias("size"), F.count(F.when(F.col("outcome") == "clean", 1)).alias("survivors"))
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    marked = truth.select(row_id, "error_type").join(own.join(groups, same).select(row_id, "outcome", "reject_reason", ((F.col("size") > 1) & (F.col("survivors") <= 1)).alias("collapsed")), row_id, "left")
    collapsed, outcome = F.coalesce("collapsed", F.lit(False)), F.coalesce("outcome", F.lit("dropped"))
    detected = F.when(F.col("error_type") == "duplicate", collapsed).when(F.col("error_type").isNull() & collapsed, False).otherwise(outcome != "clean")
    return marked.select(row_id, "error_type", outcome.alias("outcome"), F.coalesce("reject_reason", outcome).alias("reason"), detected.alias("detected"))


def detection(found: DataFrame) -> DataFrame:
    """Confusion, precision, recall and accuracy from outcomes()."""
    bad, hit = F.col("error_type").isNotNull(), F.col("detected")
    one = found.agg(*[F.count(F.when(c, 1)).alias(k) for k, c in (("tp", bad & hit), ("fp", ~bad & hit), ("fn", bad & ~hit), ("tn", ~bad & ~hit))], F.count("*").alias("rows"), F.count(F.when(F.col("outcome") == "dropped", 1)).alias("dropped"))
    return one.select("rows", "dropped", "tp", "fp", "fn", "tn", _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), _ratio(F.col("tp") + F.col("tn"), F.col("rows")).alias("accuracy"))


def detection_by_type(found: DataFrame) -> DataFrame:
    """Rows of each kind of error, those detected, and their share."""
    return found.filter("error_type is not null").groupBy("error_type").agg(F.count("*").alias("actual"), F.count(F.when(F.col("detected"), 1)).alias("found"), F.round(F.avg(F.col("detected").cast("int")), 4).alias("rate"))


def false_positives(found: DataFrame, k: int = 10) -> DataFrame:
    """The most frequent reasons of sound rows that count as detected; 'dropped' where there is none."""
    wrong = found.filter("error_type is null and detected")
    return wrong.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(k)


def by_category(zoned: DataFrame, truth: DataFrame, row_id: str) -> DataFrame:
    """One against the rest for every label: TP, FP, FN, TN, precision, recall, F1. zoned: row_id, error_type."""
    pair = zoned.select(row_id, F.coalesce("error_type", F.lit("none")).alias("said")).join(truth.select(row_id, F.coalesce("error_type", F.lit("none")).alias("is")), row_id)
    counts = pair.groupBy("said", "is").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    rows = counts.select(F.explode(F.array_distinct(F.array("said", "is"))).alias("category"), "said", "is", "n")
    per = rows.groupBy("category").agg(*[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(k) for k, c in (("tp", (F.col("said") == F.col("category")) & (F.col("is") == F.col("category"))), ("fp", (F.col("said") == F.col("category")) & (F.col("is") != F.col("category"))), ("fn", (F.col("said") != F.col("category")) & (F.col("is") == F.col("category"))))])
    return per.crossJoin(F.broadcast(total)).select("category", "tp", "fp", "fn", (F.col("total") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"), _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def diff_runs(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields in which two versions of the same runs differ; null equals null."""
    joined = a.select(key, *[F.col(f).cast("string").alias(f"a_{f}") for f in fields]).join(b.select(key, *[F.col(f).cast("string").alias(f"b_{f}") for f in fields]), key, "full_outer")
    rows = joined.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("was"), F.col(f"b_{f}").alias("is")) for f in fields])).alias("d")).select(key, "d.*")
    return rows.filter(~F.col("was").eqNullSafe(F.col("is")))


def scale(df: DataFrame, times: int, columns: list[str], offset: int) -> DataFrame:
    """df `times` over, keys shifted by offset for each copy."""
    copies = df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return copies.withColumns({c: F.col(c) + F.col("__k") * offset for c in columns}).drop("__k")


def performance(df: DataFrame, group: str, value: str, passing: float, bands: list[tuple[str, float]]) -> DataFrame:
    """Count, mean, extremes, deviation, pass rate and band (by mean, best first) of every group."""
    stats = df.groupBy(group).agg(F.count(value).alias("n"), F.round(F.avg(value), 4).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.stddev_samp(value), 4).alias("sd"), F.round(100 * F.avg((F.col(value) >= passing).cast("int")), 4).alias("pass_pct"))
    band = F.coalesce(*[F.when(F.col("mean") >= low, name) for name, low in bands], F.lit("below"))
    return stats.withColumn("band", band)


def follow_up(df: DataFrame, ids: str, value: str, low: float) -> DataFrame:
    return df.filter(F.col(value) < low).select(ids).distinct()


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy((F.floor(F.col(value) / width) * width).cast("double").alias("low")).agg(F.count("*").alias("n"))
