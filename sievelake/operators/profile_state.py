"""Profiles as mergeable states: counts, moments and sketches of a batch, which add up to those of all batches without their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import drift, versions

#: Size of the quantile sketch: ranks are off by 1 % or so; and of the distinct sketch (4,096 registers): counts are off by 2 % or so.
QUANTILES, DISTINCT = 400, 12
SHARES = [0.05, 0.25, 0.5, 0.75, 0.95, *[k / 10 for k in range(11)]]


def state(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column from one pass with partial sums: rows, nulls, n (values), mean, m2 to m4 (sums of powers of deviations), min, max, and sketches of quantiles and of distinct values.

    NaN counts as null. A column without values has a null mean and sketches.
    """
    rows = []
    for c in columns:
        x = F.nullif(F.col(f"`{c}`").cast("double"), F.lit(float("nan")))
        n = F.count(x).cast("double")
        m2 = F.var_pop(x) * n
        rows.append(F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count(F.when(x.isNull(), 1)).alias("nulls"), F.count(x).alias("n"), F.avg(x).alias("mean"), m2.alias("m2"),
            F.when(m2 > 0, F.skewness(x) * F.pow(m2, F.lit(1.5)) / F.sqrt(n)).otherwise(0.0).alias("m3"), F.when(m2 > 0, (F.kurtosis(x) + 3) * m2 * m2 / n).otherwise(0.0).alias("m4"),
            F.min(x).alias("min"), F.max(x).alias("max"), F.kll_sketch_agg_double(x, F.lit(QUANTILES)).alias("quantiles"), F.hll_sketch_agg(F.xxhash64(x), F.lit(DISTINCT)).alias("distinct"),
        ))
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """The states of both sets of rows together; columns that one side lacks are as the other has them."""
    j = a.alias("a").join(b.alias("b"), "column", "full_outer")
    n, m = (F.coalesce(F.col(f"{s}.n"), F.lit(0)).cast("double") for s in "ab")
    total, d = n + m, F.coalesce(F.col("b.mean") - F.col("a.mean"), F.lit(0.0))
    of = lambda s, k: F.coalesce(F.col(f"{s}.{k}"), F.lit(0.0))
    both = (n > 0) & (m > 0)
    m2 = of("a", "m2") + of("b", "m2") + F.when(both, d * d * n * m / total).otherwise(0.0)
    m3 = of("a", "m3") + of("b", "m3") + F.when(both, F.pow(d, F.lit(3.0)) * n * m * (n - m) / (total * total) + 3 * d * (n * of("b", "m2") - m * of("a", "m2")) / total).otherwise(0.0)
    m4 = of("a", "m4") + of("b", "m4") + F.when(both, F.pow(d, F.lit(4.0)) * n * m * (n * n - n * m + m * m) / F.pow(total, F.lit(3.0)) + 6 * d * d * (n * n * of("b", "m2") + m * m * of("a", "m2")) / (total * total) + 4 * d * (n * of("b", "m3") - m * of("a", "m3")) / total).otherwise(0.0)
    plus = lambda k: F.coalesce(F.col(f"a.{k}"), F.lit(0)) + F.coalesce(F.col(f"b.{k}"), F.lit(0))

    def sketch(k: str, union) -> Column:
        x, y = F.col(f"a.{k}"), F.col(f"b.{k}")
        return F.when(x.isNotNull() & y.isNotNull(), union(x, y)).otherwise(F.coalesce(x, y)).alias(k)

    return j.select(
        "column", plus("rows").alias("rows"), plus("nulls").alias("nulls"), plus("n").alias("n"), F.when(both, (n * F.col("a.mean") + m * F.col("b.mean")) / total).otherwise(F.coalesce("a.mean", "b.mean")).alias("mean"),
        m2.alias("m2"), m3.alias("m3"), m4.alias("m4"), F.least("a.min", "b.min").alias("min"), F.greatest("a.max", "b.max").alias("max"), sketch("quantiles", F.kll_sketch_merge_double), sketch("distinct", F.hll_union),
    )


def described(states: DataFrame) -> DataFrame:
    """What profile.distribution tells, from states: quantiles and distinct counts are those of the sketches."""
    n, m2 = F.col("n").cast("double"), F.col("m2")
    q = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("quantiles", F.array(*map(F.lit, SHARES))))
    d = F.hll_sketch_estimate("distinct") + F.when(F.col("nulls") > 0, 1).otherwise(0)
    rows = F.greatest("rows", F.lit(1))
    return states.withColumn("q", q).select(
        "column", "mean", F.when(n > 1, F.sqrt(m2 / (n - 1))).alias("sd"), "min", "max", *[F.col("q")[k].alias(c) for k, c in enumerate(("p5", "p25", "p50", "p75", "p95"))],
        F.when(m2 > 0, F.sqrt(n) * F.col("m3") / F.pow(m2, F.lit(1.5))).alias("skewness"), F.when(m2 > 0, n * F.col("m4") / (m2 * m2) - 3).alias("kurtosis"),
        d.cast("long").alias("n_distinct"), (d / rows).alias("distinct_ratio"), F.slice("q", 6, 11).alias("boundaries"), (F.col("nulls") / rows).alias("null_rate"),
    )


def cycle(batch: DataFrame, path: str, columns: list[str], tries: int = 10) -> DataFrame:
    """One round of profiling that reads the new batch alone: drift against the stored state, which then takes the batch in.

    Returns column, psi, status, null_rate, null_status (NEW in a first round).
    Of rounds that meet, the later one merges with what the other has published.
    """
    spark = batch.sparkSession
    now = spark.createDataFrame(state(batch, columns).collect(), "column string, rows long, nulls long, n long, mean double, m2 double, m3 double, m4 double, min double, max double, quantiles binary, distinct binary")  # a row a column
    shown = described(now)
    for _ in range(tries):
        base = versions.latest(spark, path)
        if base is None:
            out, report = now, shown.select("column", F.lit(0.0).alias("psi"), F.lit("NEW").alias("status"), "null_rate", F.lit("NEW").alias("null_status"))
        else:
            stored = versions.read(spark, path, number=base.number)
            was = described(stored)
            moved = drift.distribution(batch, was.select("column", "boundaries").filter("boundaries is not null"), columns)
            nulls = drift.null_rate(shown, was.select("column", F.col("null_rate").alias("ema_null_rate")))
            out, report = merged(stored, now), moved.join(nulls.select("column", "null_rate", F.col("status").alias("null_status")), "column")
        try:
            versions.replace(out.coalesce(1), path, base)
            return report
        except versions.Conflict:
            continue
    raise versions.Conflict(f"{tries} rounds met other writers of {path}")
