"""Outliers by interquartile fences and by z-score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import two_decimals
from .quantiles import quantiles


def iqr_bounds(df: DataFrame, columns: list[str], k: float = 1.5, exact: bool = True) -> DataFrame:
    """Quartiles and fences of all columns: column, q1, q3, iqr, low, high.

    exact=False takes approx_percentile, one aggregation and no exact ranks.
    """
    if exact:
        rows = quantiles(df, {c: F.col(c) for c in columns}, [0.25, 0.75]).select("column", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    else:
        quartiles = df.agg(*[F.approx_percentile(F.col(c), F.array(F.lit(0.25), F.lit(0.75))).alias(c) for c in columns])
        rows = quartiles.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c)[0].cast("double").alias("q1"), F.col(c)[1].cast("double").alias("q3")) for c in columns])).alias("b")).select("b.*")
    iqr = F.col("q3") - F.col("q1")
    return rows.withColumn("iqr", iqr).withColumn("low", F.col("q1") - k * iqr).withColumn("high", F.col("q3") + k * iqr)


def flag_iqr(df: DataFrame, bounds: DataFrame, columns: list[str]) -> DataFrame:
    """Adds outliers: an array of 'c=value (expected [low, high])'; null is never an outlier. bounds: from iqr_bounds, a row a column."""
    expected = F.concat(F.lit(" (expected ["), two_decimals(F.col("low")), F.lit(", "), two_decimals(F.col("high")), F.lit("])"))
    one = bounds.groupBy().pivot("column", columns).agg(F.first(F.struct("low", "high", expected.alias("expected"))))
    one = one.toDF(*[f"__b_{c}" for c in columns])
    joined = df.crossJoin(F.broadcast(one))  # a single row
    hits = []
    for c in columns:
        low, high = F.col(f"__b_{c}.low"), F.col(f"__b_{c}.high")
        text = F.concat(F.lit(f"{c}="), two_decimals(F.col(c)), F.col(f"__b_{c}.expected"))
        hits.append(F.when((F.col(c) < low) | (F.col(c) > high), text))
    return joined.withColumn("outliers", F.filter(F.array(*hits), lambda x: x.isNotNull())).drop(*one.columns)


def flag_zscore(df: DataFrame, columns: list[str], t: float = 3.0, of: DataFrame | None = None) -> DataFrame:
    """Adds zscore_outliers: 'c_zscore=z (val=c deviates > t\u03c3)' of columns over t sample deviations from the mean; columns without spread are passed over.

    of: the rows that means and deviations come from; df itself by default.
    """
    one = (df if of is None else of).agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"__s_{c}") for c in columns])
    hits = []
    for c in columns:
        z = F.abs(F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")
        hits.append(F.when((F.col(f"__s_{c}") > 0) & (z > t), F.concat(F.lit(f"{c}_zscore="), F.round(z, 2).cast("string"), F.lit(f" (val={c} deviates > {t}\u03c3)"))))
    return df.crossJoin(F.broadcast(one)).withColumn("zscore_outliers", F.array_compact(F.array(*hits))).drop(*one.columns)
