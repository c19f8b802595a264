"""The stored profile of a table: computed, compared, merged and published as the next version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written
from . import drift, profile, versions


def current_profile(df: DataFrame, table_name: str, columns: list[str]) -> DataFrame:
    p = profile.distribution(df, columns)
    return p.select(F.lit(table_name).alias("table_name"), "column", "mean", "sd", "min", "max", "null_rate", F.array("null_rate").alias("null_history"), F.lit(1).alias("version"), "boundaries")


def cycle(df: DataFrame, path: str, table_name: str, columns: list[str], tries: int = 10) -> DataFrame:
    """One round of profiling: reads the stored profile, computes the present one, reports drift against the stored, writes the merged one.

    Returns column, psi, status, null_rate, null_status; a first round has nothing to compare with and says NEW.
    Where another round has published in the meantime, drift and merge are made anew against its profile.
    """
    spark = df.sparkSession
    now = written(current_profile(df, table_name, columns), "profile", files=1)  # a row a column
    for _ in range(tries):
        base = versions.latest(spark, path)
        if base is None:
            merged, report = now, now.select("column", F.lit(0.0).alias("psi"), F.lit("NEW").alias("status"), "null_rate", F.lit("NEW").alias("null_status"))
        else:
            stored = versions.read(spark, path, number=base.number)
            moved = drift.distribution(df, stored.select("column", "boundaries"), columns)
            nulls = drift.null_rate(now.select("column", "null_rate"), stored.select("column", F.col("null_rate").alias("ema_null_rate")))
            report = moved.join(nulls.select("column", "null_rate", F.col("status").alias("null_status")), "column")
            merged = profile.merge_ema(stored.drop("boundaries"), now.drop("boundaries")).join(now.select("table_name", "column", "boundaries"), ["table_name", "column"])
        try:
            versions.replace(merged.coalesce(1), path, base)
            return report
        except versions.Conflict:
            continue
    raise versions.Conflict(f"{tries} rounds met other writers of {path}")
