"""Gold tables over the history of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: what a row held back is taken to cost where the run states no value.
COST_OF_ROW = 11


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.to_date("timestamp"))


def daily_quality(runs: DataFrame) -> DataFrame:
    total, held = F.sum("total_records"), F.sum("quarantined_records")
    return _dated(runs).groupBy("date", "table_name").agg(
        F.round(F.avg("quality_score"), 4).alias("avg_score"), F.min("quality_score").alias("min_score"), F.max("quality_score").alias("max_score"),
        total.alias("total"), held.alias("quarantined"), F.round(F.when(total > 0, 100 * held / F.greatest(total, F.lit(1))).otherwise(0.0), 4).alias("quarantine_pct"),
        F.round(F.avg("freshness_lag_hours"), 4).alias("avg_lag"), F.count("*").alias("n_runs"),
    )


def error_patterns(runs: DataFrame) -> DataFrame:
    """Rows for each date, table and reason, and its per cent of the date; runs that held rows back for no stated reason are 'unclassified'."""
    parts = F.when(F.size("quarantine_breakdown") > 0, F.col("quarantine_breakdown")).otherwise(F.create_map(F.lit("unclassified"), F.col("quarantined_records")))
    counts = _dated(runs).filter("quarantined_records > 0").select("date", "table_name", F.explode(parts).alias("reason", "n")).groupBy("date", "table_name", "reason").agg(F.sum("n").alias("n"))
    day = F.sum("n").over(Window.partitionBy("date"))
    return counts.withColumn("pct_of_day", F.round(100 * F.col("n") / day, 4))


def financial_impact(runs: DataFrame) -> DataFrame:
    """Value held back by day: what runs state, else rows times a fixed cost; where it comes from, the running total, and the table with most rows held back (of equals that of the day's earliest run)."""
    stated = F.coalesce(F.col("quarantined_financial_value") != 0, F.lit(False))
    priced = _dated(runs).select("date", "table_name", "timestamp", F.col("quarantined_records").alias("rows"), F.when(stated, F.col("quarantined_financial_value")).otherwise(0.0).alias("real"), F.when(stated, 0.0).otherwise(F.col("quarantined_records") * float(COST_OF_ROW)).alias("estimated"), stated.cast("int").alias("stated"))
    by_table = priced.groupBy("date", "table_name").agg(F.sum("rows").alias("rows"), F.min("timestamp").alias("first"), F.sum("real").alias("real"), F.sum("estimated").alias("estimated"), F.max("stated").alias("stated"))
    order = F.struct(-F.col("rows"), "first", "table_name")
    by_day = by_table.groupBy("date").agg(F.sum("rows").alias("quarantined"), F.round(F.sum("real") + F.sum("estimated"), 2).alias("impact"), F.max("stated").alias("stated"), F.sum("estimated").alias("estimated"), F.min_by("table_name", order).alias("most_impacted"))
    source = F.when((F.col("stated") == 1) & (F.col("estimated") == 0), "real_financial_value").when(F.col("stated") == 1, "mixed").otherwise("flat_estimate")
    # Days are rounded first, so that the running total does not depend on the order of addition.
    running = F.sum("impact").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return by_day.select("date", "quarantined", "impact", source.alias("source"), F.round(running, 2).alias("cumulative"), "most_impacted")


def schema_drift(drifts: DataFrame) -> DataFrame:
    return _dated(drifts).groupBy("date", "table_name").agg(F.count("*").alias("n_events"), F.array_join(F.sort_array(F.collect_set("column_name")), ",").alias("columns"))


def last_days(gold: DataFrame, days: int, now: str) -> DataFrame:
    return gold.filter(F.col("date") >= F.date_sub(F.lit(now).cast("date"), days))


def top_errors(patterns: DataFrame, k: int = 5) -> DataFrame:
    return patterns.groupBy("reason").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "reason").limit(k)


def totals(runs: DataFrame) -> DataFrame:
    return runs.agg(F.sum("total_records").alias("total"), F.sum("quarantined_records").alias("quarantined"), F.count("*").alias("n_runs"), F.countDistinct("table_name").alias("n_tables"))


def most_impacted(runs: DataFrame) -> DataFrame:
    by_table = runs.groupBy("table_name").agg(F.round(F.sum("quarantined_financial_value"), 2).alias("cost"), F.sum("quarantined_records").alias("quarantined"))
    return by_table.orderBy(F.desc("cost"), "table_name")
