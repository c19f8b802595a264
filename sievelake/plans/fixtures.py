"""Dirty tables and a run history made from the clean test tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with null keys and prices, prices 50 times too large or negative, copies, two date forms and noisy priorities."""
    base = table(spark, sf_dir, "orders")
    both = base.withColumn("copy", F.explode(F.when(F.col("o_orderkey") % 61 == 4, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    k = F.col("o_orderkey")
    price = F.col("o_totalprice")
    return both.select(
        (k * 2 + F.col("copy")).alias("row_id"),
        F.when(k % 97 != 0, k).alias("order_key"),
        F.col("o_custkey").alias("cust_key"),
        F.col("o_orderstatus").alias("status"),
        F.when(k % 53 == 1, F.lit(None)).when(k % 101 == 2, price * 50).when(k % 89 == 3, -price).otherwise(price).alias("price"),
        F.when(k % 7 == 5, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date_text"),
        F.when(k % 71 != 6, F.expr("o_orderdate + make_dt_interval(copy)")).alias("order_date"),
        F.when(k % 5 == 1, F.upper(F.concat(F.lit(" "), "o_orderpriority"))).when(k % 11 == 3, F.expr("substring(o_orderpriority, 1, length(o_orderpriority) - 1)")).otherwise(F.col("o_orderpriority")).alias("priority"),
    )


DIRTY = """both_ AS (SELECT *, 0 AS copy FROM orders UNION ALL SELECT *, 1 AS copy FROM orders WHERE o_orderkey % 61 = 4),
dirty AS (SELECT o_orderkey * 2 + copy AS row_id, CASE WHEN o_orderkey % 97 <> 0 THEN o_orderkey END AS order_key, o_custkey AS cust_key, o_orderstatus AS status,
  CASE WHEN o_orderkey % 53 = 1 THEN NULL WHEN o_orderkey % 101 = 2 THEN o_totalprice * 50 WHEN o_orderkey % 89 = 3 THEN -o_totalprice ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 7 = 5 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_text,
  CASE WHEN o_orderkey % 71 <> 6 THEN o_orderdate + to_days(copy) END AS order_date,
  CASE WHEN o_orderkey % 5 = 1 THEN upper(' ' || o_orderpriority) WHEN o_orderkey % 11 = 3 THEN substring(o_orderpriority, 1, length(o_orderpriority) - 1) ELSE o_orderpriority END AS priority
  FROM both_)"""

#: Rules of the runs made from the dirty orders.
RANGE = {"price": (0.0, 1_000_000.0)}


def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One quality run for each table and month: counts, score, a map of reasons, value held back, freshness lag, threshold."""
    o = table(spark, sf_dir, "orders")
    l = table(spark, sf_dir, "lineitem")
    e = table(spark, sf_dir, "events")
    parts = [
        o.select(F.lit("orders").alias("table_name"), F.date_trunc("month", "o_orderdate").alias("month"), F.when(F.col("o_orderkey") % 97 == 0, "missing_primary_key").when(F.col("o_orderkey") % 53 == 1, "null_value_in_price").when(F.col("o_orderkey") % 101 == 2, "outlier_price").alias("reason"), F.col("o_totalprice").alias("value")),
        l.select(F.lit("lineitem").alias("table_name"), F.date_trunc("month", "l_shipdate").alias("month"), F.when(F.col("l_orderkey") % 89 == 3, "out_of_range_discount").when(F.col("l_orderkey") % 61 == 4, "duplicate_records").alias("reason"), F.col("l_extendedprice").alias("value")),
        e.select(F.lit("events").alias("table_name"), F.date_trunc("month", "ts").alias("month"), F.when(F.col("event_id") % 41 == 5, "missing_date").when(F.col("event_id") % 67 == 9, "null_value_in_value").alias("reason"), F.col("value")),
    ]
    rows = parts[0].union(parts[1]).union(parts[2])
    by_reason = rows.groupBy("table_name", "month", "reason").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    runs = by_reason.groupBy("table_name", "month").agg(
        F.sum("n").alias("total_records"),
        F.coalesce(F.sum(F.when(F.col("reason").isNotNull(), F.col("n"))), F.lit(0)).alias("quarantined_records"),
        F.round(F.coalesce(F.sum(F.when(F.col("reason").isNotNull(), F.col("v"))), F.lit(0.0)), 2).alias("quarantined_financial_value"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))))).alias("quarantine_breakdown"),
    )
    score = F.round(100 * (F.col("total_records") - F.col("quarantined_records")) / F.col("total_records"), 4)
    return runs.select(
        F.concat_ws("-", "table_name", F.date_format("month", "yyyyMM")).alias("run_id"),
        "table_name",
        F.col("month").alias("timestamp"),
        "total_records",
        (F.col("total_records") - F.col("quarantined_records")).alias("clean_records"),
        "quarantined_records",
        score.alias("quality_score"),
        (F.month("month") * 1.0).alias("freshness_lag_hours"),
        "quarantined_financial_value",
        "quarantine_breakdown",
        F.lit(95.0).alias("effective_quality_threshold"),
    )


RUNS = """run_rows AS (
  SELECT 'orders' AS table_name, date_trunc('month', o_orderdate)::TIMESTAMP AS month, CASE WHEN o_orderkey % 97 = 0 THEN 'missing_primary_key' WHEN o_orderkey % 53 = 1 THEN 'null_value_in_price' WHEN o_orderkey % 101 = 2 THEN 'outlier_price' END AS reason, o_totalprice AS value FROM orders
  UNION ALL SELECT 'lineitem', date_trunc('month', l_shipdate)::TIMESTAMP, CASE WHEN l_orderkey % 89 = 3 THEN 'out_of_range_discount' WHEN l_orderkey % 61 = 4 THEN 'duplicate_records' END, l_extendedprice FROM lineitem
  UNION ALL SELECT 'events', date_trunc('month', ts)::TIMESTAMP, CASE WHEN event_id % 41 = 5 THEN 'missing_date' WHEN event_id % 67 = 9 THEN 'null_value_in_value' END, value FROM events),
run_reasons AS (SELECT table_name, month, reason, count(*)::BIGINT AS n FROM run_rows WHERE reason IS NOT NULL GROUP BY ALL),
runs AS (SELECT table_name || '-' || strftime(month, '%Y%m') AS run_id, table_name, month AS "timestamp", count(*)::BIGINT AS total_records, count(*) FILTER (reason IS NULL)::BIGINT AS clean_records, count(reason)::BIGINT AS quarantined_records,
  round(100.0 * count(*) FILTER (reason IS NULL) / count(*), 4) AS quality_score, month(month) * 1.0::DOUBLE AS freshness_lag_hours,
  round(coalesce(sum(value) FILTER (reason IS NOT NULL), 0.0), 2) AS quarantined_financial_value, 95.0::DOUBLE AS effective_quality_threshold
  FROM run_rows GROUP BY table_name, month)"""


def drift_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema-drift events of the run history: one for each run with over 3 % held back."""
    runs = run_history(spark, sf_dir).filter(100 * F.col("quarantined_records") > 3 * F.col("total_records"))
    month = F.month("timestamp")
    return runs.select(
        "run_id",
        "table_name",
        "timestamp",
        F.concat(F.lit("col_"), (month % 3).cast("string")).alias("column_name"),
        F.when(month % 3 == 0, "new_column").when(month % 3 == 1, "missing_column").otherwise("type_mismatch").alias("error_type"),
        F.when(month % 3 == 0, 1).otherwise(5).alias("severity"),
        F.when(month % 4 == 0, "PENDING").when(month % 4 == 1, "APPROVED").otherwise("REJECTED").alias("status"),
    )


DRIFTS = """drifts AS (SELECT run_id, table_name, "timestamp", 'col_' || (month("timestamp") % 3)::VARCHAR AS column_name,
  CASE month("timestamp") % 3 WHEN 0 THEN 'new_column' WHEN 1 THEN 'missing_column' ELSE 'type_mismatch' END AS error_type,
  CASE month("timestamp") % 3 WHEN 0 THEN 1 ELSE 5 END AS severity,
  CASE month("timestamp") % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'APPROVED' ELSE 'REJECTED' END AS status
  FROM runs WHERE 100 * quarantined_records > 3 * total_records)"""


def pipeline_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline run for each quality run: its state, and seconds where they were kept."""
    t = F.col("total_records")
    state = F.when(t % 7 == 3, "failed").when(F.col("quality_score") >= F.col("effective_quality_threshold"), "success").otherwise("warnings")
    return run_history(spark, sf_dir).select("run_id", "table_name", "timestamp", state.alias("state"), F.when(t % 11 != 4, 30.5 + t % 1000).alias("duration_seconds"))


PIPELINES = """pipes AS (SELECT run_id, table_name, "timestamp", CASE WHEN total_records % 7 = 3 THEN 'failed' WHEN quality_score >= effective_quality_threshold THEN 'success' ELSE 'warnings' END AS state, CASE WHEN total_records % 11 <> 4 THEN 30.5::DOUBLE + total_records % 1000 END AS duration_seconds FROM runs)"""


def run_profiles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Null rates with tolerances of two columns of each run, and its column with a range."""
    r = run_history(spark, sf_dir)
    rate = F.col("quarantined_records") / F.col("total_records")
    rows = F.array(F.struct(F.lit("price").alias("column"), rate.alias("null_rate"), F.lit(0.03).alias("tolerance")), F.struct(F.lit("value").alias("column"), (rate / 2).alias("null_rate"), F.lit(0.02).alias("tolerance")))
    return r.select("run_id", F.inline(rows)), r.select("run_id", F.when(F.col("table_name") == "lineitem", "discount").otherwise("price").alias("column"))


PROFILES = """nulls AS (SELECT run_id, 'price' AS col, quarantined_records / total_records AS null_rate, 0.03::DOUBLE AS tolerance FROM runs UNION ALL SELECT run_id, 'value', quarantined_records / total_records / 2, 0.02 FROM runs),
ranges AS (SELECT run_id, CASE WHEN table_name = 'lineitem' THEN 'discount' ELSE 'price' END AS col FROM runs),
named AS (SELECT run_id, reason FROM runs r JOIN run_reasons q ON q.table_name = r.table_name AND q.month = r."timestamp")"""
