"""Figures of a run, and of a run against those before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of columns that hold money, in the order tried.
MONEY = ["total_sales", "sales", "revenue", "profit", "price", "amount", "total"]


def quality_score(zoned: DataFrame, threshold: float = 80.0) -> DataFrame:
    """total, clean, score (percent clean; 0 for no rows) and whether it passes."""
    one = zoned.agg(F.count("*").alias("total"), F.count(F.when(F.col("zone") == "clean", 1)).alias("clean"))
    score = F.when(F.col("total") > 0, F.round(100 * F.col("clean") / F.greatest("total", F.lit(1)), 4)).otherwise(0.0)
    return one.withColumn("score", score).withColumn("passed", F.col("score") >= threshold)


def _past(n: int = 15):
    return Window.partitionBy("table_name").orderBy("timestamp", "run_id").rowsBetween(-n, -1)


def rate_anomaly(runs: DataFrame) -> DataFrame:
    """z-score, without its sign, of each run's share held back against the 15 runs before (3 at least): falls are anomalies too.

    Population deviation, 0.05 at least; a change under 0.02 counts as none.
    """
    rate = F.when(F.col("total_records") > 0, F.col("quarantined_records") / F.greatest("total_records", F.lit(1))).otherwise(0.0)
    rated = runs.withColumn("rate", rate)
    w = _past()
    stats = rated.select("run_id", "table_name", "timestamp", "rate", F.avg("rate").over(w).alias("mean"), F.greatest(F.stddev_pop("rate").over(w), F.lit(0.05)).alias("sd"), F.count("rate").over(w).alias("n"))
    change = F.col("rate") - F.col("mean")
    z = F.when((F.col("n") < 3) | (F.abs(change) < 0.02), 0.0).otherwise(F.abs(change) / F.col("sd"))
    return stats.select("run_id", "table_name", "timestamp", F.round("rate", 6).alias("rate"), F.round(z, 4).alias("z"), (z > 3).alias("is_anomaly"))


def adaptive_threshold(runs: DataFrame, base: float = 80.0, floor: float = 70.0) -> DataFrame:
    """max(mean - sample deviation of the last 15 scores, floor); base before two runs."""
    w = _past()
    learned = F.greatest(F.avg("quality_score").over(w) - F.stddev_samp("quality_score").over(w), F.lit(floor))
    return runs.select("run_id", "table_name", F.round(F.when(F.count("quality_score").over(w) < 2, base).otherwise(learned), 4).alias("threshold"))


def reasons_of(reason: Column) -> Column:
    """The single reasons of a text that joins them by ; or |, without the values in them; 'unknown' where there is none.

    What stands before a = is the column of an outlier, or of a z-score where
    it ends so; dots become underscores. Reasons are then as many as columns
    and rules make them, whatever the rows hold.
    """
    parts = F.transform(F.split(F.coalesce(reason, F.lit("")), r"[;|]"), lambda x: _stripped(x))
    keys = F.filter(F.transform(F.filter(parts, lambda x: x != ""), _normal), lambda x: x != "")
    return F.when(F.size(keys) > 0, keys).otherwise(F.array(F.lit("unknown")))


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _normal(x: Column) -> Column:
    name = _stripped(F.substring_index(x, "=", 1))
    named = F.when(name.endswith("_zscore"), F.concat(F.lit("zscore_"), F.regexp_replace(name, "_zscore$", ""))).otherwise(F.concat(F.lit("outlier_"), name))
    return F.replace(F.when(x.contains("="), named).otherwise(x), F.lit("."), F.lit("_"))


def reason_breakdown(quarantine: DataFrame, keep: int = 50) -> DataFrame:
    """Rows for each reason; all but the `keep` most frequent are one, other_reasons."""
    counts = quarantine.select(F.explode(reasons_of(F.col("reject_reason"))).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    # The ranking is of distinct reasons, of which rules make a bounded number.
    nth = F.row_number().over(Window.orderBy(F.desc("n"), "reason"))
    named = counts.withColumn("nth", nth).select(F.when(F.col("nth") <= keep, F.col("reason")).otherwise("other_reasons").alias("reason"), "n")
    return named.groupBy("reason").agg(F.sum("n").alias("n"))


def money_column(columns: list[str]) -> str | None:
    """The column whose name, in lower case, is the first of MONEY that there is; of columns with one name the last."""
    by_name = {c.lower(): c for c in columns}
    return next((by_name[m] for m in MONEY if m in by_name), None)


def financial_value(quarantine: DataFrame) -> DataFrame:
    """Sum of the first column named for money; 0 without one."""
    c = money_column(quarantine.columns)
    return quarantine.agg(F.round(F.coalesce(F.sum(F.col(c).try_cast("double")) if c else F.lit(0.0), F.lit(0.0)), 2).alias("financial_value"))


def freshness(df: DataFrame, date: str, now: str) -> DataFrame:
    """Hours from the newest date to now, 0 at least."""
    newest = F.max(date)
    lag = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(newest)) / 3600
    return df.agg(newest.alias("newest"), F.round(F.greatest(lag, F.lit(0.0)), 2).alias("lag_hours"))


def operational_impact(tagged: DataFrame, weights: dict[str, float], pk: list[str] = (), date: str | None = None, floor: float = 0.2) -> DataFrame:
    """For each rejected row the greatest weight of what its reason names (floor at least), summed, per cent of all rows.

    Reasons of keys and duplicates weigh as the first key column (1.0 without a
    weight), those of dates as the date column (0.5); other columns by their
    names. Null and empty reasons weigh nothing.
    """
    r = F.col("reject_reason")
    own = [(r.contains("primary") | r.contains("duplicate"), weights.get(pk[0], 1.0) if pk else 1.0), (r.contains("date"), weights.get(date, 0.5) if date else 0.5)]
    own += [(r.contains(c), w) for c, w in weights.items() if c not in pk and c != date]
    weight = F.greatest(F.lit(floor), F.lit(floor), *[F.when(hit, F.lit(float(w))).otherwise(0.0) for hit, w in own])
    total = F.sum(F.when(r.isNotNull() & (r != ""), weight).otherwise(0.0))
    return tagged.agg(F.round(F.when(F.count("*") > 0, 100 * total / F.greatest(F.count("*"), F.lit(1))).otherwise(0.0), 4).alias("operational_impact"))


def run_row(tagged: DataFrame, table_name: str, run_id: str) -> DataFrame:
    """The run's document: counts, score and a map of reasons."""
    by_reason = tagged.filter("zone <> 'clean'").select(F.explode(reasons_of(F.col("reject_reason"))).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    breakdown = by_reason.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("quarantine_breakdown"))
    return quality_score(tagged).crossJoin(breakdown).select(F.lit(run_id).alias("run_id"), F.lit(table_name).alias("table_name"), F.col("total").alias("total_records"), F.col("clean").alias("clean_records"), (F.col("total") - F.col("clean")).alias("quarantined_records"), F.col("score").alias("quality_score"), "quarantine_breakdown")


def lineage_rows(runs: DataFrame, raw: str, active: str, quarantine: str) -> DataFrame:
    """(run_id, table_name, paths) of every run: where its rows came from and where its clean and rejected ones went, under the three folders."""
    place = lambda folder: F.concat(F.lit(f"{folder}/"), "table_name")
    return runs.select("run_id", "table_name", F.struct(place(raw).alias("source"), place(active).alias("target"), F.concat(place(quarantine), F.lit("/run_id="), "run_id").alias("quarantine")).alias("paths"))


def alerts(runs: DataFrame, drifts: DataFrame) -> DataFrame:
    """Rows for what calls for notice: score under its threshold, unusual share held back, missing column, changed type."""
    low = runs.filter("quality_score < effective_quality_threshold").select("run_id", "table_name", F.lit("low_quality").alias("alert"), F.format_string("%.4f", "quality_score").alias("detail"))
    odd = rate_anomaly(runs).filter("is_anomaly").select("run_id", "table_name", F.lit("rate_anomaly").alias("alert"), F.format_string("%.4f", "z").alias("detail"))
    schema = drifts.filter(F.col("error_type").isin("missing_column", "type_mismatch")).select("run_id", "table_name", F.col("error_type").alias("alert"), F.col("column_name").alias("detail"))
    return low.unionByName(odd).unionByName(schema)


def advisory_triggers(runs: DataFrame, drifts: DataFrame) -> DataFrame:
    """Runs that call for advice, and why: rate anomaly, score 15 under the threshold or more, schema drift."""
    odd = rate_anomaly(runs).select("run_id", "is_anomaly")
    drifted = drifts.groupBy("run_id").agg(F.count("*").alias("n_drifts"))
    joined = runs.select("run_id", "table_name", "quality_score", "effective_quality_threshold").join(odd, "run_id").join(drifted, "run_id", "left")
    why = F.array_compact(F.array(F.when(F.col("is_anomaly"), F.lit("rate_anomaly")), F.when(F.col("quality_score") <= F.col("effective_quality_threshold") - 15, F.lit("low_score")), F.when(F.col("n_drifts") > 0, F.lit("schema_drift"))))
    return joined.withColumn("why", F.array_join(why, ",")).filter("why <> ''").select("run_id", "table_name", "why")
