"""Drift of schema, distribution and null rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.align import ENGINE_TYPES, engine_type

DRIFT = "column string, error string, expected string, actual string, action string"


def apply_schema_drift(df: DataFrame, spec: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """df with every registered column (missing ones null, ones of another type as text), and the drift: a row for each difference."""
    rows, have = [], {f.name: engine_type(f.dataType) for f in df.schema.fields}
    for c, kind in spec.items():
        if c not in have:
            rows.append((c, "missing_column", kind, None, "filled_with_null"))
            df = df.withColumn(c, F.lit(None).cast(ENGINE_TYPES[kind]))
        elif have[c] != kind:
            rows.append((c, "type_mismatch", kind, have[c], "cast_to_string"))
            df = df.withColumn(c, F.col(c).cast("string"))
    rows += [(c, "new_column", None, have[c], "recorded") for c in have if c not in spec]
    return df, df.sparkSession.createDataFrame(rows, DRIFT)


def evaluate_proposal(drift: DataFrame, n_columns: int = 0, allow_new: bool = True, max_columns: int = 50, require_approval: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Severity (new 1, missing 5, changed type 5), status and reason of the proposal that a drift makes (or each of `by`).

    New columns alone are approved where no approval is asked for, and refused
    where none are allowed; tables of over max_columns (n_columns are there
    now) are refused; all else waits. Without a drift status is null.
    """
    severity = F.sum(F.when(F.col("error") == "new_column", 1).otherwise(5))
    added = F.count(F.when(F.col("error") == "new_column", 1))
    safe, wide = F.count("*") == added, F.lit(n_columns > max_columns)
    status = F.when(F.count("*") == 0, None).when(safe & F.lit(allow_new and not require_approval) & ~wide, "APPROVED").when((safe & F.lit(not allow_new)) | wide, "REJECTED").otherwise("PENDING")
    reason = F.when(status == "APPROVED", None).when(safe & F.lit(not allow_new), "new columns are not allowed").when(wide, f"{n_columns} columns are over the limit of {max_columns}").when(~safe, "missing columns or changed types").when(status.isNotNull(), "waits for approval")
    return drift.groupBy(*by).agg(F.coalesce(severity, F.lit(0)).cast("long").alias("severity"), added.alias("n_new"), status.alias("status"), reason.alias("reason"))


def group_proposals(proposals: DataFrame) -> DataFrame:
    """Proposals that repeat the same change of a table: how often, when first and last, and which runs."""
    grouped = proposals.groupBy("table_name", F.concat_ws(":", "error_type", "column_name").alias("signature"))
    return grouped.agg(F.count("*").alias("occurrences"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.array_join(F.sort_array(F.collect_list("run_id")), ",").alias("run_ids"))


def _bucket(value: Column, bounds: Column) -> Column:
    """0 for values up to the second boundary, up to n - 2 for those over the last but one."""
    return F.size(F.filter(F.slice(bounds, 2, F.size(bounds) - 2), lambda b: value > b))


def psi(df: DataFrame, boundaries: DataFrame, columns: list[str], least: float = 1e-6) -> DataFrame:
    """Population stability index of columns against stored boundaries (column, boundaries): |sum of (a - e) ln(a / e)|, e being equal shares.

    One aggregation over the data; buckets without rows count with share `least`.
    """
    values = df.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("column", "value")).filter("value is not null")
    joined = values.join(F.broadcast(boundaries.select("column", "boundaries")), "column")  # a row for each column
    counts = joined.groupBy("column", _bucket(F.col("value"), F.col("boundaries")).alias("bucket")).agg(F.count("*").alias("n"))
    buckets = boundaries.select("column", F.explode(F.sequence(F.lit(0), F.size("boundaries") - 2)).alias("bucket"), (1 / (F.size("boundaries") - 1)).alias("e"))
    total = counts.groupBy("column").agg(F.sum("n").alias("total"))
    shares = buckets.join(counts, ["column", "bucket"], "left").join(total, "column").withColumn("a", F.greatest(F.coalesce("n", F.lit(0)) / F.col("total"), F.lit(least)))
    return shares.groupBy("column").agg(F.round(F.abs(F.sum((F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e")))), 6).alias("psi"))


def distribution(df: DataFrame, boundaries: DataFrame, columns: list[str]) -> DataFrame:
    status = F.when(F.col("psi") > 0.25, "CRITICAL").when(F.col("psi") > 0.1, "MODERATE").otherwise("STABLE")
    return psi(df, boundaries, columns).withColumn("status", status)


def null_rate(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Null rates (column, null_rate) against stored ones (column, ema_null_rate)."""
    now, was = F.col("null_rate"), F.col("ema_null_rate")
    status = F.when((was == 0) & (now > 0.05), "NEW_NULLS").when((now > 3 * was) & (now > 0.05), "CRITICAL").when((now > 2 * was) & (now > 0.03), "MODERATE").otherwise("STABLE")
    return current.select("column", "null_rate").join(stored.select("column", "ema_null_rate"), "column").withColumn("status", status)
