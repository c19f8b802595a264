"""Profiles of columns, each from one aggregation over the data where semantics allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tables import written
from .quantiles import distinct_counts, quantiles, value_counts, wide

ALPHA = 0.3


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _null(df: DataFrame, c: str) -> Column:
    floating = isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))
    return F.col(c).isNull() | F.isnan(c) if floating else F.col(c).isNull()


def _stacked(df: DataFrame, rows: list[Column]) -> DataFrame:
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def null_profile(df: DataFrame, pk: list[str], tolerance: float = 0.05) -> DataFrame:
    """Null (and NaN) rate of every column, its tolerance, and whether it is required (a key)."""
    total = F.greatest(F.count(F.lit(1)), F.lit(1))
    rows = [F.struct(F.lit(c).alias("column"), F.round(F.count(F.when(_null(df, c), 1)) / total, 6).alias("null_rate"), F.lit(0.0 if c in pk else tolerance).alias("tolerance"), F.lit(c in pk).alias("required")) for c in df.columns]
    return _stacked(df, rows)


def adaptive_nulls(df: DataFrame, history: DataFrame) -> DataFrame:
    """Null rates smoothed with history (column, ema_null_rate): tolerance 1.5 times the smoothed rate within 0.01 and 0.5; required under 2 %."""
    now = null_profile(df, []).select("column", "null_rate")
    ema = F.when(F.col("ema_null_rate").isNull(), F.col("null_rate")).otherwise(ALPHA * F.col("null_rate") + (1 - ALPHA) * F.col("ema_null_rate"))
    joined = now.join(history.select("column", "ema_null_rate"), "column", "left").withColumn("ema", F.round(ema, 6))
    return joined.select("column", "null_rate", "ema", F.round(F.least(F.greatest(1.5 * F.col("ema"), F.lit(0.01)), F.lit(0.5)), 6).alias("tolerance"), (F.col("ema") < 0.02).alias("required"))


def distribution(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """Mean, deviation, extremes, percentiles, skewness, kurtosis, distinct count (null counts as a value) and decile boundaries of columns."""
    shares = [0.05, 0.25, 0.5, 0.75, 0.95, *[k / 10 for k in range(11)]]
    rows, total = [], F.greatest(F.count(F.lit(1)), F.lit(1))
    for c in columns:
        x = F.col(c).cast("double")
        rough = [] if exact else [F.approx_count_distinct(x).alias("n_values"), F.approx_percentile(x, F.array(*map(F.lit, shares))).alias("q")]
        rows.append(F.struct(
            F.lit(c).alias("column"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"),
            F.max(x.isNull().cast("int")).alias("has_null"), total.alias("rows"), (F.count(F.when(x.isNull(), 1)) / total).alias("null_rate"), *rough,
        ))
    moments = _stacked(df, rows)
    both = moments.join(quantiles(df, {c: F.col(c) for c in columns}, shares).withColumnRenamed("n_distinct", "n_values"), "column") if exact else moments
    d = F.col("n_values") + F.coalesce("has_null", F.lit(0))
    return both.select(
        "column", "mean", "sd", "min", "max", *[F.col("q")[k].alias(n) for k, n in enumerate(("p5", "p25", "p50", "p75", "p95"))], "skewness", "kurtosis",
        d.cast("long").alias("n_distinct"), (d / F.col("rows")).alias("distinct_ratio"), F.slice("q", 6, 11).alias("boundaries"), "null_rate",
    )


def merge_ema(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored profiles (table_name, column, mean, sd, min, max, null_rate, null_history, version) brought on by current ones: smoothed, extremes kept, last ten null rates."""
    s, c = stored.alias("s"), current.alias("c")
    joined = s.join(c, ["table_name", "column"], "full_outer")

    def smooth(n: str) -> Column:
        return F.coalesce(ALPHA * F.col(f"c.{n}") + (1 - ALPHA) * F.col(f"s.{n}"), F.col(f"c.{n}"), F.col(f"s.{n}"))

    history = F.concat(F.coalesce("s.null_history", F.array().cast("array<double>")), F.array_compact(F.array("c.null_rate")))
    return joined.select(
        "table_name", "column", *[F.round(smooth(n), 6).alias(n) for n in ("mean", "sd", "null_rate")], F.least("s.min", "c.min").alias("min"), F.greatest("s.max", "c.max").alias("max"),
        F.slice(history, F.greatest(F.size(history) - 9, F.lit(1)), 10).alias("null_history"), (F.coalesce("s.version", F.lit(0)) + F.col("c.mean").isNotNull().cast("int")).alias("version"),
    )


#: Parts of a column's name that make it a date.
DATED = ["date", "time", "timestamp", "_at", "dob"]


def _declared(f: T.StructField) -> str:
    """What type and name say of a column: Boolean, Identifier, Integer, Float, Date, else String, which its values tell more of."""
    name = f.name.lower()
    if isinstance(f.dataType, T.BooleanType):
        return "Boolean"
    if name.endswith("_id") or name == "id":
        return "Identifier"
    if isinstance(f.dataType, T.NumericType):
        return "Integer" if isinstance(f.dataType, T.IntegralType) else "Float"
    return "Date" if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) or any(k in name for k in DATED) else "String"


def columns(df: DataFrame, samples: int = 5) -> DataFrame:
    """Kind, nulls, distinct values and share of every column, its smallest values as samples, and quartiles and Tukey outliers of numbers.

    Text with 85 different values in 100 (of five rows or more) is an
    Identifier, else with up to 25 different ones Categorical, else String.
    """
    numbers = numeric_columns(df)
    spark = df.sparkSession
    wide_df = df
    if numbers:
        found = quantiles(df, {c: F.col(c) for c in numbers}, [0.25, 0.75])
        wide_df = df.crossJoin(F.broadcast(wide(found, numbers, F.col("q"), "__q_")))
    rows, total = [], F.count(F.lit(1))
    for f in df.schema.fields:
        c, number = F.col(f.name), f.name in numbers
        if number:
            low, high = (F.col(f"__q_{f.name}")[a] + s * 1.5 * (F.col(f"__q_{f.name}")[1] - F.col(f"__q_{f.name}")[0]) for a, s in ((0, -1), (1, 1)))
            outliers = F.count(F.when((c < low) | (c > high), 1))
        else:
            outliers = F.lit(None).cast("long")
        q1, q3 = (F.first(F.col(f"__q_{f.name}")[k]) if number else F.lit(None).cast("double") for k in (0, 1))
        rows.append(F.struct(F.lit(f.name).alias("column"), total.alias("rows"), F.count(F.when(c.isNull(), 1)).alias("nulls"), F.round(q1, 4).alias("q1"), F.round(q3, 4).alias("q3"), outliers.alias("outliers")))
    stats = _stacked(wide_df, rows)
    types = [(f.name, _declared(f)) for f in df.schema.fields]
    counts = value_counts(df, {c: F.col(f"`{c}`").cast("string") for c in df.columns})
    # The smallest few of each part, then of all: no task holds a column's values.
    nth = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    few = counts.withColumn("nth", nth).filter(F.col("nth") <= samples).groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("samples"))
    joined = stats.join(F.broadcast(spark.createDataFrame(types, "column string, type string")), "column").join(distinct_counts(df, df.columns), "column").join(few, "column", "left")
    unique = F.when(F.col("rows") > 0, F.round(100 * F.col("n_distinct") / F.col("rows"), 2)).otherwise(0.0)
    text = F.when((unique >= 85) & (F.col("rows") >= 5), "Identifier").when((F.col("n_distinct") <= 25) & (F.col("rows") > 0), "Categorical").otherwise("String")
    return joined.select("column", F.when(F.col("type") == "String", text).otherwise(F.col("type")).alias("kind"), "nulls", "n_distinct", unique.alias("unique_pct"), "q1", "q3", "outliers", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def top_categories(df: DataFrame, names: list[str], k: int = 10) -> DataFrame:
    """The k most frequent values of each column."""
    values = df.select(F.explode(F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("string"))])).alias("column", "value")).filter("value is not null")
    counts = values.groupBy("column", "value").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("nth", nth).filter(F.col("nth") <= k)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that repeat a whole row, and values that repeat in each column of keys (null is a value). One pass over stacked keys, with partial sums."""
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    values = {"<row>": whole, **{k: F.coalesce(F.concat(F.lit("v"), F.col(f"`{k}`").cast("string")), F.lit("n")) for k in keys}}
    counts = value_counts(df, values).groupBy("column").agg(F.sum(F.col("n") - 1).alias("duplicates"))
    listed = df.sparkSession.createDataFrame([(k,) for k in values], "key string")
    return listed.join(counts, F.col("key") == F.col("column"), "left").select("key", F.coalesce("duplicates", F.lit(0)).cast("long").alias("duplicates"))


#: Parts of names whose values are held against a range.
RANGE_MONEY = ["price", "salary", "income", "stock", "cost", "revenue", "amount"]
RANGE_AGE = ["age"]
RANGE_PERCENT = ["humidity", "percentage", "rate"]


def range_anomalies(df: DataFrame) -> DataFrame:
    """Columns whose values do not suit their names, by parts of these: money under 0, else ages over 120, else percentages outside 0 to 100."""
    rows = [F.struct(F.lit(c).alias("column"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")) for c in numeric_columns(df)]
    named = lambda words: F.lower("column").rlike("|".join(words))
    issue = (
        F.when(named(RANGE_MONEY) & (F.col("min") < 0), "negative_money")
        .when(named(RANGE_AGE) & (F.col("max") > 120), "impossible_age")
        .when(named(RANGE_PERCENT) & ((F.col("min") < 0) | (F.col("max") > 100)), "percentage_outside")
    )
    return _stacked(df, rows).withColumn("issue", issue).filter("issue is not null")


def before(df: DataFrame, key: list[str], score: str, low: float, high: float, hours: str, k: float = 3.0) -> DataFrame:
    """A raw table before any repair: rows, nulls of the score (blank is null), scores out of bounds, repeated keys, Tukey outliers of hours."""
    s, h = F.col(score).try_cast("double"), F.col(hours).try_cast("double")
    q = quantiles(df, {"hours": h}, [0.25, 0.75]).select(F.col("q").alias("__q"))
    wide = df.crossJoin(F.broadcast(q))
    iqr = F.col("__q")[1] - F.col("__q")[0]
    outside = (h < F.col("__q")[0] - k * iqr) | (h > F.col("__q")[1] + k * iqr)
    values = wide.agg(F.count("*").alias("rows"), F.count(F.when(F.trim(F.coalesce(F.col(score).cast("string"), F.lit(""))) == "", 1)).alias("missing"), F.count(F.when((s < low) | (s > high), 1)).alias("invalid"), F.count(F.when(outside, 1)).alias("outliers"))
    repeated = df.groupBy(*key).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicates"))
    return values.crossJoin(repeated)


def kinds(df: DataFrame) -> DataFrame:
    """Kind of every column for dashboards (numeric, date, categorical, text), missing and distinct values, extremes and mean."""
    rows, total = [], F.greatest(F.count(F.lit(1)), F.lit(1))
    for f in df.schema.fields:
        c, text = F.col(f.name), F.col(f.name).cast("string")
        filled = F.greatest(F.count(c), F.lit(1))
        number = F.count(F.when(text.try_cast("double").isNotNull() & ~text.rlike("^0[0-9]"), 1)) / filled
        dated = F.count(F.when(F.try_to_timestamp(text).isNotNull() & text.rlike("^[0-9]{4}-"), 1)) / filled
        declared = "numeric" if isinstance(f.dataType, T.NumericType) else "date" if isinstance(f.dataType, (T.DateType, T.TimestampType)) else None
        value = text.try_cast("double")
        rows.append(F.struct(F.lit(f.name).alias("column"), F.lit(declared).cast("string").alias("declared"), total.alias("rows"), number.alias("number"), dated.alias("dated"), F.count(F.when(c.isNull(), 1)).alias("missing"), F.round(F.min(value), 4).alias("min"), F.round(F.max(value), 4).alias("max"), F.round(F.avg(value), 4).alias("mean")))
    joined = _stacked(df, rows).join(distinct_counts(df, df.columns), "column")
    few = (F.col("n_distinct") <= 50) | (F.col("n_distinct") / F.col("rows") <= 0.5)
    kind = F.when(F.col("declared").isNotNull(), F.col("declared")).when(F.col("number") >= 0.9, "numeric").when(F.col("dated") >= 0.9, "date").when(few, "categorical").otherwise("text")
    return joined.select("column", kind.alias("kind"), "missing", "n_distinct", "min", "max", "mean")


def prepare(df: DataFrame, kind: dict[str, str], technical: tuple[str, ...] = ("run_id", "ingest_id", "_meta", "reject_reason")) -> DataFrame:
    """Columns in the type of their kind (bad cells null), without technical ones."""
    casts = {"numeric": lambda c: c.try_cast("double"), "date": lambda c: F.try_to_timestamp(c.cast("string"))}
    return df.select(*[casts.get(kind.get(c, ""), lambda x: x)(F.col(c)).alias(c) for c in df.columns if c not in technical])


#: Columns whose classes are counted, in the order tried.
KNOWN_CLASSES = ["label", "role", "category", "type", "status", "class", "gender", "country", "state", "sector", "transaction_type"]


def class_column(df: DataFrame) -> str | None:
    """The column whose classes are counted: the first name of KNOWN_CLASSES that there is, in lower case, else the first text column with 2 to 25 different values."""
    by_name = {c.lower(): c for c in df.columns}
    known = next((by_name[k] for k in KNOWN_CLASSES if k in by_name), None)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if known or not texts:
        return known
    counts = {r["column"]: r["n_distinct"] for r in distinct_counts(df, texts).collect()}  # a row a column
    return next((c for c in texts if 2 <= counts[c] <= 25), None)


def class_balance(df: DataFrame, column: str | None = None, k: int = 25) -> DataFrame:
    """The k most frequent classes of a column (by default class_column's), dots as underscores; null is NULL, blank is SPACES. Without such a column no rows."""
    column = column or class_column(df)
    c = F.lit(None).cast("string") if column is None else F.col(f"`{column}`").cast("string")
    label = F.when(c.isNull(), "NULL").when(F.trim(c) == "", "SPACES").otherwise(F.replace(c, F.lit("."), F.lit("_")))
    counts = (df.limit(0) if column is None else df).groupBy(label.alias("class")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "class").limit(k)
