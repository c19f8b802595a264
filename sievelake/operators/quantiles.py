"""Exact quantiles and distinct counts of many columns without a task that sees all values of one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import drop_tables, table_mark, written


def value_counts(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(column, value, n): how often each value of the columns occurs; nulls are left out. Partial sums come before the shuffle."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("column"), c.alias("value")) for k, c in columns.items()])).alias("s")).select("s.*")
    return stacked.filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_distinct), null not counted, of all columns in one pass: values are dealt out by their hash."""
    each = value_counts(df, {c: F.col(f"`{c}`").cast("string") for c in columns}).groupBy("column").agg(F.count("*").alias("n_distinct"))
    listed = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return listed.join(each, "column", "left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)).cast("long"))


def quantiles(df: DataFrame, columns: dict[str, Column], shares: list[float]) -> DataFrame:
    """(column, n_distinct, q): exact quantiles at the shares, linear between values, as an array of doubles.

    Different values with their counts are dealt out by range and written; the
    rank of a value is the count of the ranges before its own (a row a range)
    and of the values before it in its range. NaN counts as the largest value;
    a column without values has no distinct ones, and null quantiles.
    """
    mark = table_mark()
    counts = value_counts(df, {k: c.cast("double") for k, c in columns.items()})
    dealt = written(counts.repartitionByRange("column", "value").withColumn("part", F.spark_partition_id()), "value-counts")
    across = Window.partitionBy("column")
    ranges = dealt.groupBy("column", "part").agg(F.sum("n").alias("held"), F.count("*").alias("different"))
    ranges = ranges.withColumn("ahead", F.coalesce(F.sum("held").over(across.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranges = ranges.select("column", "part", "ahead", F.sum("held").over(across).alias("total"), F.sum("different").over(across).alias("n_distinct"))
    inside = Window.partitionBy("column", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.join(ranges, ["column", "part"]).withColumn("rank", F.col("ahead") + F.coalesce(F.sum("n").over(inside), F.lit(0)))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("rank") <= place) & (place < F.col("rank") + F.col("n")), F.col("value")))

    places = [share * (F.col("total") - 1) for share in shares]
    found = ranked.groupBy("column").agg(F.max("n_distinct").alias("n_distinct"), F.max("total").alias("total"), *[at(g(p)).alias(f"{k}{i}") for i, p in enumerate(places) for k, g in (("a", F.floor), ("b", F.ceil))])
    q = []
    for i, p in enumerate(places):
        low = F.floor(p)
        q.append(F.when(p == low, F.col(f"a{i}")).otherwise((low + 1 - p) * F.col(f"a{i}") + (p - low) * F.col(f"b{i}")))
    found = found.select("column", "n_distinct", F.array(*q).alias("q"))
    listed = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    out = listed.join(found, "column", "left").select("column", F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_distinct"), F.coalesce("q", F.array(*[F.lit(None).cast("double") for _ in shares])).alias("q"))
    out = written(out, "quantiles", files=1)  # a row a column
    drop_tables(df.sparkSession, mark, (out,))
    return out


def wide(found: DataFrame, columns: list[str], value: Column, prefix: str) -> DataFrame:
    """One row with a column prefix + c of `value` for each c, from rows by `column`."""
    one = found.groupBy().pivot("column", columns).agg(F.first(value))
    return one.toDF(*[f"{prefix}{c}" for c in columns])
