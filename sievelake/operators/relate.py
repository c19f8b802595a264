"""How two tables join: candidate keys, roles, date forms, the join itself."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def key_text(c: Column) -> Column:
    """A key as text, whole numbers without a fraction: 65001.0 is 65001."""
    return F.regexp_replace(F.trim(c.cast("string")), r"^(-?[0-9]+)\.0+$", "$1")


def _kind(t: T.DataType) -> str:
    return "number" if isinstance(t, T.NumericType) else "text"


def _values(df: DataFrame) -> DataFrame:
    """Distinct (column, kind, value) of a table, and whether the column is unique: one pass and one shuffle."""
    pairs = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(_kind(f.dataType)).alias("kind"), key_text(F.col(f.name)).alias("value")) for f in df.schema.fields])
    return df.select(F.inline(pairs)).filter("value is not null and value <> ''").groupBy("column", "kind", "value").agg(F.count("*").alias("n"))


def candidate_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of columns of one kind that may join: at least two shared values and half of the smaller side's, of one name (but for case and signs) or unique on a side.

    Score: share of the smaller side + 0.5 for one name + 0.25 for a unique side. All pairs come from one join on values.
    """
    x, y = _values(a), _values(b)
    side = lambda v, p: v.groupBy("column").agg(F.count("*").alias(f"{p}_distinct"), (F.max("n") == 1).alias(f"{p}_unique")).withColumnRenamed("column", f"{p}_column")
    shared = x.select(F.col("column").alias("a_column"), "kind", "value").join(y.select(F.col("column").alias("b_column"), "kind", "value"), ["kind", "value"]).groupBy("a_column", "b_column").agg(F.count("*").alias("shared"))
    p = shared.join(side(x, "a"), "a_column").join(side(y, "b"), "b_column")
    rate = F.col("shared") / F.least("a_distinct", "b_distinct")
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    named = bare("a_column") == bare("b_column")
    unique = F.col("a_unique") | F.col("b_unique")
    score = rate + F.when(named, 0.5).otherwise(0.0) + F.when(unique, 0.25).otherwise(0.0)
    fitting = p.filter((F.col("shared") >= 2) & (rate >= 0.5) & (named | unique))
    return fitting.select("a_column", "b_column", "shared", F.round(rate, 6).alias("rate"), F.round(score, 6).alias("score"), "a_unique", "b_unique", "a_distinct", "b_distinct")


def roles(a: DataFrame, ka: str, b: DataFrame, kb: str) -> DataFrame:
    """Cardinality of a join and which side is the lookup: the unique one, b if both are."""
    u = lambda df, c, n: df.agg((F.count_distinct(c) == F.count(c)).alias(n))
    one = u(a, ka, "a_unique").crossJoin(u(b, kb, "b_unique"))
    kind = F.when(F.col("a_unique") & F.col("b_unique"), "1:1").when(F.col("b_unique"), "N:1").when(F.col("a_unique"), "1:N").otherwise("N:M")
    return one.select("a_unique", "b_unique", kind.alias("cardinality"), F.when(F.col("b_unique"), "b").when(F.col("a_unique"), "a").alias("lookup"))


def match_rate(a: DataFrame, ka: str, b: DataFrame, kb: str) -> DataFrame:
    """Rows of a, those whose key b has, and their share."""
    keys = b.select(key_text(F.col(kb)).alias("__k")).filter("__k is not null").distinct().withColumn("__hit", F.lit(1))
    joined = a.select(key_text(F.col(ka)).alias("__k")).join(keys, "__k", "left")
    return joined.agg(F.count("*").alias("rows"), F.count("__hit").alias("matched"), F.round(F.count("__hit") / F.greatest(F.count("*"), F.lit(1)), 6).alias("match_rate"))


def analyze(a: DataFrame, b: DataFrame, alternatives: int = 3) -> DataFrame:
    """The best pair of keys (place 1) and its alternatives: roles, match rate of the base's keys, verdict.

    The base keeps its rows and the lookup adds columns: of two sides the one
    whose key is not unique, of two unique ones the larger table, else b. A
    pair is STRONG if 90 % of the base's different keys are found and a side is
    unique, else POSSIBLE. No candidate, no rows.
    """
    rows = a.agg(F.count("*").alias("a_rows")).crossJoin(b.agg(F.count("*").alias("b_rows")))
    pairs = candidate_keys(a, b).orderBy(F.desc("score"), "a_column", "b_column").limit(1 + alternatives)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "a_column", "b_column"))  # of a few pairs
    p = pairs.withColumn("place", place).crossJoin(F.broadcast(rows))
    base_a = F.when(F.col("a_unique") & F.col("b_unique"), F.col("a_rows") >= F.col("b_rows")).otherwise(~F.col("a_unique") & F.col("b_unique"))
    cardinality = F.when(F.col("a_unique") & F.col("b_unique"), "1:1").when(F.col("a_unique") | F.col("b_unique"), "1:N").otherwise("N:M")
    p = p.withColumn("base", F.when(base_a, "a").otherwise("b"))
    match = F.round(100 * F.col("shared") / F.greatest(F.when(F.col("base") == "a", F.col("a_distinct")).otherwise(F.col("b_distinct")), F.lit(1)), 2)
    verdict = F.when((match >= 90) & (F.col("a_unique") | F.col("b_unique")), "STRONG").otherwise("POSSIBLE")
    return p.select("place", "a_column", "b_column", "shared", "rate", "score", cardinality.alias("cardinality"), "base", match.alias("match_pct"), verdict.alias("verdict"))


def name_mappings(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_column, b_column) of columns whose names differ only in case, blanks, hyphens and underscores."""
    bare = lambda c: re.sub(r"[\s_-]+", "", c.lower())
    found = [(x, y) for x in a.columns for y in b.columns if x != y and bare(x) == bare(y)]
    return a.sparkSession.createDataFrame(found, "a_column string, b_column string")


#: Forms of dates and what they are called, in the order tried.
DATE_FORMS = [(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}", "YYYY-MM-DD"), (r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$", "DD/MM/YYYY")]


def date_formats(df: DataFrame, sample: int = 200) -> DataFrame:
    """Text columns of whose first values (nulls apart) 90 % and more are dates, and in which form (the sample is the feature)."""
    parts = [df.select(F.lit(f.name).alias("column"), F.col(f"`{f.name}`").alias("value")).filter("value is not null").limit(sample) for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, form string")
    form = F.coalesce(*[F.when(F.avg(F.col("value").rlike(p).cast("int")) >= 0.9, F.lit(name)) for p, name in DATE_FORMS])
    return reduce(DataFrame.union, parts).groupBy("column").agg(form.alias("form")).filter("form is not null")


def join(a: DataFrame, b: DataFrame, ka: str, kb: str, how: str = "left", order: tuple[str, ...] = (), suffix: str = "_lookup") -> DataFrame:
    """a joined to b, one row of b (the first by `order`) for each key: keys compared as text, columns of b that a has get the suffix; adds matched."""
    nth = F.row_number().over(Window.partitionBy("__k").orderBy(*[F.col(c) for c in (order or (kb,))]))
    one = b.withColumn("__k", key_text(F.col(kb))).filter("__k is not null").withColumn("__nth", nth).filter("__nth = 1").drop("__nth")
    one = one.select(F.col("__k").alias("__kb"), F.lit(True).alias("__hit"), *[F.col(c).alias(f"{c}{suffix}" if c in a.columns else c) for c in b.columns if c != kb])
    joined = a.withColumn("__ka", key_text(F.col(ka))).join(one, F.col("__ka") == F.col("__kb"), how)
    return joined.withColumn("matched", F.coalesce("__hit", F.lit(False))).drop("__ka", "__kb", "__hit")
