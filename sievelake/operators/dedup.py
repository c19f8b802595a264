"""Duplicates by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Keys with more than this share of all rows are split, and into how many parts.
HOT, PARTS = 0.002, 32


def row_hash(df: DataFrame) -> Column:
    """64 bits of all columns; maps, which have no hash, by their text."""
    return F.xxhash64(*[F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def mark_first(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds whether a row is the first of its key by `order`; null keys are equal to one another, of rows alike in all one is first.

    Keys that very many rows share, and keys with a null, are dealt out over
    PARTS parts by the rows' hashes, each with a first of its own; these few
    meet in a second window. Rows alike in all columns stay together. Which
    keys are split comes from a count of fixed size (freqItems, at most
    1 / HOT keys) and changes no result.
    """
    # Parts and order depend on the rows alone: both branches below agree, whether Spark reads one shuffle twice or makes it anew.
    whole = row_hash(df)
    order = [*order, whole]
    key = F.xxhash64(*[F.col(f"`{c}`") for c in keys])
    hot = df.select(key.alias("key")).freqItems(["key"], HOT).first()[0]
    null = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in keys])
    split = null | key.isin(hot) if hot else null
    part = F.when(split, 1 + F.pmod(whole, F.lit(PARTS))).otherwise(0)
    dealt = df.withColumn("__part", part.cast("int"))
    inside = Window.partitionBy(*[F.col(f"`{c}`") for c in keys], "__part").orderBy(*order)
    ranked = dealt.withColumn(name, F.row_number().over(inside) == 1)
    firsts = F.col(name) & (F.col("__part") > 0)
    across = Window.partitionBy(*[F.col(f"`{c}`") for c in keys]).orderBy(*order, "__part")
    again = ranked.filter(firsts).withColumn(name, F.row_number().over(across) == 1)
    return ranked.filter(~firsts).unionByName(again).drop("__part")


def _order(df: DataFrame, date: str | None, tie: list[str]) -> list[Column]:
    # Rows that date and tie leave equal are told apart by the hash of all their columns, so that reruns agree.
    return ([F.col(date).desc_nulls_last()] if date else []) + [F.col(c) for c in tie] + [row_hash(df)]


def keep_latest(df: DataFrame, pk: list[str], date: str | None, tie: list[str]) -> tuple[DataFrame, DataFrame]:
    """The newest row of each key (ties by `tie`), with rows whose key has a null kept aside; and a row with the resolved duplicates."""
    whole = F.lit(True)
    for c in pk:
        whole = whole & F.col(c).isNotNull()
    ranked = mark_first(df.filter(whole), pk, _order(df, date, tie), "__first")
    kept = ranked.filter("__first").drop("__first").unionByName(df.filter(~whole))
    return kept, ranked.agg(F.count(F.when(~F.col("__first"), 1)).alias("resolved_duplicates"))


def split_duplicates(df: DataFrame, pk: list[str], date: str | None, tie: list[str]) -> DataFrame:
    """df and is_duplicate: all rows of a key but its newest. No join; keys that very many rows share are split."""
    return mark_first(df, pk, _order(df, date, tie), "__first").withColumn("is_duplicate", ~F.col("__first")).drop("__first")


def anti(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_anti")
