"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import drop_paths as drop_paths
from ..functions.tables import drop_tables as drop_tables
from ..functions.tables import scratch as fresh_path
from ..functions.tables import table_mark as table_mark
from ..functions.tables import tables_since as tables_since
from ..functions.tables import written as written

#: A word: a run of anything but the ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(column: str) -> str:
    """The name as Spark reads it whatever it holds: dots, blanks, backticks."""
    return "`" + column.replace("`", "``") + "`"


def packed_row(df: DataFrame, name: str = "row", columns: list[str] | None = None) -> Column:
    """All columns of df (or those named) in one struct, so that helper columns beside it clash with none of them."""
    return F.struct(*[F.col(quoted(c)) for c in (df.columns if columns is None else dict.fromkeys(columns))]).alias(name)


def unpacked(columns: list[str], name: str = "row") -> list[Column]:
    """The columns that packed_row has put away, under their own names."""
    return [F.col(f"{name}.{quoted(c)}").alias(c) for c in columns]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str) -> Column:
    return F.coalesce(F.col(quoted(column)).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def source_key(column: str, parsed: bool = False) -> Column:
    """A key that is never null: null becomes 'n', any other value gets the prefix 'v'. parsed: the name is quoted where it must be."""
    c = F.col(column if parsed else quoted(column)).cast("string")
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), c))


def seeded_key(seed: int, *columns: Column) -> Column:
    """32 hex digits that stand for a seeded shuffle of the rows; equal values get equal keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))


def key_bucket(key: str, buckets: int) -> Column:
    """Bucket 0 to buckets - 1 of a seeded key; it never falls as the key rises."""
    high = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    return F.shiftright(high * F.lit(buckets), 32)


def buckets_for(rows: int) -> int:
    """About the root of the row count, so that neither the buckets nor the rows of one are many."""
    return max(1, round(rows**0.5))


def prefix_sums(df: DataFrame, group: list[str], bucket: str, order: list, values: list[str]) -> DataFrame:
    """Adds <v>_before, the sum of v over earlier rows of the group, and <v>_total, that over the whole group.

    Rows are in order of (bucket, order). The sums over buckets are made first,
    so that no task gets more of a hot group than one bucket. Group columns
    must not be null.
    """
    per = df.groupBy(*group, bucket).agg(*[F.sum(v).alias(f"__{v}") for v in values])
    across = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    ahead = across.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(
        *group,
        bucket,
        *[F.coalesce(F.sum(f"__{v}").over(ahead), F.lit(0)).alias(f"__{v}_ahead") for v in values],
        *[F.sum(f"__{v}").over(across).alias(f"{v}_total") for v in values],
    )
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(offsets, [*group, bucket])
    for v in values:
        out = out.withColumn(f"{v}_before", F.col(f"__{v}_ahead") + F.coalesce(F.sum(v).over(inside), F.lit(0)))
    return out.drop(*[f"__{v}_ahead" for v in values])
