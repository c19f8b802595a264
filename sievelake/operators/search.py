"""Rows that contain a text, found over signatures of files so that few files are read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import history, versions

#: Three characters of a text stand for one of so many bits of a file's signature.
BITS = 1 << 16
#: Bits of one of Spark's bitmaps.
_BITMAP = 32_768


def _bits(text: Column) -> Column:
    """Places in a signature of every three characters of a text in lower case."""
    n = F.length(text)
    grams = F.transform(F.sequence(F.lit(1), n - 2), lambda k: F.pmod(F.xxhash64(F.substr(text, k, F.lit(3))), F.lit(BITS)))
    return F.array_distinct(F.when(n >= 3, grams).otherwise(F.array().cast("array<bigint>")))


def _index(path: str) -> str:
    return f"{path}/text"


def index_files(spark: SparkSession, path: str) -> int:
    """Signs those files of a table (operators.versions) that have no signature yet, as files never change; returns how many.

    A signature has a bit for every three characters that stand in a cell of
    one of the file's rows; it is made as Spark's bitmaps, with partial ones
    before the shuffle.
    """
    files = versions.file_list(spark, path)
    known = versions.latest(spark, _index(path))
    if known is not None:
        files = files.join(versions.read(spark, _index(path)).select("file").distinct(), "file", "left_anti")
    new = [r["file"] for r in files.select("file").collect()]
    if not new:
        return 0
    rows = versions.rows_of_files(spark, path, new)
    cells = F.explode(F.array_compact(F.array(*[F.lower(F.col(f"`{c}`").cast("string")) for c in rows.columns if c != "__file"])))
    bits = rows.select("__file", cells.alias("cell")).select("__file", F.explode(_bits(F.col("cell"))).alias("bit"))
    signed = bits.groupBy(F.col("__file").alias("file"), F.floor(F.col("bit") / _BITMAP).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(_BITMAP))).alias("signature"))
    # Files without a text of three characters have a row too, so that they are not signed again.
    none = spark.createDataFrame([(f, -1, None) for f in new], "file string, part int, signature binary")
    versions.append(signed.unionByName(none), _index(path))
    return len(new)


def files_with(spark: SparkSession, path: str, text: str) -> list[str]:
    """Files of the newest version that can have the text: those whose signatures have all its bits, and those without a signature."""
    files = versions.file_list(spark, path).select("file")
    if len(text) < 3 or versions.latest(spark, _index(path)) is None:
        return [r["file"] for r in files.collect()]
    asked = [r[0] for r in spark.range(1).select(F.explode(_bits(F.lit(text.lower())))).collect()]
    signed = versions.read(spark, _index(path))
    byte = lambda k: F.conv(F.hex(F.substring("signature", k // 8 + 1, 1)), 16, 10).cast("int")
    has = [F.when(F.col("part") == bit // _BITMAP, byte(bit % _BITMAP).bitwiseAND(1 << (bit % _BITMAP % 8)) != 0).otherwise(F.lit(False)) for bit in asked]
    hits = signed.groupBy("file").agg(*[F.max(h).alias(f"h{k}") for k, h in enumerate(has)])
    able = hits.select("file", reduce(lambda a, b: a & b, [F.coalesce(F.col(f"h{k}"), F.lit(False)) for k in range(len(has))]).alias("able"))
    return [r["file"] for r in files.join(able, "file", "left").filter(F.coalesce("able", F.lit(True))).select("file").collect()]


def search(spark: SparkSession, path: str, text: str, run_id: str | None = None) -> DataFrame:
    """Rows of a table any of whose columns contains the text, in any case; only files that can have it are read.

    A text of under three characters, or one with the character 31, which
    stands between columns, is looked for in all files.
    """
    files = files_with(spark, path, "" if "\x1f" in text else text)
    return history.search_rows(versions.rows_of_files(spark, path, files).drop("__file"), text, run_id)
