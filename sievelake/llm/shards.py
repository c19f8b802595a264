"""Sharding by proportional stratified interleaving (native)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, key_bucket, prefix_sums, quoted, seeded_key, source_key, text_of, written


def interleaved_shards(docs: DataFrame, shards: int = 40, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Deals rows into shards so that every shard has the mixture of sources of the whole.

    Within each source the rows are ranked in a seeded shuffle; row r of n has
    the fractional rank (2r + 1) / 2n. All rows in order of that fraction are
    cut into shards whose row counts differ by one at most. Both global ranks
    come from sums over buckets (prefix_sums), so that a source which holds a
    third of the rows is split like any other.

    Returns id, source, size (UTF-8 bytes of the text plus 16), text_crc32,
    shard and slot (place in the shard, without gaps from 0). Null texts count
    as empty; null sources are a source of their own; an empty table gives no
    rows. Rows that repeat an id are ordered by checksum and size; rows equal
    in all of these can stand for one another. Only the columns named here are
    read, so that others may have any name.
    """
    utf8 = F.encode(text_of(text_col), "utf-8")
    rows = written(
        docs.select(
            F.col(quoted(id_col)).alias("doc_id"),
            F.col(quoted(source_col)).alias("source"),
            source_key(source_col).alias("stratum"),
            (F.octet_length(utf8) + 16).cast("long").alias("size"),
            F.crc32(utf8).alias("text_crc32"),
            seeded_key(seed, F.col(quoted(id_col))).alias("key"),
            F.lit(1).cast("long").alias("one"),
        ),
        "shard-rows",
    )
    total = max(rows.count(), 1)
    buckets = buckets_for(total)
    ranked = prefix_sums(rows.withColumn("bucket", key_bucket("key", buckets)), ["stratum"], "bucket", ["key", "text_crc32", "size"], ["one"])
    dealt = ranked.select(
        "doc_id", "source", "stratum", "size", "text_crc32", "key", "one",
        ((2 * F.col("one_before") + 1) / (2 * F.col("one_total"))).alias("fraction"),
        F.expr(f"((2 * one_before + 1) * {buckets}L) div (2 * one_total)").alias("slice"),
    )
    placed = prefix_sums(dealt, [], "slice", ["fraction", "stratum", "key", "text_crc32", "size"], ["one"])
    shard = f"(one_before * {shards}L) div {total}L"
    first = f"(({shard}) * {total}L + {shards - 1}L) div {shards}L"  # rank of the shard's first row
    return placed.select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.expr(shard).cast("int").alias("shard"),
        F.expr(f"one_before - {first}").cast("long").alias("slot"),
    )
