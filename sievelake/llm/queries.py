"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audit import filter_audit
from .common import table
from .mixing import mixed
from .neighbours import nearest
from .oracles import ORACLES as ORACLES
from .packing import packed
from .passages import without_passages
from .quality import quality_rules
from .shards import interleaved_shards
from .simhash import near_duplicates
from .suffixes import without_repeats
from .templates import without_recurring_lines
from .urls import url_verdicts
from .warc import archived_pages
from .whitening import whitened

#: The host rules of the URL query.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def vantage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("distance")


def line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_recurring_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = interleaved_shards(table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"))


def sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def concatenated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def audit_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_passages(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def whitened_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviations beyond a long, which the contract asks for, are null."""
    made = whitened(table(spark, sf_dir, "embeddings"))
    return made.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_vantage": vantage_search,
    "op2_deep_shallow": suffix_dedup,
    "op3_mcd": quality_mcd,
    "op4_simhash": simhash_groups,
    "op5_url_trees": url_filter,
    "op6_templates": line_templates,
    "op7_interleave": interleaved,
    "op8_warc_members": warc_members,
    "op9_sainte_lague": sainte_lague_mix,
    "op10_concat_cut": concatenated_windows,
    "op11_term_matrix": audit_filters,
    "op12_fm_index": passage_dedup,
    "op13_bit_sliced": whitened_vectors,
}
