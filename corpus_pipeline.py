"""A pipeline from documents to packed sequences; every stage is one operator of sievelake.llm."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm.common import WORD, drop_paths, quoted, table, table_mark, tables_since, written
from sievelake.llm.mixing import mixed_documents
from sievelake.llm.packing import packed
from sievelake.llm.quality import kept_documents
from sievelake.llm.simhash import first_of_similar
from sievelake.llm.templates import without_recurring_lines


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables in the shared folder that the last stage's result reads.
_LEFT: list[str] = []


def stage(function: Stage) -> Stage:
    """A stage deletes the tables that the stage before it has left, for that one's result is written by now; not those that its input reads."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _LEFT:
            read = "\n".join(docs.inputFiles())
            drop_paths(spark, [path for path in _LEFT if path.rsplit("/", 1)[-1] not in read])
        mark = table_mark()
        out = function(spark, docs, sf_dir)
        _LEFT[:] = tables_since(mark)
        return out

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: with no text, few words or many repeats, and outliers; equal rows go or stay together."""
    return kept_documents(docs)


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates and passages of over 50 words go (all but the first document's), and documents that have no word left, null and empty ones among them."""
    cleaned = without_recurring_lines(docs, passage_docs=2, counts=False)
    columns = {c: F.col(quoted(c)) for c in docs.columns} | ({"n_chars": F.char_length("text").cast("long")} if "n_chars" in docs.columns else {})
    return cleaned.filter(F.col("text").rlike(WORD)).select(*[c.alias(k) for k, c in columns.items()])


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, of equal ones the first: texts with a similarity of 0.8 or more in shingles of five words. Texts without words are alike."""
    return first_of_similar(docs)


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is one of its own; those without words are in no mix."""
    return mixed_documents(docs)


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids; null and empty texts are their end mark alone, equal rows are packed each."""
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("packing", packing),
]

#: SQL has neither the XXH64 hashes of the near-duplicate stage nor the tokenizer of the last.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again as the next one's input."""
    docs, read = table(spark, sf_dir, "documents"), []
    for name, apply in STAGES[:-1]:
        docs = written(apply(spark, docs, sf_dir), f"stage-{name}")
        drop_paths(spark, read)
        read = tables_since(table_mark() - 1)
    return STAGES[-1][1](spark, docs, sf_dir)
