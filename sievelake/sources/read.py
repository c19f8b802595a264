"""Sources: files of several kinds, JDBC, and the register of what has come in."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a file that are read at once.
PIECE = 4 << 20


def read_raw_csv(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """All columns as text; quoted fields may have breaks and doubled quotes."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False, recursiveFileLookup=recursive)


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """Rows from result.records, records, data or items, else from the list or object itself; nested values are JSON text, columns in order of name."""
    df = spark.read.json(path, multiLine=True)
    for way in ("result.records", "records", "data", "items"):
        head, _, tail = way.partition(".")
        if head not in df.columns:
            continue
        kind = df.schema[head].dataType
        if tail:
            if not isinstance(kind, T.StructType) or tail not in kind.names:
                continue
            kind = kind[tail].dataType
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            df = df.select(F.explode(way).alias("r")).select("r.*")
            break
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*[(F.to_json(f.name) if isinstance(f.dataType, nested) else F.col(f.name)).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)])


def guarded_query(query: str) -> str:
    """The query, if it is a single SELECT."""
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", query, flags=re.S).strip().rstrip(";").strip()
    if ";" in bare or not re.match(r"(?i)select\b", bare):
        raise ValueError("only a single SELECT may be read")
    return bare


def read_jdbc(spark: SparkSession, options: dict[str, str], query: str, max_rows: int) -> DataFrame:
    """The rows of a single SELECT; more than max_rows is an error, not a cut."""
    df = spark.read.format("jdbc").options(**options).option("query", guarded_query(query)).load()
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"the query has over {max_rows} rows")
    return df


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_any(spark: SparkSession, path: str, form: str, row_tag: str = "row") -> DataFrame:
    if form == "csv":
        return read_raw_csv(spark, path)
    if form == "json":
        return read_json_records(spark, path)
    if form == "xml":
        return spark.read.format("xml").option("rowTag", row_tag).load(path)
    return spark.read.format(form).load(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of landed files.

    Files on a disk that executors share are read in pieces by the tasks, a few
    files each, and never held whole. Files in other stores come through
    Spark's reader, which holds one at a time and takes none over 2 GB.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        return found.select("path", "length", F.sha2("content", 256).alias("sha256"))
    listed = found.select("path", "length")

    def digest(batches):
        for batch in batches:
            sums = []
            for name in batch.column(0).to_pylist():
                total = hashlib.sha256()
                with open(re.sub("^file:/+", "/", name), "rb") as f:
                    while piece := f.read(PIECE):
                        total.update(piece)
                sums.append(total.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.string())], ["path", "length", "sha256"])

    # Sizes tell nothing of the work in a partition of names, so names are dealt out.
    return listed.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(digest, "path string, length long, sha256 string")


def new_files(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files whose content no queued, running or succeeded ingestion has."""
    known = registry.filter(F.col("status").isin("QUEUED", "RUNNING", "SUCCEEDED")).select("sha256").distinct()
    return files.join(known, "sha256", "left_anti")


def summarize_runs(ingestions: DataFrame) -> DataFrame:
    """Ingestions, successes and bytes of every source."""
    return ingestions.groupBy("source").agg(F.count("*").alias("ingestions"), F.count(F.when(F.col("status") == "SUCCEEDED", 1)).alias("succeeded"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def summarize_quality(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count_distinct("table_name").alias("tables"), F.count("*").alias("runs"), F.sum("total_records").alias("records"), F.max("total_records").alias("largest_run"))
