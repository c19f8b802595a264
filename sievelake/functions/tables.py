"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where the setting is absent (tests, one machine), a temporary folder of
    this machine is taken and kept for the session.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found is None:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables of this process that written() has made, oldest first.
_MADE: list[tuple[str, DataFrame]] = []


def written(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, is computed once however often it is read, and survives lost executors.

    files: for tables of a row a group, into how many files at most, so that
    Spark sees from their size whether they can be broadcast.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    (df if files is None else df.coalesce(files)).write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    _MADE.append((path, made))
    return made


def table_mark() -> int:
    """A mark for tables_since and drop_tables."""
    return len(_MADE)


def tables_since(mark: int) -> list[str]:
    """Paths of the tables written since the mark that are still there."""
    return [path for path, _ in _MADE[mark:]]


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that written() has made and that nothing reads any more."""
    gone = set(paths)
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _MADE[:] = [x for x in _MADE if x[0] not in gone]


def drop_tables(spark: SparkSession, mark: int, keep: tuple[DataFrame, ...] = ()) -> None:
    """Deletes the tables written since the mark but those in keep, the only ones that a plan not yet run may read."""
    drop_paths(spark, [path for path, df in _MADE[mark:] if not any(df is k for k in keep)])
