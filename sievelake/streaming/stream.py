"""Streams: source, parsing, sinks and bounded de-duplication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

Writer = Callable[[DataFrame, int], None]
#: Fixed value: the record of the post feed.
POST = "subreddit string, id string, title string, created_utc double, author string, score int"


def kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("failOnDataLoss", "false").load()


def files(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as a stream of `value`, in place of a broker."""
    return spark.readStream.text(path)


def parse(df: DataFrame, schema: str = POST, epoch: str = "created_utc") -> DataFrame:
    """The fields of JSON values; the epoch as event time."""
    rows = df.select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")
    return rows.withColumn("event_time", F.timestamp_seconds(epoch))


def write_partitioned(df: DataFrame, path: str, column: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    writer = df.writeStream.format("parquet").partitionBy(column).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start(path)


def batch_sink(path: str, query: str, columns: tuple[str, ...] = ()) -> Writer:
    """Writes each batch of a query into a folder of its own, partitioned by columns; a batch that comes again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*columns).parquet(f"{path}/query={query}/batch={number}")

    return write


def fan_out(df: DataFrame, writers: dict[str, Writer], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Every micro-batch goes to all writers, each with progress of its own.

    A writer that is through with a batch leaves a mark below the checkpoint
    and is passed over when the batch comes again, so that one that fails (the
    stream then stops, the other writers having had their turn) does not make
    others repeat theirs. One that was stopped between its writing and its mark
    gets the batch again: it must replace what it wrote (batch_sink does).
    """
    fs_of = df.sparkSession._jvm.org.apache.hadoop.fs.Path

    def write(batch: DataFrame, number: int) -> None:
        conf = batch.sparkSession._jsc.hadoopConfiguration()
        mark = lambda name, n: fs_of(f"{checkpoint}/written/{name}/{n}")
        fs = fs_of(checkpoint).getFileSystem(conf)
        batch.persist()
        failed = None
        for name, writer in writers.items():
            if fs.exists(mark(name, number)):
                continue
            try:
                writer(batch, number)
            except Exception as e:  # the others have their turn first
                failed = failed or e
                continue
            fs.create(mark(name, number)).close()
            fs.delete(mark(name, number - 2), False)  # only the last batch can come again
        batch.unpersist()
        if failed is not None:
            raise failed

    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def dedup_posts(df: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row for each id within the watermark, which bounds the state."""
    return df.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["id"])


def clean_post(df: DataFrame) -> DataFrame:
    """Titles without tags and entities; scores from text like '12 points'."""
    bare = F.regexp_replace("title", r"<[^>]*>", " ")
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(mark))
    score = F.regexp_extract(F.col("score").cast("string"), r"-?[0-9]+", 0).try_cast("int")
    return df.withColumn("title", F.trim(F.regexp_replace(bare, r"\s+", " "))).withColumn("score", score)
