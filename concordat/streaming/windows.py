"""Structured Streaming over annotation events: label shares by window, deduplicated replies, resumable results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


def stream_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of parquet files as a stream, with the schema of what is there now."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def label_shares(events: DataFrame, ts: str, label: str, width: str, late: str) -> DataFrame:
    """Counts of labels by tumbling window; state of windows older than the watermark is dropped."""
    w = F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), F.col(label).alias("label")).agg(F.count("*").alias("n"))


def first_replies(replies: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """The first reply of each key within the watermark, as a reply cache keeps it."""
    return replies.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def run_to_table(stream: DataFrame, name: str, mode: str, out: str | None = None) -> DataFrame:
    """Process what is there now and give the resulting table; ``out`` names the folder of a run to go on with.

    Progress is kept in a checkpoint, so a lost run resumes. A batch that runs again after a failure writes its own folder
    again, so no row comes twice; the same holds for its row of ``progress``.
    """
    spark = stream.sparkSession
    out = out or shared_dir(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        data = f"{out}/data" if mode == "complete" else f"{out}/data/batch-{number}"
        batch.write.mode("overwrite").parquet(data)
        n = spark.read.schema(batch.schema).parquet(data).count()
        spark.createDataFrame([(number, n)], "batch bigint, n bigint").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(f"{out}/progress/batch-{number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{out}/data")


def progress(spark: SparkSession, out: str) -> DataFrame:
    """(batch, n, at): what each finished batch of a run has written."""
    return spark.read.schema("batch bigint, n bigint, at timestamp").option("recursiveFileLookup", "true").parquet(f"{out}/progress")
