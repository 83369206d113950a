"""The queue as Structured Streaming: a stream of job or event files, state by key, and sinks
that can repeat a batch without harm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files_per_batch: int = 1) -> DataFrame:
    """Events from the Parquet file or folder ``name`` under ``folder``, as they come."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    # A pattern, so that a single file is a source as a folder is.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{name[:-1]}[{name[-1]}]")


def deduplicated(stream: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """The first event of each key; state older than the delay goes."""
    return stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay).dropDuplicatesWithinWatermark(keys)


def counts_by_key(stream: DataFrame, key: str) -> DataFrame:
    return stream.groupBy(key).agg(F.count("*").alias("n"), F.max(F.struct("event_id", "event_type")).alias("m")).select(key, "n", "m.event_id", "m.event_type")


def windowed(stream: DataFrame, size: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """An extension: event-time windows with a watermark."""
    at = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    return at.groupBy(F.window("at", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def drained(stream: DataFrame, out: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs the stream over all that is there and returns what it left under ``out``. Each batch overwrites a
    folder of its own, so a repeated batch leaves one result; in mode complete the last batch holds all."""
    spark = stream.sparkSession

    def work(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(work).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    # The folders tell which batches there are, those of earlier runs from the same checkpoint included.
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(path(out))] if files.exists(path(out)) else []
    numbers = sorted(int(n[6:]) for n in names if n.startswith("batch=") and files.exists(path(f"{out}/{n}/_SUCCESS")))
    if not numbers:
        return spark.createDataFrame([], stream.schema)
    kept = numbers[-1:] if mode == "complete" else numbers
    return spark.read.schema(stream.schema).parquet(*[f"{out}/batch={n}" for n in kept])


def claims(batch: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs of a batch that are due and not done, in order of claim: queued before failed, then age, then id."""
    return batch.join(done.select("event_id"), "event_id", "left_anti").orderBy(F.col("event_type") == "error", "ts", "event_id")


def run_jobs(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Processes all queued jobs of a stream in order of claim. Each batch overwrites its own
    folder, so a batch that is repeated after a crash leaves one result."""
    order = [F.col("event_type") == "error", F.col("ts"), F.col("event_id")]

    def work(batch: DataFrame, number: int) -> None:
        from pyspark.sql import Window

        claimed = batch.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)))
        claimed.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
