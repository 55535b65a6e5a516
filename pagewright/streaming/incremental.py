"""Work that goes on where it stopped: as batches and as streams. The streams are an extension with the same results as the batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def resume(todo: DataFrame, output: str, key: str, work: Callable[[DataFrame], DataFrame]) -> int:
    """Work on the rows that the output folder has no row for, and append. Returns how many there were. Running it again adds nothing."""
    spark = todo.sparkSession
    try:
        done = spark.read.parquet(output).select(key)
        rest = todo.join(done.distinct(), key, "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        rest = todo
    n = rest.count()
    if n:
        work(rest).write.mode("append").parquet(output)
    return n


def stream_new_rows(spark: SparkSession, folder: str, schema: str, output: str, checkpoint: str, key: str, work: Callable[[DataFrame], DataFrame], time: str = "ingested_at", late: str = "30 days") -> StreamingQuery:
    """Rows that arrive in a folder, each key once, through ``work`` into the output. A replayed batch writes nothing twice.

    Keys are remembered for ``late`` after the newest time, so the state is bounded. Ends when all that is there has been read.
    """
    rows = spark.readStream.schema(schema).parquet(folder).withWatermark(time, late).dropDuplicatesWithinWatermark([key])

    def write(batch: DataFrame, number: int) -> None:
        work(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(output)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_counts(rows: DataFrame, time: str, by: str, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """Counts per window and value of a stream (or a batch); windows close ``late`` after the newest time."""
    timed = rows.withWatermark(time, late) if rows.isStreaming else rows
    return timed.groupBy(F.window(time, window).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), by, "n")


def stream_counts_to(counts: DataFrame, output: str, checkpoint: str) -> None:
    """Run a stream of counts until all that is there has been read; ``output`` holds the counts so far after each batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(output)

    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
