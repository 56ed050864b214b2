"""The tumbling window counts as a stream, and their parity with the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_folder


def counts(events: DataFrame, length: str = "6 hours") -> DataFrame:
    """(a, event_type, n, total) by tumbling windows; the same plan for a batch and a stream with a watermark."""
    return events.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("a"), "event_type", "n", F.round("total", 4).alias("total"))


def streamed_counts(spark: SparkSession, path: str) -> DataFrame:
    """(a, event_type, n, total) from a stream over the files, run until the input's end; every batch's windows go to a folder
    of their own, and the last one that is whole holds all windows (complete mode), read from files, not from the driver."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(path if path.endswith("/") else f"{path}*").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    root, done = shared_folder(spark, "stream"), []

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure overwrites its own folder
        batch.write.mode("overwrite").parquet(f"{root}/out-{number}")
        done.append(number)

    shape = counts(spark.read.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))).schema
    q = counts(stream).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(shape).parquet(f"{root}/out-{max(done)}") if done else spark.createDataFrame([], shape)
