"""Ledger pairing under Structured Streaming.

Duplicates within the watermark are dropped by event id; a run's state holds its
first start and first finish.  ``pair_stream`` is a plain aggregation, so it runs
in update or complete mode with bounded state per run and needs no Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream, with an event time that watermarks accept."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return raw.withColumn("at", F.col("ts").cast("timestamp"))


def pair_stream(events: DataFrame, start: str, finish: str, delay: str = "400 days") -> DataFrame:
    """``run_id, start_id, finish_id``: the first start and finish of each run so far."""
    fresh = events.withWatermark("at", delay).dropDuplicatesWithinWatermark(["event_id"])
    first = lambda kind, name: F.min(F.when(F.col("event_type") == kind, F.struct("at", "event_id")))["event_id"].alias(name)
    return fresh.groupBy(F.col("user_id").alias("run_id")).agg(first(start, "start_id"), first(finish, "finish_id"))


def run_to_end(df: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there to its end, however long, and return its table.

    Each batch writes the whole result as Parquet beside the checkpoint, in the shared folder; the last one counts.
    """
    last: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{checkpoint}-table/batch-{number}"
        batch.write.mode("overwrite").parquet(path)
        last[:] = [path]

    query = df.writeStream.outputMode("complete").foreachBatch(keep).queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()  # raises what the stream raised
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(last[0]) if last else spark.createDataFrame([], df.schema)
