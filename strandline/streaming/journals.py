"""Open runs and stage journals under Structured Streaming, with built-in operators only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def incomplete_runs(events: DataFrame, start: str, finish: str, timeout: str, delay: str = "0 seconds") -> DataFrame:
    """``run_id, start_id, started``: starts without a finish within ``timeout``, reported once the watermark has passed it.

    An outer join of two streams; state older than the timeout is dropped.
    """
    timed = events.withWatermark("at", delay)
    starts = timed.where(F.col("event_type") == start).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("start_id"), F.col("at").alias("started"))
    finishes = timed.where(F.col("event_type") == finish).select(F.col("user_id").alias("by"), F.col("at").alias("finished"))
    within = (F.col("run_id") == F.col("by")) & (F.col("finished") >= F.col("started")) & (F.col("finished") <= F.col("started") + F.expr(f"INTERVAL {timeout}"))
    return starts.join(finishes, within, "left_outer").where("by IS NULL").select("run_id", "start_id", "started")


def appended(df: DataFrame, path: str) -> DataFrame:
    """Run a stream in append mode over what is there, into a Parquet table of the shared folder, and return it."""
    query = df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def judged_stages(records: DataFrame, accepted: DataFrame | None, parents: dict[str, tuple[str, ...]]) -> tuple[DataFrame, DataFrame]:
    """Records ``run_id, stage, at, event_id`` of one batch with their ``state``, and when each run's stages have been accepted.

    A stage is accepted at its first record after all its parents have been.  ``parents``
    names them, each before its children.  The state is one row for each run; records of
    a run are only compared with it, so a run with very many records stays spread out.
    """
    spot = F.struct("at", "event_id")
    column = {stage: f"s{n}" for n, stage in enumerate(parents)}
    empty = F.lit(None).cast(records.select(spot.alias("x")).schema["x"].dataType)
    known = records.select("run_id").distinct()
    if accepted is None:
        known = known.select("run_id", *(empty.alias(c) for c in column.values()))
    else:
        known = known.join(accepted, "run_id", "full_outer")
    for stage, before in parents.items():
        own = records.where(F.col("stage") == stage).select(F.col("run_id").alias("by"), spot.alias("spot"))
        after = reduce(lambda a, b: a & b, (F.col(column[p]) < F.col("spot") for p in before), F.col("run_id") == F.col("by"))
        first = known.join(own, after, "left").groupBy("run_id", *column.values()).agg(F.min("spot").alias("first"))
        known = first.withColumn(column[stage], F.coalesce(column[stage], "first")).drop("first")
    state = F.lit("unknown")
    for stage, name in column.items():
        judged = F.when(F.col(name).isNull() | (spot < F.col(name)), "out_of_order").when(spot == F.col(name), "accepted").otherwise("repeated")
        state = F.when(F.col("stage") == stage, judged).otherwise(state)
    return records.join(known, "run_id").select("run_id", "stage", "at", "event_id", state.alias("state")), known


def stage_journal(records: DataFrame, parents: dict[str, tuple[str, ...]], path: str) -> DataFrame:
    """Judge a stream of stage records batch by batch; a batch that is run again overwrites its own results.

    The state after batch n is a table of its own, so a restart goes on from the last
    batch that was completed.
    """
    spark = records.sparkSession
    schema = records.select("run_id", "stage", "at", "event_id", F.lit("").alias("state")).schema
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/rows/batch=none")

    def judge(batch: DataFrame, number: int) -> None:
        before = spark.read.parquet(f"{path}/state/{number - 1}") if number else None
        rows, known = judged_stages(batch, before, parents)
        known.write.mode("overwrite").parquet(f"{path}/state/{number}")
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = records.writeStream.foreachBatch(judge).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/rows/batch=*")
