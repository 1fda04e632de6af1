"""Incremental work: pending files, job states with attempts and leases, windowed counts, idempotent ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

STATE = "id string, status string, attempts int"


def landing(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 100) -> DataFrame:
    """New parquet files below a folder; with a checkpoint each is read once, so a stopped run resumes."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drain(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything that is pending and stop."""
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def append_new(key: list[str], path: str) -> Callable[[DataFrame, int], None]:
    """A step that adds rows with unknown keys to a parquet table, so that a repeated batch changes nothing."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(key)
        try:
            fresh = fresh.join(spark.read.parquet(path).select(*key), key, "left_anti")
        except Exception as e:  # the table does not exist yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("append").parquet(path)

    return step


def once(stream: DataFrame, key: list[str], path: str, checkpoint: str) -> None:
    """Add every key once to a parquet table: the keys that were seen are kept in the stream's state, so no batch reads the table."""
    query = stream.dropDuplicates(key).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of parquet files as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def collected(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """What a drained stream gives, with the number of its batch."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(path)

    query = stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)


def windowed_counts(events: DataFrame, lateness: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events by window and kind; later than ``lateness`` they are dropped by the watermark."""
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def _advance(lease_ms: int | None):
    """A step of one job: the last status, and how often it failed; a running job gets a lease where there are leases."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts = state.get if state.exists else ("pending", 0)
        if lease_ms and state.hasTimedOut:
            status = "pending" if status == "running" else status
        for batch in batches:
            for word in batch.sort_values("seq")["status"]:
                attempts += word == "failed"
                status = word
        state.update((status, int(attempts)))
        if lease_ms and status == "running":
            state.setTimeoutDuration(lease_ms)
        yield pd.DataFrame({"id": [key[0]], "status": [status], "attempts": [int(attempts)]})

    return step


def job_states(events: DataFrame, lease_ms: int | None = 3_600_000) -> DataFrame:
    """Latest status and number of failures of each job from (id, seq, status); a running job whose lease ends becomes pending.

    A stream with leases never ends, as they may end at any time; without them it can be drained.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if lease_ms else GroupStateTimeout.NoTimeout
    return events.groupBy("id").applyInPandasWithState(_advance(lease_ms), STATE, "status string, attempts int", "update", timeout)
