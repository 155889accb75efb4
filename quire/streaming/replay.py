"""Run a stream over what its folder holds now, and return its sink's table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.session import checkpoint_dir


def new_root(spark: SparkSession, kind: str = "stream") -> str:
    """A folder of its own beside the checkpoints."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The files of a table as a stream, one trigger's worth of them at a time."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}.parquet*")


def arrivals(frame: DataFrame, arrival: str, numbers: range, root: str) -> None:
    """Write rows as files in order of ``arrival``, one file a number, as if they had come in one after the other."""
    for number in numbers:
        frame.where(f"{arrival} = {number}").drop(arrival).coalesce(1).write.mode("append").parquet(f"{root}/in")


def arrived(spark: SparkSession, root: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")


def run_batches(stream: DataFrame, put: Callable[[DataFrame, int], None], root: str, mode: str = "append", seconds: int = 1800) -> None:
    """Process all files there are, then stop; a later call with the same folder goes on where this one ended."""
    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError("the stream did not end in time")


def replay(stream: DataFrame, mode: str = "complete", seconds: int = 1800) -> DataFrame:
    """Process all files there are, then stop. In complete mode the sink holds the last result, else every row sent."""
    spark = stream.sparkSession
    root = new_root(spark)

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that is run again overwrites its own folder, so each row is kept once
        name = "last" if mode == "complete" else f"batch={number}"
        batch.write.mode("overwrite").parquet(f"{root}/sink/{name}")

    run_batches(stream, keep, root, mode, seconds)
    return spark.read.schema(stream.schema).parquet(f"{root}/sink/*")
