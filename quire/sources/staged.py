"""Tables between the stages of a job."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, functions as F

from quire.session import checkpoint_dir

#: Rows above which a stored table is never sent whole to the driver and all tasks.
SMALL = 100_000


def staged(frame: DataFrame, kind: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    What follows is planned from a scan, so a job of many stages is planned in the time of its longest stage, and a lost
    executor costs the stage that it was in. Files of alike rows are far smaller than their rows, and a join judges a scan by
    its files: a table of more than ``SMALL`` rows is marked, so that joins merge it.
    """
    spark = frame.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    seen = Observation()
    frame.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    stored = spark.read.schema(frame.schema).parquet(path)
    # a plan known to be empty is not observed
    return stored.hint("merge") if seen.get.get("rows", 0) > SMALL else stored
