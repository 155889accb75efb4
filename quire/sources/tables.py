"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt over all tasks by their keys.

    A table of short rows is one file split, or few partitions once the exchange is merged by size; work that costs far more
    than a row weighs would then run in a few tasks.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
