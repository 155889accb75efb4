"""Helpers that the operators share: reading, tables in the shared folder, plain text columns."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import checkpoint_dir

#: Separators of words in the contracts: space and tab to carriage return. ``bytes.split()`` splits at the same six.
BLANK = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, kind: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: it is computed once, and its lineage ends there."""
    path = shared_path(frame.sparkSession, kind)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def keyed_text(frame: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, as ``id`` and ``text``; other columns, clashing names included, stay outside."""
    return frame.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def raw(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def unit_hash(*columns: Column | str) -> Column:
    """A number in [0, 1) from a hash of the columns: the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(1 << 53))
