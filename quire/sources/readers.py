"""Text files, delimited files and nested JSON as lines."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as Ty

from quire.functions import text as T


def decoded(content: Column) -> Column:
    """UTF-8 where valid, UTF-16 where a byte-order mark says so, else ISO-8859-1."""
    mark = F.substring(content, 1, 2)
    return (
        F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8"))
        .when(mark.isin(F.unhex(F.lit("FFFE")), F.unhex(F.lit("FEFF"))), F.decode(content, "UTF-16"))
        .otherwise(F.decode(content, "ISO-8859-1"))
    )


def text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """path, ext, text of every file; captions are cleaned, everything else stays as it is."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select("path", F.regexp_extract(F.lower("path"), r"\.([^./]+)$", 1).alias("ext"), decoded(F.col("content")).alias("raw"))
    )
    return files.select(
        "path", "ext", F.when(F.col("ext") == "vtt", T.transcript_clean(F.col("raw"))).otherwise(F.col("raw")).alias("text")
    )


def delimited_lines(spark: SparkSession, path: str, sep: str = ",", columns: int = 64) -> DataFrame:
    """One line per record, cells trimmed and joined by `` | ``."""
    names = [f"c{i}" for i in range(columns)]
    rows = spark.read.csv(path, sep=sep, schema=", ".join(f"{n} string" for n in names), multiLine=True, escape='"')
    return rows.select(F.concat_ws(" | ", *[T.strip(F.col(n)) for n in names]).alias("line"))


_LEAF = Ty.StructType([Ty.StructField("path", Ty.StringType()), Ty.StructField("value", Ty.StringType())])


@F.pandas_udf(Ty.ArrayType(_LEAF))
def _leaves(texts: pd.Series) -> pd.Series:
    def walk(node, path: str):
        if isinstance(node, dict):
            for name, child in node.items():
                yield from walk(child, f"{path}.{name}" if path else name)
        elif isinstance(node, list):
            for child in node:
                yield from walk(child, path)
        else:
            yield {"path": path, "value": str(node)}

    def one(text):
        try:
            return list(walk(json.loads(text), ""))
        except (TypeError, ValueError):
            return []

    return texts.map(one)


def json_flatten(df: DataFrame, column: str) -> DataFrame:
    """One row per leaf: dotted path and value; list items repeat the path of their list."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(_leaves(F.col(column))).alias("pos", "leaf")).select(
        *rest, "pos", "leaf.path", "leaf.value"
    )
