"""Object inventory: scan, merge, roll-ups, top-k and daily activity."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.functions import keys as K
from quire.operators.ordered import best_per_group

FILE_COLUMNS = ("key", "name", "size", "last_modified", "etag")


def inventory_scan(spark: SparkSession, path: str, prefix: str = "", limit: int | None = None) -> DataFrame:
    """Objects below ``path`` whose key starts with ``prefix``; file contents are never read."""
    root = path.rstrip("/") + "/"
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select(
            F.regexp_extract("path", r"^(?:[a-z0-9]+:/*)?/?" + _quoted(root.lstrip("/")) + r"(.*)$", 1).alias("key"),
            F.col("length").alias("size"),
            F.col("modificationTime").alias("last_modified"),
        )
        .withColumn("etag", F.lit(None).cast("string"))
    )
    return from_listing(files, prefix, limit)


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r".^$*+?{}[]\|()" else c for c in text)


def from_listing(listing: DataFrame, prefix: str = "", limit: int | None = None) -> DataFrame:
    """Inventory rows of a raw listing: folder markers are skipped, names derived."""
    rows = listing.where(F.col("key").startswith(prefix) & ~F.col("key").endswith("/"))
    rows = rows.select(
        "key", K.base_name(F.col("key")).alias("name"), F.coalesce(F.col("size"), F.lit(0)).alias("size"),
        "last_modified", F.nullif(F.regexp_replace("etag", '^"+|"+$', ""), F.lit("")).alias("etag"),
    )
    return rows.orderBy("key").limit(limit) if limit is not None else rows


def inventory_union(parts: Sequence[DataFrame], keep: str = "last") -> DataFrame:
    """Overlapping listings merged on ``key``; the last or the first listing of a key is kept."""
    tagged = [p.withColumn("prefix_ord", F.lit(i)) for i, p in enumerate(parts)]
    return merge_listings(reduce(DataFrame.unionByName, tagged), keep).drop("prefix_ord")


def merge_listings(rows: DataFrame, keep: str = "last") -> DataFrame:
    """As ``inventory_union`` for rows that already carry ``prefix_ord``.

    One aggregate with map-side combine, so a key that is listed very often does not gather on
    one task. Inside one listing the newest, then largest row is taken.
    """
    order = F.col("prefix_ord") if keep == "last" else -F.col("prefix_ord")
    return best_per_group(rows, ["key"], [order, F.col("last_modified"), F.col("size")])


def object_versions(versions: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """Newest versions of exactly this key."""
    return (
        versions.where(F.col("key") == key)
        .select("version_id", "is_latest", "size", "last_modified", "etag")
        .orderBy(F.desc("last_modified"), "version_id")
        .limit(limit)
    )


def with_object_metadata(inventory: DataFrame, metadata: DataFrame) -> DataFrame:
    """One join in place of a lookup per object; map keys are lower-cased, missing maps are empty."""
    heads = metadata.select("key", *[c for c in metadata.columns if c not in ("key",)])
    head_size = F.col("head_size") if "head_size" in heads.columns else F.lit(None).cast("bigint")
    head_time = F.col("head_modified") if "head_modified" in heads.columns else F.lit(None).cast("timestamp")
    lowered = F.map_from_entries(
        F.transform(F.map_entries("metadata"), lambda e: F.struct(F.lower(e["key"]), e["value"]))
    )
    joined = inventory.join(heads, "key", "left")
    return joined.select(
        *[c for c in inventory.columns if c not in ("size", "last_modified")],
        F.coalesce(head_size, F.col("size")).alias("size"),
        F.coalesce(F.col("last_modified"), head_time).alias("last_modified"),
        F.coalesce(lowered, F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def classified(inventory: DataFrame) -> DataFrame:
    return inventory.withColumns({"area": K.classify_area(F.col("key")), "kind": K.file_kind(F.col("name"))})


def _sizes() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("count"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"),
    ]


def storage_by_area(inventory: DataFrame) -> DataFrame:
    return (
        inventory.groupBy(K.classify_area(F.col("key")).alias("id"))
        .agg(*_sizes())
        .select("id", K.area_label(F.col("id")).alias("label"), "count", "bytes")
        .orderBy(F.desc("bytes"), "id")
    )


def storage_by_kind(inventory: DataFrame) -> DataFrame:
    return (
        inventory.groupBy(K.file_kind(F.col("name")).alias("id"))
        .agg(*_sizes())
        .select("id", K.kind_label(F.col("id")).alias("label"), "count", "bytes")
        .orderBy(F.desc("bytes"), "id")
    )


def inventory_totals(inventory: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: objects, bytes, office files, generated documents, templates and their versions."""
    area, kind = K.classify_area(F.col("key")), K.file_kind(F.col("name"))
    objects = inventory.agg(
        F.count(F.lit(1)).alias("objects"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"),
        F.count_if(kind.isin("xlsx", "docx", "pptx")).alias("office_files"),
        F.count_if(area == "generated").alias("generated_documents"),
    )
    templates = catalog.agg(
        F.count(F.lit(1)).alias("templates"), F.coalesce(F.sum("version_count"), F.lit(0)).cast("bigint").alias("versions")
    )
    # both sides are ungrouped aggregates, exactly one row each
    counts = templates.select(F.struct("templates", "versions")).scalar()
    return objects.withColumn("__t", counts).select(*objects.columns, "__t.templates", "__t.versions")


def generated_per_stem(inventory: DataFrame) -> DataFrame:
    return (
        inventory.where(K.classify_area(F.col("key")) == "generated")
        .groupBy(K.usage_stem(F.col("name")).alias("stem"))
        .agg(F.count(F.lit(1)).alias("generated"))
        .where("stem <> ''")
    )


def _file_rows(inventory: DataFrame) -> DataFrame:
    return classified(inventory).select("name", "key", "size", "last_modified", "area", "kind")


def largest(inventory: DataFrame, n: int = 10) -> DataFrame:
    return _file_rows(inventory).orderBy(F.desc("size"), "key").limit(n)


def recent(inventory: DataFrame, n: int = 10) -> DataFrame:
    return _file_rows(inventory).orderBy(F.desc_nulls_last("last_modified"), "key").limit(n)


def daily_activity(inventory: DataFrame, today: str, days: int = 14) -> DataFrame:
    """Files per UTC day and bucket for the ``days`` up to ``today``, days without files included."""
    spark = inventory.sparkSession
    last = F.to_date(F.lit(today))
    spine = spark.range(days).select(F.date_sub(last, F.col("id").cast("int")).alias("day"))
    area = K.classify_area(F.col("key"))
    counted = (
        inventory.where(
            (F.col("last_modified") >= F.date_sub(last, days - 1).cast("timestamp"))
            & (F.col("last_modified") < F.date_add(last, 1).cast("timestamp"))
        )
        .groupBy(F.to_date("last_modified").alias("day"))
        .agg(
            F.count_if(area == "templates").alias("templates"),
            F.count_if(area == "generated").alias("generated"),
            F.count_if(~area.isin("templates", "generated")).alias("other"),
        )
    )
    zero = F.lit(0).cast("bigint")
    filled = spine.join(counted, "day", "left").select(
        F.col("day").cast("string").alias("day"),
        *[F.coalesce(F.col(c), zero).alias(c) for c in ("templates", "generated", "other")],
    )
    return filled.withColumn("count", F.expr("templates + generated + other")).orderBy("day")


def share_of_total(df: DataFrame, value: str) -> DataFrame:
    """Percent of the total and of the maximum; rows without a value are dropped.

    The two totals are one-row aggregates, so no window gathers all rows in one task.
    """
    kept = df.where(F.col(value) > 0)
    total = kept.agg(F.sum(value)).scalar()
    top = kept.agg(F.max(value)).scalar()
    return kept.withColumns(
        {
            "pct_total": F.round(F.col(value) * 100.0 / total, 6),
            "pct_max": F.round(F.col(value) * 100.0 / top, 6),
        }
    )
