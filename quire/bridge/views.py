"""Inventories, versions, notes, cells and facts derived from the star-schema tables.

Each view is a plain DataFrame over the given tables, so it grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from quire.sources.tables import table


def _dash(name: Column) -> Column:
    return F.translate(name, " ", "-")


def _under(name: Column) -> Column:
    return F.translate(name, " ", "_")


def _kind(name: Column) -> Column:
    rest = F.length(name) % 3
    return F.when(rest == 0, "word").when(rest == 1, "powerpoint").otherwise("excel")


def _ext(name: Column) -> Column:
    rest = F.length(name) % 3
    return F.when(rest == 0, "docx").when(rest == 1, "pptx").otherwise("xlsx")


def _version() -> Column:
    return F.concat((F.col("p_size") % 2 + 1).cast("string"), F.lit("."), F.col("p_partkey").cast("string"))


def _version_key() -> Column:
    name = F.col("p_name")
    return F.concat(
        F.lit("template/"), _kind(name), F.lit("/tmpl-"), _dash(name), F.lit("/v"), _version(), F.lit("/"),
        _under(name), F.lit("."), _ext(name),
    )


def _two(value: Column) -> Column:
    return F.lpad(value.cast("string"), 2, "0")


def _day(ts: str, sep: str) -> Column:
    return F.concat_ws(sep, F.year(ts).cast("string"), _two(F.month(ts)), _two(F.dayofmonth(ts)))


def dated_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Each part with the order that carries the same key, which gives it a date."""
    part = table(spark, folder, "part")
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    return part.join(orders, F.col("o_orderkey") == F.col("p_partkey"))


def ordered_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Each order with the part its key falls on."""
    part = table(spark, folder, "part")
    count = part.agg(F.count(F.lit(1)).alias("n")).scalar()
    orders = table(spark, folder, "orders").withColumn("__part", F.col("o_orderkey") % count)
    return orders.join(part, F.col("p_partkey") == F.col("__part")).drop("__part")


def generated_key() -> Column:
    return F.concat(
        F.lit("documents/generated/"), _day("o_orderdate", "/"), F.lit("/"), _under(F.col("p_name")), F.lit("_"),
        _day("o_orderdate", ""), F.lit("_"),
        F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0"), F.lit("."), _ext(F.col("p_name")),
    )


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """key, name, size, last_modified, etag, prefix_ord; some keys repeat across prefixes."""
    dated = dated_parts(spark, folder)
    name = F.col("p_name")

    def branch(df: DataFrame, number: int, key: Column, size: Column, modified: Column) -> DataFrame:
        return df.select(
            key.alias("key"), size.cast("bigint").alias("size"), modified.cast("timestamp").alias("last_modified"),
            F.lit(number).alias("prefix_ord"),
        )

    versioned = branch(
        dated.where("p_partkey % 10 <> 0"), 1, _version_key(), F.floor(F.col("p_retailprice") * 10), F.col("o_orderdate")
    )
    loose = branch(
        dated.where("p_partkey % 10 = 0"), 2, F.concat(F.lit("Template/"), _under(name), F.lit("."), _ext(name)),
        F.floor("p_retailprice"), F.col("o_orderdate"),
    )
    generated = branch(
        ordered_parts(spark, folder), 3, generated_key(), F.floor("o_totalprice"), F.col("o_orderdate")
    )
    previews = branch(
        table(spark, folder, "pages"), 4, F.concat(F.lit("documents/previews/"), F.col("page_id"), F.lit(".html")),
        F.length("html"), F.lit(None),
    )
    metadata = branch(
        table(spark, folder, "supplier"), 5, F.concat(F.lit("metadata/template/s"), F.col("s_suppkey"), F.lit(".json")),
        F.col("s_nationkey") + 512, F.lit(None),
    )
    knowledge = branch(
        table(spark, folder, "documents"), 6, F.concat(F.lit("KB/doc_"), F.col("doc_id"), F.lit(".txt")),
        F.col("n_chars"), F.lit(None),
    )
    rows = versioned
    for more in (loose, generated, previews, metadata, knowledge):
        rows = rows.unionByName(more)
    return rows.select(
        "key", F.element_at(F.split("key", "/"), -1).alias("name"), "size", "last_modified",
        F.substring(F.md5("key"), 1, 16).alias("etag"), "prefix_ord",
    )


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """One version per part: status and dates follow the part key."""
    key = F.col("p_partkey")
    return dated_parts(spark, folder).select(
        F.concat(F.lit("tmpl-"), _dash(F.col("p_name"))).alias("template_id"),
        _version().alias("version"),
        F.when(key % 3 == 0, "published").when(key % 3 == 1, "archived").when(key % 6 == 2, "draft").alias("status"),
        F.when(key % 7 == 0, "").otherwise(F.concat(F.lit("Update for "), F.col("p_brand"))).alias("changelog"),
        F.col("o_orderdate").alias("created_at"),
        F.when(key % 5 != 0, F.col("o_orderdate") + F.expr("interval 1 day")).alias("modified_at"),
        _version_key().alias("s3_key"),
        key.alias("part"),
    )


def metadata_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The copy kept with the metadata; every tenth version is known only here."""
    return versions(spark, folder).where("part % 10 = 0 or part % 3 = 1")


def template_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """One row per template name, every fifth left out."""
    first = F.col("first")
    return (
        table(spark, folder, "part")
        .groupBy("p_name")
        .agg(
            F.min("p_partkey").alias("first"),
            F.count(F.lit(1)).alias("parts"),
            F.min_by(_version(), F.struct(F.col("p_size") % 2, F.col("p_partkey"))).alias("lowest"),
        )
        .where("first % 5 <> 4")
        .select(
            F.concat(F.lit("tmpl-"), _dash(F.col("p_name"))).alias("id"),
            F.when(first % 3 != 0, F.initcap("p_name")).alias("name"),
            F.when(first % 2 == 0, F.concat(F.lit("About "), F.col("p_name"))).alias("description"),
            (F.col("parts") % 7).cast("bigint").alias("usage_count"),
            F.when(first % 4 == 0, F.col("lowest")).alias("active_version"),
            F.when(first % 2 == 1, F.split("p_name", " ")).otherwise(F.array().cast("array<string>")).alias("tags"),
            F.concat(F.lit("user"), (first % 9).cast("string")).alias("created_by"),
        )
    )


def object_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """User metadata of generated files: mixed-case names, blank owners, every ninth missing."""
    return (
        ordered_parts(spark, folder)
        .where("o_orderkey % 9 <> 0")
        .select(
            generated_key().alias("key"),
            F.create_map(
                F.lit("Template_Id"), F.concat(F.lit("tmpl-"), _dash(F.col("p_name"))),
                F.lit("GENERATED_BY"),
                F.when(F.col("o_orderkey") % 6 == 0, "").otherwise(
                    F.concat(F.lit("User"), (F.col("o_custkey") % 10).cast("string"))
                ),
                F.lit("template_name"), F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.col("p_name")),
            ).alias("metadata"),
        )
    )
