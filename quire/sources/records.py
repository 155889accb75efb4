"""JSON sidecars, object versions and output rows for stored objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.functions import keys as K
from quire.schemas import TEMPLATE_META

# --- fixed values: the keys a metadata sidecar may hold ------------------------------------------
META_KEYS = (
    "id",
    "name",
    "description",
    "placeholders",
    "context_questions",
    "content_outline",
    "field_config",
    "current_version",
    "active_version",
    "versions",
    "created_by",
    "tags",
    "usage_count",
)
# ------------------------------------------------------------------------------------------------


def metadata_read(spark: SparkSession, path: str) -> DataFrame:
    """One row per sidecar file; a file that is no JSON object gives a row of nulls."""
    text = spark.read.option("wholetext", "true").text(path).select("_metadata.file_path", "value")
    return metadata_parse(text, "value").drop("value")


def metadata_parse(df: DataFrame, column: str, schema: str = TEMPLATE_META) -> DataFrame:
    """Adds ``meta``: the parsed object, null fields where the text is bad or not an object."""
    text = F.trim(F.col(column))
    usable = text.startswith("{") & F.try_parse_json(text).isNotNull()
    return df.withColumn("meta", F.from_json(F.when(usable, text), schema, {"mode": "PERMISSIVE"}))


def metadata_name(template_id: Column) -> Column:
    """Template id as a file stem: runs of other characters become one dash."""
    safe = F.regexp_replace(F.regexp_replace(template_id, r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", "")
    return F.when(safe == "", "template").otherwise(safe)


def metadata_rows(df: DataFrame, user: str, now: str, prefix: str = "metadata/") -> DataFrame:
    """Rows to store: only known keys, with key and stamps added."""
    kept = [c for c in df.columns if c in META_KEYS]
    return df.select(
        F.concat(F.lit(prefix), metadata_name(F.col("id")), F.lit(".json")).alias("key"),
        *kept,
        F.lit(now).alias("updated_at"),
        F.lit(user).alias("updated_by"),
    )


def metadata_write(df: DataFrame, path: str, user: str, now: str) -> None:
    """Appends the rows as JSON, so earlier states stay readable."""
    metadata_rows(df, user, now).write.mode("append").json(path)


def generated_rows(df: DataFrame, made_at: Column, prefix: str = "documents/generated/") -> DataFrame:
    """Output key and object metadata of generated files; df has name, template_id, version, owner."""
    stem, ext = K.stem(F.col("name")), K.extension(F.col("name"))
    dot = F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext))
    out = F.concat(stem, F.lit("_"), F.date_format(made_at, "yyyyMMdd_HHmmss"), dot)
    return df.select(
        F.concat(F.lit(prefix), F.date_format(made_at, "yyyy/MM/dd/"), out).alias("key"),
        out.alias("document_name"),
        K.mime_of(out).alias("content_type"),
        F.coalesce(F.nullif(F.col("template_id"), F.lit("")), F.col("template_key")).alias("template_id"),
        F.coalesce(F.nullif(F.col("template_name"), F.lit("")), stem).alias("template_name"),
        F.coalesce("version", F.lit("")).alias("template_version"),
        F.coalesce("owner", F.lit("")).alias("generated_by"),
        F.year(made_at).alias("year"), F.month(made_at).alias("month"), F.dayofmonth(made_at).alias("day"),
    )


def generated_sink(rows: DataFrame, path: str) -> None:
    """Date folders, so a later listing of some days prunes to them."""
    rows.write.mode("append").partitionBy("year", "month", "day").parquet(path)


def pick_kb_source(inventory: DataFrame, marks: tuple[str, ...] = ("knowledge_base", "knowledge-base")) -> DataFrame:
    """The JSON file to read: names that look like a summary first, then the largest."""
    name = F.lower("name")
    preferred = F.lit(False)
    for mark in marks:
        preferred = preferred | name.contains(mark)
    return (
        inventory.where(name.endswith(".json"))
        .withColumn("preferred", preferred)
        .orderBy(F.desc("preferred"), F.desc("size"), "key")
        .limit(1)
    )


def ingest_guard(
    df: DataFrame, max_bytes: int = 12 * 1024 * 1024, text_chars: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(accepted with a preview of 4000 characters, rejected with the reason).

    Texts stay whole unless ``text_chars`` asks for a cut.
    """
    size = F.octet_length("text")
    reason = F.when(F.coalesce(size, F.lit(0)) == 0, "empty").when(size > max_bytes, "too large")
    tagged = df.withColumn("reason", reason)
    good = tagged.where("reason is null").drop("reason").withColumns(
        {
            "preview_text": F.substring("text", 1, 4000),
            "text": F.substring("text", 1, text_chars) if text_chars else F.col("text"),
        }
    )
    return good, tagged.where("reason is not null")
