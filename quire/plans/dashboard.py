"""The inventory dashboard as a set of DataFrames over one merged listing."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from quire.operators import catalog as C, inventory as I


def inventory_snapshot(
    listing: DataFrame, meta: DataFrame, meta_versions: DataFrame, today: str, days: int = 14, n: int = 10
) -> dict[str, DataFrame]:
    """totals, by_area, by_kind, most_used, largest, recent, activity.

    The merged listing is marked for caching because every part reads it; the mark runs nothing by
    itself and a lost executor only means that its blocks are computed again.
    """
    merged = I.merge_listings(listing).persist(StorageLevel.MEMORY_AND_DISK)
    catalog = C.template_catalog(merged, meta, meta_versions)
    versions = C.catalog_versions(merged, meta, meta_versions)
    return {
        "totals": I.inventory_totals(merged, catalog),
        "by_area": I.storage_by_area(merged),
        "by_kind": I.storage_by_kind(merged),
        "most_used": C.most_used(merged, catalog, versions, n),
        "largest": I.largest(merged, n),
        "recent": I.recent(merged, n),
        "activity": I.daily_activity(merged, today, days),
    }


def long_form(parts: dict[str, DataFrame]) -> DataFrame:
    """All parts as rows of (section, id, label, count, bytes)."""
    null_text, null_long = F.lit(None).cast("string"), F.lit(None).cast("bigint")

    def rows(section: str, df: DataFrame, ident: Column, label: Column, count: Column, size: Column) -> DataFrame:
        return df.select(
            F.lit(section).alias("section"), ident.alias("id"), label.alias("label"),
            count.cast("bigint").alias("count"), size.cast("bigint").alias("bytes"),
        )

    totals = parts["totals"]
    spread = totals.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("bigint").alias("v")) for c in totals.columns])).alias("t")
    )
    c = F.col
    pieces = [
        rows("totals", spread, c("t.k"), null_text, c("t.v"), null_long),
        rows("by_area", parts["by_area"], c("id"), c("label"), c("count"), c("bytes")),
        rows("by_kind", parts["by_kind"], c("id"), c("label"), c("count"), c("bytes")),
        rows("most_used", parts["most_used"], c("id"), c("name"), c("score"), c("storage_bytes")),
        rows("largest", parts["largest"], c("key"), c("name"), null_long, c("size")),
        rows("recent", parts["recent"], c("key"), c("name"), null_long, c("size")),
        rows("activity", parts["activity"], c("day"), null_text, c("count"), null_long),
    ]
    return reduce(DataFrame.unionByName, pieces)
