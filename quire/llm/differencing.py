"""Shards of near equal bytes by Karmarkar-Karp differencing over indivisible groups of equal texts.

A group is all rows with one text; it stays in one shard. Groups are weighed by an aggregate, so a group of any number
of copies is one row. A group of at least one ``UNITS``-th of all bytes is an item of its own: there are at most
``UNITS`` of them. All smaller groups are dealt by a hash of their text to ``BUNDLES`` bundles, which are the other items.
Differencing starts with one partial partition per item, its weight in one shard and nothing in the others, and keeps
combining the two with the largest spread, the fullest shard of one with the emptiest of the other, until one is left.
Its input has at most ``UNITS + BUNDLES`` rows at every size of the table, and so has the result that rows are joined
with. Slots are running counts over parts of the rows of a shard, corrected by sums of parts.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored
from quire.llm.mixing import _running

SHARDS = 8
#: A group of one in so many bytes is an item by itself.
UNITS = 8192
BUNDLES = 8192
#: Distinct rows of a part of a shard, and parts of a group of parts, for the slots.
PART = 20_000
GROUP = 256
#: Slots that one row holds while repeated rows are spelled out.
RUN = 1 << 16


def difference(sizes: Sequence[int], shards: int = SHARDS) -> list[int]:
    """The shard of each item. Equal spreads are combined in the order of the items, so reruns agree."""
    if not sizes:
        return []
    # a partial partition: shard weights, heaviest first, each with its items
    heap = [(-size, k, [(size, [k])] + [(0, []) for _ in range(shards - 1)]) for k, size in enumerate(sizes)]
    heapq.heapify(heap)
    number = len(heap)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = []
        for (x, some), (y, more) in zip(a, reversed(b), strict=True):
            if len(some) < len(more):
                some, more = more, some
            some.extend(more)
            both.append((x + y, some))
        both.sort(key=lambda pair: -pair[0])
        heapq.heappush(heap, (both[-1][0] - both[0][0], number, both))
        number += 1
    out = [0] * len(sizes)
    for shard, (_, items) in enumerate(heap[0][2]):
        for k in items:
            out[k] = shard
    return out


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _bundle(bundles: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(bundles)).cast("int").alias("bundle")


def shard_items(weighed: DataFrame, total: int, shards: int, units: int = UNITS, bundles: int = BUNDLES) -> DataFrame:
    """``bundle``, ``digest`` (null for a bundle of small groups), ``bytes`` and ``shard`` of each item.

    ``weighed`` has one row per group: ``digest`` and ``bytes``.
    """
    large = F.col("bytes") * F.lit(units) >= F.lit(total)
    items = weighed.select(_bundle(bundles), F.when(large, F.col("digest")).alias("digest"), "bytes").groupBy("bundle", "digest").agg(F.sum("bytes").alias("bytes"))

    def solve(table: pd.DataFrame) -> pd.DataFrame:
        table = table.assign(name=[b"" if d is None else bytes(d) for d in table["digest"]])
        table = table.sort_values(["bytes", "bundle", "name"], ascending=[False, True, True], ignore_index=True)
        table["shard"] = difference(table["bytes"].tolist(), shards)
        return table[["bundle", "digest", "bytes", "shard"]]

    # one group by design: at most units + bundles rows
    return items.groupBy().applyInPandas(solve, "bundle int, digest binary, bytes long, shard int")


def _placed(rows: DataFrame, items: DataFrame, bundles: int) -> DataFrame:
    """``rows`` (with ``digest``) and their ``shard``; the tables of items have at most ``UNITS + BUNDLES`` rows."""
    alone = items.where(F.col("digest").isNotNull()).select(F.col("digest").alias("__digest"), F.col("shard").alias("__alone"))
    shared = items.where(F.col("digest").isNull()).select(F.col("bundle").alias("__bundle"), F.col("shard").alias("__shared"))
    rows = rows.join(F.broadcast(alone), F.col("digest") == F.col("__digest"), "left").join(F.broadcast(shared), _bundle(bundles) == F.col("__bundle"), "left")
    return rows.withColumn("shard", F.coalesce("__alone", "__shared")).drop("__digest", "__alone", "__bundle", "__shared")


def _units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = _text(text_col)
    narrow = docs.select(
        F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), (F.octet_length(text) + F.lit(1).cast("long")).alias("size"),
        F.crc32(text).alias("crc"))
    return stored(narrow.groupBy("id", "digest", "size", "crc").agg(F.count(F.lit(1)).alias("rows")), "units")


def _items(units: DataFrame, shards: int, bundles: int) -> DataFrame:
    total = units.agg(F.sum(F.col("size") * F.col("rows"))).first()[0] or 0
    weighed = units.groupBy("digest").agg(F.sum(F.col("size") * F.col("rows")).alias("bytes"))
    return stored(shard_items(weighed, total, shards, UNITS, bundles), "items")


def shard_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, bundles: int = BUNDLES) -> DataFrame:
    """One row per row: ``id``, ``size`` (bytes and one), ``text_crc32``, ``shard``, ``slot`` (0, 1, 2, ... in each shard).

    Rows of equal texts share a shard; null and empty texts are one group, of size 1 a row. Equal rows get slots side by
    side. A group above one shard's part of the bytes fills a shard alone, and the other shards stay equal. Null ids are
    allowed; other columns stay outside; an empty table gives no rows. Very long texts are one hash and one number each.
    """
    units = _units(docs, id_col, text_col)
    placed = _placed(units, _items(units, shards, bundles), bundles)
    parts = max(1, units.count() // (shards * PART))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id", "digest"), F.lit(parts))).withColumn("grp", F.expr(f"part div {GROUP}"))
    counted = _running(placed, ["shard"], ["id", "digest"], "rows")
    # runs first, then slots: an array never holds more than the runs of one row or the slots of one run
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(RUN).cast("long"))))
    slots = runs.withColumn("slot", F.explode(F.sequence(F.col("before") + F.col("run"), F.col("before") + F.least(F.col("run") + RUN, F.col("rows")) - 1)))
    return slots.select("id", "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def with_shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, bundles: int = BUNDLES, out: str = "shard") -> DataFrame:
    """The rows of ``docs`` with all their columns and their shard in ``out``, for writing; texts are not shuffled."""
    items = _items(_units(docs, id_col, text_col), shards, bundles)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.unhex(F.sha2(_text(text_col), 256)).alias("digest"))
    return _placed(whole, items, bundles).select("__row.*", F.col("shard").alias(out))
