"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source has a target in words. Its documents stand in a fixed pseudo-random order, repeated once per epoch, and the
words up to the target are cut into blocks of equal length; a document belongs to the block that its middle word falls
into, so a source takes its target up to half a document. The blocks are the balls of an urn with one colour a source:
a tree over the output shards splits the block quotas of a range of shards between its halves by multivariate
hypergeometric draws, which fixes for every shard exactly how many blocks of each source it gets. A shard then draws
disjoint blocks of a permutation of each source's blocks, and its rows are shuffled within it.

Only one row a source reaches the driver. Positions are running sums over parts of a few hundred documents, corrected by
sums of parts and of groups of parts; no source is ordered in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import stored, unit_hash

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SHARDS = 64
SEED = 17
#: Words of a block in large sources; small ones have this many blocks at least.
BLOCK_WORDS = 4096
LEAST_BLOCKS = 64
#: Documents of a part of the order, and parts of a group of parts.
PART = 200
GROUP = 256


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    docs: int
    target: float
    blocks: int


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = EPOCHS) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; what is above goes to the others by weight."""
    targets, open_, left = [0.0] * len(sizes), list(range(len(sizes))), total
    while open_:
        unit = left / sum(weights[k] for k in open_)
        full = [k for k in open_ if weights[k] * unit > most * sizes[k]]
        for k in full or open_:
            targets[k] = float(most * sizes[k] if full else weights[k] * unit)
            left -= targets[k]
        open_ = [k for k in open_ if k not in set(full)] if full else []
    return targets


def split_quotas(quotas: Sequence[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source for each shard: rows are shards, columns sources; columns add up to the quotas."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(low: int, high: int, here: np.ndarray) -> None:
        if high - low == 1:
            out[low] = here
            return
        middle = (low + high) // 2
        n = int(here.sum()) * (middle - low) // (high - low)
        draw = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(here, n, method="marginals") if here.sum() else here
        split(low, middle, draw)
        split(middle, high, here - draw)

    split(0, shards, np.asarray(quotas, np.int64))
    return out


def plan_sources(totals: Sequence[tuple[str | None, int, int]], weights: Sequence[float] = WEIGHTS, share: float = SHARE) -> list[Source]:
    """Targets and block counts of (source, words, documents) rows; sources by code point, null last."""
    rows = sorted(totals, key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [r[1] for r in rows]
    targets = water_fill(sizes, [weights[k % len(weights)] for k in range(len(rows))], share * sum(sizes))
    # the urn of numpy's draws holds fewer than 1e9 balls
    block = max(BLOCK_WORDS, math.ceil(sum(targets) / 5e8))
    return [Source(n, s, d, t, max(min(LEAST_BLOCKS, math.ceil(t)), round(t / block))) for (n, s, d), t in zip(rows, targets, strict=True)]


def _coprime(n: int, near: int) -> int:
    near = max(1, near % max(n, 1))
    while math.gcd(near, n) != 1:
        near += 1
    return near


def _running(frame: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``before``: the sum of ``value`` over the rows of the same source that come earlier."""
    def earlier(names: list[str], by: list[str], of: str) -> Column:
        return F.coalesce(F.sum(of).over(Window.partitionBy(*names).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))

    parts = stored(frame.groupBy(*keys, "grp", "part").agg(F.sum(value).alias("sum")), "parts")
    groups = parts.groupBy(*keys, "grp").agg(F.sum("sum").alias("sum")).withColumn("g_before", earlier(keys, ["grp"], "sum")).drop("sum")
    parts = parts.withColumn("p_before", earlier([*keys, "grp"], ["part"], "sum")).drop("sum").join(groups, [*keys, "grp"])
    rows = frame.withColumn("r_before", earlier([*keys, "grp", "part"], order, value)).join(parts, [*keys, "grp", "part"])
    return rows.withColumn("before", F.col("r_before") + F.col("p_before") + F.col("g_before")).drop("r_before", "p_before", "g_before")


def mix_plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE,
    shards: int = SHARDS, seed: int = SEED,
) -> DataFrame:
    """One row per distinct (id, source, text): ``id``, ``source``, ``text_key``, ``rows``, ``size``, ``source_size``,
    ``target`` and ``copies``, an array of (epoch, block, shard, at), empty if the mix doesn't take it.

    ``rows`` counts equal rows; a decision holds for each of them. Sizes are words; a null or empty text has none and is
    never taken. A null source is a source of its own, the last. An empty table gives no rows.
    """
    words = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    narrow = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_key"),
        words.alias("size"))
    units = stored(narrow.groupBy("id", "source", "text_key", "size").agg(F.count(F.lit(1)).alias("rows")), "units")
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("size"), F.sum("rows").alias("docs")).collect()
    sources = plan_sources([(r.source, r["size"], r.docs) for r in totals], weights, share)
    quotas = [s.blocks if s.target > 0 else 0 for s in sources]
    by_shard = split_quotas(quotas, shards, seed)
    spark, rows = docs.sparkSession, []
    for k, s in enumerate(sources):
        step, shift = _coprime(quotas[k], round(quotas[k] * 0.6180339887)), (seed * 7919 + k) % max(quotas[k], 1)
        rows.append((k, s.name, s.size, max(1, s.docs // PART), s.target, quotas[k], step, shift, np.cumsum(by_shard[:, k]).tolist()))
    table = spark.createDataFrame(rows, "src int, name string, source_size long, parts long, target double, blocks long, step long, shift long, ends array<long>")
    keyed = units.withColumn("u", unit_hash(F.lit(seed), "id", "text_key")).join(table, units["source"].eqNullSafe(table["name"]))
    keyed = keyed.withColumn("part", F.floor(F.col("u") * F.col("parts"))).withColumn("grp", F.expr(f"part div {GROUP}")).withColumn("all", F.col("size") * F.col("rows"))
    placed = _running(keyed, ["src"], ["u", "id", "text_key"], "all")

    def copy(epoch: int) -> Column:
        middle = F.lit(epoch) * F.col("source_size") + F.col("before") + F.col("all") / 2
        block = F.floor(middle * F.col("blocks") / F.col("target"))
        drawn = (block * F.col("step") + F.col("shift")) % F.col("blocks")
        shard = F.size(F.filter("ends", lambda end: end <= drawn))
        made = F.struct(F.lit(epoch).alias("epoch"), block.alias("block"), shard.alias("shard"), unit_hash(F.lit(seed + 1), F.lit(epoch), "id", "text_key").alias("at"))
        return F.when((F.col("size") > 0) & (F.col("target") > 0) & (block < F.col("blocks")), made)

    copies = F.array_compact(F.array(*[copy(e) for e in range(EPOCHS)]))
    return placed.select("id", "source", "text_key", "rows", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often as it is taken, in the order of the shards."""
    plan = mix_plan(docs, id_col, text_col, source_col, **options).where(F.size("copies") > 0)
    plan = plan.select(F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("text_key").alias("__key"), F.explode("copies").alias("__copy"))
    key = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    same = docs[id_col].cast("long").eqNullSafe(plan["__id"]) & docs[source_col].cast("string").eqNullSafe(plan["__source"]) & (key == plan["__key"])
    order = [plan["__copy"]["shard"], plan["__copy"]["at"]]
    return docs.join(plan, same).repartitionByRange(*order).sortWithinPartitions(*order).select(*[docs[c] for c in docs.columns])
