"""Ordered operations that never sort one whole group in a single task.

A window over (document order by line) puts every line of a document on one task. Where one
document can hold a third of all lines that task decides the run time. The helpers here cut each
group into parts along a coarse prefix of its order, work inside the parts, and correct each part
by what the earlier parts add up to. The summary that crosses parts has one row per (group, part).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

PART_ROWS = 20_000


def part_of(order: str, rows: int = PART_ROWS) -> Column:
    """Part number of an integer position."""
    return F.floor(F.col(order) / F.lit(rows))


def part_rank(
    df: DataFrame,
    keys: Sequence[str],
    coarse: Column,
    order: Sequence[Column],
    out: str = "pos",
    descending: bool = False,
    *,
    nulls: bool = True,
) -> DataFrame:
    """Exact row number per group. ``coarse`` must be a leading prefix of ``order``; ``nulls``: a key may be null."""
    tagged = df.withColumn("__part", coarse)
    local = W.partitionBy(*keys, "__part").orderBy(*order)
    across = W.partitionBy(*keys).orderBy(F.desc("__part") if descending else F.asc("__part"))
    sizes = (
        tagged.groupBy(*keys, "__part")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn(
            "__before",
            F.coalesce(F.sum("__n").over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        )
        .drop("__n")
    )
    ranked = tagged.withColumn("__local", F.row_number().over(local))
    return (
        _join_parts(ranked, sizes, keys, nulls)
        .withColumn(out, (F.col("__local") + F.col("__before")).cast("bigint"))
        .drop("__part", "__local", "__before")
    )


def carry_forward(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, rows: int = PART_ROWS
) -> DataFrame:
    """Latest non-null ``value`` at or before each row, by integer ``order``.

    What the earlier parts leave to a part enters it as one row before its first, so nothing is joined: rows that already
    stand by group are not moved again.
    """
    tagged = df.withColumn("__part", part_of(order, rows)).withColumn("__value", value).withColumn("__own", F.lit(True))
    local = W.partitionBy(*keys, "__part").orderBy("__own", order).rowsBetween(W.unboundedPreceding, 0)
    across = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    last = (
        tagged.groupBy(*keys, "__part")
        .agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col(order))).alias("__last"))
        .withColumn("__carried", F.last("__last", ignorenulls=True).over(across))
        .where("__carried is not null")
    )
    given = {"__part": F.col("__part"), "__value": F.col("__carried"), "__own": F.lit(False)} | {k: F.col(k) for k in keys}
    entering = last.select(*[given.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in tagged.schema.fields])
    seen = tagged.unionByName(entering).withColumn(out, F.last("__value", ignorenulls=True).over(local))
    return seen.where("__own").drop("__part", "__value", "__own")


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, amount: Column, out: str, rows: int = PART_ROWS, *, nulls: bool = True
) -> DataFrame:
    """Sum of ``amount`` over all rows of the group up to and including this one; ``nulls``: a key may be null."""
    tagged = df.withColumn("__part", part_of(order, rows)).withColumn("__amount", amount)
    local = W.partitionBy(*keys, "__part").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    across = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        tagged.groupBy(*keys, "__part")
        .agg(F.sum("__amount").alias("__total"))
        .withColumn("__before", F.coalesce(F.sum("__total").over(across), F.lit(0)))
        .drop("__total")
    )
    if not nulls:
        summed = tagged.withColumn("__sum", F.sum("__amount").over(local))
        return (
            _join_parts(summed, totals, keys, nulls)
            .withColumn(out, F.col("__sum") + F.col("__before"))
            .drop("__part", "__amount", "__sum", "__before")
        )
    # a join that lets nulls meet would move all rows: what the earlier parts add up to enters a part as one row before its first
    own = tagged.withColumn("__own", F.lit(True))
    seen = own.unionByName(totals.where("__before <> 0").withColumn("__own", F.lit(False)), allowMissingColumns=True)
    local = W.partitionBy(*keys, "__part").orderBy("__own", order).rowsBetween(W.unboundedPreceding, 0)
    return (
        seen.withColumns({"__sum": F.sum("__amount").over(local), "__entered": F.max("__before").over(local)}).where("__own")
        .withColumn(out, F.col("__sum") + F.coalesce("__entered", F.lit(0)))
        .drop("__part", "__amount", "__own", "__before", "__sum", "__entered")
    )


def running_max(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, rows: int = PART_ROWS
) -> DataFrame:
    """Largest ``value`` over the rows of the group before this one, null at the first."""
    tagged = df.withColumn("__part", part_of(order, rows)).withColumn("__value", value)
    local = W.partitionBy(*keys, "__part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    tops = (
        tagged.groupBy(*keys, "__part")
        .agg(F.max("__value").alias("__top"))
        .withColumn("__before", F.max("__top").over(across))
        .drop("__top")
    )
    seen = tagged.withColumn("__seen", F.max("__value").over(local))
    return (
        _join_parts(seen, tops, keys)
        .withColumn(out, F.greatest("__seen", "__before"))
        .drop("__part", "__value", "__seen", "__before")
    )


def neighbour(
    df: DataFrame, keys: Sequence[str], order: str, columns: dict[str, str], step: int, rows: int = PART_ROWS
) -> DataFrame:
    """Columns of the row ``step`` positions away, for dense integer positions; a row of its own for each if there are more.

    A window over parts of the order: a row that is asked for from another part stands in that one too, so no group is
    sorted as a whole, and rows that stand by group are not moved.
    """
    mine, asking = part_of(order, rows), F.floor((F.col(order) - F.lit(step)) / F.lit(rows))
    stands = F.when(mine == asking, F.array(mine)).when(F.col(order).isNotNull(), F.array(mine, asking)).otherwise(F.array(mine))
    placed = df.withColumn("__part", F.explode(stands)).withColumn("__own", F.col("__part").eqNullSafe(mine))
    there = W.partitionBy(*keys, "__part").orderBy(order).rangeBetween(step, step)
    # a null place meets no other
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in (*keys, order)])
    met = F.when(known, F.collect_list(F.struct(*[F.col(c).alias(o) for c, o in columns.items()])).over(there))
    return placed.withColumn("__met", met).where("__own").select(*df.columns, F.explode_outer("__met").alias("__met")).select(*df.columns, "__met.*")


def best_per_group(df: DataFrame, keys: Sequence[str], rank: Sequence[Column]) -> DataFrame:
    """The row with the greatest ``rank`` per group.

    An aggregate, not a window: each map task sends one candidate per group it holds.
    """
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)])).alias("__row"))
        .select(*keys, *[F.col("__row")[c].alias(c) for c in rest])
        .select(*df.columns)
    )


def _join_parts(df: DataFrame, parts: DataFrame, keys: Sequence[str], nulls: bool = True) -> DataFrame:
    if not nulls:  # the rows stand by these columns already, which a test that lets nulls meet does not make use of
        return df.join(parts, [*keys, "__part"], "left")
    on = None
    right = parts.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__part").alias("__k_part"),
                         *[c for c in parts.columns if c not in (*keys, "__part")])
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        on = test if on is None else on & test
    on = on & F.col("__part").eqNullSafe(F.col("__k_part"))
    return df.join(right, on, "left").drop(*[f"__k_{k}" for k in keys], "__k_part")
