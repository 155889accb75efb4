"""Structured Streaming forms of activity, listings, sessions and audit.

Sinks are folders of one part per batch, written over when a batch is run again, so a restart neither loses nor doubles
rows. What a batch may know of earlier ones it reads from their parts only.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.functions import keys as K
from quire.plans.sessions import step, user_turns

Batch = Callable[[DataFrame, int], None]


def _parts(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """The rows of all batches, or of those before a number; none where nothing is written yet."""
    rows = spark.createDataFrame([], f"{schema}, batch long")
    try:
        rows = spark.read.schema(f"{schema}, batch long").parquet(path)
    except Exception as missing:  # the folder does not exist before the first batch
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    return rows if before is None else rows.where(F.col("batch") < before)


def _put(rows: DataFrame, path: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={number}")


# --- activity -----------------------------------------------------------------------------------------
_COUNTS = "day date, bucket string, late boolean, n long"


def bucket_of(key: Column) -> Column:
    area = K.classify_area(key)
    return F.when(area.isin("templates", "generated"), area).otherwise("other")


def activity_stream(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Files per day and bucket of a stream of (key, ts); rows later than the watermark are dropped."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day"), bucket_of(F.col("key")).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.to_date("window.start").alias("day"), "bucket", "n")
    )


def activity_sink(root: str, late: str = "1 day") -> Batch:
    """Counts per day and bucket, those of late rows apart, for ``foreachBatch`` over (key, ts).

    A row is late if it is older than the newest row of all earlier batches less the delay, which is what a watermark
    would drop without a trace. A batch adds a part of at most a few rows a day.
    """

    def put(batch: DataFrame, number: int) -> None:
        newest = _parts(batch.sparkSession, f"{root}/newest", "ts timestamp", number).agg(F.max("ts").cast("string")).first()[0]
        edge = F.lit(newest).cast("timestamp") - F.expr(f"interval {late}")
        marked = batch.withColumn("late", F.coalesce(F.col("ts") < edge, F.lit(False)))
        counts = marked.groupBy(F.to_date("ts").alias("day"), bucket_of(F.col("key")).alias("bucket"), "late").agg(F.count(F.lit(1)).alias("n"))
        _put(counts, f"{root}/counts", number)
        _put(batch.agg(F.max("ts").alias("ts")), f"{root}/newest", number)

    return put


def activity_days(spark: SparkSession, root: str, last: str, days: int = 14) -> DataFrame:
    """The last days up to ``last``, days without files included: day, templates, generated, other, count, late."""
    spine = spark.range(days).select(F.date_sub(F.to_date(F.lit(last)), F.col("id").cast("int")).alias("day"))
    counts = _parts(spark, f"{root}/counts", _COUNTS).join(spine, "day", "left_semi")
    names = ("templates", "generated", "other")
    each = [F.sum(F.when(~F.col("late") & (F.col("bucket") == b), F.col("n"))).alias(b) for b in names]
    daily = counts.groupBy("day").agg(*each, F.sum(F.when(~F.col("late"), F.col("n"))).alias("count"), F.sum(F.when(F.col("late"), F.col("n"))).alias("late"))
    return spine.join(daily, "day", "left").select("day", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in (*names, "count", "late")])


# --- listings -----------------------------------------------------------------------------------------
def latest_object_stream(listings: DataFrame, late: str = "1 day") -> DataFrame:
    """One row per (key, etag) of repeated listings."""
    return listings.withWatermark("last_modified", late).dropDuplicatesWithinWatermark(["key", "etag"])


def _latest(rows: DataFrame) -> DataFrame:
    newest = F.max(F.struct("last_modified", "etag")).alias("n")
    return rows.groupBy("key").agg(newest).select("key", "n.last_modified", "n.etag")


def latest_sink(root: str) -> Batch:
    """Upsert of listings (key, last_modified, etag) for ``foreachBatch``: a batch writes the keys that it changes, no others."""
    schema = "key string, last_modified timestamp, etag string"

    def put(batch: DataFrame, number: int) -> None:
        new = _latest(batch.select("key", "last_modified", "etag"))
        known = _latest(_parts(batch.sparkSession, f"{root}/latest", schema, number)).select("key", F.struct("last_modified", "etag").alias("__known"))
        changed = new.join(known, "key", "left").where(F.col("__known").isNull() | (F.struct("last_modified", "etag") > F.col("__known")))
        _put(changed.drop("__known"), f"{root}/latest", number)

    return put


def latest_objects(spark: SparkSession, root: str) -> DataFrame:
    """The latest listing of each key; ties go to the larger etag."""
    return _latest(_parts(spark, f"{root}/latest", "key string, last_modified timestamp, etag string"))


# --- audit --------------------------------------------------------------------------------------------
def audit_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Audit events per hour and action."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "action").agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("hour"), "action", "n")
    )


def audit_sink(root: str) -> Batch:
    """Appends audit events as they come, for ``foreachBatch``."""
    return lambda batch, number: _put(batch, f"{root}/audit", number)


def audit_events(spark: SparkSession, root: str, schema: str) -> DataFrame:
    return _parts(spark, f"{root}/audit", schema).drop("batch")


# --- sessions -----------------------------------------------------------------------------------------
_OUT = "conv_id bigint, turns bigint, given array<string>, closed boolean"
_STATE = "turns bigint, answers string, waiting string"


def session_stream(turns: DataFrame, required: Sequence[str], late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """Answers per conversation as turns (conv_id, turn, role, text, ts) arrive: conv_id, turns, given, closed.

    Turns may come out of order within the delay ``late``: those above the watermark wait in the state, those below are
    folded in order of (turn, text) and forgotten. Each batch sends the conversations that it touched, as if what
    waits were all. A conversation that has been idle for ``idle_ms`` of event time sends its last row, ``closed``, and
    leaves the state. Timers run on event time, so a replay of files ends.
    """
    watched = user_turns(turns.withWatermark("ts", late), "ts")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, packed, waiting = state.get if state.exists else (0, "{}", "[]")
        answers, rows = json.loads(packed), json.loads(waiting)
        if state.hasTimedOut:
            state.remove()
        else:
            for batch in batches:
                for row in batch.itertuples():
                    rows.append([int(row.turn), row.text or "", dict(row.found or {}), bool(row.is_notes), int(row.ts.timestamp() * 1000)])
                    seen += 1
            rows.sort(key=lambda r: (r[0], r[1]))
            edge = state.getCurrentWatermarkMs()
            # a turn is settled if it and all turns before it are older than anything that may still come
            settled = next((k for k, r in enumerate(rows) if r[4] >= edge), len(rows))
            for turn in rows[:settled]:
                step(answers, required, turn[1], turn[2], turn[3])
            rows = rows[settled:]
            state.update((seen, json.dumps(answers), json.dumps(rows)))
            newest = max((r[4] for r in rows), default=edge)
            state.setTimeoutTimestamp(max(newest, edge) + idle_ms)
        for turn in rows:
            step(answers, required, turn[1], turn[2], turn[3])
        yield pd.DataFrame([(key[0], seen, [answers.get(f) or None for f in required], state.hasTimedOut)], columns=["conv_id", "turns", "given", "closed"])

    return watched.groupBy("conv_id").applyInPandasWithState(run, _OUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
