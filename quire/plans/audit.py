"""Review queue, audit entries, job summaries, saved runs."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quire.operators.policy import BLOCKED, FILL_AUDIT, NO_EVIDENCE, NOT_FOUND, REVIEW, TYPE_MISMATCH

REVIEWED = (REVIEW, FILL_AUDIT, TYPE_MISMATCH, BLOCKED)


def target_text(kind: Column, sheet: Column, area: Column, index: Column, row: Column, col: Column, shape: Column) -> Column:
    """Address of a target: sheet!range, slide[i]/shape[id], table[i]!rRcC, table[i] or paragraph[i]."""
    text = lambda c: c.cast("string")
    cell = F.concat(F.lit("table["), text(index), F.lit("]!r"), text(row), F.lit("c"), text(col))
    return (
        F.when(kind == "sheet", F.concat(sheet, F.lit("!"), area))
        .when(kind == "slide", F.concat(F.lit("slide["), text(index), F.lit("]/shape["), text(shape), F.lit("]")))
        .when(kind == "table_cell", cell)
        .when(kind == "table", F.concat(F.lit("table["), text(index), F.lit("]")))
        .otherwise(F.concat(F.lit("paragraph["), text(index), F.lit("]")))
    )


def audit_join(plan: DataFrame, writes: DataFrame, spec: DataFrame | None = None) -> DataFrame:
    """Plan rows with the status of their write record and the decider of their spec entry."""
    done = writes.select("job", "node_id", F.col("status").alias("w_status"), "rows_written", F.col("target").alias("w_target"))
    joined = plan.join(done, ["job", "node_id"], "left")
    if spec is not None:
        joined = joined.join(spec.select("template_id", "role", "decided_by"), ["template_id", "role"], "left")
    else:
        joined = joined.withColumn("decided_by", F.lit("rules"))
    status = (
        F.when(F.col("w_status") == "written", "filled").when(F.col("w_status") == "skipped", "skipped_by_renderer")
        .when(F.col("w_status") == "failed", "render_failed").otherwise(F.coalesce("w_status", "decision"))
    )
    return joined.withColumns({"status": status, "decided_by": F.coalesce("decided_by", F.lit(""))}).drop("w_status")


def audit_entries(joined: DataFrame) -> DataFrame:
    """One entry per instruction: field, target, value or row count, status, confidence, evidence."""
    value = F.when(F.col("kind") == "table", F.concat(F.col("n_rows").cast("string"), F.lit(" row(s)"))).otherwise(F.col("value"))
    return joined.select(
        "job", F.col("role").alias("field"), F.coalesce("w_target", F.col("target")).alias("target"), value.alias("value"), "status",
        "confidence", "evidence", "decided_by",
    )


def audit_summary(joined: DataFrame) -> DataFrame:
    """Per job: planned, written, rows added, failed, review, no evidence, not found, blocked."""
    decision = F.col("decision")
    return joined.groupBy("job").agg(
        F.count(F.lit(1)).alias("planned"),
        F.count_if(F.col("status") == "filled").alias("written"),
        F.coalesce(F.sum("rows_written"), F.lit(0)).cast("bigint").alias("rows_added"),
        F.count_if(F.col("status") == "render_failed").alias("failed"),
        F.count_if(decision == REVIEW).alias("needs_review"),
        F.count_if(decision == NO_EVIDENCE).alias("no_evidence"),
        F.count_if(decision == NOT_FOUND).alias("not_found"),
        F.count_if(decision == BLOCKED).alias("blocked"),
    )


def review_queue(plan: DataFrame, unresolved: DataFrame) -> DataFrame:
    """What a person should look at, with the regions nobody could map."""
    planned = plan.where(F.col("decision").isin(*REVIEWED)).select("job", "role", "label", "value", "confidence", "decision", "evidence")
    regions = unresolved.select(
        "job", F.lit(None).cast("string").alias("role"), "label", F.lit(None).cast("string").alias("value"),
        F.lit(None).cast("double").alias("confidence"), F.lit("unmapped_region").alias("decision"), F.col("reason").alias("evidence"),
    )
    return planned.unionByName(regions)


def job_summary(summary: DataFrame, queue: DataFrame, reports: DataFrame) -> DataFrame:
    """One row per job from its audit summary, its review queue and its validation report."""
    waiting = queue.groupBy("job").agg(F.count(F.lit(1)).alias("review_items"))
    checked = reports.select("job", F.col("ok").alias("validation_ok"))
    zero = F.lit(0).cast("bigint")
    return summary.join(waiting, "job", "left").join(checked, "job", "left").select(
        "job", "planned", "written", "rows_added", F.coalesce("review_items", zero).alias("review_items"),
        F.coalesce("validation_ok", F.lit(True)).alias("validation_ok"),
        (F.coalesce("validation_ok", F.lit(True)) & (F.col("failed") == 0)).alias("ok"),
    )


def run_artifacts_sink(tables: dict[str, DataFrame], path: str, job: str = "job", jobs: DataFrame | None = None) -> None:
    """Store what a run made of its jobs: one folder per table below ``path``, and the run's jobs in ``runs``.

    The tables are written first, under a name of the run, the list of its jobs last. A job belongs to the last run that lists
    it, so a repeated job replaces all its rows in all tables, also where it has none any more, and a run that
    fails on the way changes nothing. ``jobs`` (one column) names the run's jobs where some may have no row at all.
    """
    root, run = path.rstrip("/"), uuid.uuid4().hex
    listed = None if jobs is None else jobs.select(F.col(job).alias("job"))
    for name, df in tables.items():
        df.write.parquet(f"{root}/{name}/run={run}")
        made = df.sparkSession.read.schema(df.schema).parquet(f"{root}/{name}/run={run}").select(F.col(job).alias("job"))
        listed = made if listed is None else listed.unionByName(made)
    spark = next(iter(tables.values())).sparkSession
    before = _runs(spark, root, listed.schema["job"].dataType.simpleString()).agg(F.max("number")).first()[0] or 0
    listed.distinct().withColumns({"run": F.lit(run), "number": F.lit(before + 1).cast("long")}).write.mode("append").parquet(f"{root}/runs")


def _runs(spark: SparkSession, root: str, kind: str) -> DataFrame:
    try:
        return spark.read.schema(f"job {kind}, run string, number long").parquet(f"{root}/runs")
    except AnalysisException as missing:  # no run has ended yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], f"job {kind}, run string, number long")


def run_artifacts(spark: SparkSession, path: str, name: str, schema: StructType, job: str = "job") -> DataFrame:
    """The rows of one table, each job's as its last run left them."""
    root = path.rstrip("/")
    last = _runs(spark, root, schema[job].dataType.simpleString()).groupBy(F.col("job").alias("__job")).agg(F.max_by("run", "number").alias("__run"))
    rows = spark.read.schema(StructType([*schema.fields, StructField("run", StringType())])).parquet(f"{root}/{name}")
    return rows.join(last, F.col(job).eqNullSafe(F.col("__job")) & (F.col("run") == F.col("__run")), "left_semi").drop("run")
