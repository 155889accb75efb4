"""Checks of a plan against the live template; an error blocks the write, a warning notes it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import values as X
from quire.operators.policy import BLOCKED, WRITABLE, Policy

VIOLATION_COLUMNS = ("job", "node_id", "role", "check", "message", "severity")


def _violation(test: Column, check: str, message: Column | str, severity: str = "error") -> Column:
    text = message if isinstance(message, Column) else F.lit(message)
    return F.when(
        F.coalesce(test, F.lit(False)),
        F.struct(F.lit(check).alias("check"), text.alias("message"), F.lit(severity).alias("severity")),
    )


def _exploded(rows: DataFrame, *violations: Column) -> DataFrame:
    found = F.filter(F.array(*violations), lambda v: v.isNotNull())
    return rows.select("job", "node_id", "role", F.explode(found).alias("v")).select("job", "node_id", "role", "v.*")


def target_check(plan: DataFrame, nodes: DataFrame) -> DataFrame:
    """Field targets that are gone, protected, of the wrong kind, formulas, no anchors, or already filled.

    ``nodes``: template_id, node_id, node_type, editable, is_protected, has_formula, merged, is_anchor,
    is_empty, placeholder, text.
    """
    live = nodes.select(
        "template_id", "node_id", "node_type", "editable", "is_protected", "has_formula", "merged", "is_anchor", "is_empty",
        "placeholder", F.col("text").alias("node_text"), F.lit(True).alias("__live"),
    )
    rows = plan.where("kind = 'field'").join(live, ["template_id", "node_id"], "left")
    here = F.col("__live").isNotNull()
    fits = X.coerce(F.col("value"), F.col("value_format"))["ok"]
    return _exploded(
        rows,
        _violation(~here, "target_exists", "node is not in the template"),
        _violation(here & (F.col("is_protected") | ~F.col("editable")), "editable", "target is a protected region"),
        _violation(here & (F.col("node_type") != "value_region"), "region_type", F.concat(F.lit("target is a "), F.col("node_type"))),
        _violation(here & F.col("has_formula"), "no_formula_overwrite", "target holds a formula"),
        _violation(here & F.col("merged") & ~F.col("is_anchor"), "merge_anchor", "cell is not the anchor of its merged range"),
        _violation(here & ~fits, "type_fit", F.concat(F.lit("value does not fit format "), F.col("value_format"))),
        _violation(
            here & ~F.col("is_empty") & (F.coalesce("placeholder", F.lit("")) == ""), "overwrite",
            F.concat(F.lit("target already contains "), F.substring("node_text", 1, 40)), "warning",
        ),
    )


def header_drift(tables: DataFrame, live_columns: DataFrame) -> DataFrame:
    """Spec headers that the live table no longer has; both sides by (template_id, node_id, header)."""
    key = F.lower(F.trim("header"))
    spec = tables.select("template_id", "node_id", "role", F.explode("columns").alias("c")).select(
        "template_id", "node_id", "role", F.col("c.header").alias("header")
    ).withColumn("__h", key)
    live = live_columns.withColumn("__h", key).select("template_id", "node_id", "__h")
    return spec.join(live, ["template_id", "node_id", "__h"], "left_anti").select("template_id", "node_id", "role", "header")


def row_type_check(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """Planned cells in unknown columns, protected columns, or that do not fit the column.

    ``cells``: job, template_id, node_id, role, row, column, value; ``columns``: template_id, node_id,
    column, format, editable.
    """
    spec = columns.select("template_id", "node_id", "column", "format", "editable", F.lit(True).alias("__known"))
    rows = cells.join(spec, ["template_id", "node_id", "column"], "left")
    known = F.col("__known").isNotNull()
    at = F.concat(F.lit("row "), F.col("row").cast("string"), F.lit(": "))
    fits = X.coerce(F.col("value"), F.coalesce("format", F.lit("text")))["ok"]
    return _exploded(
        rows,
        _violation(~known, "unknown_column", F.concat(at, F.lit("no column for field "), F.col("column")), "warning"),
        _violation(known & ~F.coalesce("editable", F.lit(True)), "editable", F.concat(at, F.lit("column is protected: "), F.col("column"))),
        _violation(known & ~fits, "type_fit", F.concat(at, F.lit("value does not fit "), F.col("format")), "warning"),
    )


def floor_check(plan: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Evidence and the confidence floor, looked at again."""
    floor = F.lit(policy.review) + policy.bump(F.col("critical"))
    return _exploded(
        plan,
        _violation(F.lit(policy.require_evidence) & (F.coalesce("evidence", F.lit("")) == ""), "evidence", "no evidence for this value"),
        _violation(F.col("confidence") < floor, "confidence", "confidence below floor"),
    )


def table_check(plan: DataFrame, tables: DataFrame, live_tables: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Table targets: present, in the spec, with a sane number of rows."""
    live = live_tables.select("template_id", "node_id", F.lit(True).alias("__live")).distinct()
    spec = tables.select("template_id", "node_id", "fixed_rows", "existing_rows", F.lit(True).alias("__spec"))
    rows = plan.where("kind = 'table'").join(live, ["template_id", "node_id"], "left").join(spec, ["template_id", "node_id"], "left")
    here, known = F.col("__live").isNotNull(), F.col("__spec").isNotNull()
    room = F.greatest(F.lit(1), F.coalesce("existing_rows", F.lit(0)))
    most = policy.max_rows_per_table
    return _exploded(
        rows,
        _violation(~here, "target_exists", "table is not in the template"),
        _violation(here & ~known, "spec_present", "table has no spec entry"),
        _violation(here & known & (F.col("n_rows") == 0), "row_count", "no rows to write", "warning"),
        _violation(F.lit(most is not None) & here & known & (F.col("n_rows") > F.lit(most or 0)), "row_count", "too many rows"),
        _violation(here & known & F.col("fixed_rows") & (F.col("n_rows") > room), "fixed_rows", "table cannot grow safely", "warning"),
    )


def validate_plan(plan: DataFrame, violations: list[DataFrame], policy: Policy = Policy()) -> tuple[DataFrame, DataFrame]:
    """(plan with errors turned into blocks, all violations of its writable rows)."""
    writable = plan.where(F.col("decision").isin(*WRITABLE))
    every = reduce(DataFrame.unionByName, [v.select(*VIOLATION_COLUMNS) for v in [*violations, floor_check(writable, policy)]])
    mine = every.join(writable.select("job", "node_id"), ["job", "node_id"], "left_semi")
    blocked = mine.where("severity = 'error'").select("job", "node_id", F.lit(True).alias("__blocked")).distinct()
    checked = plan.join(blocked, ["job", "node_id"], "left").withColumn(
        "decision", F.when(F.col("__blocked") & F.col("decision").isin(*WRITABLE), BLOCKED).otherwise(F.col("decision"))
    ).drop("__blocked")
    return checked, mine


def report(violations: DataFrame, key: str = "job") -> DataFrame:
    """ok, errors, warnings and blocked nodes per job; a job is ok without a single error."""
    error = F.col("severity") == "error"
    return violations.groupBy(key).agg(
        F.bool_and(~error).alias("ok"), F.count_if(error).alias("errors"), F.count_if(~error).alias("warnings"),
        F.count_distinct(F.when(error, F.col("node_id"))).alias("blocked"),
    )
