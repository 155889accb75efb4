"""Confidence policy, geometric mean, format fit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# --- fixed values: decisions ----------------------------------------------------------------------
FILL, FILL_AUDIT, REVIEW = "fill", "fill_with_audit", "needs_review"
LOW_CONFIDENCE, NO_EVIDENCE, NOT_FOUND = "skipped_low_confidence", "skipped_no_evidence", "skipped_not_found"
PROTECTED, TYPE_MISMATCH, BLOCKED = "skipped_protected", "skipped_type_mismatch", "blocked_by_validation"
WRITABLE = (FILL, FILL_AUDIT)
# --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Policy:
    auto_fill: float = 0.95
    audit_fill: float = 0.85
    review: float = 0.70
    critical_bonus: float = 0.05
    fill_at_review: bool = False
    require_evidence: bool = True
    max_rows_per_table: int | None = None

    def bump(self, critical: Column) -> Column:
        return F.when(critical, F.lit(self.critical_bonus)).otherwise(F.lit(0.0))


def decide(confidence: Column, critical: Column, has_evidence: Column, policy: Policy = Policy()) -> Column:
    bump = policy.bump(critical)
    missing = ~has_evidence if policy.require_evidence else F.lit(False)
    return (
        F.when(missing, NO_EVIDENCE)
        .when(confidence >= F.least(F.lit(0.99), F.lit(policy.auto_fill) + bump), FILL)
        .when(confidence >= F.lit(policy.audit_fill) + bump, FILL_AUDIT)
        .when(confidence >= F.lit(policy.review) + bump, FILL_AUDIT if policy.fill_at_review else REVIEW)
        .otherwise(LOW_CONFIDENCE)
    )


def geo_mean(value: Column) -> Column:
    """Aggregate: geometric mean, values floored at 1e-6, nulls ignored, 0 for nothing."""
    floored = F.when(value.isNotNull(), F.greatest(F.lit(1e-6), value))
    return F.coalesce(F.exp(F.avg(F.ln(floored))), F.lit(0.0))


def geo_mean_of(*values: Column) -> Column:
    """The same over columns of one row."""
    logs = F.filter(F.array(*[F.ln(F.greatest(F.lit(1e-6), v)) for v in values]), lambda x: x.isNotNull())
    total = F.aggregate(logs, F.lit(0.0), lambda a, b: a + b)
    return F.when(F.size(logs) == 0, 0.0).otherwise(F.exp(total / F.size(logs)))


def format_compat(expected: Column, observed: Column) -> Column:
    e, o = F.coalesce(expected, F.lit("unknown")), F.coalesce(observed, F.lit("unknown"))
    money = (e.isin("currency", "number")) & (o.isin("currency", "number"))
    return (
        F.when((e == "unknown") | (o == "unknown"), 0.5).when(e == o, 1.0).when(money, 0.7).when(e == "text", 0.45)
        .otherwise(0.1)
    )


def decision_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def apply_overrides(plan: DataFrame, overrides: DataFrame, keys: tuple[str, ...] = ("job", "role")) -> DataFrame:
    """A human value replaces the planned one with full confidence; the gate still sees it."""
    given = overrides.select(*keys, F.col("value").alias("__new"), F.lit(True).alias("__hit"))
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    joined = plan.join(given, list(keys), "left")
    changed = {
        "value": F.when(hit, F.col("__new")).otherwise(F.col("value")),
        "confidence": F.when(hit, 1.0).otherwise(F.col("confidence")),
        "evidence": F.when(hit, "human override").otherwise(F.col("evidence")),
        "decision": F.when(hit, FILL).otherwise(F.col("decision")),
    }
    if "extractor" in plan.columns:
        changed["extractor"] = F.when(hit, "user").otherwise(F.col("extractor"))
    return joined.withColumns(changed).drop("__new", "__hit")
