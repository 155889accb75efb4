"""Answers of a form: keys, duplicates, overlays, progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import keys as K, text as T
from quire.operators.ordered import best_per_group
from quire.profiles import Slot

# --- fixed values: fields that must stay short in a pitch ----------------------------------------
SHORT_FIELDS = (
    "team_name", "problem_statement_id", "theme", "demo_url", "process_name", "prepared_by", "doc_code", "area_path",
)
# ------------------------------------------------------------------------------------------------


def project_fields(slots: DataFrame) -> DataFrame:
    """Slots as public field records with their defaults, highest ask priority first."""
    return order_by_priority(slots.where("coalesce(id, '') <> ''")).select(
        "profile", "id",
        F.coalesce("label", "id").alias("label"),
        F.coalesce(F.nullif(F.col("question"), F.lit("")), F.nullif(F.col("help"), F.lit("")), F.col("id")).alias("question"),
        F.coalesce("required", F.lit(True)).alias("required"),
        F.coalesce("type", F.lit("string")).alias("field_type"),
        F.coalesce("help", F.lit("")).alias("help"),
        F.lit("spec").alias("source"),
        "pos",
    )


def order_by_priority(slots: DataFrame) -> DataFrame:
    return slots.orderBy("profile", F.desc(F.coalesce("ask_priority", F.lit(0))), "pos")


def answer_rows(df: DataFrame, keys: Sequence[str], answers: str = "answers") -> DataFrame:
    """One row per answer with its position."""
    return df.select(*keys, F.posexplode(F.map_entries(answers)).alias("ord", "e")).select(
        *keys, "ord", F.col("e.key").alias("key"), F.col("e.value").alias("value")
    )


def normalize_keys(rows: DataFrame, keys: Sequence[str], slots: list[Slot]) -> DataFrame:
    """Answer keys as slot ids: by id, by snake case of the key, by snake case of a label.

    Slots are a few fixed rows per profile, so the lookup is a literal map and needs no join. Several
    keys of one slot: the last one counts.
    """
    ids = {s.id: s.id for s in slots}
    labels = {_snake(s.label or s.id): s.id for s in slots}
    by_id = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
    by_label = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    key = F.col("key")
    slot = F.coalesce(by_id[key], by_id[K.snake(key)], by_label[K.snake(key)])
    usable = (F.coalesce(F.col("value"), F.lit("")) != "") & ~key.startswith("_")
    matched = rows.where(usable).withColumn("slot", slot).where("slot is not null")
    return best_per_group(matched.drop("key"), [*keys, "slot"], [F.col("ord")]).drop("ord")


def _snake(text: str) -> str:
    import re

    return re.sub(r"[^a-z0-9]+", "_", text.strip().lower()).strip("_")


def dedupe_answers(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One answer per snake id: labels with a blank first, then plain words, then snake case."""
    label = F.col("key")
    score = F.when(label.contains(" "), 2).when(label.contains("_"), 0).otherwise(1)
    shown = F.when(label.contains("_") & ~label.contains(" "), K.title_from_ident(label)).otherwise(label)
    ranked = rows.where("coalesce(value, '') <> ''").select(
        *keys, K.snake(label).alias("id"), shown.alias("label"), "value", score.alias("score"), "ord"
    ).where("id <> ''")
    return best_per_group(ranked, [*keys, "id"], [F.col("score"), -F.col("ord")]).drop("score", "ord")


def merge_context(
    base: DataFrame, overlay: DataFrame, keys: Sequence[str], short: Sequence[str] = SHORT_FIELDS
) -> DataFrame:
    """Overlay of (keys, field, value, items) rows: non-empty values win, lists only if as long.

    A short identity field keeps its text against one longer than max(40, twice its length).
    """
    left = base.select(*keys, "field", F.col("value").alias("b_value"), F.col("items").alias("b_items"))
    right = overlay.where(
        "not startswith(field, '_') and (coalesce(value, '') <> '' or size(coalesce(items, array())) > 0)"
    ).select(*keys, "field", F.col("value").alias("o_value"), F.col("items").alias("o_items"))
    both_lists = F.col("b_items").isNotNull() & F.col("o_items").isNotNull()
    guarded = (
        F.col("field").isin(*short) & (T.strip(F.coalesce("b_value", F.lit(""))) != "") & F.col("o_value").isNotNull()
        & (F.length("o_value") > F.greatest(F.lit(40), F.length("b_value") * 2))
    )
    has_overlay = F.col("o_value").isNotNull() | F.col("o_items").isNotNull()
    keep_base = ~has_overlay | guarded | (both_lists & (F.size("o_items") < F.size("b_items")))
    return left.join(right, [*keys, "field"], "full_outer").select(
        *keys, "field",
        F.when(keep_base, F.col("b_value")).otherwise(F.col("o_value")).alias("value"),
        F.when(keep_base, F.col("b_items")).otherwise(F.col("o_items")).alias("items"),
    )


def required_progress(sessions: DataFrame, answers: DataFrame, fields: DataFrame) -> DataFrame:
    """Per session: missing required fields, the next question, the number of it and the total.

    ``fields`` (profile, id, label, question, required, pos) is a small table; sessions name their
    profile. An answer counts under the id or the label of its field.
    """
    required = fields.where("required")
    given = answers.where("trim(coalesce(value, '')) <> ''")
    wanted = sessions.join(required, "profile")
    answered = (
        wanted.select("session_id", "id", F.explode(F.array("id", "label")).alias("key"))
        .join(given.select("session_id", "key"), ["session_id", "key"], "left_semi")
        .select("session_id", "id").distinct().withColumn("done", F.lit(True))
    )
    state = wanted.join(answered, ["session_id", "id"], "left")
    missing = F.col("done").isNull()
    return state.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(missing).alias("n_missing"),
        F.transform(
            F.sort_array(F.collect_list(F.when(missing, F.struct("pos", "label")))), lambda m: m["label"]
        ).alias("missing"),
        F.min_by("question", F.when(missing, F.col("pos"))).alias("next_question"),
    ).withColumn(
        "step", F.when(F.col("n_missing") > 0, F.col("total") - F.col("n_missing") + 1)
    )
