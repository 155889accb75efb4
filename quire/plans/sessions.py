"""Answers of a conversation in turn order, as joins and counts: a conversation of any length is many tasks.

A turn of notes fills the fields that it names, over what is there; any other answer, and a short note, fills the first
field that is still missing. Only the first time that a field is named changes which field a later answer fills, so a
conversation is the order of these first namings and the answers before, between and after them; of the answers in one
such stretch no more than the number of fields can matter. That is what is gathered per conversation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions import text as T

LONG_NOTE = 200


def step(answers: dict, required: Sequence[str], text: str, found: dict, is_notes: bool) -> None:
    """One user turn: notes fill what they name; a short answer fills the first field still missing."""
    if is_notes:
        answers.update({k: v for k, v in found.items() if k in required and v})
    missing = [f for f in required if not answers.get(f)]
    if missing and not (is_notes and len(text.strip()) > LONG_NOTE) and text.strip():
        answers[missing[0]] = text.strip()


def user_turns(turns: DataFrame, *keep: str) -> DataFrame:
    """Turns of users with what their notes name, read by built-in expressions; greetings are left out."""
    users = turns.where("role = 'user'").withColumn("__kind", T.turn_kind(F.col("text")))
    return users.where("__kind <> 'greeting'").select(
        "conv_id", "turn", "text", T.kv_map(F.col("text")).alias("found"), (F.col("__kind") == "notes").alias("is_notes"), *keep
    )


def _filled(required: Sequence[str]) -> Column:
    """Field by field the number of the answer (0: none) that fills it first, by a fold over the stretches of a conversation.

    ``stretches`` has, in order, the answers of a stretch (their numbers) and the fields named at its end. State: for each
    field 0 while it is missing, the number of the answer that filled it, or -1 once it is named.
    """
    names = F.array(*[F.lit(f) for f in required])
    start = F.array_repeat(F.lit(0).cast("long"), len(required))

    def answer(state: Column, number: Column) -> Column:
        first = F.array_position(state, F.lit(0).cast("long"))
        return F.when(first == 0, state).otherwise(F.transform(state, lambda s, i: F.when(i + 1 == first, number).otherwise(s)))

    def stretch(state: Column, s: Column) -> Column:
        after = F.aggregate(s["answers"], state, answer)
        return F.transform(after, lambda x, i: F.when((x == 0) & F.array_contains(s["named"], F.get(names, i)), F.lit(-1).cast("long")).otherwise(x))

    return F.aggregate("stretches", start, stretch)


def session_answers(turns: DataFrame, required: Sequence[str]) -> DataFrame:
    """Per conversation: turns, filled and missing required fields, clarifying or ready, and the answers.

    Turns stand by number (null first), those of one number by a hash of their text. A null text is no answer. A
    conversation without turns of its user has no row.
    """
    n = len(required)
    users = user_turns(turns)
    order = F.struct(F.coalesce("turn", F.lit(-(1 << 62)).cast("long")).alias("turn"), F.xxhash64("text").alias("mark"))
    bare = T.strip(F.coalesce("text", F.lit("")))
    read = users.select("conv_id", order.alias("o"), bare.alias("text"), "found", "is_notes").withColumn(
        "short", (F.col("text") != "") & ~(F.col("is_notes") & (F.length("text") > LONG_NOTE))
    )
    counts = read.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    said = read.where("is_notes").select("conv_id", "o", F.explode(F.map_filter("found", lambda k, v: k.isin(*required) & (v != ""))).alias("field", "value"))
    named = said.groupBy("conv_id", "field").agg(F.min("o").alias("first"), F.max_by("value", "o").alias("value"))
    # at most one row a required field
    marks = named.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("first", "field"))).alias("marks"), F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("told"))
    short = read.where("short").select("conv_id", "o", "text").join(marks.select("conv_id", "marks"), "conv_id", "left")
    # an answer belongs behind all namings at or before its turn
    empty = F.expr("cast(array() as array<struct<first:struct<turn:bigint,mark:bigint>,field:string>>)")
    part = F.size(F.filter(F.coalesce("marks", empty), lambda m: m["first"] <= F.col("o")))
    ranked = short.select("conv_id", part.alias("part"), "o", "text").withColumn(
        "k", F.row_number().over(W.partitionBy("conv_id", "part").orderBy("o"))
    ).where(F.col("k") <= n)
    parts = ranked.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "k", "text"))).alias("short"))
    whole = counts.join(marks, "conv_id", "left").join(parts, "conv_id", "left").select(
        "conv_id", "turns", F.coalesce("marks", empty).alias("marks"), "told", F.coalesce("short", F.expr("cast(array() as array<struct<part:int,k:int,text:string>>)")).alias("short")
    )
    numbered = F.transform("short", lambda s, i: F.struct(s["part"].alias("part"), (i + 1).cast("long").alias("number")))
    stretches = F.transform(
        F.sequence(F.lit(0), F.size("marks")),
        lambda p: F.struct(
            F.transform(F.filter(numbered, lambda a: a["part"] == p), lambda a: a["number"]).alias("answers"),
            F.array_compact(F.array(F.get("marks", p)["field"])).alias("named"),
        ),
    )
    folded = whole.withColumn("stretches", stretches).withColumn("state", _filled(required))
    answer = F.array(*[
        F.coalesce(F.col("told")[F.lit(f)], F.get("short", F.get("state", F.lit(i)).cast("int") - 1)["text"]) for i, f in enumerate(required)
    ])
    return closing(folded.withColumn("given", answer), required)


def closing(rows: DataFrame, required: Sequence[str]) -> DataFrame:
    """conv_id, turns, filled, missing, status and answers from ``given``, one value or null per required field."""
    names = [F.lit(f) for f in required]
    missing = F.array_compact(F.array(*[F.when(F.get("given", F.lit(i)).isNull(), name) for i, name in enumerate(names)]))
    pairs = F.filter(F.arrays_zip(F.array(*names).alias("field"), F.col("given").alias("value")), lambda p: p["value"].isNotNull())
    return rows.select(
        "conv_id", "turns", (F.lit(len(required)) - F.size(missing)).cast("bigint").alias("filled"), F.array_join(missing, ",").alias("missing"),
        F.when(F.size(missing) == 0, "ready").otherwise("clarifying").alias("status"), F.array_join(F.transform(pairs, lambda p: F.concat(p["field"], F.lit("="), p["value"])), "; ").alias("answers"),
    )
