"""Keyword search and rule-scored profile choice."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import keys as K
from quire.operators.ordered import best_per_group
from quire.profiles import PROFILES, Profile


def query_tokens(query: str) -> list[str]:
    return [t for t in re.split(r"[^\w.-]+", query.strip().lower()) if t]


def keyword_search(pool: DataFrame, query: str, n: int = 25) -> DataFrame:
    """8 points for the whole query, 3 per token, as substrings of key and name."""
    text = query.strip().lower()
    order = [F.lower("name"), F.col("key")]
    if not text:
        return pool.withColumn("score", F.lit(0)).orderBy(*order).limit(n)
    hay = F.lower(F.concat_ws(" ", F.col("key"), F.col("name")))
    score = F.when(hay.contains(text), 8).otherwise(0)
    for token in query_tokens(query):
        score = score + F.when(hay.contains(token), 3).otherwise(0)
    return pool.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), *order).limit(n)


def contains_search(df: DataFrame, columns: list[Column], query: str) -> DataFrame:
    """Rows whose columns, joined by a blank, contain the query; an empty query keeps all rows."""
    text = query.strip().lower()
    if not text:
        return df
    return df.where(F.lower(F.concat_ws(" ", *columns)).contains(text))


def _hay(*bits: Column) -> Column:
    joined = F.concat_ws(" ", *[F.coalesce(b, F.lit("")) for b in bits])
    return F.lower(F.trim(F.regexp_replace(joined, r"[\s._-]+", " ")))


def _with_hay(files: DataFrame, name: str, out: str) -> DataFrame:
    """Normal text and extension as columns of their own, so that scoring reads them once per file."""
    filename = F.coalesce(F.col("filename"), F.lit(""))
    given = F.when(filename == "", F.col(name)).otherwise(filename)
    return files.withColumns(
        {out: _hay(K.base_name(filename), F.col(name), F.col("id")), f"{out}_ext": K.extension(K.base_name(given))}
    )


def profile_score(profile: Profile, hay: Column, ext: Column) -> Column:
    """Points of one profile for a file, 0 when its extension does not fit."""
    sample = re.sub(r"[\s._-]+", " ", profile.sample_file.rsplit(".", 1)[0]).lower()
    score = (
        F.when(hay.contains(sample), 100).otherwise(0)
        + F.when(hay.contains("sample"), 25).otherwise(0)
        - F.when(hay.contains("template") & ~hay.contains("sample"), 8).otherwise(0)
    )
    for hint in profile.hints:
        score = score + F.when(hay.contains(hint), 20).otherwise(0)
    for token in profile.tokens:
        score = score + F.when(F.concat(F.lit(" "), hay, F.lit(" ")).contains(f" {token} "), 12).otherwise(0)
    fits = (hay != "") & ((ext == "") | ext.isin(*profile.extensions))
    return F.when(fits, score).otherwise(0)


def best_profile(files: DataFrame, profiles: list[Profile] = PROFILES) -> DataFrame:
    """Best profile per file (filename, name, id); at least 12 points, the first profile wins ties.

    The profiles are a handful of fixed rows, so each becomes one expression and no join is needed.
    """
    scored = [
        F.struct(
            profile_score(p, F.col("__hay"), F.col("__hay_ext")).alias("score"),
            F.lit(-i).alias("before"), F.lit(p.id).alias("profile_id"),
        )
        for i, p in enumerate(profiles)
    ]
    enough = F.col("__best.score") >= 12
    return (
        _with_hay(files, "name", "__hay")
        .withColumn("__best", F.array_max(F.array(*scored)))
        .withColumn("match_score", F.when(enough, F.col("__best.score")))
        .withColumn("profile_id", F.when(enough, F.col("__best.profile_id")))
        .drop("__best", "__hay", "__hay_ext")
    )


def annotate(files: DataFrame, profiles: list[Profile] = PROFILES) -> DataFrame:
    """Profile, its display name, and the score under that display name."""
    matched = best_profile(files, profiles)
    shown = F.create_map(*[F.lit(x) for p in profiles for x in (p.id, p.name)])
    place = F.create_map(*[F.lit(x) for i, p in enumerate(profiles) for x in (p.id, i)])
    named = _with_hay(
        matched.withColumns(
            {
                "shown_name": F.coalesce(shown[F.col("profile_id")], F.col("name")),
                "profile_ord": place[F.col("profile_id")],
            }
        ),
        "shown_name", "__hay",
    )
    rescored = F.lit(None).cast("int")
    for p in profiles:
        own = profile_score(p, F.col("__hay"), F.col("__hay_ext"))
        rescored = F.when(F.col("profile_id") == p.id, own).otherwise(rescored)
    return named.withColumn("profile_score", rescored).drop("__hay", "__hay_ext")


def best_file_per_profile(annotated: DataFrame) -> DataFrame:
    """Highest scoring file of each profile; the earliest file (``ord``) wins ties."""
    return best_per_group(
        annotated.where("profile_id is not null"), ["profile_id"], [F.col("profile_score"), -F.col("ord")]
    )


def guided_extras(annotated: DataFrame, chosen: DataFrame) -> DataFrame:
    """Files not chosen for a profile, under their own names."""
    return annotated.join(chosen.select("id"), "id", "left_anti").withColumn(
        "shown_name",
        F.coalesce(
            F.nullif(F.trim(F.regexp_replace(K.stem(F.col("filename")), r"[_-]+", " ")), F.lit("")),
            F.col("shown_name"),
        ),
    )


def profile_catalog(files: DataFrame, profiles: list[Profile] = PROFILES) -> DataFrame:
    """Guided templates in profile order, then the others by name."""
    annotated = annotate(files, profiles)
    chosen = best_file_per_profile(annotated)
    first = chosen.select("id", "shown_name", "profile_id", F.lit(True).alias("guided"),
                          F.col("profile_ord").alias("section"))
    rest = guided_extras(annotated, chosen).select(
        "id", "shown_name", "profile_id", F.lit(False).alias("guided"), F.lit(len(profiles)).alias("section")
    )
    return first.unionByName(rest).orderBy("section", F.lower("shown_name"), "id")
