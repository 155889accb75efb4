"""Mail merge: template cells filled with the answers of each document, and the generated file that results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import keys as K, text as T
from quire.sources.tables import spread


def answer_of(answers: Column, label: Column) -> Column:
    """The non-empty answer whose key, in snake case, is the label; the last of several. Null if there is none."""
    own = F.filter(F.map_entries(answers), lambda e: (F.coalesce(e["value"], F.lit("")) != "") & ((K.snake(e["key"]) == label) | (e["key"] == label)))
    return F.when(label != "", F.get(F.reverse(own), F.lit(0))["value"])


def merged_cells(cells: DataFrame, documents: DataFrame) -> DataFrame:
    """Cells (doc, sheet, r, c, text, filled) of every document (doc, template_id, answers) from its template's (template_id,
    sheet, r, c, text).

    Placeholders of six forms are replaced; a blank, a dash or a bracketed cell right of a label that names an answer
    takes the answer. ``filled`` is ``placeholder``, ``neighbour`` or null. A value put in is no label itself.
    """
    spelled = spread(documents.select("doc", "template_id", "answers"), "doc").withColumn("spelled", T.spellings(F.col("answers")))
    both = spelled.join(cells, "template_id")
    own = T.fill_spelled(F.coalesce("text", F.lit("")), F.col("spelled"))
    staged = both.select("doc", "sheet", "r", "c", F.coalesce("text", F.lit("")).alias("before"), own.alias("own"), "answers", "spelled")
    label = K.snake(F.regexp_replace(T.strip(F.col("own")), r":+$", ""))
    left = staged.select("doc", "sheet", "r", (F.col("c") + 1).alias("c"), answer_of(F.col("answers"), label).alias("value")).where("value is not null")
    bare = T.strip(F.col("before"))
    place = bare.isin("", "-", "—") | bare.startswith("[")
    joined = staged.join(left, ["doc", "sheet", "r", "c"], "left").withColumn("taken", F.when(place, F.col("value")))
    return joined.select(
        "doc", "sheet", "r", "c", F.coalesce(T.fill_spelled(F.col("taken"), F.col("spelled")), "own").alias("text"),
        F.when(F.col("taken").isNotNull(), "neighbour").when(F.col("own") != F.col("before"), "placeholder").alias("filled"),
    )


def generated_files(documents: DataFrame, prefix: str) -> DataFrame:
    """One row per document (doc, key, at, generated_by, template_id, template_name, template_version): name and key of its file.

    The name carries the second of its making, the key the day; blanks in the metadata fall back to the template's own.
    """
    file = F.element_at(F.split("key", "/"), -1)
    stem, ext = F.regexp_replace(file, r"\.[^.]*$", ""), F.regexp_extract(file, r"(\.[^.]*)$", 1)
    name = F.concat(stem, F.lit("_"), F.date_format("at", "yyyyMMdd_HHmmss"), F.lower(ext))
    either = lambda column, other: F.coalesce(F.nullif(F.col(column), F.lit("")), other)
    return documents.select(
        "doc", name.alias("name"), F.concat(F.lit(prefix), F.date_format("at", "yyyy/MM/dd"), F.lit("/"), name).alias("s3_key"),
        either("template_id", F.col("key")).alias("template_id"), either("template_name", stem).alias("template_name"), F.coalesce("template_version", F.lit("")).alias("template_version"),
        F.coalesce("generated_by", F.lit("")).alias("generated_by"),
    )
