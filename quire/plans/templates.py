"""What a template asks for: the fields of its texts and grids, its questions, its outline, a preview.

Every finder gives rows (template_id, place, id, label, source); the first place of an id wins by an aggregate, so a
template of any length is many tasks until its distinct fields meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions import keys as K, text as T
from quire.sources.staged import staged

# --- fixed values: lengths and the field of a template that names none ------------------------------
HEADER_CHARS, LABEL_CHARS, OUTLINE, PREVIEW, SUMMARY = 40, 48, 8, 4000, 240
FALLBACK = ("document_title", "Document title", "What is the title of this document?")
# --------------------------------------------------------------------------------------------------
_PLACE = "struct<part:int,a:bigint,b:bigint,c:bigint,k:int>"


def _place(part: int, a: Column, b: Column, c: Column, k: Column) -> Column:
    return F.struct(F.lit(part).alias("part"), a.cast("bigint").alias("a"), b.cast("bigint").alias("b"), c.cast("bigint").alias("c"), k.cast("int").alias("k")).alias("place")


def _usable(fields: DataFrame) -> DataFrame:
    return fields.where((F.col("id") != "") & ~F.col("id").isin(*T.SKIP_FIELDS))


def text_fields(paragraphs: DataFrame) -> DataFrame:
    """Tokens, placeholders and drawn lines of paragraphs (template_id, pos, text)."""
    found = T.unfolded(paragraphs, ["template_id", "pos"], T.field_candidates(F.col("text")), "f", "k")
    zero = F.lit(0)
    return found.select("template_id", _place(0, F.col("pos"), zero, zero, F.col("k")), "f.id", "f.label", "f.source")


def grid_fields(cells: DataFrame) -> DataFrame:
    """Header labels, tokens and labels next to a blank of sheets (template_id, sheet, r, c, text).

    A sheet's first row is its header if two or more of its cells are written and none is long; any other cell is
    read for tokens, and is a label itself if the cell right of it is blank or a place to write on.
    """
    sheets = cells.groupBy("template_id", "sheet").agg(F.min("r").alias("top"))
    bare = cells.select("template_id", "sheet", "r", "c", T.strip(F.coalesce("text", F.lit(""))).alias("text")).join(sheets, ["template_id", "sheet"])
    first = bare.where("r = top and text <> ''").groupBy("template_id", "sheet").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("long"))
    heads = first.where((F.col("n") >= 2) & (F.col("long") <= HEADER_CHARS)).select("template_id", "sheet", F.lit(True).alias("headed"))
    marked = bare.join(heads, ["template_id", "sheet"], "left").withColumn("is_head", (F.col("r") == F.col("top")) & F.coalesce("headed", F.lit(False)))
    # sheets stand by name
    order = marked.select("template_id", "sheet").distinct().withColumn("no", F.row_number().over(W.partitionBy("template_id").orderBy("sheet")))
    rows = staged(marked.join(order, ["template_id", "sheet"]), "placed")
    at = [F.col("no"), F.col("r"), F.col("c")]
    header = rows.where("is_head and text <> ''").select("template_id", _place(1, *at, F.lit(0)), K.snake(F.col("text")).alias("id"), F.col("text").alias("label"), F.lit("detected").alias("source"))
    body = rows.where("not is_head and text <> ''")
    tokens = T.unfolded(body, ["template_id", *[c.alias(n) for c, n in zip(at, "abc", strict=True)]], T.field_candidates(F.col("text")), "f", "k").select(
        "template_id", _place(1, F.col("a"), F.col("b"), F.col("c"), F.col("k")), "f.id", "f.label", "f.source"
    )
    right = rows.select("template_id", "sheet", "r", (F.col("c") - 1).alias("c"), F.col("text").alias("next"))
    label = T.strip(F.regexp_replace("text", r":+$", ""))
    beside = body.join(right, ["template_id", "sheet", "r", "c"], "left").withColumn("label", label)
    named = beside.where(T.is_blank_slot(F.coalesce("next", F.lit(""))) & F.length("label").between(2, LABEL_CHARS) & ~F.col("label").rlike(r"^\d+$")).select(
        "template_id", _place(1, F.col("no"), F.col("r"), F.col("c"), F.lit(1 << 30)), K.snake(F.col("label")).alias("id"), "label", F.lit("detected").alias("source")
    )
    return header.unionByName(tokens).unionByName(named)


def _previews(paragraphs: DataFrame, cells: DataFrame) -> DataFrame:
    """The first characters of every template's texts and rows."""
    said = paragraphs.where(F.col("pos") < PREVIEW).select("template_id", F.struct(F.lit(0).alias("part"), F.lit("").alias("sheet"), F.col("pos").cast("bigint").alias("a"), F.substring("text", 1, PREVIEW).alias("text")).alias("l"))
    rows = cells.where(F.col("r") <= PREVIEW).groupBy("template_id", "sheet", "r").agg(
        F.array_sort(F.collect_list(F.struct("c", F.coalesce("text", F.lit("")).alias("t")))).alias("x")
    ).where(F.exists("x", lambda x: x["t"] != ""))
    lines = rows.select("template_id", F.struct(F.lit(1).alias("part"), "sheet", F.col("r").cast("bigint").alias("a"), F.substring(F.array_join(F.col("x.t"), " | "), 1, PREVIEW).alias("text")).alias("l"))
    titles = cells.select("template_id", "sheet").distinct().select("template_id", F.struct(F.lit(1).alias("part"), "sheet", F.lit(-1).cast("bigint").alias("a"), F.concat(F.lit("# "), "sheet").alias("text")).alias("l"))
    every = said.unionByName(lines).unionByName(titles)
    return every.groupBy("template_id").agg(F.substring(F.array_join(F.array_sort(F.collect_list("l"))["text"], "\n"), 1, PREVIEW).alias("preview"))


def analyze_templates(paragraphs: DataFrame, cells: DataFrame, spec_fields: DataFrame | None = None) -> DataFrame:
    """One row per template: fields, questions, outline, tables, literal, preview, summary.

    paragraphs: template_id, pos, text, heading (boolean); cells: template_id, sheet, r, c, text. ``spec_fields``
    (template_id, ord, id, label) are added to templates without a literal ``{{token}}``. A template without any field gets
    one that asks for its title. The outline is its headings and sheets, else its first eight labels.
    """
    # every part below reads both
    paragraphs = staged(paragraphs.select("template_id", "pos", "text", "heading"), "paragraphs")
    cells = staged(cells.select("template_id", "sheet", "r", "c", "text"), "sheets")
    found = _usable(text_fields(paragraphs).unionByName(grid_fields(cells)))
    best = found.groupBy("template_id", "id").agg(F.min(F.struct("place", "label", "source")).alias("f")).select("template_id", "id", "f.*")
    if spec_fields is not None:
        literal = best.where("source = 'placeholder'").select("template_id").distinct()
        zero = F.lit(0)
        extra = _usable(spec_fields.select("template_id", _place(2, F.col("ord"), zero, zero, zero), "id", "label", F.lit("spec").alias("source")))
        both = best.unionByName(extra.join(literal, "template_id", "left_anti").select(*best.columns))
        best = both.groupBy("template_id", "id").agg(F.min(F.struct("place", "label", "source")).alias("f")).select("template_id", "id", "f.*")
    question = F.concat(F.lit("What is the "), "label", F.lit("?"))
    listed = best.groupBy("template_id").agg(F.array_sort(F.collect_list(F.struct("place", "id", "label", question.alias("question"), "source"))).alias("fs"))
    heads = paragraphs.where(F.col("heading") & (T.strip(F.coalesce("text", F.lit(""))) != "")).select("template_id", F.struct(F.lit(0).alias("part"), F.col("pos").cast("bigint").alias("a"), T.strip(F.col("text")).alias("t")).alias("h"))
    sheets = cells.select("template_id", "sheet").distinct()
    every = heads.unionByName(sheets.select("template_id", F.struct(F.lit(1).alias("part"), F.lit(0).cast("bigint").alias("a"), F.col("sheet").alias("t")).alias("h")))
    outline = every.groupBy("template_id").agg(F.array_sort(F.collect_list("h"))["t"].alias("heads"))
    tables = sheets.groupBy("template_id").agg(F.count(F.lit(1)).alias("tables"))
    whole = _previews(paragraphs, cells).join(listed, "template_id", "left").join(outline, "template_id", "left").join(tables, "template_id", "left")
    keep = lambda f: F.struct(f["id"].alias("id"), f["label"].alias("label"), f["question"].alias("question"), f["source"].alias("source"))
    alone = F.array(F.struct(*[F.lit(v).alias(n) for v, n in zip(FALLBACK, ("id", "label", "question"), strict=True)], F.lit("fallback").alias("source")))
    told = whole.withColumn("fields", F.coalesce(F.transform("fs", keep), alone))
    labels = F.when(F.col("fs").isNull(), F.array().cast("array<string>")).otherwise(F.slice(F.col("fields.label"), 1, OUTLINE))
    return told.select(
        "template_id", "fields", F.col("fields.question").alias("questions"), F.coalesce("heads", labels).alias("outline"), F.coalesce("tables", F.lit(0)).cast("bigint").alias("tables"),
        F.exists("fields", lambda f: f["source"] == "placeholder").alias("literal"), "preview", F.substring("preview", 1, SUMMARY).alias("summary"),
    )
