"""Lines of documents: headings carried down, runs of alike lines, label and block slots, audit feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import text as T
from quire.operators.ordered import carry_forward, neighbour, running_sum

BULLET = r"\A(?:[-*•·]|\d++[.)])\s"


def line_class(line: Column) -> Column:
    """bullet, table, blank, heading (``Label:`` alone) or text, of a line without blanks around it."""
    return (
        F.when(line == "", "blank").when(line.rlike(BULLET), "bullet").when(line.contains("|"), "table")
        .when(line.endswith(":") & T.looks_like_label(line), "heading").otherwise("text")
    )


def carry_heading(lines: DataFrame) -> DataFrame:
    """Latest heading at or above each line (doc_id, line_no, line)."""
    bare = lines.withColumn("__bare", T.trim_line(F.col("line")))
    tagged = bare.withColumn("class", line_class(F.col("__bare")))
    heading = F.when(F.col("class") == "heading", F.rtrim("__bare", F.lit(":")))
    return carry_forward(tagged, ["doc_id"], "line_no", heading, "heading").drop("__bare")


def block_runs(lines: DataFrame) -> DataFrame:
    """Runs of consecutive lines of one class: doc_id, block, class, first, last, n."""
    tagged = lines.withColumn("__bare", T.trim_line(F.col("line"))).withColumn("class", line_class(F.col("__bare")))
    before = neighbour(tagged.select("doc_id", "line_no", "class"), ["doc_id"], "line_no", {"class": "before"}, -1)
    starts = before.withColumn("start", F.when(F.col("class").eqNullSafe(F.col("before")), 0).otherwise(1))
    numbered = running_sum(starts, ["doc_id"], "line_no", F.col("start"), "block")
    return numbered.where("class <> 'blank'").groupBy("doc_id", "block", "class").agg(
        F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.count(F.lit(1)).alias("n")
    )


def label_block_pairs(lines: DataFrame) -> DataFrame:
    """Slots of a text: ``Label:`` over an empty line is a block, ``Label: ____`` a place in the line."""
    tagged = neighbour(lines.select("doc_id", "line_no", "line"), ["doc_id"], "line_no", {"line": "after"}, 1)
    t = T.strip(F.col("line"))
    inline = t.rlike(r"^(.{2,60}?)\s*:\s*[_\-.\s]{3,}$")
    block = t.endswith(":") & T.looks_like_label(t) & F.col("after").isNotNull() & (T.strip(F.col("after")) == "")
    label = T.strip(F.regexp_replace(t, r"\s*:.*$", ""))
    return tagged.where(inline | block).select(
        "doc_id", "line_no", label.alias("label"), F.when(inline, "inline").otherwise("block").alias("mode")
    )


def audit_feed(events: DataFrame, template_id=None, n: int | None = None) -> DataFrame:
    """Events of one template or of all, the newest first; all of them or the newest ``n``."""
    mine = events if template_id is None else events.where(F.col("template_id") == template_id)
    ordered = mine.orderBy(F.desc("created_at"), F.desc("event_id"))
    return ordered if n is None else ordered.limit(n)
