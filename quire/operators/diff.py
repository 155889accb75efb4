"""Versions cell by cell or line by line; template shapes lost in an output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import text as T
from quire.operators.cells import has_token, is_written
from quire.operators.linediff import line_changes

def cell_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed and updated cells of (book, sheet, r, c, value) tables; equal cells are dropped."""
    key = ["book", "sheet", "r", "c"]
    both = old.select(*key, F.col("value").alias("before")).join(
        new.select(*key, F.col("value").alias("after")), key, "full_outer"
    )
    changed = both.where(~F.col("before").eqNullSafe(F.col("after")))
    return changed.select(
        *key,
        F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("updated").alias("change"),
        F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"),
    )


def diff_versions(pairs: DataFrame, cells_old: DataFrame | None = None, cells_new: DataFrame | None = None) -> DataFrame:
    """Change rows of texts, and of cells where both sides are cell tables."""
    lines = line_changes(pairs).select(
        F.concat_ws("!", F.col("pair").cast("string"), "field").alias("where"), "change", F.concat_ws(" -> ", "before", "after").alias("what")
    )
    if cells_old is None or cells_new is None:
        return lines
    cells = cell_diff(cells_old, cells_new).select(
        F.concat_ws("!", F.col("book").cast("string"), "sheet", F.concat(F.lit("R"), "r", F.lit("C"), "c")).alias("where"), "change",
        F.concat_ws(" -> ", "before", "after").alias("what"),
    )
    return lines.unionByName(cells)


# --- what an output lost ------------------------------------------------------------------------------
def lost_merges(template: DataFrame, output: DataFrame) -> DataFrame:
    """Merged ranges (book, sheet, min_r, min_c, max_r, max_c) of the template missing in the output.

    A range that only moved down counts as kept, with multiplicity: equal shapes are counted on both
    sides and the last of the template's surplus, in row order, is lost.
    """
    key = ["book", "sheet", "min_r", "min_c", "max_r", "max_c"]
    shape = ["book", "sheet", "min_c", "max_c", "height"]
    tall = lambda df: df.withColumn("height", F.col("max_r") - F.col("min_r"))
    moved = tall(template.join(output, key, "left_anti"))
    # every output range of a shape can stand for one template range that is not there as such
    left = tall(output).groupBy(*shape).agg(F.count(F.lit(1)).alias("spare"))
    from quire.operators.ordered import part_of, part_rank

    ranked = part_rank(moved, shape, part_of("min_r"), [F.asc("min_r")], "nth")
    return ranked.join(left, shape, "left").where(F.col("nth") > F.coalesce("spare", F.lit(0))).select(*key)


def lost_formulas(template: DataFrame, output: DataFrame) -> DataFrame:
    """Formulas (book, sheet, r, c, formula) whose text and digit-free shape are both gone."""
    shape = lambda df: df.withColumn("shape", T.formula_shape(F.col("formula")))
    left = shape(template).join(output.select("book", "sheet", "formula").distinct(), ["book", "sheet", "formula"], "left_anti")
    return left.join(shape(output).select("book", "sheet", "shape").distinct(), ["book", "sheet", "shape"], "left_anti").select(
        "book", "sheet", "r", "c", "formula"
    )


def _issue(check: str, message: Column | str, severity: str = "error") -> list[Column]:
    text = message if isinstance(message, Column) else F.lit(message)
    return [F.lit(check).alias("check"), text.alias("message"), F.lit(severity).alias("severity")]


def structural_qa(
    template: DataFrame, output: DataFrame, template_merges: DataFrame, output_merges: DataFrame
) -> DataFrame:
    """Issues (book, sheet, check, message, severity) of filled grids against their templates."""
    sheets = lambda df: df.select("book", "sheet").distinct()
    gone = sheets(template).join(sheets(output), ["book", "sheet"], "left_anti")
    fresh = sheets(output).join(sheets(template), ["book", "sheet"], "left_anti")
    both = sheets(template).join(sheets(output), ["book", "sheet"])
    in_both = lambda df: df.join(both, ["book", "sheet"], "left_semi")
    formulas = lambda df: in_both(df).where("has_formula").select("book", "sheet", "r", "c", F.col("text").alias("formula"))
    profile = lambda df, tag: in_both(df).groupBy("book", "sheet").agg(
        F.count_if("has_formula").alias(f"{tag}_formulas"), F.max("c").alias(f"{tag}_columns"), F.max("r").alias(f"{tag}_rows"),
        F.bool_or("locked").alias(f"{tag}_locked"),
    )
    sides = profile(template, "t").join(profile(output, "o"), ["book", "sheet"])
    merges = lost_merges(in_both(template_merges), in_both(output_merges)).groupBy("book", "sheet").agg(F.count(F.lit(1)).alias("n"))
    number = lambda a, b: F.concat(F.col(a).cast("string"), F.lit(" -> "), F.col(b).cast("string"))
    side_checks = F.filter(
        F.array(
            F.when(F.col("o_formulas") < F.col("t_formulas"), F.struct(*_issue("formulas", number("t_formulas", "o_formulas")))),
            F.when(F.col("o_columns") != F.col("t_columns"), F.struct(*_issue("dimensions", number("t_columns", "o_columns"), "warning"))),
            F.when(F.col("o_rows") < F.col("t_rows"), F.struct(*_issue("rows", number("t_rows", "o_rows")))),
            F.when(F.col("o_locked") != F.col("t_locked"), F.struct(*_issue("protection", "sheet protection changed"))),
        ),
        lambda x: x.isNotNull(),
    )
    parts = [
        gone.select("book", "sheet", *_issue("sheets", "sheet is gone")),
        fresh.select("book", "sheet", *_issue("sheets", "sheet is new")),
        merges.select("book", "sheet", *_issue("merged_ranges", F.concat(F.col("n").cast("string"), F.lit(" merged range(s) lost")))),
        sides.select("book", "sheet", F.explode(side_checks).alias("i")).select("book", "sheet", "i.*"),
        lost_formulas(formulas(template), formulas(output)).select("book", "sheet", *_issue("formulas", F.concat(F.lit("no equivalent of "), "formula"))),
        in_both(output).where(has_token(F.col("text"))).select(
            "book", "sheet", *_issue("placeholders", F.concat(F.lit("unresolved "), F.substring("text", 1, 40)), "warning")
        ),
    ]
    issues = parts[0]
    for part in parts[1:]:
        issues = issues.unionByName(part)
    return issues
