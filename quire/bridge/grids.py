"""Cell tables derived from line items and orders: two versions of a list, and forms with a table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.bridge.plans import numbered_lines
from quire.bridge.views import ordered_parts
from quire.sources.tables import spread


def _spelled(rows: DataFrame, extra: str) -> DataFrame:
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("c"), v.alias("value"))
            for i, v in enumerate(
                (F.col("l_partkey").cast("string"), F.col("qty"), F.col("l_returnflag"), F.expr(extra)), 1
            )
        ]
    )
    return rows.select(
        F.col("l_orderkey").alias("book"), F.lit("Lines").alias("sheet"), (F.col("rn") + 1).alias("r"), F.explode(cells).alias("x")
    ).select("book", "sheet", "r", "x.c", "x.value").where("value is not null")


def cells_a(spark: SparkSession, folder: str) -> DataFrame:
    rows = numbered_lines(spark, folder).withColumn("qty", F.col("l_quantity").cast("int").cast("string"))
    return _spelled(rows, "cast(null as string)")


def cells_b(spark: SparkSession, folder: str) -> DataFrame:
    rows = numbered_lines(spark, folder).where("l_partkey % 11 <> 0")
    qty = F.col("l_quantity").cast("int").cast("string")
    rows = rows.withColumn("qty", F.when(F.col("l_partkey") % 7 == 0, F.concat(qty, F.lit("*"))).otherwise(qty))
    return _spelled(rows, "case when l_partkey % 5 = 0 then 'new' end")


# r, c, text, look: b bold, f filled, d bordered, w wrapped, m merged over four columns, p part of a merge, l locked, x formula
_FORM = [
    (1, 1, "concat('Order of ', p_name)", "bfm"), (1, 2, "''", "p"), (1, 3, "''", "p"), (1, 4, "''", "p"),
    (2, 1, "'Customer'", ""), (2, 2, "''", "d"), (2, 3, "''", ""), (2, 4, "''", ""),
    (3, 1, "'Meeting Date:'", ""), (3, 2, "''", ""), (3, 3, "''", "dd"), (3, 4, "''", "fd"),
    (4, 1, "'Owner'", ""), (4, 2, "concat('The north team looks after ', p_name, '.')", ""), (4, 3, "''", ""), (4, 4, "''", ""),
    (5, 1, "'Notes'", ""), (5, 2, "'=A1'", "x"), (5, 3, "''", ""), (5, 4, "''", ""),
    (6, 1, "''", "w"), (6, 2, "''", ""), (6, 3, "''", ""), (6, 4, "''", ""),
    (7, 1, "'Total'", ""), (7, 2, "'{{total_amount}}'", ""), (7, 3, "''", ""), (7, 4, "''", "l"),
    (8, 1, "concat('Lines of ', p_type)", "f"), (8, 2, "''", ""), (8, 3, "''", ""), (8, 4, "''", ""),
    (9, 1, "'Sl No'", "b"), (9, 2, "'Task'", "b"), (9, 3, "'Responsible'", "b"), (9, 4, "'Due Date'", "b"),
    (10, 1, "''", "d"), (10, 2, "''", "d"), (10, 3, "''", "d"), (10, 4, "''", "d"),
    (11, 1, "case when o_orderkey % 2 = 0 then cast(o_custkey as string) else '' end", ""), (11, 2, "''", ""), (11, 3, "''", ""), (11, 4, "''", ""),
    (12, 1, "''", ""), (12, 2, "''", ""), (12, 3, "''", ""), (12, 4, "'=SUM(A10:A11)'", "x"),
]


# a text without a column in it
_PLAIN = re.compile(r"'[^']*'$")
_LOOKS = (
    "bold", "filled", "bordered", "size", "wrap", "merged", "merge_rows", "merge_cols", "is_anchor", "has_formula", "locked", "number_format", "width",
)


# a second and a third layout: repeated and claimed roles, two tables of one role, a qualified label, slots with samples, locked cells
_MEETING = [
    (1, 1, "concat('Meeting information of ', p_brand)", "bfm"), (1, 2, "''", "p"), (1, 3, "''", "p"), (1, 4, "''", "p"),
    (2, 1, "'Date'", ""), (2, 2, "''", "dt"), (2, 3, "'Venue:'", ""), (2, 4, "''", "d"),
    (3, 1, "'Held on'", ""), (3, 2, "''", "d"), (3, 3, "''", ""), (3, 4, "''", ""),
    (4, 1, "'Action Items'", ""), (4, 2, "''", "d"), (4, 3, "''", ""), (4, 4, "''", ""),
    (5, 1, "'Attendees (Vendor)'", ""), (5, 2, "''", "d"), (5, 3, "''", ""), (5, 4, "''", ""),
    (6, 1, "'This form is kept with the files of the north team.'", ""), (6, 2, "''", ""), (6, 3, "''", ""), (6, 4, "''", ""),
    (7, 1, "'Task'", "b"), (7, 2, "'Owner'", "b"), (7, 3, "'Due Date'", "b"), (7, 4, "'Status'", "b"),
    (8, 1, "''", "d"), (8, 2, "''", "d"), (8, 3, "''", "dt"), (8, 4, "''", "d"),
    (9, 1, "''", ""), (9, 2, "''", ""), (9, 3, "''", ""), (9, 4, "''", ""),
    (10, 1, "'Action Items'", "f"), (10, 2, "''", ""), (10, 3, "''", ""), (10, 4, "''", ""),
    (11, 1, "'Sl No'", "b"), (11, 2, "'Task'", "b"), (11, 3, "'Owner'", "b"), (11, 4, "'Remarks'", "b"),
    (12, 1, "''", "d"), (12, 2, "''", "d"), (12, 3, "''", "d"), (12, 4, "''", "d"),
    (13, 1, "''", ""), (13, 2, "''", ""), (13, 3, "''", ""), (13, 4, "''", ""),
]
_SHEET = [
    (1, 1, "'Status of the works'", "bf"), (1, 2, "''", ""), (1, 3, "''", ""), (1, 4, "''", ""),
    (2, 1, "'Qwzx'", ""), (2, 2, "concat('the parts of ', p_brand, ' are counted by the north team.')", ""), (2, 3, "''", ""), (2, 4, "''", ""),
    (3, 1, "'Department'", ""), (3, 2, "''", "d"), (3, 3, "'Kept by hand'", "l"), (3, 4, "''", "l"),
    (4, 1, "'Zumbra'", ""), (4, 2, "''", "d"), (4, 3, "''", ""), (4, 4, "''", ""),
    (5, 1, "'{{prepared_by}}'", ""), (5, 2, "''", ""), (5, 3, "''", ""), (5, 4, "'=B2'", "x"),
    (6, 1, "''", ""), (6, 2, "''", ""), (6, 3, "''", ""), (6, 4, "''", ""),
    (7, 1, "'Vorlon'", "b"), (7, 2, "'Krell'", "b"), (7, 3, "''", ""), (7, 4, "''", ""),
    (8, 1, "''", "d"), (8, 2, "''", "d"), (8, 3, "''", ""), (8, 4, "''", ""),
]


def _grids(rows: DataFrame, layouts: list[tuple[Column | None, list[tuple[int, int, str, str]], set[tuple[int, int]]]]) -> DataFrame:
    """The first layout whose condition holds, once for each row; a mark ``t`` is a date format as well.

    A layout is a constant, so a row carries it by reference; only texts that name a column are computed, by their number.
    """
    computed = list(dict.fromkeys(text for _, layout, _ in layouts for _, _, text, _ in layout if not _PLAIN.match(text)))

    def cell(r: int, c: int, text: str, k: str, dates: set[tuple[int, int]]) -> Column:
        plain = F.lit(None if text in computed else text[1:-1]).cast("string")
        return F.struct(
            F.lit(r).alias("r"), F.lit(c).alias("c"), plain.alias("text"), F.lit("b" in k).alias("bold"), F.lit("f" in k).alias("filled"),
            F.lit("d" in k).alias("bordered"), F.lit(11.0).alias("size"), F.lit("w" in k).alias("wrap"), F.lit("m" in k or "p" in k).alias("merged"),
            F.lit(1).alias("merge_rows"), F.lit(4 if ("m" in k or "p" in k) else 1).alias("merge_cols"), F.lit("p" not in k).alias("is_anchor"),
            F.lit("x" in k).alias("has_formula"), F.lit("l" in k).alias("locked"),
            F.lit("dd/mm/yyyy" if (r, c) in dates or "t" in k else "General").alias("number_format"), F.lit(12.0).alias("width"),
            F.lit(computed.index(text) if text in computed else -1).alias("computed"),
        )

    chosen = None
    for condition, layout, dates in layouts:
        cells = F.array(*[cell(*x, dates) for x in layout])
        chosen = cells if condition is None else F.when(condition, cells) if chosen is None else chosen.when(condition, cells)
    # rows of one book stay together: whatever is grouped, ordered or joined by book and place then needs no further exchange
    made = spread(rows, "o_orderkey").select("*", F.explode(chosen).alias("x"))
    text = F.col("x.text")
    if computed:
        at = F.when(F.col("x.computed") == 0, F.expr(computed[0]))
        for i, expression in enumerate(computed[1:], 1):
            at = at.when(F.col("x.computed") == i, F.expr(expression))
        text = F.when(F.col("x.computed") < 0, text).otherwise(at)
    return made.select(
        F.col("o_orderkey").alias("book"), F.lit("Form").alias("sheet"), "x.r", "x.c", text.alias("text"), *[f"x.{name}" for name in _LOOKS]
    )


def forms(spark: SparkSession, folder: str) -> DataFrame:
    """One form per order: banner, labels with their slots, a token, a table of four columns."""
    return _grids(ordered_parts(spark, folder), [(None, _FORM, {(3, 3), (10, 4)})])


def mixed_forms(spark: SparkSession, folder: str) -> DataFrame:
    """One form per order, of three layouts by the order's key."""
    order = [(1, 1, "'Order details'", "bfm"), *_FORM[1:]]
    kinds = enumerate(((order, {(3, 3), (10, 4)}), (_MEETING, set()), (_SHEET, set())))
    return _grids(ordered_parts(spark, folder), [(F.col("o_orderkey") % 3 == k, layout, dates) for k, (layout, dates) in kinds])


GRID_CTES = {
    "ca": "select l_orderkey as book, rn + 1 as r, unnest([1, 2, 3]) as c, unnest([cast(l_partkey as varchar), cast(cast(l_quantity as int) as varchar), l_returnflag]) as value "
    "from nlines",
    "cb": "select * from (select l_orderkey as book, rn + 1 as r, unnest([1, 2, 3, 4]) as c, unnest([cast(l_partkey as varchar), concat(cast(l_quantity as int), case when l_partkey % 7 = 0 then '*' else '' end), l_returnflag, "
    "case when l_partkey % 5 = 0 then 'new' end]) as value from nlines where l_partkey % 11 <> 0) where value is not null",
    "forms": "select o_orderkey as book, o_custkey, p_name, p_type, p_brand from ordered",
}
GRID_NEEDS = {"ca": ("nlines",), "cb": ("nlines",), "forms": ("ordered",)}
