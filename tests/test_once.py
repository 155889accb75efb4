"""Arrays that a filter asks for are computed once, and parts of stored tables are merged however small they look."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import items as I, text as T
from quire.plans import extract, spec

NOTE = "Action items:\n\n- Ship bolt — Ada — 2024-01-02\n- Count — Bela\n\nTask | Action by\n--- | ---\nClose | Cleo\n | \n"


def _optimized(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_settled_columns_are_not_computed_by_filters(spark):
    frame = spark.createDataFrame([(1, "a1b2"), (2, ""), (3, None)], "i int, t string")
    made = T.settled(frame, "xs", F.filter(F.regexp_extract_all("t", F.lit(r"(\d)"), F.lit(1)), lambda x: x != "1"))
    kept = made.where(F.size("xs") > 0)
    assert _optimized(kept).count("regexp_extract_all") == 1
    assert [(r.i, r.xs) for r in kept.collect()] == [(1, ["2"])] and [r.xs for r in made.orderBy("i").collect()] == [["2"], [], None]


def test_records_are_read_once_a_block(spark):
    docs = spark.createDataFrame([(1, NOTE), (2, "nothing"), (None, NOTE)], "doc_id long, text string")
    I.items_view(docs, "once_records")
    rows = spark.sql("select doc_id, pos, at, i.* from once_records lateral view posexplode(records) r as at, i")
    # as often as one reading of a bullet names the pattern of its keys
    plain = docs.select(F.transform(F.array("text"), lambda t: I.L.bullet_item(t)).alias("x"))
    assert _optimized(rows).count("owner|assignee") == _optimized(plain).count("owner|assignee")
    assert sorted((r.pos, r.at, r.kind, r.task, r.owner, r.due_date) for r in rows.where("doc_id = 1").collect()) == [
        (0, 0, "bullet", "Ship bolt", "Ada", "2024-01-02"), (0, 1, "bullet", "Count", "Bela", None), (1, 0, "row", "Close", "Cleo", None),
    ]
    assert rows.where("doc_id is null").count() == 3 and rows.where("doc_id = 2").count() == 0


def test_quotes_of_tasks_are_found_once(spark):
    docs = spark.createDataFrame([(1, "Ada Adler will check the bolt stock by 20 August 2024. Nothing else."), (2, "none")], "doc_id long, text string")
    told = extract.narrative_collections(docs)
    assert _optimized(told).count("regexp_extract_all(text") == 2
    assert [(r.doc_id, r.role, r["items"][0]["owner"]) for r in told.collect()] == [(1, "action_items", "Ada Adler")]


def test_parts_of_protected_cells_are_merged(spark):
    cells = spark.sql(
        "select 1L as book, 'S' as sheet, r, c, text, true as is_anchor, false as has_formula, false as locked from values (1, 1, 'Title'), (2, 1, 'Owner'), (2, 2, 'Ada'), (3, 1, 'A note'), (5, 1, 'in a table') as t(r, c, text)"
    )
    place = "1L as book, 'S' as sheet"
    banners, band = spark.sql(f"select {place}, 1 as r, 1 as c, 'Title' as text"), spark.sql(f"select {place}, 5 as r, 1 as c")
    pairs = spark.sql(f"select {place}, 2 as r, 1 as c, 2 as t_r, 2 as t_c, 'right' as how")
    made = spec.spec_protected(cells, banners, band, pairs)
    assert "BroadcastHashJoin" not in made._jdf.queryExecution().sparkPlan().toString()
    assert sorted((r.node_id, r.reason) for r in made.collect()) == [("S::A1", "section header"), ("S::A2", "label text"), ("S::A3", "static content")]
