"""Work that must not grow with what it is repeated for: exchanges, evaluations and comparisons that were made too often."""

from __future__ import annotations

import os
import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from quire.functions import similarity as S, text as T
from quire.operators import catalog, cells as G, ordered as O
from quire.plans import extract, spec
from quire.session import checkpoint_dir
from quire.sources.tables import spread


def _seconds(frame) -> float:
    began = time.perf_counter()
    frame.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def test_quote_is_compared_with_hopeful_windows_only():
    text = "the north team looks after the ring and ships the bolt " * 40
    quote = "nobody wrote this sentence"
    assert list(S._hopeful(quote, S._words(quote), text, 6)) == []
    near = "ships the blot the"
    at = list(S._hopeful(near, S._words(near), text, 4))
    assert at and len(at) < len(text) // 4


def test_no_window_that_scores_is_left_out():
    dice = random.Random(5)
    hits = 0
    for _ in range(4000):
        signs = dice.choice(["abcde fg .-:*_%/&É ß !İσς", "ab c.", "abcd         .:*-"])
        text = "".join(dice.choice(signs) for _ in range(dice.randint(10, 60)))
        at = dice.randint(0, len(text) - 8)
        quote = list(text[at:at + dice.randint(8, 20)])
        for _ in range(dice.randint(0, 4)):
            quote[dice.randrange(len(quote))] = dice.choice(signs)
        quote = "".join(quote)
        words, step = S._words(quote), max(1, len(quote) // 4)
        starts = set(S._hopeful(quote, words, text, step))
        for start in range(0, max(1, len(text) - len(quote) + 1), step):
            if S._Target(text[start:start + len(quote)]).score(quote, words, 0.8199) >= 0.82:
                hits += 1
                assert start in starts, (quote, text, start)
    assert hits > 500


def test_fields_of_a_long_template_are_found_once(spark):
    text = " ".join(f"{{{{name_{i}}}}}" for i in range(600)) + " {{name_3}}"
    frame = spark.createDataFrame([(text,)], "t string").repartition(1).select(T.harvest_fields(F.col("t")).alias("f"))
    assert [f.id for f in frame.first().f] == [f"name_{i}" for i in range(600)]
    assert _seconds(frame) < 5


def test_answers_are_spelled_once(spark):
    answers = {f"Name {i}": f"v{i}" for i in range(150)}
    frame = spark.createDataFrame([("{{name_7}} [Name 8] <<name 9>> {{ Name_10 }}", answers)], "t string, a map<string,string>").repartition(1)
    filled = frame.select(T.fill_text(F.col("t"), F.col("a")).alias("x"))
    assert filled.first().x == "v7 v8 v9 v10"
    assert _seconds(filled) < 5


def test_label_rules_of_words_and_signs(spark):
    rows = ["", "  ", "a b c d e f g h", "a b c d e f g h i", "a/b/c/d/e/f/g/h/i", "one two three four.", "one two three four five.", "x" * 81, "a b c d e f g h i:", " / ", None]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").select("i", T.looks_like_label(F.col("t")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [False, False, True, False, False, True, False, False, True, True, False]


def _exchanges(frame) -> int:
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_cells_that_stand_by_book_are_not_moved_again(spark):
    grid = "book bigint, sheet string, r int, c int, text string, bold boolean, filled boolean, bordered boolean, size double, merged boolean, merge_cols int, is_anchor boolean, has_formula boolean"
    cells = spread(spark.createDataFrame([(1, "S", 1, 1, "Title", True, True, False, 11.0, False, 1, True, False)], grid), "book")
    banners = G.section_banners(cells)
    assert _exchanges(banners) == 1
    assert [tuple(r) for r in banners.collect()] == [(1, "S", 1, 1, "Title")]
    carried = O.carry_forward(cells.select("book", "sheet", "r", "text"), ("book", "sheet"), "r", F.col("text"), "last")
    assert "Join" not in carried._jdf.queryExecution().executedPlan().toString()


def test_values_are_carried_over_parts_and_null_keys(spark):
    rows = [(None, 1, "a"), (None, 2, None), (None, 7, None), (1, 0, None), (1, 3, "b"), (1, 9, None), (1, 10, "c"), (1, 11, None), (2, 8, None)]
    frame = spark.createDataFrame(rows, "k int, p int, v string")
    got = O.carry_forward(frame, ("k",), "p", F.col("v"), "w", rows=3).collect()
    assert sorted((str(r.k), r.p, r.w) for r in got) == [
        ("1", 0, None), ("1", 3, "b"), ("1", 9, "b"), ("1", 10, "c"), ("1", 11, "c"), ("2", 8, None), ("None", 1, "a"), ("None", 2, "a"), ("None", 7, "a"),
    ]


def test_headers_are_scored_in_one_step(spark):
    shape = "template_id int, node_id int, idx int, header string, allowed array<string>, editable boolean"
    rows = [(0, 1, 0, "Status", [], True), (0, 1, 1, "Sl No", [], True), (0, 1, 2, "Status", ["owner"], True), (0, 2, 0, None, [], False), (0, 2, 1, "Assigned to", None, True)]
    made = spec.assign_columns(spark.createDataFrame(rows, shape))
    assert "ArrowEvalPython" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.node_id, r.idx, r.field) for r in made.collect()) == [(1, 0, "status"), (1, 1, "__serial_no__"), (1, 2, None), (2, 0, None), (2, 1, None)]


def test_large_stored_tables_are_merged_however_small_their_files(spark):
    from quire.sources import staged as ST

    many = ST.staged(spark.range(ST.SMALL + 1).select("id", F.lit("alike").alias("text")), "many")
    few = ST.staged(spark.range(50).select("id", F.lit("few").alias("other")), "few")
    none = ST.staged(spark.range(0).select("id", F.lit("none").alias("nothing")), "none")
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan(many.join(many.where("id % 2 = 0").select("id", F.col("text").alias("again")), "id"))
    assert "Broadcast" in plan(spark.range(10).join(few, "id"))
    assert none.count() == 0 and many.join(few, "id").count() == 50


def test_codes_of_a_long_text_are_found_in_one_pass(spark):
    from quire.operators import knowledge as KB

    texts = ["", "5", "a 12.345.67x 123.456", "10.20.30.40.50\n99", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(KB._code_spans(F.col("t")).alias("s")).collect()
    assert sorted(rows[2].s) == sorted(["12", "12.34", "12.345", "12.345.67", "23", "23.45", "23.456", "34", "45", "45.67", "56", "67"])
    assert "10.20.30.40" in rows[3].s and "99" in rows[3].s and rows[0].s == [] and rows[1].s == []
    long = spark.range(1).select(F.repeat(F.lit("10.20.300 words of a step\n"), 12_000).alias("t"))
    assert _seconds(long.select(KB._code_spans(F.col("t")))) < 8


def test_suggestions_are_read_once_for_all_items(spark):
    from quire.operators import knowledge as KB

    row = "struct<type:string,name:string,description:string,acceptance:string,flow:array<string>>"
    offers = [("Feature", f"handling of lot {k} with many words behind it {k}", "A description that is long enough", "kb acceptance", ["one"]) for k in range(150)]
    suggested = spark.createDataFrame([(0, offers)], f"scope int, suggested array<{row}>")
    items = spark.range(8_000).selectExpr(
        "id", "cast(id % 2 as int) as scope", "'Feature' as type", "concat('Handling lots behind words ', id) as name", "'short' as description", "'' as acceptance", "cast(array() as array<string>) as flow"
    )
    made = KB.enrich_items(items, suggested, ["scope"])
    # words are taken once of an item's name and once of a suggestion, wherever they are asked for
    assert made._jdf.queryExecution().optimizedPlan().toString().count("([a-z0-9]{4,})") == 2
    rows = made.where("id < 2").orderBy("id").collect()
    assert (rows[0].description, rows[0].acceptance, rows[0].flow) == ("A description that is long enough", "kb acceptance", ["one"])
    assert (rows[1].description, rows[1].acceptance, rows[1].flow) == ("short", "", [])


def test_inputs_of_templates_are_computed_once(spark):
    from quire.plans import templates as TP

    texts = spark.range(2).selectExpr("id as template_id", "0 as pos", "'Dear {{ name }}' as text", "false as heading")
    cells = spark.range(2).selectExpr("-1 - id as template_id", "'Form' as sheet", "1 as r", "1 as c", "'Owner' as text")
    made = TP.analyze_templates(texts, cells)
    assert "Range (" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert {r.template_id: [f.id for f in r.fields] for r in made.collect()} == {0: ["name"], 1: ["name"], -1: ["owner"], -2: ["owner"]}


def test_office_filter_computes_the_key_once(spark):
    names = spark.createDataFrame([("a.docx",), ("b.txt",), (None,)], "n string")
    keys = names.select(F.concat(F.lit("template/marker/"), "n").alias("key"))
    found = catalog.office_objects(keys)
    filtered = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
    assert filtered and all(line.count("template/marker/") <= 1 for line in filtered)
    assert [r.key for r in found.collect()] == ["template/marker/a.docx"]


def test_scores_are_laid_out_once_a_distinct_label(spark):
    names = (("date", ("date", "day")), ("owner", ("owner",)))
    labels = ["Date", None, "Owner", "Date", ""]
    found = S._scorer(names, 0.35).func(pa.array(labels, pa.string())).to_pylist()
    assert found == [S._ranker(names, 0.35)(label) for label in labels]
    shown = spark.createDataFrame([(x,) for x in labels], "label string").select(S.role_scores(F.col("label")).alias("s")).collect()
    assert shown[0] == shown[3] and shown[1].s == [] and shown[0].s[0].score == 1.0


def test_texts_of_notes_are_stored_once(spark):
    notes = spark.createDataFrame([(1, "Status: open\n")], "doc_id long, text string")
    facts, _ = extract.extract_facts(notes)
    kept = [name for name in os.listdir(checkpoint_dir(spark)) if name.startswith("texts-")]
    assert kept and [(r.role, r.value) for r in facts.collect()] == [("status", "open")]
