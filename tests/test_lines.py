"""Lines of documents: neighbours and sums over parts of an order, and rules of texts against their plain forms."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quire.functions import similarity as S, text as T
from quire.operators import lines as LN, ordered as O
from quire.sources.tables import spread


def _plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_neighbours_meet_over_parts_without_a_join(spark):
    dice = random.Random(3)
    rows = [(dice.choice([1, 2, None]), dice.choice([*range(-7, 12), None]), dice.choice("abc")) for _ in range(90)]
    frame = spread(spark.createDataFrame(rows, "k int, p int, v string"), "k")
    for step in (-1, 1, 3):
        want = []
        for k, p, v in rows:
            hits = [x[2] for x in rows if None not in (k, p) and x[1] is not None and (x[0], x[1]) == (k, p + step)] or [None]
            want += [(str(k), str(p), v, str(w)) for w in hits]
        met = O.neighbour(frame, ["k"], "p", {"v": "w"}, step, 4)
        assert "Join" not in _plan(met) and _plan(met).count("Exchange hashpartitioning") == 1
        assert sorted((str(r.k), str(r.p), r.v, str(r.w)) for r in met.collect()) == sorted(want)


def test_sums_of_earlier_parts_enter_without_a_join(spark):
    dice = random.Random(4)
    rows = [(k, p, dice.choice([0, 1, 5, None])) for k in (1, None, 3) for p in range(-3, 25) if dice.random() < 0.8]
    summed = O.running_sum(spread(spark.createDataFrame(rows, "k int, p int, a int"), "k"), ["k"], "p", F.col("a"), "s", 4)
    for r in summed.collect():
        known = [a for k, p, a in rows if k == r.k and p // 4 == r.p // 4 and p <= r.p and a is not None]
        # nothing known yet in its part: no sum
        assert r.s == (sum(known) + sum(a or 0 for k, p, a in rows if k == r.k and p // 4 < r.p // 4) if known else None)
    assert "Join" not in _plan(summed)


def test_runs_of_lines_are_found_without_moving_them(spark):
    lines = ["Head:", "- a", "2) b", "", "x | y", "| z |", "plain", "so on", "- ", "3.x", "* c"]
    frame = spread(spark.createDataFrame([(d, i, x) for d in (1, None) for i, x in enumerate(lines)], "doc_id long, line_no int, line string"), "doc_id")
    runs = LN.block_runs(frame)
    # lines are read twice, as the sums of parts are taken in a pass of their own
    assert "Join" not in _plan(runs) and _plan(runs).count("Exchange hashpartitioning") == 2
    want = [("heading", 0, 0, 1), ("bullet", 1, 2, 2), ("table", 4, 5, 2), ("text", 6, 9, 4), ("bullet", 10, 10, 1)]
    # lines of an unknown document meet no other
    alone = [(k, i, i, 1) for k, a, b, _ in want for i in range(a, b + 1)]
    assert sorted((str(r.doc_id), r.first, r["class"], r["last"], r.n) for r in runs.collect()) == sorted((d, a, k, b, n) for d, rows in (("1", want), ("None", alone)) for k, a, b, n in rows)


def test_headings_are_read_from_bare_lines(spark):
    lines = [" Action items: ", "\t- one", "Plan::", "1) two: ", "a | b:", "x" * 90 + ":", "", "Owner : ", ":"]
    frame = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, line_no int, line string")
    carried = LN.carry_heading(frame)
    assert [r.heading for r in carried.orderBy("line_no").collect()] == ["Action items", "Action items", "Plan", "Plan", "Plan", "Plan", "Plan", "Owner ", ""]
    assert carried.columns == ["doc_id", "line_no", "line", "class", "heading"]
    # blanks are taken off by their ends, not looked for all over the line
    plan = carried._jdf.queryExecution().optimizedPlan().toString()
    assert "AS __bare" in plan and "regexp_replace(line" not in plan


ODD = ["", None, "A_b  C", " -- x . y:* ", "é̀Ä ß—--\t\n\x0bq", "a%b/c&d.e-f", "(x) [y]  {z}", "one two  three ,four", "😀 ok", "İI", "a\x1cb‍c", ". .", "a\r\nb\rc\n\n", "\x85 z", "x y　z"]


def test_normal_texts_are_as_their_plain_form_gives(spark):
    dice = random.Random(9)
    signs = [*"abZ09 _-.:*%/&,()|\t\n\r", " ", " ", "\x1c", "\x85", "é", "—", "ß", "̀", "‍"]
    texts = [*ODD, *("".join(dice.choice(signs) for _ in range(dice.randint(0, 40))) for _ in range(400))]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    plain = F.translate(F.lower(F.coalesce("t", F.lit(""))), "_ ", "  ")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?U)[^\w\s%/&.-]+", " "), r"(?U)\s+", " ")
    both = frame.select("t", T.normalize_text(F.col("t")).alias("a"), F.trim(T.strip(plain, " :*-.")).alias("b"), T.lines(F.col("t")).alias("c"), F.split("t", T.LINE_BREAK).alias("d"))
    for r in both.collect():
        assert r.a == r.b and r.c == r.d, ascii(r)
    # blanks and punctuation are squeezed in one pass
    assert frame.select(T.normalize_text(F.col("t")).alias("a"))._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_window_filter_counts_once_for_all_signs():
    quote, text = "nobody wrote this sentence", "the agenda focused on reviewing bolts and on stock levels " * 400
    words = S._words(quote)
    calls, plain = [], S.np.cumsum
    S.np.cumsum = lambda *a, **k: calls.append(1) or plain(*a, **k)
    try:
        assert list(S._hopeful(quote, words, text, 6)) == []
    finally:
        S.np.cumsum = plain
    assert len(calls) <= 3
