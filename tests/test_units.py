"""Thresholds, ordered folds, similarity and streams on small frames, against plain Python."""

from __future__ import annotations

import difflib
import random

from pyspark.sql import functions as F

from quire.functions import keys as K, similarity as S, text as T
from quire.functions.linescan import read_blocks
from quire.operators import inventory as I, policy as P
from quire.operators.ordered import carry_forward, part_rank, running_sum
from quire.plans import extract as X, sessions


def test_decide_bands(spark):
    rows = [(0.95, False, True, "fill"), (0.949, False, True, "fill_with_audit"), (0.85, False, True, "fill_with_audit"),
            (0.849, False, True, "needs_review"), (0.70, False, True, "needs_review"), (0.699, False, True, "skipped_low_confidence"),
            (0.98, True, True, "fill_with_audit"), (0.99, True, True, "fill"), (0.99, False, False, "skipped_no_evidence")]
    df = spark.createDataFrame(rows, "c double, crit boolean, ev boolean, want string")
    got = df.select("want", P.decide(F.col("c"), F.col("crit"), F.col("ev")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_ordered_helpers_match_plain_python(spark):
    random.seed(3)
    rows = [(g, i, random.choice([None, "a", "b"]), random.randint(0, 5)) for g in range(3) for i in range(97)]
    df = spark.createDataFrame(rows, "g int, i int, v string, n int")
    out = running_sum(carry_forward(df, ["g"], "i", F.col("v"), "last", rows=10), ["g"], "i", F.col("n"), "total", rows=7)
    got = {(r.g, r.i): (r["last"], r.total) for r in out.collect()}
    for g in range(3):
        last, total = None, 0
        for _, i, v, n in [r for r in rows if r[0] == g]:
            last, total = v or last, total + n
            assert got[(g, i)] == (last, total)
    ranked = part_rank(df, ["g"], F.floor(F.col("i") / 10), [F.asc("i")]).collect()
    assert all(r.pos == r.i + 1 for r in ranked)


def test_similarity_is_the_library_ratio():
    def plain(a, b):
        na, nb = S.normal(a), S.normal(b)
        if not na or not nb:
            return 0.0
        if na == nb:
            return 1.0
        stop = set(T.STOP_WORDS)
        ta, tb = {w for w in na.split() if w not in stop}, {w for w in nb.split() if w not in stop}
        overlap = len(ta & tb) / min(len(ta), len(tb)) if ta and tb else 0.0
        ratio = difflib.SequenceMatcher(None, na, nb).ratio()
        inside = 0.88 if min(len(na), len(nb)) >= 4 and (na in nb or nb in na) else 0.0
        return max(0.85 * overlap + 0.15 * ratio, 0.9 * ratio, inside)

    words = ["Meeting Date", "date of meeting", "Owner (Vendor)", "due", "Zürich café", "", "the", "status: open", "action_items"]
    for a in words:
        for b in words:
            assert abs(S.similarity(a, b) - plain(a, b)) < 1e-12, (a, b)


def test_best_collection_folds_in_order(spark):
    random.seed(5)
    rows = [(1, f"r{k % 3}", k, [{"t": "x"}] * random.randint(0, 4), random.choice([0.1, 0.5, 0.9])) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, role string, ord bigint, items array<map<string,string>>, confidence double")
    want = {}
    for _, role, k, items, conf in rows:
        cur = want.get(role)
        if cur is None or len(items) > cur[1] or conf > cur[2]:
            want[role] = (k, len(items), conf)
    for size in (7, 50, 100000):
        got = {r.role: r.ord for r in X.best_collection(df, rows=size).collect()}
        assert got == {role: v[0] for role, v in want.items()}


def test_blocks_consume_lines_in_order(spark):
    text = "Date: 1 May\n  wrapped on\n\nItems:\n- a\n- b\n\nName | Role\nAnn | Lead\nBob | Dev\n\nSummary\n" + "word " * 12
    docs = spark.createDataFrame([(1, text), (2, "Summary\ntoo short")], "doc_id int, text string")
    found = read_blocks(docs, "text", ("doc_id",)).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.kind, r.label) for r in found] == [(1, "pair", "Date"), (1, "bullets", "Items"), (1, "table", "Items"), (1, "prose", "Summary")]


def test_scan_reads_no_content(spark, tmp_path):
    (tmp_path / "template").mkdir()
    (tmp_path / "template" / "a b.docx").write_bytes(b"12345")
    rows = I.inventory_scan(spark, str(tmp_path)).collect()
    assert [(r.name, r["size"]) for r in rows] == [("a b.docx", 5)] or rows[0]["size"] == 5


def test_merge_is_stable_under_partitioning(spark):
    rows = [("k", 1, None, 1), ("k", 2, None, 2), ("j", 1, None, 3)]
    df = spark.createDataFrame(rows, "key string, prefix_ord int, last_modified timestamp, size bigint")
    for n in (1, 7):
        got = {r.key: r["size"] for r in I.merge_listings(df.repartition(n)).collect()}
        assert got == {"k": 2, "j": 3}


def test_versions_and_areas(spark):
    df = spark.createDataFrame([("template/x/t/v1.10/a.docx",), ("previews/x.html",), ("a/previews/b.html",)], "key string")
    got = df.select(K.version_from_key(F.col("key")).alias("v"), K.classify_area(F.col("key")).alias("a")).collect()
    assert [(r.v, r.a) for r in got] == [("1.10", "templates"), ("1.0", "other"), ("1.0", "previews")]


def test_sessions_equal_a_walk_over_their_turns(spark):
    rng = random.Random(4)
    says = ["hello", "Venue: Hall 1\nPrepared by: Ann", "a short answer", "Purpose: to plan\nand more", "x" * 250, None, " ", "Venue: Hall 2\nthe second", "yes", "no: it is not. It is. Not"]
    rows = [(c, t, rng.choice(["user", "user", "assistant"]), rng.choice(says)) for c in range(60) for t in range(rng.randint(1, 12))]
    rows += [(100, t, "user", "yes") for t in range(5000)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    fields = ["purpose", "venue", "prepared_by", "owner"]
    read = sessions.user_turns(turns).collect()
    want = {}
    for r in sorted(read, key=lambda r: (r.conv_id, r.turn)):
        seen, answers = want.setdefault(r.conv_id, [0, {}])
        sessions.step(answers, fields, r.text or "", dict(r.found or {}), r.is_notes)
        want[r.conv_id][0] = seen + 1
    found = {r.conv_id: (r.turns, r.missing, r.answers) for r in sessions.session_answers(turns, fields).collect()}
    assert found == {
        c: (n, ",".join(f for f in fields if not a.get(f)), "; ".join(f"{f}={a[f]}" for f in fields if a.get(f))) for c, (n, a) in want.items()
    }


def test_activity_counts_late_rows_once(spark, tmp_path):
    from quire.streaming import streams

    put = streams.activity_sink(str(tmp_path))
    day = lambda *days: spark.createDataFrame([("templates/a.docx", f"2024-01-{d:02d} 12:00:00") for d in days], "key string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    put(day(10, 11), 0)
    put(day(9, 10, 12), 1)
    put(day(9, 10, 12), 1)  # the batch is run again
    put(day(), 2)
    found = {str(r.day): (r.templates, r["count"], r.late) for r in streams.activity_days(spark, str(tmp_path), "2024-01-13", 5).collect()}
    assert found == {"2024-01-09": (0, 0, 1), "2024-01-10": (2, 2, 0), "2024-01-11": (1, 1, 0), "2024-01-12": (1, 1, 0), "2024-01-13": (0, 0, 0)}


def test_listings_write_only_what_changes(spark, tmp_path):
    from quire.streaming import streams

    put = streams.latest_sink(str(tmp_path))
    rows = lambda *found: spark.createDataFrame(found, "key string, last_modified string, etag string").withColumn("last_modified", F.col("last_modified").cast("timestamp"))
    put(rows(("a", "2024-01-01", "1"), ("a", "2024-01-02", "2"), ("b", "2024-01-01", "1")), 0)
    put(rows(("a", "2024-01-01", "9"), ("b", "2024-01-01", "2")), 1)
    put(rows(("a", "2024-01-01", "9"), ("b", "2024-01-01", "2")), 1)
    assert sorted((r.key, r.etag) for r in streams.latest_objects(spark, str(tmp_path)).collect()) == [("a", "2"), ("b", "2")]
    assert [r.key for r in spark.read.parquet(f"{tmp_path}/latest/batch=1").collect()] == ["b"]


def test_arrays_become_rows_without_a_filter_ahead_of_the_exchange(spark):
    """The array is computed once, after the rows are dealt; nulls and empty arrays give no row."""
    from pyspark.sql import functions as F

    from quire.functions import text as T

    rows = spark.createDataFrame([(1, "a\nb"), (2, None), (3, "")], "k long, t string").repartition(3, "k")
    made = T.line_table(rows, ["k"], "t")
    assert sorted(tuple(r) for r in made.collect()) == [(1, 0, "a"), (1, 1, "b"), (3, 0, "")]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in plan
    none = T.unfolded(rows, ["k"], F.filter(T.lines(F.col("t")), lambda s: s == "z"))
    assert none.collect() == []


def test_words_are_counted_from_the_front(spark):
    from pyspark.sql import functions as F

    from quire.functions import text as T

    texts = ["", " ", "a b", "/a / b c", "one two three four five six seven eight", "one two three four five six seven eight nine", "a/b/c/d/e/f/g/h/i", "Five words end here now.", "w" * 81, "a:"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.looks_like_label("t").alias("l"), T.word_count_over(F.col("t"), 1).alias("n")).collect()
    assert [r.l for r in found] == [False, False, True, True, True, False, False, False, False, True]
    assert all(r.n == (len(r.t.split()) > 1) for r in found)
    once = spark.createDataFrame([("A: 1\nB: 2\nx\n- a: 3",)], "t string").select(F.map_entries(T.kv_map(F.col("t"))).alias("m"), T.bare_line(F.lit("\t -• * x y \r")).alias("b")).first()
    assert [tuple(e) for e in once.m] == [("b", "2"), ("a", "3")] and once.b == "x y"
