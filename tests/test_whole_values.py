"""What used to be cut: each former limit gets one item more than it allowed."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire.functions import keys as K, lists as L
from quire.functions.linescan import read_blocks
from quire.operators import knowledge as KB, lines as LN
from quire.plans import forms, slides


def only(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_lists_and_texts_are_whole(spark):
    nine = " ".join(f"Sentence number {k} goes here." for k in range(9))
    assert len(only(spark, L.flow_steps(F.lit(nine)))) == 9
    assert only(spark, L.map_vocab(F.lit("q" * 41), {"a": "A"}, "none")) == "q" * 41
    assert only(spark, K.slugify(F.lit("w " * 49))).count("w") == 49
    five = F.array(*[F.lit(f"users wait for part {k}") for k in range(5)])
    breaks, _ = forms.split_misplaced(five, F.array().cast("array<string>"))
    assert len(only(spark, breaks)) == 5
    assert len(only(spark, slides.section_points(five, 4))) == 5


def test_blocks_take_all_lines(spark):
    wrapped = "Key: first\n" + "\n".join(f"more {k} words, of the value" for k in range(40))
    found = read_blocks(spark.createDataFrame([(1, wrapped)], "doc_id int, text string"), "text", ("doc_id",)).collect()
    assert len(found) == 1 and "more 39 words" in found[0].value


def test_audit_feed_filters_before_any_limit(spark):
    events = spark.createDataFrame([(k, k % 100, k) for k in range(1000)], "event_id int, template_id int, created_at int")
    assert LN.audit_feed(events, 3).count() == 10
    assert [r.event_id for r in LN.audit_feed(events, 3, n=2).collect()] == [903, 803]


def test_passages_are_whole(spark):
    chunks = spark.createDataFrame([("10", 1, "T", "x" * 701, "body", ["10.5"])], "root string, slide_number int, title string, content string, category string, process_codes array<string>")
    scopes = spark.createDataFrame([(1, "10", "10"), (2, "10", "10.5")], "qid int, root string, scope string")
    assert [len(r.body) for r in KB.kb_passages(chunks, scopes).collect()] == [701, 701]


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    from quire import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())
