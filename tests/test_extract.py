"""Blocks of texts by worked examples, and the fold of lists against a plain walk."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quire.functions.linescan import read_blocks
from quire.plans import extract

NOTE = """Meeting Date: 2024-01-02
  and a wrapped line, as it is
- Owner: Ada

Action items:

- one — Ada
2) two
after the list
Plan
| Task | Owner |
|---|---|
| Build | Ada |
col: a | b
alone | x
Summary

The plan of the north team stays
within the budget: nobody asks for more

and that was all of it


Not part of it, since two blank lines come before."""

BLOCKS = [
    ("pair", "Meeting Date", "2024-01-02 and a wrapped line, as it is", [], []),
    ("pair", "Owner", "Ada", [], []),
    ("bullets", "Action items", "", ["one — Ada", "two"], []),
    ("table", "Plan", "", [], [["Task", "Owner"], ["Build", "Ada"], ["col: a", "b"], ["alone", "x"]]),
    ("prose", "Summary", "The plan of the north team stays within the budget: nobody asks for more and that was all of it", [], []),
]


def blocks_of(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {}
    for r in sorted(read_blocks(frame, "text", ("doc_id",)).collect(), key=lambda r: (r.doc_id, r.pos)):
        rows = [list(r.header), *[list(x) for x in r.rows]] if r.header else []
        out.setdefault(r.doc_id, []).append((r.kind, r.label, r.value, list(r["items"]), rows))
    return out


def test_blocks(spark):
    long = "Heading:\n" + "\n".join(["- point"] * 30_000) + "\n\nKey: value\n" + "\n".join(["goes on, and on"] * 30_000) + "\n\nT\n" + "\n".join(["a | b"] * 30_000)
    cases = [
        NOTE, None, "", "\n\n",
        # too short for prose, so its lines are read for themselves; a lone row is no table
        "Title\nshort, text\nKey: value\none | row\nLast - thing",
        # a table that starts with a pair is none; a rule needs two rows
        "ab: b | c\nd | e\n---|---\nx, y",
        # one bullet in a list may read as a pair; at the start of a block it is one
        "- Owner: Ada\nTeam:\n- Lead: Bela\n- Cleo",
        "# Long title of a text that goes on for more than six words\n" + "word " * 10 + "\n# Next",
        long,
    ]
    found = blocks_of(spark, cases)
    assert found[0] == BLOCKS
    assert not any(k in found for k in (1, 2, 3))
    assert found[4] == [("pair", "Key", "value", [], []), ("pair", "Last", "thing", [], [])]
    assert found[5] == [("pair", "ab", "b | c", [], [])]
    assert found[6] == [("pair", "Owner", "Ada", [], []), ("bullets", "Team", "", ["Lead: Bela", "Cleo"], [])]
    assert found[7] == [("prose", "Long title of a text that goes on for more than six words", ("word " * 10).strip(), [], [])]
    kinds = [(k, len(i) or len(r) or len(v)) for k, _, v, i, r in found[8]]
    assert kinds == [("bullets", 30_000), ("pair", len("value") + 30_000 * len(" goes on, and on")), ("table", 30_000)]


def walk(rows):
    """The fold over (ord, size, confidence) in order."""
    current = None
    for row in sorted(rows):
        if current is None or row[1] > current[1] or row[2] > current[2]:
            current = row
    return current


def test_lists_are_folded_alike_at_every_size(spark):
    rng = random.Random(3)
    sizes = {1: 1, 2: 5, 3: 300, 4: 20_001}
    rows = []
    for doc, n in sizes.items():
        for role in ("one_place", "many_places"):
            for _ in range(n):
                rows.append((doc, role, 7 if role == "one_place" else rng.randrange(3 * n), rng.randrange(4), round(rng.random(), 2)))
    frame = spark.createDataFrame(rows, "doc_id long, role string, ord long, n int, confidence double").withColumn(
        "items", F.array_repeat(F.create_map(F.lit("k"), F.lit("v")), F.col("n"))
    ).withColumn("evidence", F.col("ord").cast("string"))
    for part in (20_000, 50):
        found = {(r.doc_id, r.role): (r.ord, len(r["items"]), r.confidence) for r in extract.best_collection(frame, part).collect()}
        assert found == {(d, role): walk([(o, n, c) for x, y, o, n, c in rows if (x, y) == (d, role)]) for d, role in {(x, y) for x, y, *_ in rows}}
    assert extract.best_collection(frame.limit(0)).count() == 0
