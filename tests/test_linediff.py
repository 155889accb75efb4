"""Line diffs of random texts: both sides can be read back, lines that stand once are matched as well as can be."""

from __future__ import annotations

import random

from quire.operators import linediff


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        up = row[:]
        for k, y in enumerate(b):
            row[k + 1] = up[k] + 1 if x == y else max(up[k + 1], row[k])
    return row[-1]


def test_line_diff(spark):
    rng = random.Random(9)
    pairs = {}
    for key in range(60):
        old = rng.sample([f"line {k}" for k in range(60)], rng.randint(0, 25))
        new = [x for x in old if rng.random() < 0.7]
        for _ in range(rng.randint(0, 4)):
            new.insert(rng.randint(0, len(new)), f"new {rng.randint(0, 99)}")
        if key % 3 == 0:
            rng.shuffle(new)
        pairs[key] = (old, new)
    for key in range(60, 100):  # lines that repeat
        old = rng.choices(["a", "b", "c", "x y"], k=rng.randint(0, 12))
        pairs[key] = (old, rng.choices(["a", "b", "c", "z"], k=rng.randint(0, 12)))
    many = [f"row {k % 700}" for k in range(30_000)]
    pairs[200] = (many, [*many[:15_000], "put in", *many[15_001:]])
    rows = [(k, "\n".join(o), "  \n".join(n) + "\n\n") for k, (o, n) in pairs.items()] + [(300, None, "a\n"), (301, "b", None), (302, "same", "same"), (303, None, None)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "pair long, old string, new string, gap string")
    ops = {}
    for r in linediff.line_ops(frame).collect():
        ops.setdefault(r.pair, []).append((r.seq, r.type, r.text))
    for key, (old, new) in pairs.items():
        made = sorted(ops.get(key, []))
        assert [t for _, kind, t in made if kind != "added"] == old and [t for _, kind, t in made if kind != "removed"] == new, key
        if key < 60:
            unique = [x for x in new if new.count(x) == 1]
            assert sum(kind == "context" for _, kind, _ in made) >= longest_common(old, unique), key
    assert sum(kind != "context" for _, kind, _ in ops[200]) == 2
    shown = {}
    for r in linediff.line_diff(frame).collect():
        shown.setdefault(r.pair, []).append((r.pos, r.type, r.text))
    assert [x[1:] for x in sorted(shown[200])] == [
        ("context", "row 0"), ("context", "row 1"), ("context", "…"), ("context", many[14_998]), ("context", many[14_999]), ("removed", many[15_000]), ("added", "put in"),
        ("context", many[15_001]), ("context", many[15_002]), ("context", "…"), ("context", many[-2]), ("context", many[-1]),
    ]
    assert shown[300] == [(0, "added", "a")] and shown[301] == [(0, "removed", "b")] and 302 not in shown and 303 not in shown
    changes = {(r.pair, r.field, r.change, r.before, r.after) for r in linediff.line_changes(frame).where("pair >= 200").collect()}
    assert changes == {(200, "line 15001", "updated", many[15_000], "put in"), (300, "line 1", "added", "", "a"), (301, "line 1", "removed", "b", "")}


def test_only_lines_that_may_be_changes_are_moved(spark):
    """Texts of pairs whose common lines keep their order stay where they are; a moved or repeated line brings all lines of its pair."""
    rows = [(1, "a\nb\nc\nd", "a\nx\nc\nd"), (2, "a\nb\nc", "b\na\nc"), (3, "a\nb", "a\na\nb"), (4, "", "\n".join(f"new {k}" for k in range(100)))]
    pairs = spark.createDataFrame(rows, "pair long, old string, new string")
    moved = {}
    for r in linediff._changed_lines(pairs, "new", "old").collect():
        moved.setdefault(r.pair, []).append((r.pos, r.line))
    assert sorted(moved[1]) == [(1, "x")] and len(moved[2]) == 3 and len(moved[3]) == 3 and len(moved[4]) == 100
    changes = {(r.pair, r.field, r.change, r.before, r.after) for r in linediff.line_changes(pairs).where("pair <= 3").collect()}
    assert (1, "line 2", "updated", "b", "x") in changes and sum(c[0] == 1 for c in changes) == 1
    assert sum(c[0] == 2 for c in changes) == 2 and {c[2:] for c in changes if c[0] == 3} == {("added", "", "a")}
