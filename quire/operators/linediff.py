"""Line diff of pairs of texts over line tables: anchors by equi join, the longest increasing run of them, runs of equal lines.

The n-th time that a line stands in the old text is held against the n-th time in the new one. Of these anchors the
longest run that increases on both sides is kept; it is found on positions only. Between two anchors, equal lines next
to either of them belong to it, which a join on positions and a minimum per gap decide. What is left of a gap was removed
or added. Lines travel as hashes, and as positions once the anchors are found; they are read again from the texts at the
very end, for the rows that are shown.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import text as T
from quire.operators.ordered import PART_ROWS, carry_forward, part_rank, running_sum
from quire.sources.staged import staged

CONTEXT = 2
#: A text with more distinct lines than this that the other lacks is not searched for them line by line.
FEW = 64
_ANCHOR = "pair bigint, i bigint, j bigint"


def _bare(side: str) -> Column:
    """The lines that are not blank, without trailing blanks."""
    bare = F.transform(T.lines(F.coalesce(side, F.lit(""))), lambda s: F.regexp_replace(s, r"\s+$", ""))
    return F.filter(bare, lambda s: s != "")


def _lines(pairs: DataFrame, side: str) -> DataFrame:
    """pair, pos, line of one of the texts."""
    return T.unfolded(pairs, ["pair"], _bare(side), "line").select("pair", F.col("pos").cast("bigint").alias("pos"), "line")


def _changed_lines(pairs: DataFrame, side: str, other: str) -> DataFrame:
    """``_lines`` without those that are sure to be context.

    Where the lines that both texts hold stand in one order in both, as often in one as in the other, each is an anchor, and
    only lines that the other text lacks are changes. That is judged where the texts lie; a pair of which it does not hold,
    or whose texts differ in many lines, keeps all its lines.
    """
    hashed = lambda lines: F.transform(lines, lambda s: F.xxhash64(s))
    both = pairs.select("pair", _bare(side).alias("__l"), hashed(_bare(other)).alias("__o")).withColumn("__h", hashed(F.col("__l")))
    lacking = both.withColumns({"__own": F.array_except("__h", "__o"), "__theirs": F.array_except("__o", "__h")})
    few = (F.size("__own") <= FEW) & (F.size("__theirs") <= FEW)
    common = lambda lines, rest: F.filter(lines, lambda h: ~F.array_contains(rest, h))
    judged = lacking.withColumn("__sure", F.when(few, common(F.col("__h"), F.col("__own")) == common(F.col("__o"), F.col("__theirs"))).otherwise(False))
    place = F.transform("__l", lambda line, i: F.struct(i.cast("bigint").alias("pos"), line.alias("line")))
    kept = F.when(F.col("__sure"), F.filter(place, lambda p: F.array_contains("__own", F.get("__h", p["pos"].cast("int"))))).otherwise(place)
    return T.unfolded(judged, ["pair"], kept, "p", "at").select("pair", "p.pos", "p.line")


def _hashed(pairs: DataFrame, side: str) -> DataFrame:
    return staged(_lines(pairs, side).select("pair", "pos", F.xxhash64("line").alias("h")), side)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of (i, j), given by ascending i, in which j increases too."""
    tops: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect.bisect_left(tops, j)
        before[k] = ends[at - 1] if at else -1
        if at == len(tops):
            tops.append(j)
            ends.append(k)
        else:
            tops[at], ends[at] = j, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidates in order of (pair, i) to the anchors of each pair."""
    rows = (row for batch in batches for row in batch.itertuples(index=False, name=None))
    kept = ((pair, i, j) for pair, group in itertools.groupby(rows, key=lambda r: r[0]) for i, j in _increasing([(i, j) for _, i, j in group]))
    while some := list(itertools.islice(kept, 10_000)):
        yield pd.DataFrame(some, columns=["pair", "i", "j"])


def _counted(lines: DataFrame) -> DataFrame:
    """The how-manieth of its kind each line is; a line that repeats is ranked by parts of its positions."""
    return part_rank(lines.select("pair", "pos", "h"), ["pair", "h"], F.floor(F.col("pos") / PART_ROWS), [F.col("pos")], "nth", nulls=False)


def _keyed(pairs: DataFrame, key: str) -> DataFrame:
    return pairs.select(F.col(key).cast("bigint").alias("pair"), "old", "new").where(F.col("pair").isNotNull() & ~F.col("old").eqNullSafe(F.col("new")))


def _with_text(ops: DataFrame, kind: str, lines: DataFrame) -> DataFrame:
    """The rows of one kind with ``text``, the line that stands at ``pos``."""
    return ops.where(F.col("type") == kind).join(lines.groupBy("pair", "pos").agg(F.min("line").alias("text")), ["pair", "pos"])


def _told(ops: DataFrame, keyed: DataFrame) -> DataFrame:
    """Adds ``text``: of the new text for an added line, else of the old one."""
    old = _with_text(ops.withColumns({"__type": F.col("type"), "type": F.when(F.col("type") != "added", "old")}), "old", _lines(keyed, "old"))
    new = _with_text(ops, "added", _changed_lines(keyed, "new", "old"))
    return old.withColumn("type", F.col("__type")).drop("__type").unionByName(new)


def line_ops(pairs: DataFrame, key: str = "pair") -> DataFrame:
    """All lines of both texts in order: pair, seq, type (context, removed, added), text, gap, k, line.

    ``gap`` names the hunk of a removed or added line and ``k`` its place among the removed or the added of it; ``line``
    is the number, from 0, of the hunk's first line in the old text. Null texts are empty; pairs of equal texts
    are left out; the key of a pair is unique.
    """
    keyed = _keyed(pairs, key)
    return _told(staged(_placed_ops(keyed), "ops"), keyed).select("pair", "seq", "type", "text", "gap", "k", "line")


def _placed_ops(keyed: DataFrame) -> DataFrame:
    """``line_ops`` with ``pos``, the place of a line in its text, for the text of the line."""
    old, new = _hashed(keyed, "old"), _hashed(keyed, "new")
    left = _counted(old).select("pair", "h", "nth", F.col("pos").alias("i"))
    right = _counted(new).select("pair", "h", "nth", F.col("pos").alias("j"))
    met = left.join(right, ["pair", "h", "nth"]).select("pair", "i", "j")
    anchors = staged(met.repartition("pair").sortWithinPartitions("pair", "i").mapInPandas(_runs, _ANCHOR), "anchors")
    sizes = keyed.select("pair").join(old.groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair", "left").join(new.groupBy("pair").agg(F.count(F.lit(1)).alias("m")), "pair", "left")
    ends = sizes.select("pair", F.coalesce("n", F.lit(0)).cast("bigint").alias("i"), F.coalesce("m", F.lit(0)).cast("bigint").alias("j"))
    starts = keyed.select("pair", F.lit(-1).cast("bigint").alias("i"), F.lit(-1).cast("bigint").alias("j"))
    # the number of an anchor within its pair, and the anchor after it
    every = part_rank(starts.unionByName(anchors).unionByName(ends), ["pair"], F.floor(F.col("i") / PART_ROWS), [F.col("i")], "gap", nulls=False)
    after = every.select("pair", (F.col("gap") - 1).alias("gap"), F.col("i").alias("i1"), F.col("j").alias("j1"))
    gaps = staged(every.select("pair", "gap", F.col("i").alias("i0"), F.col("j").alias("j0")).join(after, ["pair", "gap"]), "gaps")

    def placed(lines: DataFrame, at: str) -> DataFrame:
        """Lines that are no anchors, with the gap that they stand in."""
        marks = gaps.where(F.col(at) >= 0).select("pair", F.col(at).alias("pos"), F.col("gap").alias("mark"))
        marked = lines.join(marks, ["pair", "pos"], "left").withColumn("h", F.when(F.col("mark").isNull(), F.col("h")))
        carried = carry_forward(marked, ["pair"], "pos", F.col("mark"), "gap")
        return carried.where("mark is null").drop("mark").withColumn("gap", F.coalesce("gap", F.lit(1)).cast("bigint")).join(gaps, ["pair", "gap"])

    here = staged(placed(old, "i0"), "left")
    there = staged(placed(new, "j0"), "right")
    probe = there.select("pair", "gap", F.col("pos").alias("q"), F.col("h").alias("other"))

    def run(step: Column, q: Column, out: str) -> DataFrame:
        """Per gap the number of lines that equal their counterparts without a break."""
        asked = here.select("pair", "gap", "h", step.alias("t"), q.alias("q"), (F.col("i1") - F.col("i0") - 1).alias("n"), (F.col("j1") - F.col("j0") - 1).alias("m"))
        judged = asked.join(probe, ["pair", "gap", "q"], "left")
        broken = F.min(F.when(~F.coalesce(F.col("h") == F.col("other"), F.lit(False)), F.col("t")))
        return judged.groupBy("pair", "gap").agg(F.least(F.coalesce(broken - 1, F.max("n")), F.max("n"), F.max("m")).alias(out))

    forward = run(F.col("pos") - F.col("i0"), F.col("j0") + F.col("pos") - F.col("i0"), "f")
    backward = run(F.col("i1") - F.col("pos"), F.col("j1") - (F.col("i1") - F.col("pos")), "g")
    zero = F.lit(0).cast("bigint")
    shaped = gaps.join(forward, ["pair", "gap"], "left").join(backward, ["pair", "gap"], "left").withColumn("f", F.coalesce("f", zero))
    room = F.least(F.col("i1") - F.col("i0") - 1, F.col("j1") - F.col("j0") - 1) - F.col("f")
    shaped = staged(shaped.withColumn("g", F.least(F.coalesce("g", zero), room)).select("pair", "gap", "f", "g"), "shapes")

    def split(lines: DataFrame, low: str, high: str) -> DataFrame:
        both = lines.join(shaped, ["pair", "gap"])
        ahead, behind = F.col("pos") - F.col(low), F.col(high) - F.col("pos")
        return both.withColumns({"phase": F.when(ahead <= F.col("f"), 0).when(behind <= F.col("g"), 3).otherwise(1), "k": ahead - F.col("f") - 1, "first": F.col("i0") + F.col("f") + 1})

    shape = ["pair", "gap", "phase", "pos", "type", "k", "first"]
    theirs = split(here, "i0", "i1").withColumn("type", F.when(F.col("phase") == 1, "removed").otherwise("context")).select(*shape)
    ours = split(there, "j0", "j1").where("phase = 1").withColumns({"type": F.lit("added"), "phase": F.lit(2)}).select(*shape)
    kept = old.join(gaps.select("pair", F.col("i0").alias("pos"), "gap"), ["pair", "pos"]).select(
        "pair", "gap", F.lit(-1).alias("phase"), "pos", F.lit("context").alias("type"), F.lit(None).cast("bigint").alias("k"), F.lit(None).cast("bigint").alias("first")
    )
    rows = kept.unionByName(theirs).unionByName(ours)
    numbered = part_rank(rows, ["pair"], F.floor(F.col("gap") / PART_ROWS), [F.col("gap"), F.col("phase"), F.col("pos")], "seq", nulls=False)
    return numbered.select("pair", "seq", "type", "pos", "gap", "k", F.col("first").alias("line"))


def line_diff(pairs: DataFrame, key: str = "pair") -> DataFrame:
    """Line diff of (pair, old, new) texts: pair, pos, type, text; long equal stretches keep two lines at each end."""
    keyed = _keyed(pairs, key)
    ops = staged(_placed_ops(keyed).select("pair", "seq", "type", "pos"), "ops")
    stretch = running_sum(ops, ["pair"], "seq", F.when(F.col("type") == "context", 0).otherwise(1), "stretch", nulls=False)
    context = F.col("type") == "context"
    sizes = stretch.where(context).groupBy("pair", "stretch").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    both = stretch.join(sizes, ["pair", "stretch"], "left")
    place = F.col("seq") - F.col("first")
    cut = context & (F.col("n") > 2 * CONTEXT)
    inner = cut & (place >= CONTEXT) & (place < F.col("n") - CONTEXT)
    kept = both.where(~F.coalesce(inner, F.lit(False)) | (place == CONTEXT)).select("pair", "seq", "type", "pos", (inner & (place == CONTEXT)).alias("left_out"))
    changed = ops.where(~context).select("pair").distinct()
    ranked = part_rank(kept.join(changed, "pair", "left_semi"), ["pair"], F.floor(F.col("seq") / PART_ROWS), [F.col("seq")], "at", nulls=False)
    told = _told(staged(ranked, "shown"), keyed)
    return told.select("pair", (F.col("at") - 1).cast("int").alias("pos"), "type", F.when(F.coalesce("left_out", F.lit(False)), "…").otherwise(F.col("text")).alias("text"))


def line_changes(pairs: DataFrame, key: str = "pair") -> DataFrame:
    """What changed line by line: pair, field (``line 7``, counted in the old text), change, before, after.

    The k-th line removed by a hunk is held against the k-th that it adds.
    """
    keyed = _keyed(pairs, key)
    ops = staged(_placed_ops(keyed).where("type <> 'context'"), "ops")

    def side(kind: str, texts: str, other: str, name: str) -> DataFrame:
        return _with_text(ops, kind, _changed_lines(keyed, texts, other)).select("pair", "gap", "k", "line", F.col("text").alias(name))

    both = side("removed", "old", "new", "before").join(side("added", "new", "old", "after"), ["pair", "gap", "k", "line"], "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("updated")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).select(
        "pair", F.concat(F.lit("line "), (F.col("line") + F.col("k") + 1).cast("string")).alias("field"), change.alias("change"),
        F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"),
    )
