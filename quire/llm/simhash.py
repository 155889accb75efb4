"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

A fingerprint has a bit set where over half of the document's 3-word shingle hashes have it. Equal fingerprints are one
leaf of the trie, so copies never meet each other. The sorted leaves are cut into chunks by ranges; each chunk hangs
under its top bits. Pairs of top nodes are met by flipping up to three of those bits, which is the traversal's first
step with its differing bits as the error so far; the rest of each pair of chunks is traversed together in one task,
one bit at a time, and a pair of nodes is left as soon as its differing bits exceed the budget. Two nodes whose leaves
are known to be one component are left as well, so that dense groups cost no quadratic work. What a task returns is a
star for each component it saw; ``components`` joins the stars.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import batch_of, keyed_text, raw, stored
from quire.llm.components import components

SEED = 42
WORDS = 3
BUDGET = 3
#: Fingerprints of a chunk: 64 KB, so that a pair of chunks is a small task whatever the input.
CHUNK = 8192
#: Pairs of nodes that are expanded at once, and of leaves that are compared at once.
BLOCK = 1 << 18

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PRINTS = pa.schema([("id", pa.int64()), ("text_key", pa.int64()), ("fp", pa.int64())])
_CHUNKS = pa.schema([("top", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("leaves", pa.binary())])
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """The unsigned fingerprint of one text; zero if it has no word."""
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) < words:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, ones, digest = len(parts) - words + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        to = min(n, at + BLOCK)
        spans = zip(starts[at:to].tolist(), ends[at + words - 1 : to + words - 1].tolist(), strict=True)
        hashes = np.array([digest(line[i:j], SEED) for i, j in spans], dtype="<u8").view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            ones[8 * byte : 8 * byte + 8] += np.bincount(hashes[:, byte], minlength=256) @ _BITS
    return sum(1 << k for k in np.flatnonzero(2 * ones > n).tolist())


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = raw(batch, "text")
        keys = [_signed(xxhash.xxh64_intdigest(t or b"", SEED)) for t in texts]
        yield batch_of(_PRINTS, [batch.column(0), keys, [_signed(fingerprint(t)) for t in texts]])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``text_key`` (the text's own hash) and ``fp`` (the fingerprint as a signed long), one row per row."""
    return keyed_text(docs, id_col, text_col).mapInArrow(_prints, "id long, text_key long, fp long")


def _chunks(top_bits: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted fingerprints of one range, as chunks of one top node each."""
        rest = np.empty(0, np.int64)

        def whole(values: np.ndarray, last: bool) -> tuple[list, np.ndarray]:
            rows, tops = [], values.view(np.uint64) >> np.uint64(64 - top_bits)
            edges = np.flatnonzero(np.diff(tops)) + 1
            groups = np.split(values, edges)
            for k, group in enumerate(groups):
                pieces = np.split(group, range(CHUNK, len(group), CHUNK))
                if k == len(groups) - 1 and not last:
                    values = pieces.pop()
                rows += [(int(np.uint64(p[:1].view(np.uint64)[0]) >> np.uint64(64 - top_bits)), int(p[0]), int(p[-1]), p.tobytes()) for p in pieces if len(p)]
            return rows, values

        for batch in batches:
            values = np.concatenate((rest, batch.column(0).to_numpy()))
            if len(values):
                rows, rest = whole(values, False)
                if rows:
                    yield batch_of(_CHUNKS, list(zip(*rows, strict=True)))
        if len(rest):
            yield batch_of(_CHUNKS, list(zip(*whole(rest, True)[0], strict=True)))

    return cut


class Forest:
    """Components of the leaves of one pair of chunks."""

    def __init__(self, size: int) -> None:
        self.root = np.arange(size)
        self._steps()

    def _steps(self) -> None:
        self.steps = np.concatenate(([0], np.cumsum(self.root[1:] != self.root[:-1])))

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        changed = False
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y, changed = a[apart], b[apart], x[apart], y[apart], True
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up
        if changed:
            self._steps()

    def known(self, a0, a1, b0, b1) -> np.ndarray:
        """Whether all leaves of both nodes are in one component already."""
        one = (self.steps[a1 - 1] == self.steps[a0]) & (self.steps[b1 - 1] == self.steps[b0])
        return one & (self.root[a0] == self.root[b0])


def trie_join(left: np.ndarray, right: np.ndarray | None, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Leaves and their roots, for leaves linked to others: sorted unsigned fingerprints against others, or themselves.

    Nodes are ranges of the sorted leaves. One step of the traversal splits both nodes of a pair by the next bit into
    up to four pairs; those that differ in the bit have one error more.
    """
    leaves = left if right is None else np.concatenate((left, right))
    shift, forest = 0 if right is None else len(left), Forest(len(leaves))
    whole = np.array([[0], [len(left)], [shift], [len(leaves)], [0]], dtype=np.int64)
    ones: dict[int, np.ndarray] = {}
    stack = [(0, whole)]
    while stack:
        depth, nodes = stack.pop()
        nodes = nodes[:, ~forest.known(*nodes[:4])] if depth else nodes
        sizes = (nodes[1] - nodes[0]) * (nodes[3] - nodes[2])
        small = (sizes <= 32) | (depth == 64)
        if small.any():
            _compare(leaves, nodes[:4, small], sizes[small], budget, forest)
            nodes = nodes[:, ~small]
        if not nodes.shape[1]:
            continue
        if depth not in ones:
            ones[depth] = np.concatenate(([0], np.cumsum((leaves >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)))
        count = ones[depth]
        a0, a1, b0, b1, err = nodes
        am, bm = a1 - (count[a1] - count[a0]), b1 - (count[b1] - count[b0])
        for half in np.array_split(np.arange(nodes.shape[1]), nodes.shape[1] // BLOCK + 1):
            parts = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1), (am, a1, b0, bm, err + 1)]
            new = np.concatenate([np.stack([c[half] for c in p]) for p in parts], axis=1)
            keep = (new[0] < new[1]) & (new[2] < new[3]) & (new[4] <= budget)
            if right is None:
                keep &= new[0] <= new[2]
            if keep.any():
                stack.append((depth + 1, new[:, keep]))
    mine = np.flatnonzero(forest.root != np.arange(len(leaves)))
    return leaves[mine], leaves[forest.root[mine]]


def _compare(leaves: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, budget: int, forest: Forest) -> None:
    """Compare all leaves of pairs of small nodes (or of full depth), some at a time."""
    steps = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(steps, (steps[at - 1] if at else 0) + 4 * BLOCK, "right")))
        a0, _, b0, b1 = nodes[:, at:to]
        size = sizes[at:to]
        pair = np.repeat(np.arange(to - at), size)
        within = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        width = (b1 - b0)[pair]
        a, b = a0[pair] + within // width, b0[pair] + within % width
        near = (np.bitwise_count(leaves[a] ^ leaves[b]) <= budget) & (a != b)
        if near.any():
            forest.join(a[near], b[near])
        at = to


def _join_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a = np.sort(np.frombuffer(left, np.uint64))
            linked, root = trie_join(a, None if right is None else np.sort(np.frombuffer(right, np.uint64)))
            if len(linked):
                yield batch_of(_EDGES, [linked.view(np.int64), root.view(np.int64)])


def fingerprint_links(leaves: DataFrame, n: int, budget: int = BUDGET) -> DataFrame:
    """Edges ``a``, ``b`` that connect the distinct fingerprints ``fp`` (``n`` of them) as links within the budget do."""
    bits = min(24, max(2, math.ceil(math.log2(max(n, 1) / CHUNK))))
    chunks = leaves.select("fp").repartitionByRange("fp").sortWithinPartitions("fp").mapInArrow(_chunks(bits), "top long, low long, high long, leaves binary")
    chunks = stored(chunks, "chunks")
    flips = [sum(1 << b for b in c) for k in range(budget + 1) for c in itertools.combinations(range(bits), k)]
    # bits that all fingerprints of a chunk share: those above the highest bit in which its ends differ
    shared = "case when low = high then -1L when (low ^ high) < 0 then 0L else shiftleft(-1L, length(bin(low ^ high))) end"
    one = chunks.withColumn("shared", F.expr(shared))
    near = one.select(F.col("top").alias("p"), F.explode(F.lit(flips)).alias("flip"), F.col("low").alias("l_low"), F.col("shared").alias("l_shared"), F.col("leaves").alias("l"))
    near = near.withColumn("q", F.expr("p ^ flip")).where("q >= p")
    other = one.select(F.col("top").alias("q"), F.col("low").alias("r_low"), F.col("shared").alias("r_shared"), F.col("leaves").alias("r"))
    pairs = near.join(other, "q").where(f"(q > p or l_low <= r_low) and bit_count((l_low ^ r_low) & l_shared & r_shared) <= {budget}")
    pairs = pairs.select("l", F.expr("if(q = p and l_low = r_low, null, r)").alias("r"))
    tasks = max(1, leaves.sparkSession.sparkContext.defaultParallelism * 4)
    return pairs.repartition(tasks).mapInArrow(_join_pairs, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """``id``, ``text_key``, ``fp`` (signed long), ``root`` (the group's own fingerprint) and ``component`` (smallest id of
    the group), one row per row of ``docs``.

    A null or empty text has fingerprint zero and is linked like any other; texts of one or two words hash the whole
    sequence; repeated rows are in one group; rows without an id are grouped but never name a group, and a group of
    such rows alone has a null component. An empty table gives no rows.
    """
    marked = stored(fingerprints(docs, id_col, text_col), "prints")
    leaves = stored(marked.groupBy("fp").agg(F.min("id").alias("low")), "leaves")
    links = fingerprint_links(leaves, leaves.count(), budget)
    roots = components(links)
    rooted = leaves.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("low").alias("component"))
    named = rooted.select("fp", "root").join(named, "root").select("fp", "root", "component")
    return marked.join(named, "fp").select("id", "text_key", "fp", "root", "component")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their group: one row of each.

    It is a row with the group's smallest id, rows without an id last; among such rows (repeated ids) the one whose text
    and then whose columns have the smallest hash.
    """
    groups = simhash_groups(docs, id_col, text_col, budget).groupBy("root", "id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key", "n")).alias("f"))
    first = stored(first.select(F.col("f.id").alias("__id"), F.col("f.text_key").alias("__key"), F.col("f.n").alias("__n")), "first")
    key = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))

    def met(wanted: DataFrame) -> DataFrame:
        return docs.join(wanted, docs[id_col].cast("long").eqNullSafe(wanted["__id"]) & (key == wanted["__key"]), "left_semi")

    single, repeated = met(first.where("__n = 1")), first.where("__n > 1")
    if repeated.isEmpty():
        return single
    one = met(repeated).groupBy(F.col(id_col).alias("__id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("__key"))
    one = one.agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__row"))
    return single.union(one.select(*[F.col("__row").getField(c) for c in docs.columns]))
