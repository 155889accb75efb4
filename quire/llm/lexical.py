"""Ranked lexical search by presence masks: the best documents for each item, scored in whole numbers.

Items are the queries and documents the collection. A task reads its documents in blocks and keeps, for each term of the
items, the documents of the block that hold it. For an item, every document gets a bitmap of the item's terms that it
holds (one OR per term over the term's documents), and documents with equal bitmaps are one group: all that can differ
inside a group are frequencies and lengths. The sum of the largest contribution of each term in the mask is the most
that any document of the group can score. Groups are taken by descending maximum, in growing rounds, and scored exactly;
as soon as the next maximum is below the tenth score that the task has found so far, no other document can enter. A task
hands on ten rows an item, which are ranked in two levels.

Items are dealt to passes of about ``PASS_TERMS`` distinct terms. What a pass sends to the tasks (its terms, their
weights, the items) has that bound; the documents are never shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import batch_of, raw, stored

TOP = 10
#: Distinct terms of the items of one pass, about; a single longer item is a pass of its own.
PASS_TERMS = 100_000
#: Documents and postings of a block.
BLOCK_DOCS = 8192
BLOCK_POSTINGS = 1 << 20
#: Documents that the first round of an item scores; each further round takes twice as many.
FIRST_ROUND = 64
#: Parts that the candidates of an item are ranked in before they meet.
PARTS = 64

_LETTERS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_NONE = np.iinfo(np.int64).max


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in order: runs of ASCII letters and digits and of all other code points, A-Z lower-cased."""
    return (text or b"").translate(_LETTERS).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


_STATS = pa.schema([("term", pa.binary()), ("n", pa.int64()), ("size", pa.int64())])


def _counting(vocabulary: frozenset[bytes]):
    """Per partition: documents that hold each term, and in the row without a term the documents and their length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        docs = size = 0
        for batch in batches:
            for text in raw(batch, "text"):
                found = terms(text)
                if found:
                    docs, size = docs + 1, size + len(found)
                    held.update(vocabulary.intersection(found))
        yield batch_of(_STATS, [[None, *held], [docs, *held.values()], [size, *[0] * len(held)]])

    return count


class Block:
    """The postings of some documents, by document and by term."""

    def __init__(self, n_terms: int) -> None:
        self.n_terms = n_terms
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.counts: list[int] = []
        self.term: list[int] = []
        self.tf: list[int] = []

    def add(self, key: int | None, length: int, found: dict[int, int]) -> None:
        self.ids.append(key)
        self.lengths.append(length)
        self.counts.append(len(found))
        self.term += found.keys()
        self.tf += found.values()

    def close(self) -> None:
        """``impact`` is what a posting adds for each unit of its term's weight; ``most`` its maximum per term."""
        counts, term, tf = (np.array(x, np.int64) for x in (self.counts, self.term, self.tf))
        doc = np.repeat(np.arange(len(counts)), counts)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(np.array(self.lengths, np.int64), counts))
        self.doc_ends, self.doc_term = np.concatenate([[0], np.cumsum(counts)]), term
        order = np.argsort(term, kind="stable")
        self.term_ends = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=self.n_terms))])
        self.term_doc = doc[order]
        self.most = np.zeros(self.n_terms, np.int64)
        np.maximum.at(self.most, term, self.impact)
        self.key = np.array([_NONE if k is None else k for k in self.ids], np.int64)
        self.none = np.array([k is None for k in self.ids], bool)

    def masks(self, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct non-empty masks as rows of bits, and for each document the number of its mask (-1: none)."""
        words = np.zeros((len(self.key), (len(item) + 63) // 64), np.uint64)
        for j, t in enumerate(item.tolist()):
            words[self.term_doc[self.term_ends[t] : self.term_ends[t + 1]], j >> 6] |= np.uint64(1 << (j & 63))
        some = np.flatnonzero(words.any(axis=1))
        if words.shape[1] == 1:
            distinct, which = np.unique(words[some, 0], return_inverse=True)
            distinct = distinct[:, None]
        else:
            distinct, which = np.unique(words[some], axis=0, return_inverse=True)
        group = np.full(len(self.key), -1, np.int64)
        group[some] = which.reshape(-1)
        bits = np.unpackbits(np.ascontiguousarray(distinct).view(np.uint8), axis=1, bitorder="little")[:, : len(item)]
        return bits, group

    def scores(self, docs: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """Exact scores of some documents; ``gain`` is the weight of every term, zero outside the item."""
        starts, ends = self.doc_ends[docs], self.doc_ends[docs + 1]
        sizes = ends - starts
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        out = np.zeros(len(docs), np.int64)
        np.add.at(out, np.repeat(np.arange(len(docs)), sizes), gain[self.doc_term[at]] * self.impact[at])
        return out


class Best:
    """The best rows of one item so far: score, id, whether the id is null."""

    def __init__(self, top: int) -> None:
        self.top = top
        self.rows = np.empty((0, 3), np.int64)

    def least(self) -> int:
        """A document that scores below this can't enter."""
        return int(self.rows[-1, 0]) if len(self.rows) == self.top else 1

    def add(self, rows: np.ndarray) -> None:
        both = np.concatenate([self.rows, rows[rows[:, 0] >= self.least()]])
        self.rows = both[np.lexsort((both[:, 2], both[:, 1], -both[:, 0]))][: self.top]


def search_block(block: Block, item: np.ndarray, weights: np.ndarray, best: Best, first: int = FIRST_ROUND) -> int:
    """Bring the block's documents for one item into ``best``; returns how many were scored."""
    bits, group = block.masks(item)
    limits = bits.astype(np.int64) @ (weights[item] * block.most[item])
    order = np.argsort(-limits, kind="stable")
    limits = limits[order]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    some = np.flatnonzero(group >= 0)
    by_rank = some[np.argsort(rank[group[some]], kind="stable")]
    ends = np.cumsum(np.bincount(rank[group[some]], minlength=len(order)))
    gain = np.zeros(block.n_terms, np.int64)
    gain[item] = weights[item]
    at = mask = 0
    while mask < len(limits) and limits[mask] >= best.least():
        open_ = int(np.searchsorted(-limits, -best.least(), "right"))
        mask = min(open_, int(np.searchsorted(ends, at + first)) + 1)
        docs, at, first = by_rank[at : ends[mask - 1]], int(ends[mask - 1]), 2 * first
        best.add(np.stack([block.scores(docs, gain), block.key[docs], block.none[docs]], axis=1))
    return at


_FOUND = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _searching(vocabulary: dict[bytes, int], weights: np.ndarray, items: list[np.ndarray], n_docs: int, size: int, top: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in items]
        block = Block(len(vocabulary))

        def finish(block: Block) -> None:
            if block.ids:
                block.close()
                for item, b in zip(items, best, strict=True):
                    search_block(block, item, weights, b)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), raw(batch, "text"), strict=True):
                words = terms(text)
                counts = Counter(words)
                found = {vocabulary[w]: counts[w] for w in counts.keys() & vocabulary.keys()}
                if found:
                    block.add(key, 10 + 90 * len(words) * n_docs // size, found)
                    if len(block.ids) >= BLOCK_DOCS or len(block.term) >= BLOCK_POSTINGS:
                        finish(block)
                        block = Block(len(vocabulary))
        finish(block)
        for k, b in enumerate(best):
            if len(b.rows):
                ids = [None if none else i for _, i, none in b.rows.tolist()]
                yield batch_of(_FOUND, [[k] * len(ids), ids, b.rows[:, 0]])

    return search


_TERMS = pa.schema([("item_id", pa.int64()), ("terms", pa.list_(pa.binary()))])


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch_of(_TERMS, [batch.column(0), [sorted(set(terms(t))) for t in raw(batch, "text")]])


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    top: int = TOP, pass_terms: int = PASS_TERMS,
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score`` of the ``top`` documents of each item with a score above 0.

    Equal scores are ranked by ascending document id, null last; among rows of one id the order makes no difference.
    Repeated rows of ``docs`` are documents of their own and may all be ranked. Rows of ``items`` with one id are one item
    with the terms of all its texts; a null id is an item too. A null text, or one without a term, is no document, and
    no item finds anything by it. Other columns stay outside; empty tables give no rows. Very long texts are read whole.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    asked = asked.mapInArrow(_item_terms, "item_id long, terms array<binary>").groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    asked = stored(asked.where(F.size("terms") > 0), "items")
    passes = max(1, math.ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / pass_terms))
    found = []
    for k in range(passes):
        here = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).orderBy("item_id").collect()
        if here:
            found.append(_one_pass(plain, [r.item_id for r in here], [[bytes(t) for t in r.terms] for r in here], top))
    schema = "item_id long, doc_id long, score long"
    every = spark.createDataFrame([], schema) if not found else found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    every = every.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _one_pass(plain: DataFrame, names: list[int | None], lists: list[list[bytes]], top: int) -> DataFrame:
    spark = plain.sparkSession
    vocabulary = {t: k for k, t in enumerate(sorted({t for ts in lists for t in ts}))}
    counted = plain.select("text").mapInArrow(_counting(frozenset(vocabulary)), "term binary, n long, size long")
    totals = {r.term and bytes(r.term): (r.n, r.size) for r in counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).collect()}
    n_docs, size = totals.get(None) or (0, 0)
    weights = np.array([weight(n_docs, totals[t][0]) if t in totals else 0 for t in vocabulary], np.int64)
    items = [np.array([vocabulary[t] for t in ts if t in totals], np.int64) for ts in lists]
    kept = [k for k, item in enumerate(items) if len(item)]
    found = stored(plain.mapInArrow(_searching(vocabulary, weights, [items[k] for k in kept], n_docs, size, top), "item long, doc_id long, score long"), "found")
    ids = spark.createDataFrame([(k, names[j]) for k, j in enumerate(kept)], "item long, item_id long")
    return found.join(F.broadcast(ids), "item").select("item_id", "doc_id", "score")
