"""Toxicity of restored text: a noisy-channel decoder undoes disguises, then the words are scored.

Character trigrams are counted over all documents; the counts are one table bounded by the alphabet. A word that looks
disguised (digits or symbols inside, a letter three times in a row, letters spelled out with gaps) becomes a lattice of
the letters each sign may stand for, with runs read once, twice or as they are, and Viterbi's algorithm finds the
likeliest reading under the trigram model. The words of a text, as written and as restored, are looked up in a table of
word beginnings whose toxic share was learnt from labelled documents. Labels enter the training only.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import batch_of, keyed_text, raw, stored

#: Labelled rows of each class that the table of word beginnings is fitted on.
TRAIN_ROWS = 6000
#: A word beginning is kept if so many distinct training texts that are toxic have it.
MIN_TEXTS = 8
#: Standard deviations that a count is lowered by before its share is taken.
CAUTION = 1.5
#: Lengths of the word beginnings, besides the whole word.
STEMS = (4, 5, 6)
#: What each sign may stand for, fixed values.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il",
    "+": "t", "(": "c", "€": "e",
}

_SIZE = 32
_BASE = "áàâäãåaçcéèêëeíìîïiñnóòôöõoúùûüuýÿy"
_PLAIN = "aaaaaaacceeeeeiiiiinnoooooouuuuuyyy"
_FOLD = str.maketrans(_BASE, _PLAIN)


def _code_table() -> bytes:
    """Latin-1 bytes to codes: 0 for what is no letter, 1 to 26 for letters without their accents, 27 for others."""
    codes = []
    for n in range(256):
        c = chr(n).lower().translate(_FOLD)
        codes.append(0 if not c.isalpha() else ord(c) - 96 if "a" <= c <= "z" else 27)
    return bytes(codes)


_CODES = _code_table()
_LEET = re.compile(r"[^\W\d_][0-9@$!|+(€]+[^\W\d_]|^[0-9@$!|+(€]+[^\W\d_]{2}|[^\W\d_]{2}[0-9$@]+$|([^\W\d_])\1\1")
_EDGE = re.compile(r"^[^\w@$!|+(€]+|[^\w@$€]+$")
#: A run of one kind of symbol after a word is decoration.
_TAIL = re.compile(r"([^\w\s])\1+[.,;:]?$")
_SPACED = re.compile(r"(?<= )\w(?:[ .\-_*]\w){3,}(?= )")

_COUNTS = pa.schema([("code", pa.int64()), ("n", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_SIZE**3, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            codes = np.frombuffer((" " + (text or "") + " ").encode("latin-1", "replace").translate(_CODES), np.uint8).astype(np.int32)
            codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
            if len(codes) > 2:
                total += np.bincount((codes[:-2] * _SIZE + codes[1:-1]) * _SIZE + codes[2:], minlength=_SIZE**3)
    seen = np.flatnonzero(total)
    if len(seen):
        yield batch_of(_COUNTS, [seen, total[seen]])


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities of a letter after two letters, from all documents; at most 32 x 32 x 32 counts are gathered."""
    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    table = np.zeros(_SIZE**3)
    for row in counts.collect():
        table[row.code] = row.n
    three = table.reshape(_SIZE, _SIZE, _SIZE)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one + 1).sum()
    p2 = (two + 50 * p1) / (two.sum(1, keepdims=True) + 50)
    p3 = (three + 20 * p2[None]) / (three.sum(2, keepdims=True) + 20)
    return np.log(p3).astype(np.float32)


def decode(word: str, model: np.ndarray) -> str:
    """The likeliest reading of a disguised word: Viterbi over the lattice of what its signs may stand for.

    A state is the last two letters read. A run of one sign may be read once, twice, or at its length.
    """
    runs: list[list[str]] = []
    for m in re.finditer(r"(.)\1*", word.lower().translate(_FOLD)):
        sign, n = m.group(1), len(m.group())
        counts = {n} if sign.isalpha() and n < 3 else {1, min(n, 2)}
        options = [c * k for c in SIGNS.get(sign, sign) if c.isalpha() for k in sorted(counts)]
        if sign.isalpha() and n > 2:
            options.append(sign * n)
        if options:
            runs.append(options)

    def code(c: str) -> int:
        return ord(c) - 96 if "a" <= c <= "z" else 27

    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for options in [*runs, [""]]:
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, text) in best.items():
            for option in options:
                x, y, s = a, b, score
                for k in [*map(code, option)] or [0]:
                    s += float(model[x, y, k])
                    x, y = y, k
                if (x, y) not in new or s > new[x, y][0]:
                    new[x, y] = (s, text + option)
        best = new
    return max(best.values())[1]


def stems(word: str) -> list[str]:
    return [word[:n] for n in STEMS if len(word) > n] + [word + "$"] if len(word) > 2 else []


@dataclass
class Words:
    """Reads the words of texts, as written and restored; remembers a bounded number of them."""

    model: np.ndarray
    room: int = 30_000
    seen: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def forms(self, word: str) -> tuple[str, ...]:
        found = self.seen.get(word)
        if found is None:
            core = _EDGE.sub("", _TAIL.sub("", word))
            plain = core.lower().strip("$@€!|+(.,;:*#%&-_'\"")
            found = (plain,)
            if _LEET.search(core):
                restored = decode(core, self.model)
                found = (plain, restored) if restored != plain else found
            if len(self.seen) < self.room:
                self.seen[word] = found
        return found

    def spaced(self, text: str) -> list[str]:
        """Words spelled out with gaps between their letters."""
        if not _GAPS.search(text):
            return []
        return [decode(re.sub(r"\W|_", "", m.group()), self.model) for m in _SPACED.finditer(" " + text.replace("\n", " ") + " ")]


_GAPS = re.compile(r"\b\w[ .\-_*]\w[ .\-_*]\w[ .\-_*]\w\b")


def _near_key(words: list[str]) -> int:
    """The least hash of 5-word shingles: mostly the same for near copies."""
    n = max(1, len(words) - 4)
    return min(xxhash.xxh64_intdigest(" ".join(words[k : k + 5])) for k in range(n)) >> 1


def _features(labels: dict[int, int], model: np.ndarray):
    schema = pa.schema([("id", pa.int64()), ("near", pa.int64()), ("toxic", pa.int64()), ("words", pa.list_(pa.string()))])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), raw(batch, "text"), strict=True):
                if key in labels:
                    plain = (text or b"").decode("utf-8", "replace")
                    listed = plain.split()
                    found = {f for w in set(listed) for f in words.forms(w)}.union(words.spaced(plain))
                    rows.append((key, _near_key(listed), labels[key], sorted(f for f in found if len(f) > 2)))
            if rows:
                yield batch_of(schema, list(zip(*rows, strict=True)))

    return extract


@dataclass
class ToxicModel:
    letters: np.ndarray
    shares: dict[str, float]
    prior: float


def _shares(held: DataFrame, sizes: tuple[int, int], prior: float) -> dict[str, float]:
    """Cautious toxic shares of the stems ``held`` by toxic and other texts, of those well above the prior."""
    counted = held.groupBy("stem").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    odds, shares = prior / (1 - prior), {}
    for r in counted.where((F.col("bad") >= MIN_TEXTS) & (F.col("bad") * 4 >= F.col("good"))).collect():
        sure = r.bad - CAUTION * math.sqrt(r.bad)
        ratio = odds * (sure / sizes[0]) / ((r.good + min(2.0, sizes[1] / 500)) / sizes[1])
        if ratio / (1 + ratio) > 2 * prior:
            shares[r.stem] = ratio / (1 + ratio)
    return shares


def in_training(id_col: Column) -> Column:
    """Whether a row's label may be learnt from: crc32 of the id as text, mod 5, is not 0."""
    return F.crc32(id_col.cast("string")) % 5 != 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> ToxicModel:
    """Fit the word beginnings on at most ``rows`` labelled rows of each class, the letters on all documents.

    Rows held out, without an id or without a label 0 or 1 are not learnt from; near copies of one text count once.
    Without labelled rows of both classes the table is empty and every text gets the share of toxic labels.
    """
    letters = character_model(docs, text_col)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("id").isNotNull())
    known = known.where(in_training(F.col("id")))
    totals = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 5)
    picked: dict[int, int] = {}
    for label in (0, 1):
        chosen = known.where(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(rows)
        picked |= {r.id: label for r in chosen.collect()}
    found = keyed_text(docs, id_col, text_col).where(in_training(F.col("id"))).mapInArrow(_features(picked, letters), "id long, near long, toxic long, words array<string>")
    found = stored(found.groupBy("near").agg(F.max("toxic").alias("toxic"), F.min_by("words", "id").alias("words")), "training")
    size = found.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    sizes = max(1, size[0]), max(1, size[1] - size[0])
    worded = found.select("near", "toxic", F.explode("words").alias("word"))
    whole = _shares(worded.withColumn("stem", F.concat("word", F.lit("$"))), sizes, prior)
    # beginnings are judged by the words that are not telling as a whole: "lose" by what begins so, "loser" left out
    telling = [k[:-1] for k, v in whole.items() if v >= 0.6]
    rest = worded.where(~F.col("word").isin(telling)) if telling else worded
    begun = [F.when(F.length("word") > n, F.substring("word", 1, n)) for n in STEMS]
    begun = rest.select("near", "toxic", F.explode(F.array_compact(F.array(*begun))).alias("stem")).distinct()
    shares = _shares(begun, sizes, prior) | whole
    return ToxicModel(letters, shares, prior)


class Scorer:
    """Scores texts by their two most telling words, as written, restored or spelled out; remembers words."""

    def __init__(self, model: ToxicModel, room: int = 150_000) -> None:
        self.model, self.room, self.words, self.known = model, room, Words(model.letters), {}

    def _form(self, form: str) -> float:
        return max((self.model.shares.get(s, 0.0) for s in stems(form)), default=0.0)

    def __call__(self, text: bytes | None) -> float:
        plain, found = (text or b"").decode("utf-8", "replace"), []
        for word in set(plain.split()):
            value = self.known.get(word)
            if value is None:
                value = max(map(self._form, self.words.forms(word)))
                if len(self.known) < self.room:
                    self.known[word] = value
            if value:
                found.append(value)
        found += [v for f in self.words.spaced(plain) if (v := self._form(f))]
        score = self.model.prior / 2
        for value in sorted(found, reverse=True)[:2]:
            score = 1 - (1 - score) * (1 - value)
        return score


def toxicity(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``id`` and ``score`` in [0, 1]. A null or empty text gets half the share of toxic labels."""
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            yield batch_of(schema, [batch.column(0), [scorer(t) for t in raw(batch, "text")]])

    return keyed_text(docs, id_col, text_col).mapInArrow(score, "id long, score double")


def keep_harmless(docs: DataFrame, model: ToxicModel, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below the limit."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            yield batch.filter(pa.array([scorer(t) < limit for t in raw(batch, text_col)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
