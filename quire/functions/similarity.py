"""Text similarity and vocabulary matching.

The character part is the Ratcliff/Obershelp ratio of the standard library, which no built-in
expression gives, so these are Arrow functions. Each batch is reduced to its distinct texts and
every worker remembers what it has scored, so a label that fills a third of the rows is scored
once per worker and nothing has to be shuffled to find the distinct ones.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as Ty

from quire.functions.text import STOP_WORDS
from quire.roles import BASE_ROLES, ITEM_FIELDS, Role

_STOPS = frozenset(STOP_WORDS)
_ODD = re.compile(r"[^\w\s%/&.-]+")
_BLANKS = re.compile(r"\s+")


def normal(text: str | None) -> str:
    low = (text or "").lower().replace("_", " ").replace(" ", " ")
    return _BLANKS.sub(" ", _ODD.sub(" ", low)).strip(" :*-.").strip()


class _Target:
    """A text that many others are compared with; its character index is built once."""

    def __init__(self, text: str):
        self.text = text
        self.normal = normal(text)
        self.words = frozenset(w for w in self.normal.split() if w not in _STOPS)
        self.matcher = difflib.SequenceMatcher(None, "", self.normal)

    def score(self, left: str, words: frozenset[str], floor: float = 0.0) -> float:
        """Similarity of ``left``; any value not above ``floor`` may come back as 0."""
        right = self.normal
        if not left or not right:
            return 0.0
        if left == right:
            return 1.0
        overlap = 0.0
        if words and self.words:
            overlap = 1.0 if words == self.words else len(words & self.words) / min(len(words), len(self.words))
        inside = 0.88 if min(len(left), len(right)) >= 4 and (left in right or right in left) else 0.0
        self.matcher.set_seq1(left)
        for bound in (self.matcher.real_quick_ratio, self.matcher.quick_ratio):
            most = bound()
            if max(0.85 * overlap + 0.15 * most, 0.9 * most, inside) <= floor:
                return 0.0
        ratio = self.matcher.ratio()
        return max(0.85 * overlap + 0.15 * ratio, 0.9 * ratio, inside)


def _words(left: str) -> frozenset[str]:
    return frozenset(w for w in left.split() if w not in _STOPS)


@lru_cache(maxsize=20_000)
def _target(text: str) -> _Target:
    return _Target(text)


@lru_cache(maxsize=200_000)
def similarity(a: str | None, b: str | None) -> float:
    """Token overlap blended with the character ratio; 1 for equal normal forms, 0 if one is empty."""
    left = normal(a)
    return _target(b or "").score(left, _words(left))


@F.pandas_udf(Ty.DoubleType())
def text_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b)], dtype="float64")


def register_functions(spark) -> None:
    """Makes ``text_similarity`` callable from SQL text."""
    spark.udf.register("text_similarity", text_similarity)


_SCORE = Ty.StructType(
    [
        Ty.StructField("name", Ty.StringType()), Ty.StructField("score", Ty.DoubleType()),
        Ty.StructField("synonym", Ty.StringType()), Ty.StructField("ord", Ty.IntegerType()),
    ]
)


_SCORES = pa.list_(pa.struct([("name", pa.string()), ("score", pa.float64()), ("synonym", pa.string()), ("ord", pa.int32())]))


def _ranker(names: Iterable[tuple[str, tuple[str, ...]]], floor: float):
    """label -> rows (name, score, synonym, ord) above ``floor``, best first, vocabulary order on ties."""
    names = [(n, tuple(s)) for n, s in names]

    @lru_cache(maxsize=1)
    def targets():
        return [(n, i, [_Target(s) for s in synonyms]) for i, (n, synonyms) in enumerate(names)]

    @lru_cache(maxsize=200_000)
    def rank(label: str):
        left = normal(label)
        words = _words(left)
        rows = []
        for name, place, options in targets():
            best, matched = 0.0, ""
            for option in options:
                value = option.score(left, words, max(best, floor))
                if value > best:
                    best, matched = value, option.text
            if best > floor:
                rows.append({"name": name, "score": best, "synonym": matched, "ord": place})
        rows.sort(key=lambda r: (-r["score"], r["ord"]))
        return rows

    return rank


def _scorer(names: tuple, floor: float):
    """Scores of a column: each distinct text of a batch is scored, and its scores laid out, once."""

    @F.arrow_udf(Ty.ArrayType(_SCORE))
    def scored(texts: pa.Array) -> pa.Array:
        rank, named = _cached_ranker(names, floor), texts.fill_null("").dictionary_encode()
        return pa.array(map(rank, named.dictionary.to_pylist()), _SCORES, size=len(named.dictionary)).take(named.indices)

    return scored


def role_scores(
    label: Column, roles: Iterable[Role] = BASE_ROLES, floor: float = 0.35, synonyms_only: bool = False
) -> Column:
    """Array of (name, score, synonym, ord) of the roles a label may mean, best first."""
    names = [(r.role, r.synonyms if synonyms_only else r.names()) for r in roles if not r.role.startswith("x_")]

    return _scorer(tuple(names), floor)(label)


def field_scores(header: Column, floor: float = 0.0) -> Column:
    """Array of (name, score, synonym, ord) of the item fields a column header may mean."""

    return _scorer(_FIELD_NAMES, floor)(header)


_FIELD_NAMES = tuple((f, (f.replace("_", " "), *s)) for f, s in ITEM_FIELDS.items())


@F.pandas_udf(Ty.StructType([Ty.StructField("name", Ty.StringType()), Ty.StructField("score", Ty.DoubleType())]))
def best_field(headers: pd.Series, allowed: pd.Series) -> pd.DataFrame:
    """Name and score of the allowed item field (none given: any) a column header means best; null where there is none."""
    rank, known = _cached_ranker(_FIELD_NAMES, 0.0), {}
    names, scores = [], []
    for header, fields in zip(headers, allowed, strict=True):
        key = (header or "", None if fields is None else tuple(fields))
        if key not in known:
            known[key] = (None, None) if fields is None else next(((s["name"], s["score"]) for s in rank(key[0]) if not key[1] or s["name"] in key[1]), (None, None))
        names.append(known[key][0])
        scores.append(known[key][1])
    return pd.DataFrame({"name": pd.Series(names, dtype="object"), "score": pd.Series(scores, dtype="float64")})


@F.pandas_udf(Ty.ArrayType(Ty.StringType()))
def header_fields(headers: pd.Series) -> pd.Series:
    """Item field of every header of a table row, empty where none scores above 0.6."""
    rank = _cached_ranker(_FIELD_NAMES, 0.0)

    def field(header: str) -> str:
        scored = rank(header or "")
        return scored[0]["name"] if scored and scored[0]["score"] > 0.6 else ""

    return headers.map(lambda row: [field(h) for h in (row if row is not None else ())])


@F.pandas_udf(Ty.ArrayType(_SCORE))
def all_field_scores(headers: pd.Series) -> pd.Series:
    """Best score of every item field over all headers of a table."""
    rank = _cached_ranker(_FIELD_NAMES, 0.0)

    def one(row):
        best: dict[str, dict] = {}
        for header in row if row is not None else ():
            for hit in rank(header or ""):
                if hit["name"] not in best or hit["score"] > best[hit["name"]]["score"]:
                    best[hit["name"]] = hit
        return list(best.values())

    return headers.map(one)


@lru_cache(maxsize=64)
def _cached_ranker(names: tuple, floor: float):
    return _ranker(names, floor)


_BEST = Ty.StructType([Ty.StructField("pos", Ty.IntegerType()), Ty.StructField("score", Ty.DoubleType())])


@F.pandas_udf(_BEST)
def best_of(name: pd.Series, label: pd.Series, options: pd.Series) -> pd.DataFrame:
    """Position (from 0) and score of the option most like ``name`` or ``label``; the first wins ties."""
    places, scores = [], []
    for n, lab, opts in zip(name, label, options):
        place, best = -1, 0.0
        for i, option in enumerate(opts if opts is not None else ()):
            value = similarity(n, option)
            if lab is not None and value < 1.0:
                value = max(value, similarity(lab, option))
            if value > best:
                place, best = i, value
        places.append(place)
        scores.append(best)
    return pd.DataFrame({"pos": places, "score": scores})


@F.pandas_udf(Ty.ArrayType(Ty.DoubleType()))
def each_of(name: pd.Series, label: pd.Series, options: pd.Series) -> pd.Series:
    """Score of every option against ``name`` or ``label``."""

    def one(n, lab, opts):
        return [max(similarity(n, o), similarity(lab, o) if lab else 0.0) for o in (opts if opts is not None else ())]

    return pd.Series([one(*row) for row in zip(name, label, options)])


@F.pandas_udf(Ty.ArrayType(Ty.StringType()))
def nearest_columns(fields: pd.Series, names: pd.Series, headers: pd.Series) -> pd.Series:
    """Table column each source field means: the same name, else the most alike by name, header or synonyms."""

    def nearest(name: str, columns: list[tuple[str, str]]) -> str | None:
        best, chosen = 0.0, None
        for column, header in columns:
            options = (column, header, *ITEM_FIELDS.get(column, ()))
            value = max(similarity(name, o) for o in options)
            if value > best:
                best, chosen = value, column
        return chosen if best >= 0.7 else None

    def one(wanted, cols, heads):
        if wanted is None or cols is None:
            return []
        pairs = list(zip(cols, heads))
        have = set(cols)
        return [f if f in have else nearest(f, pairs) for f in wanted]

    return pd.Series([one(*row) for row in zip(fields, names, headers)])


_ODD_ONE = re.compile(r"[^\w %/&.-]")
_LOOSE = " :*-."


def _loose(codes: np.ndarray) -> np.ndarray:
    found = np.zeros(len(codes), dtype=bool)
    for sign in _LOOSE:
        found |= codes == ord(sign)
    return found


def _hopeful(q: str, words: frozenset[str], t: str, step: int) -> Iterable[int]:
    """Starts of the windows of ``t`` that may be 0.82 similar to ``q``; every one left out is proven not to be.

    A score of 0.82 needs a shared word, a character ratio above 0.91, or a normal window that stands inside the quote. The
    characters that a window shares with the quote bound the last two, and are counted for all windows at once.
    """
    starts = np.arange(0, max(1, len(t) - len(q) + 1), step)
    low = t.lower()
    if len(low) != len(t):
        return starts.tolist()
    # character by character what ``normal`` makes of a window, but for squeezed blanks and bare ends
    flat = _ODD_ONE.sub(" ", low.replace("_", " ").replace("\u00a0", " "))
    codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.minimum(starts + len(q), len(t))

    def within(mask: np.ndarray) -> np.ndarray:
        seen = np.concatenate(([0], np.cumsum(mask)))
        return seen[ends] - seen[starts]

    # signs of the quote, counted as often as a window holds them: where even these are too few, their numbers are not compared
    times = sorted(Counter(q).items())
    signs = np.array([ord(sign) for sign, _ in times], dtype=np.uint32)
    place = np.minimum(np.searchsorted(signs, codes), len(signs) - 1)
    held, loose = signs[place] == codes, _loose(codes)
    most = np.minimum(within(held), len(q))
    good = np.zeros(len(starts), dtype=bool)
    maybe = np.flatnonzero((2 * most >= 0.91 * (len(q) + most)) | (within(~held & ~loose) == 0))
    if len(maybe):
        each = starts[maybe][:, None] + np.arange(min(len(q), len(t)))
        signs_of = (np.arange(len(maybe))[:, None] * len(signs) + place[each])[held[each]]
        have = np.bincount(signs_of, minlength=len(maybe) * len(signs)).reshape(len(maybe), len(signs))
        have = np.minimum(have, [n for _, n in times])
        shared, firm = have.sum(axis=1), have[:, ~_loose(signs)].sum(axis=1)
        good[maybe] = (2 * shared >= 0.91 * (len(q) + shared)) | (firm == (~loose[each]).sum(axis=1))
    for word in words:
        at = flat.find(word)
        while at >= 0:
            good |= (starts <= at) & (ends >= at + len(word))
            at = flat.find(word, at + 1)
    return starts[good].tolist()


@F.pandas_udf(Ty.BooleanType())
def near_quote(quote: pd.Series, text: pd.Series) -> pd.Series:
    """A window of the normal text is at least 0.82 similar to the normal quote."""

    def one(q: str, t: str) -> bool:
        width = len(q)
        if width < 8:
            return False
        left, words = q, _words(q)
        for start in _hopeful(q, words, t, max(1, width // 4)):
            if _Target(t[start:start + width]).score(left, words, 0.8199) >= 0.82:
                return True
        return False

    return pd.Series([one(q or "", t or "") for q, t in zip(quote, text)], dtype="bool")


def evidence_present(quote: Column, normal_text: Column) -> Column:
    """The normal quote stands in the normal text; the window search runs only where ``contains`` fails."""
    from quire.functions.text import normalize_text

    wanted = normalize_text(quote)
    long = F.length(wanted) >= 8
    literal = long & normal_text.contains(wanted)
    # rows that need no search reach the function as empty strings
    search = long & ~literal
    empty = F.lit("")
    return literal | near_quote(F.when(search, wanted).otherwise(empty), F.when(search, normal_text).otherwise(empty))
