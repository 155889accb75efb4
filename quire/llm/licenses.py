"""Licence scan: exact phrases, and short notices with a bounded number of edits.

A text is read as its words, lower-cased and joined by one space. Phrases are counted where their words stand
consecutively. A notice may differ from its wording by up to ``k`` edits: cut into ``k + 1`` pieces, at least one piece
stands unchanged (the pigeonhole principle), so an Aho-Corasick scan for all pieces finds every place that can hold one.
Around such a place the regex library's bounded-error matching decides, and reports the span and the edits.

Each text is scanned by itself in one pass; nothing is shuffled.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quire.llm.common import batch_of, keyed_text, raw

# Phrases and their labels, and the wording of short notices with theirs.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("all rights reserved", "proprietary"),
)
# Short names in licences. They and all numbers tell licences apart, so no edit may touch them.
NAMES = frozenset("cc by nc nd sa mit gnu gpl lgpl agpl mpl bsd isc apache".split())
#: One edit is allowed for so many characters of a notice, and this many at most.
PER_EDIT = 12
MOST_EDITS = 4

#: Bytes that stand in no word: ASCII but digits and letters. Capital letters become small ones.
_TABLE = bytes(
    32 if n < 0x30 or 0x3A <= n <= 0x40 or 0x5B <= n <= 0x60 or 0x7B <= n <= 0x7F else n + 32 if 0x41 <= n <= 0x5A else n for n in range(256))


@dataclass(frozen=True)
class Found:
    label: str
    first_word: int
    last_word: int
    edits: int
    score: float


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text after lower-casing A-Z."""
    return (text or b"").translate(_TABLE).split()


def held(line: str) -> str:
    """The numbers and short names of a line of words, in order, put together."""
    return "".join(w for w in line.split() if w in NAMES or any("0" <= c <= "9" for c in w))


def allowed(notice: str) -> int:
    return max(1, min(MOST_EDITS, len(notice) // PER_EDIT))


@functools.cache
def _machine(notices: tuple[tuple[str, str], ...]):
    """The automaton of all pieces, and the fuzzy pattern of each notice."""
    scan, patterns, pieces = ahocorasick.Automaton(), [], {}
    for n, (notice, _) in enumerate(notices):
        k = allowed(notice)
        cuts = [round(j * len(notice) / (k + 1)) for j in range(k + 2)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            pieces.setdefault(notice[a:b], []).append((n, a))
        patterns.append(regex.compile(rf"(?e)(?<![^ ])(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}(?![^ ])"))
    for piece, places in pieces.items():
        scan.add_word(piece, (len(piece), places))
    scan.make_automaton()
    return scan, patterns


def fuzzy_notices(line: str, notices: tuple[tuple[str, str], ...] = NOTICES) -> list[Found]:
    """Every notice in a line of words, each place once: its label, span in words, edits and likeness.

    Numbers and short names of the place must be the notice's own; only what stands around them may differ.
    """
    scan, patterns = _machine(notices)
    blanks: list[int] | None = None
    windows: dict[int, list[tuple[int, int]]] = {}
    for end, (size, places) in scan.iter(line):
        for n, offset in places:
            k = allowed(notices[n][0])
            start = end + 1 - size - offset
            windows.setdefault(n, []).append((max(0, start - k), min(len(line), start + len(notices[n][0]) + k)))
    out = []
    for n, spans in windows.items():
        notice, label = notices[n]
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in merged:
            for hit in patterns[n].finditer(line, max(0, a - 1), min(len(line), b + 1)):
                if held(hit.group()) != held(notice):
                    continue
                if blanks is None:
                    blanks = [m.start() for m in regex.finditer(" ", line)]
                edits = sum(hit.fuzzy_counts)
                first = bisect.bisect_left(blanks, hit.start() + (line[hit.start() : hit.start() + 1] == " "))
                out.append(Found(label, first, first + hit.group().strip().count(" "), edits, 1 - edits / len(notice)))
    return _best(out)


def _best(found: list[Found]) -> list[Found]:
    """Of notices that overlap, those with the fewest edits, and the longest of these; ties go to the first, then to the lesser label."""
    firsts: list[int] = []
    kept: list[Found] = []
    for f in sorted(found, key=lambda f: (f.edits, f.first_word - f.last_word, f.first_word, f.label)):
        at = bisect.bisect_left(firsts, f.first_word)
        if (at == 0 or kept[at - 1].last_word < f.first_word) and (at == len(kept) or f.last_word < firsts[at]):
            firsts.insert(at, f.first_word)
            kept.insert(at, f)
    return kept


def exact_phrases(line: bytes, phrases: tuple[tuple[str, str], ...] = PHRASES) -> list[tuple[str, int]]:
    """Label and start, in words, of every place where a phrase's words stand consecutively."""
    padded, out = b" " + line + b" ", []
    for phrase, label in phrases:
        wanted = f" {phrase} ".encode()
        at, words, done = padded.find(wanted), 0, 0
        while at >= 0:
            words, done = words + padded.count(b" ", done, at), at
            out.append((label, words))
            at = padded.find(wanted, at + 1)
    return out


_SCAN = pa.schema([
    ("id", pa.int64()), ("n_words", pa.int64()), ("phrases", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64())]))),
    ("notices", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("edits", pa.int64()), ("score", pa.float64())]))),
])
_SCAN_DDL = (
    "id long, n_words long, phrases array<struct<label: string, first: bigint>>, "
    "notices array<struct<label: string, first: bigint, last: bigint, edits: bigint, score: double>>")


def _scanned(phrases: tuple, notices: tuple):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in raw(batch, "text"):
                words = words_of(text)
                line = b" ".join(words)
                exact = [{"label": a, "first": b} for a, b in exact_phrases(line, phrases)]
                fuzzy = [
                    {"label": f.label, "first": f.first_word, "last": f.last_word, "edits": f.edits, "score": f.score}
                    for f in fuzzy_notices(line.decode("utf-8", "replace"), notices)]
                rows.append((len(words), exact, fuzzy))
            if rows:
                yield batch_of(_SCAN, [batch.column(0), *zip(*rows, strict=True)])

    return scan


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row per row: ``id``, ``n_words``, ``phrases`` (label, first word) and ``notices`` (label, span in words, edits,
    score). A null or empty text has no words and empty lists; repeated rows stay; an empty table gives no rows. Other columns
    stay outside. Very long texts are scanned whole, in time that grows with their length.
    """
    return keyed_text(docs, id_col, text_col).mapInArrow(_scanned(tuple(phrases), tuple(notices)), _SCAN_DDL)
