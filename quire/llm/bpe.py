"""BPE encoding and decoding of whole texts, with tree concatenation for long unsplit text.

A tokenizer that splits at white space encodes each word by itself, so a task encodes every distinct word once with the
library and puts texts together from what it remembers. Text without a place to split (a pre-token longer than
``LONG``) is cut into pieces, which are encoded in parallel as rows of their own; then neighbours are joined pairwise,
as the inner nodes of a tree. At a join, a window of the text around it is encoded again and grows until it has a token
in common (the same id over the same characters) with the left side and one with the right side. What stands left of
the first and right of the second is kept. Every pair of adjacent tokens then stems from the encoding of a text that
holds both, which makes the joined sequence the encoding of the joined text.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm.common import batch_of, keyed_text, raw, stored

#: Characters of a pre-token from which it is encoded as a tree of pieces, and of a piece.
LONG = 8192
PIECE = 4096
#: Characters on each side of a join that the first window takes.
WINDOW = 64
#: Distinct words that a task remembers; further ones are encoded at each sight.
ROOM = 500_000


@functools.cache
def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a worker, without truncation and padding and without threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


class Remembered:
    """What ``make`` returns for each of a list of keys, for keys not seen before; up to ``room`` of them stay."""

    def __init__(self, make: Callable[[list[bytes]], list], room: int = ROOM) -> None:
        self.make, self.room, self.known = make, room, {}

    def fill(self, groups: list[list[bytes]]) -> dict:
        """A lookup for all keys of the groups."""
        new = list(dict.fromkeys(k for keys in groups for k in keys if k not in self.known))
        made = dict(zip(new, self.make(new), strict=True)) if new else {}
        if len(self.known) + len(made) <= self.room:
            self.known.update(made)
            return self.known
        return self.known | made if len(made) > 50_000 else _Both(self.known, made)


class _Both(dict):
    def __init__(self, known: dict, made: dict) -> None:
        super().__init__(made)
        self.known = known

    def __missing__(self, key):
        return self.known[key]


def _word_entries(path: str):
    def make(words: list[bytes]) -> list[tuple[bytes, bytes, int]]:
        out = []
        for at in range(0, len(words), 20_000):
            found = tokenizer(path).encode_batch_fast([w.decode() for w in words[at : at + 20_000]], add_special_tokens=False)
            out += [(" ".join(map(str, e.ids)).encode(), tokenizer(path).decode(e.ids, skip_special_tokens=False).encode(), len(e.ids)) for e in found]
        return out

    return make


_DIGESTS = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("text", pa.string())])
_DIGESTS_DDL = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, text string"


def _encoded(path: str, long: int):
    """Texts of words of usual length are done here; the others are handed on with their text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Remembered(_word_entries(path))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                split = [(t or b"").split() for t in raw(part, "text")]
                hard = [max(map(len, words), default=0) >= long for words in split]
                look, out = memo.fill([w for w, h in zip(split, hard, strict=True) if not h]), []
                for words, h, text in zip(split, hard, part.column(1), strict=True):
                    if h:
                        out.append((None, None, None, text.as_py()))
                        continue
                    found = [e for e in [look[w] for w in words] if e[2]]
                    ids, plain = b" ".join([e[0] for e in found]), b" ".join([e[1] for e in found])
                    out.append((sum([e[2] for e in found]), hashlib.sha256(ids).hexdigest(), hashlib.sha256(plain).hexdigest(), None))
                yield batch_of(_DIGESTS, [part.column(0), *zip(*out, strict=True)])

    return encode


def pre_tokens(text: str, path: str) -> list[str | int]:
    """The pre-tokens of a text as the model sees them; the id itself for special tokens, which the library cuts out first."""
    made, out = tokenizer(path), []
    special = {t.content: i for i, t in made.get_added_tokens_decoder().items()}
    parts = [text]
    for mark in special:
        parts = [p for x in parts for p in ([x] if isinstance(x, int) else _cut(x, mark, special[mark]))]
    for part in parts:
        if isinstance(part, int):
            out.append(part)
        elif part:
            plain = made.normalizer.normalize_str(part) if made.normalizer else part
            out += [p for p, _ in made.pre_tokenizer.pre_tokenize_str(plain)]
    return out


def _cut(text: str, mark: str, value: int) -> list[str | int]:
    pieces: list[str | int] = []
    for k, piece in enumerate(text.split(mark)):
        pieces += [value, piece] if k else [piece]
    return pieces


def _model_tokens(path: str, text: str, at: int = 0) -> np.ndarray:
    """Rows of (id, start, end) for one pre-token or a part of one; the model itself marks its end as a word's end."""
    made = tokenizer(path)
    ending = len(getattr(made.model, "end_of_word_suffix", None) or "")
    tokens = made.model.tokenize(text)
    sizes = np.array([len(t.value) for t in tokens], np.int64)
    if len(sizes) and ending:
        sizes[-1] -= ending
    ends = np.cumsum(sizes) + at
    return np.stack([np.array([t.id for t in tokens], np.int64), ends - sizes, ends], axis=1) if len(tokens) else np.empty((0, 3), np.int64)


def joined(left: np.ndarray, right: np.ndarray, text_of: Callable[[int, int], str], path: str, window: int = WINDOW) -> np.ndarray:
    """The tokens of two neighbouring parts of one pre-token, from the tokens of each."""
    start, cut, end = int(left[0, 1]), int(right[0, 1]), int(right[-1, 2])
    while True:
        a = int(left[max(0, np.searchsorted(left[:, 1], cut - window, "right") - 1), 1])
        b = int(right[min(len(right) - 1, np.searchsorted(right[:, 2], cut + window)), 2])
        middle = _model_tokens(path, text_of(a, b), a)
        whole_left, whole_right = a == start, b == end
        i = 0 if whole_left else _shared(left, middle, first=True)
        j = len(middle) - 1 if whole_right else _shared(right, middle, first=False)
        if whole_left and whole_right:
            return middle
        if i is not None and j is not None and (whole_left or whole_right or i <= j):
            head = left[:0] if whole_left else left[left[:, 1] < middle[i, 1]]
            tail = right[:0] if whole_right else right[right[:, 2] > middle[j, 2]]
            return np.concatenate((head, middle[i : j + 1], tail))
        window *= 2


def _shared(side: np.ndarray, middle: np.ndarray, first: bool) -> int | None:
    """Where in ``middle`` the first or last token stands that ``side`` has as well, over the same characters."""
    known = set(map(tuple, side[(side[:, 1] >= middle[0, 1]) & (side[:, 2] <= middle[-1, 2])].tolist()))
    hits = [k for k, t in enumerate(middle.tolist()) if tuple(t) in known]
    return (hits[0] if first else hits[-1]) if hits else None


def tree_encode(text: str, path: str, piece: int = PIECE) -> list[int]:
    """The ids of one pre-token, encoded in pieces and joined as a tree (the form for one task)."""
    parts = [_model_tokens(path, text[k : k + piece], k) for k in range(0, len(text), piece)]
    while len(parts) > 1:
        pairs = [parts[k : k + 2] for k in range(0, len(parts), 2)]
        parts = [joined(*p, lambda a, b: text[a:b], path) if len(p) == 2 else p[0] for p in pairs]
    return parts[0][:, 0].tolist() if parts else []


# Long runs as rows: (run, piece, text, start, tokens). Joining two pieces concatenates their texts and tokens.

_RUN_DDL = "run string, piece long, start long, text string, tokens binary"


def _run_name(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _pieces(path: str, long: int, piece: int):
    schema = pa.schema([("run", pa.string()), ("piece", pa.int64()), ("start", pa.int64()), ("text", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                runs = {p for w in text.split() for p in pre_tokens(w, path) if isinstance(p, str) and len(p) >= long}
                rows = [(_run_name(r), k // piece, k, r[k : k + piece]) for r in runs for k in range(0, len(r), piece)]
                if rows:
                    yield batch_of(schema, list(zip(*rows, strict=True)))

    return cut


def _leaves(path: str):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield frame.assign(tokens=[_model_tokens(path, t, int(s)).tobytes() for t, s in zip(frame["text"], frame["start"], strict=True)])

    return encode


def _join_two(path: str):
    def join(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("piece").to_dict("records")
        text, at = "".join(r["text"] for r in rows), rows[0]["start"]
        parts = [np.frombuffer(r["tokens"], np.int64).reshape(-1, 3) for r in rows]
        tokens = joined(*parts, lambda a, b: text[a - at : b - at], path) if len(parts) == 2 else parts[0]
        return pd.DataFrame({"run": [rows[0]["run"]], "piece": [rows[0]["piece"] // 2], "start": [at], "text": [text], "tokens": [tokens.tobytes()]})

    return join


def encode_runs(docs: DataFrame, path: str, long: int = LONG, piece: int = PIECE) -> DataFrame:
    """``run`` (its digest) and ``tokens`` for each distinct long pre-token of the texts, by a tree of joins."""
    pieces = docs.select("text").mapInArrow(_pieces(path, long, piece), "run string, piece long, start long, text string")
    pieces = pieces.groupBy("run", "piece").agg(F.first("start").alias("start"), F.first("text").alias("text"))
    level = stored(pieces.mapInPandas(_leaves(path), _RUN_DDL), "pieces")
    most = level.agg(F.max("piece")).first()[0] or 0
    while most:
        level = stored(level.groupBy("run", F.expr("piece div 2")).applyInPandas(_join_two(path), _RUN_DDL), "pieces")
        most //= 2
    return level.select("run", "tokens")


def _with_runs(path: str, long: int):
    schema = _DIGESTS.remove(4)

    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        """One document: its text (in the rows with none of the runs) and the tokens of its long runs."""
        made = tokenizer(path)
        runs = {r: np.frombuffer(t, np.int64).reshape(-1, 3)[:, 0].tolist() for r, t in zip(frame["run"], frame["tokens"], strict=True) if r is not None}
        ids: list[int] = []
        for word in frame["text"].iloc[0].encode().split():
            if len(word) < long:
                ids += made.encode(word.decode(), add_special_tokens=False).ids
                continue
            for part in pre_tokens(word.decode(), path):
                ids += [part] if isinstance(part, int) else runs[_run_name(part)] if len(part) >= long else [t.id for t in made.model.tokenize(part)]
        plain = made.decode(ids, skip_special_tokens=False)
        row = [frame["id"].iloc[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()]
        return pd.DataFrame([row], columns=schema.names)

    return finish


def _runs_of(path: str, long: int):
    schema = pa.schema([("row", pa.int64()), ("run", pa.string())])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(row, r) for r in {_run_name(p) for w in text.split() for p in pre_tokens(w, path) if isinstance(p, str) and len(p) >= long} | {None}]
            if rows:
                yield batch_of(schema, list(zip(*rows, strict=True)))

    return name


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", long: int = LONG, piece: int = PIECE) -> DataFrame:
    """One row per row: ``id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    A null or empty text has no tokens and the digests of the empty string; repeated rows stay; an empty table gives
    no rows. A text of any length is encoded whole.
    """
    first = stored(keyed_text(docs, id_col, text_col).mapInArrow(_encoded(path, long), _DIGESTS_DDL), "encoded")
    done = first.where("text is null").drop("text")
    hard = first.where("text is not null").select("id", "text")
    if hard.isEmpty():
        return done
    hard = stored(hard.select(F.monotonically_increasing_id().alias("row"), "id", "text"), "long")
    runs = encode_runs(hard, path, long, piece)
    named = hard.select("row", "text").mapInArrow(_runs_of(path, long), "row long, run string")
    met = hard.join(named, "row").join(runs, "run", "left").select("row", "id", "text", "run", "tokens")
    finished = met.groupBy("row").applyInPandas(_with_runs(path, long), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return done.unionByName(finished)
