"""Conversation structure repair at least cost, with Four-Russians tables over blocks of turns.

A turn is one symbol: it must go (blank or repeated), or it is a system, user, assistant or other turn, whole or
truncated. What is left of a conversation to pay is a vector of four costs, one for each state of the role grammar
``(s?(ua)+)?`` (nothing yet, after s, after u, after a). Less its least entry, only a few such vectors exist; they are
found by closure from the vector of the end. For every block of ``BLOCK`` symbols and every vector a table holds the
vector before the block and what the block adds, so a conversation is priced from its end with one lookup a block. The
edits are then traced from the front: the vector at the end of a block is expanded backward inside it, and the least
letter among the cheapest edits is taken at each step, which makes the whole string the least one. An expanded block
is remembered by (block, vector, state).

Rows are put in order by ranges of (conversation, turn, role, text hash), cut into pieces of ``PIECE`` rows; a piece is
a string of symbols. All pieces of one conversation are priced by one task, which holds a byte a row; texts go past it
and meet their edits by their keys.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import batch_of, stored

BLOCK = 4
#: Rows of a piece, as a power of two.
PIECE_BITS = 12
#: Must go; system, user, assistant, other; the same truncated.
SYMBOLS = b"xsuaoSUAO"
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: State after an inserted or reroled turn, by state; and the state after a kept turn, by role and state.
FORCED = (2, 2, 3, 2)
KEPT = {ord("s"): {0: 1}, ord("u"): {0: 2, 1: 2, 3: 2}, ord("a"): {2: 3}, ord("o"): {}}
ROLES = {2: "user", 3: "assistant"}
_LAST = (0, 10, 5, 0)


def _before(symbol: int, after: tuple[int, ...]) -> list[int]:
    """Costs before a symbol from the costs after it."""
    out = [DELETE + c for c in after]
    if symbol != SYMBOLS[0]:
        role, fine = (symbol, 0) if symbol >= 0x61 else (symbol + 32, TRUNCATED)
        for s in range(4):
            out[s] = min(out[s], fine + REROLE + after[FORCED[s]])
            if s in KEPT[role]:
                out[s] = min(out[s], fine + after[KEPT[role][s]])
    for _ in range(2):
        out = [min(c, INSERT + out[FORCED[s]]) for s, c in enumerate(out)]
    return out


def _normal(costs: list[int]) -> tuple[tuple[int, ...], int]:
    least = min(costs)
    return tuple(c - least for c in costs), least


@functools.cache
def vectors() -> tuple[tuple[int, ...], ...]:
    """All normalised cost vectors that occur, the one of the end first."""
    known = {_normal(list(_LAST))[0]: None}
    waiting = list(known)
    while waiting:
        v = waiting.pop()
        for symbol in SYMBOLS:
            new = _normal(_before(symbol, v))[0]
            if new not in known:
                known[new] = None
                waiting.append(new)
    return tuple(known)


@functools.cache
def tables(block: int = BLOCK) -> tuple[list[list[int]], list[list[int]]]:
    """For every vector and every block of symbols: the vector before the block, and what its least entry grows by."""
    every = vectors()
    number = {v: k for k, v in enumerate(every)}
    steps = [[_normal(_before(symbol, v)) for symbol in SYMBOLS] for v in every]
    to1 = np.array([[number[v] for v, _ in row] for row in steps])
    add1 = np.array([[least for _, least in row] for row in steps])
    to, add = np.arange(len(every))[:, None], np.zeros((len(every), 1), np.int64)
    for _ in range(block):
        # a new first symbol: the rest is behind it and is priced first
        to, add = (np.concatenate([t[:, k] for k in range(len(SYMBOLS))], axis=1) for t in (to1[to].transpose(0, 2, 1), (add[..., None] + add1[to]).transpose(0, 2, 1)))
    return to.tolist(), add.tolist()


_CODES = bytes.maketrans(SYMBOLS, bytes(range(len(SYMBOLS))))


def _blocks(symbols: bytes, block: int) -> list[int]:
    codes = np.frombuffer(symbols.translate(_CODES), np.uint8).reshape(-1, block).astype(np.int64)
    return (codes @ (len(SYMBOLS) ** np.arange(block)[::-1])).tolist()


def price(symbols: bytes, vector: int = 0, block: int = BLOCK) -> tuple[int, int]:
    """The vector before the symbols, and what they add; ``vector`` is the one after them."""
    head, total = len(symbols) % block, 0
    to, add = tables(block)
    for code in reversed(_blocks(symbols[head:], block)):
        total += add[vector][code]
        vector = to[vector][code]
    to, add = tables(1)
    for code in reversed(symbols[:head].translate(_CODES)):
        total += add[vector][code]
        vector = to[vector][code]
    return vector, total


@functools.lru_cache(1 << 16)
def expand(symbols: bytes, vector: int, state: int) -> tuple[tuple[str, ...], int]:
    """The edits of each symbol, and the state after them. An edit is its letter and the initial of the role that it leaves
    (``-``: none, ``=``: its own); those of a symbol begin with the inserts before it."""
    costs = [list(vectors()[vector])]
    for symbol in reversed(symbols):
        costs.append(_before(symbol, tuple(costs[-1])))
    costs.reverse()
    out = []
    for k, symbol in enumerate(symbols):
        here, after, edits = costs[k], costs[k + 1], ""
        role, fine = (symbol, 0) if symbol >= 0x61 else (symbol + 32, TRUNCATED)
        while True:
            if DELETE + after[state] == here[state]:
                edits += "D-"
            elif INSERT + here[FORCED[state]] == here[state]:
                state = FORCED[state]
                edits += "I" + ROLES[state][0]
                continue
            elif role in KEPT and state in KEPT[role] and fine + after[KEPT[role][state]] == here[state]:
                state = KEPT[role][state]
                edits += "K="
            else:
                state = FORCED[state]
                edits += "R" + ROLES[state][0]
            break
        out.append(edits)
    return tuple(out), state


def ending(state: int) -> tuple[str, int]:
    """The inserts that end a conversation in this state."""
    edits = ""
    while _LAST[state]:
        state = FORCED[state]
        edits += "I" + ROLES[state][0]
    return edits, state


def trace(pieces: list[bytes], block: int = BLOCK) -> Iterator[list[str]]:
    """The edits of each symbol of the consecutive pieces of one conversation; those of the end follow the last symbol's."""
    after = [0] * len(pieces)
    for k in range(len(pieces) - 1, 0, -1):
        after[k - 1] = price(pieces[k], after[k], block)[0]
    state = 0
    for k, symbols in enumerate(pieces):
        head = len(symbols) % block
        cuts = [0, head] if head else [0]
        cuts += range(head + block, len(symbols) + 1, block)
        codes, to = _blocks(symbols[head:], block), tables(block)[0]
        ends = [after[k]]
        for code in reversed(codes):
            ends.append(to[ends[-1]][code])
        ends.reverse()
        if not head:
            ends = ends[1:]
        made: list[str] = []
        for (low, high), vector in zip(itertools.pairwise(cuts), ends, strict=True):
            edits, state = expand(symbols[low:high], vector, state)
            made += edits
        if k == len(pieces) - 1:
            made[-1] += "|" + ending(state)[0]
        yield made


def damage(frame: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text`` after the faults that a hash of (conversation, turn) plants.

    Of 20 hashes, 0 drops a row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it and 4 makes it a user's; null texts and
    roles are one blank, as are null conversations and turns within the hash. Repeated rows get the same fault.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col)]
    fault = F.crc32(F.concat_ws(":", *named)) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    rows = frame.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), fault.alias("fault")).where("fault <> 0")
    return rows.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fault", "copy")


def _name(column: str) -> Column:
    """A null-free key of a number."""
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def _symbol() -> Column:
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)


_EDITS = pa.schema([("at", pa.int64()), ("edits", pa.string())])


def _tracing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (``name``, ``at`` of the first row, ``symbols``) in order of name and at; one row out per symbol."""
    held: list[tuple[int, bytes]] = []
    name = None

    def finish() -> Iterator[pa.RecordBatch]:
        for (at, _), edits in zip(held, trace([s for _, s in held]), strict=True):
            yield batch_of(_EDITS, [range(at, at + len(edits)), edits])

    for batch in batches:
        for this, at, symbols in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and this != name:
                yield from finish()
                held = []
            name = this
            held.append((at, symbols.encode()))
    if held:
        yield from finish()


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches as larger ones."""
    waiting, n = [], 0
    for batch in batches:
        waiting.append(batch)
        n += batch.num_rows
        if n >= 10_000:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
            waiting, n = [], 0
    if waiting:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def repair(rows: DataFrame, conv_col: str = "conv", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per distinct row: ``conv``, ``at``, ``turn``, ``role``, ``text``, ``copies``, ``fault``, ``edits``, ``tail``.

    Rows of a conversation stand by turn (null first), role and text hash; ``at`` numbers them through the table. ``copies``
    counts equal rows, of which the first has ``fault`` (``blank``, ``duplicate``, ``truncated`` or null) and the others are
    deleted as duplicates (or blanks). ``edits`` are pairs of a letter (D, I, K, R) and the initial of the role that the
    edit leaves (``-`` none, ``=`` its own); ``tail`` are those after the last row. Null roles and texts are one blank, a null
    conversation is one of its own; an empty table gives no rows. Very long texts are hashed and copied, never compared.
    """
    def or_blank(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    plain = rows.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), or_blank(role_col).alias("role"), or_blank(text_col).alias("text"))
    plain = plain.withColumn("conv_name", _name("conv")).withColumn("turn_name", _name("turn")).withColumn("key", F.unhex(F.sha2("text", 256)))
    keys = ["conv_name", "turn_name", "role", "key"]
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    marked = plain.select("conv", "turn", *keys, (last == "").alias("blank"), (~last.isin("", ".", "!", "?")).alias("cut"))
    distinct = stored(marked.groupBy(*marked.columns).agg(F.count(F.lit(1)).alias("copies")), "turns")
    same = ["conv_name", "role", "key"]
    first = distinct.groupBy(*same).agg(F.max(F.col("turn").isNull()).alias("unset"), F.min("turn").alias("low"))
    first = first.select(*same, F.when(F.col("unset"), " ").otherwise(F.col("low").cast("string")).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first") != F.col("turn_name"), "duplicate").when(F.col("cut"), "truncated")
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "key"]
    faulty = distinct.join(first, same).withColumn("fault", fault).drop("blank", "cut", "first")
    placed = stored(faulty.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "placed")
    pieces = placed.select("conv_name", "at", F.shiftright("at", PIECE_BITS).alias("piece"), _symbol().alias("symbol")).groupBy("conv_name", "piece").agg(
        F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("at", "symbol"))).alias("symbols"))
    pieces = pieces.select("conv_name", "at", F.array_join(F.col("symbols.symbol"), "").alias("symbols"))
    ordered = pieces.repartition("conv_name").sortWithinPartitions("conv_name", "at")
    edits = ordered.mapInArrow(lambda batches: _together(_tracing(batches)), "at long, edits string")
    edited = placed.join(edits.withColumnRenamed("at", "__at"), F.col("at") == F.col("__at")).drop("__at")
    texts = plain.select(*keys, "text").dropDuplicates(keys)
    pair = F.split("edits", r"\|")
    whole = texts.join(edited, keys)
    return whole.select("conv", "at", "turn", "role", "text", "copies", "fault", pair[0].alias("edits"), F.coalesce(F.get(pair, F.lit(1)), F.lit("")).alias("tail"))


def turns_after(role: str, text: str, edits: str) -> Iterator[tuple[str, str]]:
    """The turns that the edits of one row leave: role and text."""
    for letter, initial in itertools.batched(edits, 2):
        if letter == "I":
            yield ("user" if initial == "u" else "assistant"), ""
        elif letter != "D":
            yield (role if letter == "K" else "user" if initial == "u" else "assistant"), text


_TURNS = pa.schema([("conv", pa.int64()), ("at", pa.int64()), ("step", pa.int32()), ("role", pa.string()), ("text", pa.string())])


def repaired(fixed: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv``, ``at``, ``step``, ``role``, ``text``, in order of (at, step) within each."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (conv, at, step, *turn)
                for conv, at, role, text, edits, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                for step, turn in enumerate(turns_after(role, text, edits + tail))]
            if out:
                yield batch_of(_TURNS, list(zip(*out, strict=True)))

    return fixed.select("conv", "at", "role", "text", "edits", "tail").mapInArrow(made, "conv long, at long, step int, role string, text string")


_LEGAL = {"su", "ua", "au"}
_COST = {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}
_AUDITS = pa.schema([
    ("conv", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_AUDITS_DDL = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Audit:
    """Counts, edits and hash of one conversation while its rows go by in order."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.low, self.high, self.turns, self.illegal, self.cost = conv, None, None, 0, 0, 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.role, self.letters, self.sha, self.some = None, [], hashlib.sha256(), False

    def add(self, turn: int | None, role: str, text: str, copies: int, fault: str | None, edits: str, tail: str) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        initial = role[:1]
        if self.role is not None and self.role + initial not in _LEGAL:
            self.illegal += 1
        self.role, self.illegal = initial, self.illegal + copies - 1
        if fault:
            self.faults[fault] += 1
        self.faults["blank" if fault == "blank" else "duplicate"] += copies - 1
        letters = edits[::2]
        self.cost += sum(map(_COST.__getitem__, letters + tail[::2])) + DELETE * (copies - 1) + (TRUNCATED if fault == "truncated" and letters[-1] != "D" else 0)
        self.letters.append(letters + "D" * (copies - 1) + tail[::2])
        for name, words in turns_after(role, text, edits + tail):
            self.sha.update(f"{chr(10) if self.some else ''}{name}:{words}".encode())
            self.some = True

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.letters), self.sha.hexdigest()


def _auditing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of conversation and ``at``; a row without ``at`` comes first and opens a conversation."""
    held, done = None, []
    for batch in batches:
        for conv, at, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at is None:
                if held is not None:
                    done.append(held.row())
                held = _Audit(conv)
            else:
                held.add(*rest)
        if len(done) >= 1000:
            yield batch_of(_AUDITS, list(zip(*done, strict=True)))
            done = []
    if held is not None:
        done.append(held.row())
    if done:
        yield batch_of(_AUDITS, list(zip(*done, strict=True)))


def audits(conversations: DataFrame, fixed: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation of ``conversations``: counts, cost, the letters of its edits, the hash of what they leave.

    ``fixed`` is what ``repair`` returns for its rows. A conversation without rows there has zeros, no letters and the hash
    of the empty string. A hash is a chain, so the texts of one conversation pass through one task, row by row.
    """
    columns = ["conv", "at", "turn", "role", "text", "copies", "fault", "edits", "tail"]
    ids = conversations.select(F.col(conv_col).cast("long").alias("conv")).distinct()
    marks = ids.select("conv", *[F.lit(None).cast(fixed.schema[c].dataType).alias(c) for c in columns[1:]])
    rows = marks.unionByName(fixed.select(*columns)).repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), F.asc_nulls_first("at"))
    return rows.mapInArrow(_auditing, _AUDITS_DDL)
