"""Quality rules: word and line counts of a text, and lines that too many documents of a host share.

A line is hashed with its words joined by one space. Per host, the documents that hold a line are counted by an exact
distinct count of texts, so copies count once, and the distinct length classes among them are counted too: near copies
of one text fall into one or two classes, while a menu or a notice stands in texts of all lengths. A line above both
limits is removed from the texts; a document of whose words too few are left is rejected. The counting shuffles only
hashes; at the end each text, compressed for its way, meets the hashes of its own frequent lines, and its lines are
dropped in one pass.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from quire.llm.common import batch_of, raw, stored

MIN_WORDS = 50
#: A line is removed if more texts of its host hold it than this number and this share of the host's texts ...
MAX_TEXTS = 20
MAX_SHARE = 0.001
#: ... and if those texts fall into more length classes than this (sixteen classes for each doubling).
MAX_CLASSES = 8
#: A document is rejected if less than one word in so many is left.
LEFT = 5
SYMBOLS = b"#*$%&|<>"
#: The seed of Spark's own ``xxhash64``, which names a text by the same number.
TEXT_SEED = 42

_LINES = pa.schema([("host", pa.string()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("lines", pa.list_(pa.int64()))])
_LINES_DDL = "host string, text_key long, n_words long, lines array<long>"
_JUDGED = pa.schema([
    ("id", pa.int64()), ("host", pa.string()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("removed_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("text", pa.string()),
])
_JUDGED_DDL = (
    "id long, host string, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, removed_words long, "
    "base_failed boolean, kept boolean, text string")


def repeated_words(words: list[bytes]) -> int:
    """Words covered by 3-word windows that stand twice or more in the list."""
    if len(words) < 4:
        return 0
    names: dict[bytes, int] = {}
    at = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    pairs = at[:-1] * len(names) + at[1:]
    if len(names) > 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, window, count = np.unique(pairs[:-1] * len(names) + at[2:], return_inverse=True, return_counts=True)
    twice = count[window] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= twice
    return int(covered.sum())


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def line_key(line: bytes) -> int:
    """The hash of a line with its words joined by one space."""
    return _signed(xxhash.xxh64_intdigest(b" ".join(line.split())))


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    """The counts of one text: words, their characters, symbols, repeated lines, words in repeated windows."""
    words = text.split()
    lines = Counter(line for line in text.split(b"\n") if line and not line.isspace())
    letters = len(b"".join(words).decode("utf-8", "replace"))
    return len(words), letters, len(text) - len(text.translate(None, SYMBOLS)), sum(lines.values()) - len(lines), repeated_words(words)


def without_lines(text: bytes, drop: set[int]) -> bytes:
    """The text without the lines whose hash is to be dropped; every other byte stays."""
    return b"\n".join(line for line in text.split(b"\n") if not line or line.isspace() or line_key(line) not in drop)


def _lined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in (t or b"" for t in raw(batch, "text")):
            lines = {line for line in text.split(b"\n") if line and not line.isspace()}
            rows.append((_signed(xxhash.xxh64_intdigest(text, TEXT_SEED)), len(text.split()), list(set(map(line_key, lines)))))
        if rows:
            yield batch_of(_LINES, [batch.column(0), *zip(*rows, strict=True)])


def verdict(text: bytes, drop: list[int] | None, min_words: int, left: int) -> tuple:
    """The counts of one text, the words that its dropped lines took, ``base_failed``, ``kept`` and the text without these lines."""
    counts = measure(text)
    n_words, n_repeat = counts[0], counts[4]
    clean = without_lines(text, set(drop)) if drop else text
    removed = n_words - len(clean.split()) if drop else 0
    failed = n_words < min_words or 100 * n_repeat > 50 * n_words
    return *counts, removed, failed, not failed and left * (n_words - removed) >= n_words, clean


def frequent_lines(measured: DataFrame, max_texts: int, max_share: float, max_classes: int) -> DataFrame:
    """``host`` and ``line`` of the lines above the limits."""
    size = F.expr("length(bin(n_words)) * 16 + (shiftright(n_words, greatest(length(bin(n_words)) - 5, 0)) & 15)").alias("size")
    texts = measured.select("host", "text_key", size, "lines").dropDuplicates(["host", "text_key"])
    hosts = texts.groupBy("host").agg(F.count(F.lit(1)).alias("host_texts"))
    held = texts.select("host", "size", F.explode("lines").alias("line"))
    counted = held.groupBy("host", "line", "size").agg(F.count(F.lit(1)).alias("n")).groupBy("host", "line").agg(F.sum("n").alias("texts"), F.count(F.lit(1)).alias("classes"))
    counted = counted.where((F.col("texts") > max_texts) & (F.col("classes") > max_classes))
    return counted.join(hosts, counted["host"].eqNullSafe(hosts["host"])).where(F.col("texts") > F.col("host_texts") * max_share).select(counted["host"], "line")


def packed(batch: pa.RecordBatch, name: str) -> pa.RecordBatch:
    """The batch with its texts compressed, each by itself."""
    packer = zstandard.ZstdCompressor(level=1)
    texts = pa.array([None if t is None else packer.compress(t) for t in raw(batch, name)], pa.binary())
    return pa.RecordBatch.from_arrays([texts if n == name else c for n, c in zip(batch.schema.names, batch.columns, strict=True)], names=batch.schema.names)


def unpacked(column: pa.Array) -> Iterator[bytes | None]:
    unpack = zstandard.ZstdDecompressor()
    return (None if t is None else unpack.decompress(t) for t in column.to_pylist())


def _dropped(docs: DataFrame, text_col: str, host_col: str, max_texts: int, max_share: float, max_classes: int) -> DataFrame:
    """``docs`` with its texts ``packed`` and ``__drop``: the hashes of the lines of its text that are above the limits, or null."""
    plain = docs.select(F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    measured = stored(plain.mapInArrow(_lined, _LINES_DDL), "measured")
    often = frequent_lines(measured, max_texts, max_share, max_classes)
    texts = measured.select(F.col("host").alias("__host"), F.col("text_key").alias("__key"), "lines").dropDuplicates(["__host", "__key"])
    held = texts.select("__host", "__key", F.explode("lines").alias("__line"))
    hit = held.join(often, held["__host"].eqNullSafe(often["host"]) & (held["__line"] == often["line"])).select("__host", "__key", "__line")
    # a table of texts that lose lines: only as long as these texts have frequent lines
    drop = stored(hit.groupBy("__host", "__key").agg(F.collect_list("__line").alias("__drop")), "dropped")
    keyed = docs.withColumn("__own", F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))))
    schema = StructType([StructField(f.name, BinaryType()) if f.name == text_col else f for f in keyed.schema])
    # texts are the bulk of what the join moves
    light = keyed.mapInArrow(lambda batches: (packed(b, text_col) for b in batches), schema)
    # merged at every size: a broadcast would be right for small tables only
    return light.join(drop.hint("merge"), light[host_col].cast("string").eqNullSafe(drop["__host"]) & (light["__own"] == drop["__key"]), "left").select(*[light[c] for c in docs.columns], "__drop")


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = MIN_WORDS, max_texts: int = MAX_TEXTS,
    max_share: float = MAX_SHARE, max_classes: int = MAX_CLASSES, left: int = LEFT,
) -> DataFrame:
    """One row per row: ``id``, ``host``, ``text_key``, the counts, ``removed_words``, ``base_failed``, ``kept`` and ``text``.

    ``text`` is the text without its lines above the limits, and ``removed_words`` is what it lacks. A null text counts
    as empty (no words, so it fails); a null host is a host of its own; repeated rows all get the same verdict; an empty
    table gives no rows.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, drop in zip(unpacked(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                *found, clean = verdict(text or b"", drop, min_words, left)
                rows.append((_signed(xxhash.xxh64_intdigest(text or b"", TEXT_SEED)), *found, None if text is None else clean.decode()))
            if rows:
                yield batch_of(_JUDGED, [batch.column(0), batch.column(1), *zip(*rows, strict=True)])

    return _dropped(plain, "text", "host", max_texts, max_share, max_classes).mapInArrow(judged, _JUDGED_DDL)


def keep_good(
    docs: DataFrame, text_col: str = "text", host_col: str = "source", min_words: int = MIN_WORDS, max_texts: int = MAX_TEXTS,
    max_share: float = MAX_SHARE, max_classes: int = MAX_CLASSES, left: int = LEFT,
) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; the text is without its lines above the limits."""

    kind = pa.binary() if docs.schema[text_col].dataType == BinaryType() else pa.string()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            rows = [verdict(t or b"", d, min_words, left) for t, d in zip(unpacked(batch.column(at)), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            good = pa.array([r[-2] for r in rows], pa.bool_())
            clean = pa.array([r[-1] if r[-2] else None for r in rows], pa.large_binary()).cast(kind)
            columns = [clean if k == at else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1]).filter(good)

    return _dropped(docs, text_col, host_col, max_texts, max_share, max_classes).mapInArrow(keep, docs.schema)
