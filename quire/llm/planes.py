"""Token ids in binary files of planes: encode whole texts, write the ids in order, read them back.

A file holds the ids of consecutive documents as blocks of a fixed number of ids. A block is transposed into byte planes
(or bit planes), so that the high bytes, which are mostly alike, stand together, and each plane is compressed by itself
with zstandard. The file ends with the table of its documents and with an index of its blocks, which says where each
plane lies; a reader needs the last bytes, the index, and then only the planes of the blocks it wants::

    "QPLANES1" | planes of block 0 | planes of block 1 | ... | documents | index | length of index (8 bytes) | "QPLANES1"

Documents are dealt to tasks by ranges of their ids, so files follow the order of the ids. A task writes under a name of
its attempt and renames the finished file, so that a repeated task does no harm.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.bpe import tokenizer
from quire.llm.common import batch_of, keyed_text, raw, shared_path, stored

END = 2
BLOCK = 1 << 16
#: Ids of a file; one more document may stand above it.
FILE_IDS = 1 << 23
LEVEL = 3
#: Distinct chunks that a worker remembers.
ROOM = 600_000
#: Texts whose words are laid out at once, and their bytes.
PART, PART_BYTES = 1_000, 1 << 22
MAGIC = b"QPLANES1"

#: Runs of spaces and line feeds with the text up to the next: the pre-tokenizer never joins text with a blank behind it.
_CHUNK = re.compile(rb"[ \n]*[^ \n]+|[ \n]+")
#: One space, then text without any blank or control sign.
_SIMPLE = re.compile(r" [^\s\x00-\x20\x85᠎]+\Z")
_PLAIN = re.compile(r"[ \n]*[^\s\x00-\x20\x85᠎]+\Z|[ \n]+\Z")
_BREAK = b"\n"
#: What stands before the first word of a text among its words.
_FIRST = b"\n\n"


def _chunk_entries(path: str):
    """Little-endian 32-bit ids of each chunk; None if it holds blanks of other kinds, for which a whole text is encoded."""
    made = tokenizer(path)
    size = made.get_vocab_size()
    begins = np.array([(made.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
    special = re.compile("|".join(re.escape(t.content) for t in made.get_added_tokens_decoder().values()) or r"(?!)")

    def make(chunks: list[bytes]) -> list[bytes | None]:
        texts = [c.decode() for c in chunks]
        simple = list(map(_SIMPLE.match, texts))
        if special.search("\n".join(texts)):
            simple = [s and not special.search(t) for s, t in zip(simple, texts, strict=True)]
        out: list[bytes | None] = [None] * len(texts)
        at = [k for k, s in enumerate(simple) if s]
        for low in range(0, len(at), 20_000):
            groups = [at[k : k + 100] for k in range(low, min(low + 20_000, len(at)), 100)]
            for group, e in zip(groups, made.encode_batch_fast(["".join([texts[k] for k in g]) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                edges = [*(4 * np.flatnonzero(begins[ids])).tolist(), 4 * len(ids)]
                packed = ids.tobytes()
                for k, i, j in zip(group, edges[:-1], edges[1:], strict=True):
                    out[k] = packed[i:j]
        rest = [k for k, (s, t) in enumerate(zip(simple, texts, strict=True)) if not s and _PLAIN.match(t)]
        for k, e in zip(rest, made.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False) if rest else [], strict=True):
            out[k] = np.array(e.ids, "<u4").tobytes()
        return out

    return make


class Memory:
    """Entries of keys: of the words of a text (``_words``), of chunks with their blanks.

    Up to ``room`` keys stay; what a batch needs besides leaves with the batch.
    """

    def __init__(self, make, room: int = ROOM) -> None:
        self.make, self.room = make, room
        self.known: dict[str, dict[bytes, bytes | None]] = {"word": {}, "chunk": {}}
        self.passing: list[tuple[dict, dict]] = []

    def _words(self, keys: list[bytes]) -> list[bytes | None]:
        """A word behind a space takes the space along, the first word of a later line its line feed."""
        made = self.make([*(k.lstrip(_BREAK) if k.startswith(_BREAK) else b" " + k for k in keys), _BREAK])
        line_feed = made.pop()
        behind = [k.startswith(_BREAK) and not k.startswith(_FIRST) for k in keys]
        return [line_feed + m if b and m is not None else m for b, m in zip(behind, made, strict=True)]

    def fill(self, kind: str, keys: Iterable[bytes]):
        """A lookup for these keys, none of them twice, until ``settle``."""
        known = self.known[kind]
        new = [k for k in keys if k not in known]
        if new:
            made = dict(zip(new, self._words(new) if kind == "word" else self.make(new), strict=True))
            if sum(map(len, self.known.values())) + len(made) > self.room:
                self.passing.append((known, made))
            known.update(made)
        return known.__getitem__

    def settle(self) -> None:
        for known, made in self.passing:
            for key in made:
                del known[key]
        self.passing = []


_memos: dict[str, Memory] = {}
_IDS = pa.schema([("id", pa.int64()), ("ids", pa.binary())])


def _usual(text: bytes) -> bool:
    """Single spaces and single line feeds between words, and no others."""
    return not (not text or b"  " in text or b"\n\n" in text or b" \n" in text or b"\n " in text or text[0] in b" \n" or text[-1] in b" \n")


def _words(texts: list[bytes]) -> pa.Array:
    """Lists of the words of usual texts: bare behind a space, with a line feed at the start of a line, with two at the start."""
    return pc.split_pattern(pa.array([_FIRST + t.replace(_BREAK, b" " + _BREAK) for t in texts], pa.large_binary()), " ")


def _values(column: pa.Array) -> list[bytes]:
    """The values of a column without nulls."""
    ends = np.frombuffer(column.buffers()[1], "<i8", len(column) + 1).tolist()
    return list(map(column.buffers()[2].to_pybytes().__getitem__, map(slice, ends[:-1], ends[1:])))


def encode_texts(texts: list[bytes], memory: Memory, whole) -> list[bytes]:
    """Ids of texts from the entries of their words; ``whole`` encodes a text that has a chunk without an entry.

    Words are split, told apart and laid out again as Arrow columns, so only distinct ones are looked up.
    """
    out: list[bytes | None] = [None] * len(texts)
    usual = [k for k, t in enumerate(texts) if _usual(t)]
    if usual:
        lists = _words([texts[k] for k in usual])
        words = lists.flatten().dictionary_encode()
        keys = _values(words.dictionary)
        laid = pa.array(map(memory.fill("word", keys), keys), pa.large_binary(), size=len(keys)).take(words.indices)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        gaps = np.concatenate([[0], np.cumsum(laid.is_null().to_numpy(zero_copy_only=False))])[ends]
        content, at = laid.buffers()[2], np.frombuffer(laid.buffers()[1], "<i8", len(laid) + 1)[ends].tolist()
        for k, first, last, gap in zip(usual, at[:-1], at[1:], np.diff(gaps).tolist(), strict=True):
            if not gap:
                out[k] = content.slice(first, last - first).to_pybytes()
    odd = {k: _CHUNK.findall(texts[k]) for k in set(range(len(texts))).difference(usual)}
    chunks = memory.fill("chunk", set().union(*odd.values()))
    for k, parts in odd.items():
        found = list(map(chunks, parts))
        out[k] = None if None in found else b"".join(found)
    memory.settle()
    return [whole(t) if ids is None else ids for t, ids in zip(texts, out, strict=True)]


def _encoded(path: str, end: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memos.get(path) or _memos.setdefault(path, Memory(_chunk_entries(path)))
        made, last = tokenizer(path), np.array([end], "<u4").tobytes()
        narrow, packer = made.get_vocab_size() <= 1 << 16 and end < 1 << 16, zstandard.ZstdCompressor(level=1)

        def whole(text: bytes) -> bytes:
            return np.array(made.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

        for batch in batches:
            # so many texts as make up a part's bytes on average
            rows = max(1, min(PART, PART_BYTES * batch.num_rows // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                found = encode_texts([t or b"" for t in raw(part, "text")], memory, whole)
                packed = [ids + last for ids in found]
                out = [packer.compress(np.frombuffer(p, "<u4").astype("<u2").tobytes() if narrow else p) for p in packed]
                yield batch_of(_IDS, [part.column(0), out])

    return encode


def encode_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> tuple[DataFrame, int]:
    """``id`` and ``ids`` (little-endian, with the end id, compressed) per row, and the bytes of one id."""
    made = tokenizer(path)
    width = 2 if made.get_vocab_size() <= 1 << 16 and end < 1 << 16 else 4
    return keyed_text(docs, id_col, text_col).mapInArrow(_encoded(path, end), "id long, ids binary"), width


def to_planes(ids: np.ndarray, bits: bool) -> np.ndarray:
    """One row per plane: 4 byte planes, or 32 bit planes of eight ids a byte."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return np.ascontiguousarray(octets.T)
    return np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1, bitorder="little")


def from_planes(planes: np.ndarray, n: int, bits: bool) -> np.ndarray:
    if bits:
        planes = np.packbits(np.unpackbits(planes, axis=1, bitorder="little", count=n).T, axis=1, bitorder="little").T
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")


class PlaneFile:
    """Writes one file; ids and documents are added in order."""

    def __init__(self, sink, bits: bool = False, block: int = BLOCK) -> None:
        self.sink, self.bits, self.block, self.at = sink, bits, block, len(MAGIC)
        self.rest, self.waiting = [], 0
        self.index, self.ids, self.sizes, self.n_ids = [], [], [], 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        sink.write(MAGIC)

    def _put(self, data: bytes) -> list[int]:
        packed = self.packer.compress(data)
        self.sink.write(packed)
        self.at += len(packed)
        return [self.at - len(packed), len(packed)]

    def _flush(self, all_of_it: bool) -> None:
        held = np.concatenate(self.rest) if self.rest else np.empty(0, "<u4")
        stop = len(held) if all_of_it else len(held) // self.block * self.block
        for at in range(0, stop, self.block):
            ids = held[at : min(at + self.block, stop)]
            self.index.append([len(ids), [self._put(plane.tobytes()) for plane in to_planes(ids, self.bits)]])
        self.rest, self.waiting = [held[stop:]], len(held) - stop

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.ids.append(key)
        self.sizes.append(len(ids))
        self.waiting += len(ids)
        self.n_ids += len(ids)
        if self.waiting >= 8 * self.block:
            self._flush(False)

    def close(self) -> None:
        self._flush(True)
        table = b"".join(np.array(x, "<i8").tobytes() for x in ([k is None for k in self.ids], [k or 0 for k in self.ids], self.sizes))
        head = {"bits": self.bits, "docs": self._put(table), "n_docs": len(self.ids), "n_ids": self.n_ids, "blocks": self.index}
        packed = self.packer.compress(json.dumps(head).encode())
        self.sink.write(packed + len(packed).to_bytes(8, "little") + MAGIC)
        self.sink.close()


def read_file(content: bytes | memoryview) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their sizes and all ids of one file."""
    view, unpack = memoryview(content), zstandard.ZstdDecompressor()
    if bytes(view[: len(MAGIC)]) != MAGIC or bytes(view[-len(MAGIC) :]) != MAGIC:
        raise ValueError("not a whole file of planes")
    end = len(view) - len(MAGIC) - 8
    head = json.loads(unpack.decompress(view[end - int.from_bytes(view[end : end + 8], "little") : end]))

    def part(where: list[int]) -> bytes:
        return unpack.decompress(view[where[0] : where[0] + where[1]])

    table = np.frombuffer(part(head["docs"]), "<i8").reshape(3, -1)
    blocks = [from_planes(np.stack([np.frombuffer(part(w), np.uint8) for w in planes]), n, head["bits"]) for n, planes in head["blocks"]]
    keys = [None if none else key for none, key in zip(table[0].tolist(), table[1].tolist(), strict=True)]
    return keys, table[2], np.concatenate(blocks) if blocks else np.empty(0, "<u4")


_FILES = pa.schema([("part", pa.int64()), ("number", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def _writer(folder: str, width: int, bits: bool, file_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        part, number, file, made, unpack = context.partitionId(), 0, None, [], zstandard.ZstdDecompressor()

        def finish() -> None:
            file.close()
            name = f"part-{part:05d}-{number:05d}.planes"
            store.move(f"{root}/.{name}.{context.taskAttemptId()}", f"{root}/{name}")
            made.append((part, number, name, len(file.ids), file.n_ids))

        for batch in batches:
            for key, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if file is None:
                    file = PlaneFile(store.open_output_stream(f"{root}/.part-{part:05d}-{number:05d}.planes.{context.taskAttemptId()}"), bits)
                file.add(key, np.frombuffer(unpack.decompress(packed), f"<u{width}").astype("<u4"))
                if file.n_ids >= file_ids:
                    finish()
                    number, file = number + 1, None
        if file is not None:
            finish()
        if made:
            yield batch_of(_FILES, list(zip(*made, strict=True)))

    return write


def write_planes(ids: DataFrame, width: int, folder: str, bits: bool = False, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the files in ascending order of ``id`` (null first) and return their list: part, number, name, n_docs, n_ids.

    Order by ``part`` and ``number`` is order of the ids; equal ids stand in the order of a hash of their contents.
    """
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    # ranges are sampled by a short key: samples of it go to the driver
    mark = F.xxhash64("ids")
    ranged = ids.repartitionByRange("id", mark).sortWithinPartitions("id", mark, "ids")
    return stored(ranged.mapInArrow(_writer(folder, width, bits, file_ids), "part long, number long, name string, n_docs long, n_ids long"), "files")


_READ = pa.schema([("name", pa.string()), ("id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            keys, sizes, ids = read_file(content.as_buffer())
            ends = np.cumsum(sizes)
            marks = [zlib.crc32(ids[e - s : e].tobytes()) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
            yield batch_of(_READ, [[path.rpartition("/")[2]] * len(keys), keys, ends - sizes, sizes, marks])


def read_planes(files: DataFrame, folder: str) -> DataFrame:
    """One row per document of the files: ``id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    offsets = files.select("name", before.alias("offset"))
    contents = files.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*.planes").load(folder).select("path", "content")
    found = contents.mapInArrow(_documents, "name string, id long, first long, n_tokens long, ids_crc32 long")
    return found.join(offsets, "name").select("id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def planes_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", bits: bool = False, end: int = END) -> DataFrame:
    """Encode, write to a new folder beside the checkpoints, read back: one row per row of ``docs``.

    A null or empty text is the end id alone; repeated rows stand side by side; an empty table gives no files and no rows.
    """
    ids, width = encode_ids(docs, path, id_col, text_col, end)
    folder = shared_path(docs.sparkSession, "planes")
    files = write_planes(stored(ids, "ids"), width, folder, bits)
    return read_planes(files, folder)
