"""Token ids in files, packed into the fewest bits that hold the vocabulary.

A file holds blocks of 4096 ids. Every 64 ids become ``bits`` little-endian 64-bit words, so a block is unpacked
with a few numpy operations, and the stored block offsets let a reader start at any id. After the blocks come the
block offsets, the documents' ids and ends, and a fixed-size trailer; nothing but these is held while writing.

Cases: a null or empty text is the end id alone; rows without an id come first, as nulls sort; rows that repeat an
id are documents of their own, ordered by text; an empty table gives no file and no rows; extra columns are not
stored. A document of any length is packed piece by piece.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stage, text_blocks, words_of

MAGIC = b"IDPACK01"
BLOCK_IDS = 4096
FILE_IDS = 1 << 27
CACHE_WORDS = 700_000
TEXT_BYTES = 2 << 20
TRAILER = struct.Struct("<8sIIQQQ")  # magic, bits, ids in a block, ids, documents, start of the index


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids, padded with zeros to a multiple of 64, in ``bits`` bits each."""
    rows = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    rows.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(rows), bits), np.uint64)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        out[:, word] |= rows[:, i] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= rows[:, i] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed data."""
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    out = np.zeros((len(words), 64), np.uint32)
    low = np.uint64((1 << bits) - 1)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, i] = x & low
    return out.reshape(-1)[:n]


class Writer:
    """One file while it is written."""

    def __init__(self, stream, bits: int):
        self.stream, self.bits, self.n, self.at = stream, bits, 0, 0
        self.offsets, self.docs, self.ends, self.held, self.n_held = [], [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"an id needs more than {self.bits} bits")
        self.held.append(ids)
        self.n_held += len(ids)
        self.n += len(ids)
        self.docs.append(doc_id)
        self.ends.append(self.n)
        if self.n_held >= 64 * BLOCK_IDS:
            self._flush(self.n_held // BLOCK_IDS * BLOCK_IDS)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        data = pack_bits(ids[:n], self.bits)
        size = BLOCK_IDS * self.bits // 8
        self.offsets += range(self.at, self.at + len(data), size)
        self.at += len(data)
        self.stream.write(data)
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.n_held)
        null = np.array([x is None for x in self.docs], np.uint8)
        docs = np.array([x or 0 for x in self.docs], "<i8")
        for x in (np.array(self.offsets, "<u8"), docs, null, np.array(self.ends, "<u8")):
            self.stream.write(x.tobytes())
        self.stream.write(TRAILER.pack(MAGIC, self.bits, BLOCK_IDS, self.n, len(self.docs), self.at))
        self.stream.close()


class Reader:
    """Random access to the ids of a file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        magic, self.bits, self.block, self.n, self.n_docs, at = TRAILER.unpack(source.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        blocks = -(-self.n // self.block)
        index = source.read_at(size - TRAILER.size - at, at)
        parts = np.cumsum([0, 8 * blocks, 8 * self.n_docs, self.n_docs, 8 * self.n_docs])
        self.offsets = np.append(np.frombuffer(index[parts[0] : parts[1]], "<u8").astype(np.int64), at)
        self.docs = np.frombuffer(index[parts[1] : parts[2]], "<i8")
        self.null = np.frombuffer(index[parts[2] : parts[3]], np.uint8).astype(bool)
        self.ends = np.frombuffer(index[parts[3] : parts[4]], "<u8").astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``: only the blocks that hold them are read."""
        first, last = start // self.block, -(-stop // self.block)
        if start >= stop:
            return np.zeros(0, np.uint32)
        data = self.source.read_at(int(self.offsets[last] - self.offsets[first]), int(self.offsets[first]))
        shift = first * self.block
        return unpack_bits(data, self.bits, min(self.n, last * self.block) - shift)[start - shift : stop - shift]


_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def same_bytes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> bool:
    """Whether every piece has the bytes of the piece ``other`` says, eight bytes at a time."""
    size = end - start
    if (size != size[other]).any():
        return False
    padded = np.append(raw, np.zeros(8, np.uint8))
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place
    todo, k = np.flatnonzero(other != np.arange(len(start))), 0
    while len(todo):
        differ = eight[start[todo] + k] ^ eight[start[other[todo]] + k]
        if (differ & _MASKS[np.minimum(size[todo] - k, 8)]).any():
            return False
        k += 8
        todo = todo[size[todo] > k]
    return True


class Encoder:
    """Texts to ids. With ``by_space`` the ids of space-separated pieces are kept and reused.

    That is right for vocabularies that drop white space, as their pieces do not depend on each other.
    """

    def __init__(self, vocabulary: str, by_space: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.of, self.by_space = Tokenizer.from_file(vocabulary), by_space
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in turn, block after block."""
        for at, raw, offsets in text_blocks(texts, TEXT_BYTES):
            rows = len(offsets) - 1
            if self.by_space:
                yield from self._by_pieces(raw, offsets)
            else:
                for x in self.of.encode_batch(texts.slice(at, rows).fill_null("").to_pylist(), add_special_tokens=False):
                    yield np.array(x.ids, np.uint32)

    def _by_pieces(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """Each different piece of a block is looked up once, then ids are gathered for all."""
        start, end, code, doc = words_of(raw, offsets, lower=False)
        rows = len(offsets) - 1
        if not len(start):
            yield from (np.zeros(0, np.uint32) for _ in range(rows))
            return
        _, first, which = np.unique(code, return_index=True, return_inverse=True)
        data = raw.tobytes()
        if not same_bytes(raw, start, end, first[which]):  # pieces that share a code
            places: dict[bytes, int] = {}
            which = np.array([places.setdefault(data[a:b], len(places)) for a, b in zip(start.tolist(), end.tolist(), strict=True)])
            first = np.unique(which, return_index=True)[1]
        found = self._look_up([data[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)])
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        own = sizes[which]
        after = np.cumsum(own)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[which] - (after - own), own) + np.arange(after[-1])]
        cut = np.append(0, after)[np.searchsorted(doc, np.arange(rows + 1))].tolist()
        yield from (ids[a:b] for a, b in zip(cut, cut[1:], strict=False))

    def _look_up(self, pieces: list[bytes]) -> list[bytes]:
        new, old = self.new, self.old
        out = [new.get(x) for x in pieces]
        lacking = [i for i, x in enumerate(out) if x is None]
        todo = []
        for i in lacking:
            out[i] = old.get(pieces[i])
            if out[i] is None:
                todo.append(i)
        for i, x in zip(todo, self.of.encode_batch_fast([pieces[i].decode() for i in todo], add_special_tokens=False), strict=True):
            out[i] = array("I", x.ids).tobytes()
        new.update((pieces[i], out[i]) for i in lacking)
        if len(new) > CACHE_WORDS:
            self.old, self.new = new, {}
        return out


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(vocabulary: str, by_space: bool) -> Encoder:
    """The worker's encoder: tasks that follow each other in a worker share its pieces."""
    key = vocabulary, by_space
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary, by_space)
    return _ENCODERS[key]


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, by_space: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write the documents' ids in ascending id order; returns (file, path, n_ids, n_docs), where ``file`` orders the files."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = source.repartitionByRange("id").sortWithinPartitions("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        encode = encoder(vocabulary, by_space)
        bits = max(1, (max(encode.of.get_vocab_size(), end_id + 1) - 1).bit_length())
        files, out = [], None
        first = TaskContext.get().partitionId() << 24
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                if out is None:
                    store.create_dir(folder, recursive=True)
                    name = f"{folder}/{uuid.uuid4().hex}.ids"
                    out = Writer(store.open_output_stream(name, compression=None), bits)
                out.add(doc_id, np.append(ids, np.uint32(end_id)))
                if out.n >= FILE_IDS:
                    out.close()
                    files.append((first + len(files), name, out.n, len(out.docs)))
                    out = None
        if out is not None:
            out.close()
            files.append((first + len(files), name, out.n, len(out.docs)))
        if files:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*files, strict=True)], names=["file", "path", "n_ids", "n_docs"])

    return stage(ordered.mapInArrow(write, "file long, path string, n_ids long, n_docs long"))


def read_tokens(spark: SparkSession, files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files; ``start`` counts over all files."""
    folder = shared_dir(spark)
    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    placed = files.select("path", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(path) as source:
                    yield from rows_of(Reader(source), base)

    def rows_of(reader: Reader, base: int) -> Iterator[pa.RecordBatch]:
        starts = np.append(0, reader.ends[:-1])
        crc = np.zeros(reader.n_docs, np.int64)
        step = 256 * reader.block
        doc = 0
        for at in range(0, reader.n, step):
            ids = reader.ids(at, min(reader.n, at + step)).astype("<u4")
            while doc < reader.n_docs and starts[doc] < at + step:
                own = ids[max(0, starts[doc] - at) : reader.ends[doc] - at]
                crc[doc] = zlib.crc32(own.tobytes(), int(crc[doc]))
                if reader.ends[doc] > at + step:
                    break
                doc += 1
        for i in range(0, reader.n_docs, 100_000):
            k = slice(i, i + 100_000)
            arrays = [pa.array(reader.docs[k], mask=reader.null[k]), pa.array(starts[k] + base), pa.array(reader.ends[k] - starts[k]), pa.array(crc[k])]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "start", "n_tokens", "ids_crc32"])

    n = max(1, files.count())
    return placed.repartition(n, "path").mapInArrow(read, f"{id_col} long, start long, n_tokens long, ids_crc32 long")
