"""Token ids in sorted-string-table shards.

A file holds documents in ascending key order:

    data block*  filter block  index block  footer

A data block is Zstandard-compressed and followed by the CRC-32 of its bytes as stored.
Its entries are ``varint shared, varint rest, varint length, key rest, value``: a key
repeats only what differs from the key before. Every 16th entry is a restart point
with its whole key; the restart offsets and their number end the block, so that a
lookup is a binary search over restarts. The index block is built in the same way and
maps the last key of each data block to its place. The filter block is a Bloom filter
over all keys. The footer has a fixed size.

A key is an identifier in order-preserving bytes: null first, then signed integers.
A value is the ids of the document, 2 or 4 bytes each.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivane.llm.common import column_or_null, new_folder, written
from lexivane.llm.tokens import Encoder

MAGIC = b"lxvsst01"
FOOTER = "<QQQQQQB7x8s"
BLOCK_BYTES, RESTART, BLOOM_BITS, BLOOM_HASHES = 1 << 16, 16, 10, 7
#: A file of more bytes than this is closed and the next one begun.
FILE_BYTES = 256 << 20
MAX_READERS = 50_000
#: Texts are encoded in groups of about so many bytes.
GROUP_BYTES = 1_500_000


def key_bytes(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def key_id(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 0x7F) << shift
        if x < 0x80:
            return n, at
        shift += 7


class Block:
    """Builds one block of prefix-compressed entries."""

    def __init__(self):
        self.parts, self.size, self.restarts, self.n, self.last = [], 0, [], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.n % RESTART:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(self.size)
        head = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.parts += [head, value]
        self.size, self.n, self.last = self.size + len(head) + len(value), self.n + 1, key

    def raw(self) -> bytes:
        return b"".join(self.parts) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))


def entries(raw: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
    """(key, value) of a block from a restart point on."""
    end, key = len(raw) - 4 - 4 * struct.unpack_from("<I", raw, len(raw) - 4)[0], b""
    while at < end:
        shared, at = _read_varint(raw, at)
        rest, at = _read_varint(raw, at)
        length, at = _read_varint(raw, at)
        key = key[:shared] + raw[at : at + rest]
        at += rest
        yield key, raw[at : at + length]
        at += length


def seek(raw: bytes, key: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Entries from the last restart point whose key is below ``key``."""
    n = struct.unpack_from("<I", raw, len(raw) - 4)[0]
    if not n:
        return iter(())
    places = struct.unpack_from(f"<{n}I", raw, len(raw) - 4 - 4 * n)
    low, high = 0, n - 1
    while low < high:
        mid = (low + high + 1) // 2
        if next(entries(raw, places[mid]))[0] < key:
            low = mid
        else:
            high = mid - 1
    return entries(raw, places[low])


def _bloom_places(key: bytes, bits: int) -> Iterator[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return ((a + i * b) % bits for i in range(BLOOM_HASHES))


class Writer:
    """Writes one file; keys must not descend."""

    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width, self.zip = out, width, zstandard.ZstdCompressor(level=1)
        self.block, self.index, self.keys, self.at, self.ids = Block(), Block(), [], 0, 0

    def _flush(self) -> None:
        if self.block.n:
            stored = self.zip.compress(self.block.raw())
            self.index.add(self.block.last, struct.pack("<QI", self.at, len(stored)))
            self.out.write(stored + struct.pack("<I", zlib.crc32(stored)))
            self.at += len(stored) + 4
            self.block = Block()

    def add(self, key: bytes, value: bytes) -> None:
        self.keys.append(key)
        self.ids += len(value) // self.width
        self.block.add(key, value)
        if self.block.size >= BLOCK_BYTES:
            self._flush()

    def close(self) -> None:
        self._flush()
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for k in self.keys:
            for i in _bloom_places(k, bits):
                bloom[i >> 3] |= 1 << (i & 7)
        index = self.index.raw()
        self.out.write(bytes(bloom) + index)
        self.out.write(struct.pack(FOOTER, self.at, bits, self.at + len(bloom), len(index), len(self.keys), self.ids, self.width, MAGIC))
        self.out.close()


class Reader:
    """Reads one file: ``get`` looks up, ``scan`` goes through all. Closes it as a context."""

    def __init__(self, path: str):
        import zstandard
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(place)
        self.unzip = zstandard.ZstdDecompressor()
        size = self.file.size()
        tail = struct.unpack(FOOTER, self.file.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER)))
        filter_at, self.bits, index_at, index_size, self.n_docs, self.n_ids, self.width, magic = tail
        if magic != MAGIC:
            raise ValueError(f"{path} is no token table")
        self.bloom = self.file.read_at(index_at - filter_at, filter_at)
        self.index = self.file.read_at(index_size, index_at)

    def close(self) -> None:
        self.file.close()

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _block(self, place: bytes) -> bytes:
        at, size = struct.unpack("<QI", place)
        stored = self.file.read_at(size + 4, at)
        if zlib.crc32(stored[:size]) != struct.unpack("<I", stored[size:])[0]:
            raise ValueError("a block is damaged")
        return self.unzip.decompress(stored[:size])

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, dtype=f"<u{self.width}").astype("<u4")

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document of this identifier; none if there is none."""
        key = key_bytes(doc_id)
        if not all(self.bloom[i >> 3] >> (i & 7) & 1 for i in _bloom_places(key, self.bits)):
            return []
        out = []
        for last, place in seek(self.index, key):
            if last < key:
                continue
            for k, v in seek(self._block(place), key):
                if k == key:
                    out.append(self.ids(v))
                elif k > key:
                    return out
        return out

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for _, place in entries(self.index):
            yield from entries(self._block(place))


def _write(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), Encoder.of(tokenizer)
        store, place = fs.FileSystem.from_uri(folder)
        store.create_dir(place, recursive=True)
        end, writer, name, rows = np.array([end_id], dtype=f"<u{encoder.width}").tobytes(), None, "", []

        def close():
            writer.close()
            rows.append((part, len(rows), f"{folder}/{name}", len(writer.keys), writer.ids))

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            first = 0
            while first < len(texts):
                before = ends[first - 1] if first else 0
                stop = min(len(texts), int(np.searchsorted(ends, before + GROUP_BYTES)) + 1)
                coded = encoder.encode(texts.slice(first, stop - first))
                for i, value in zip(ids[first:stop], coded, strict=True):
                    if writer is None:
                        # A repeated task writes files of its own; the manifest names those of the one that counted.
                        name = f"part-{part:05d}-{len(rows):03d}-{uuid.uuid4().hex}.sst"
                        writer = Writer(store.open_output_stream(f"{place}/{name}", compression=None), encoder.width)
                    writer.add(key_bytes(i), value + end)
                    if writer.at >= FILE_BYTES:
                        close()
                        writer = None
                first = stop
            # Arrow keeps what it has freed; the next stage's workers live beside this one.
            pa.default_memory_pool().release_unused()
        if writer is not None:
            close()
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "seq", "path", "n_docs", "n_ids"])

    return run


def write_tables(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Encode (doc_id, text) into files in the shared folder; gives their manifest.

    One row a file: ``part``, ``seq`` (their order is that of the keys), ``path``,
    ``n_docs``, ``n_ids``, ``base`` (ids in all files before). Documents are sorted by
    ranges of (doc_id, text hash), so rows that share an id, or have none, spread too.
    Null texts are empty ones: the end id alone. An empty table gives no file.
    """
    spark = docs.sparkSession
    text = column_or_null(docs, "text", "string")
    rows = docs.select(column_or_null(docs, "doc_id", "long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    sorted_ = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    folder = new_folder(spark, "sstables")
    files = written(sorted_.mapInArrow(_write(folder, tokenizer, end_id), "part int, seq int, path string, n_docs long, n_ids long"), "sstable-manifest")
    before = F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("base", F.coalesce(before, F.lit(0)).cast("long"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = []

            def out():
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

            with Reader(path) as reader:
                for key, value in reader.scan():
                    n = len(value) // reader.width
                    rows.append((key_id(key), base, n, zlib.crc32(reader.ids(value).tobytes())))
                    base += n
                    if len(rows) >= 10_000:
                        yield out()
                        rows.clear()
            if rows:
                yield out()


def read_tables(manifest: DataFrame) -> DataFrame:
    """Per document, read from the files: doc_id, start, n_tokens, ids_crc32."""
    files = max(1, min(manifest.count(), MAX_READERS))
    # A fixed number: paths are so few bytes that adaptive execution would read all files in one task.
    return manifest.select("path", "base").repartition(files).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
