"""Token-id output as sorted-string-table shards (operator 1).

A shard holds documents in ascending key order::

    block*  index  bloom  footer

* block: zstd of entries ``shared suffix_len value_len suffix value``; keys are
  prefix-compressed against the entry before, the first key of a block is whole;
* index (sparse): for each block its last key, place, size, entries and tokens;
* bloom: bit array of all keys; footer: places and sizes of both, counts, magic.

A key is nine bytes in key order: a null flag and the sign-flipped big-endian id.
A value is the document's ids as little-endian 16- or 32-bit integers.  One
document is looked up by Bloom filter, binary search of the index and one block.

The input is range-partitioned by id, so shard order is id order and the number
of ids before a shard is a running sum over the small manifest of shards.  Files
are written under names of their own; only the manifest, a table written by
Spark's committer, says which belong to the result, so a repeated task does no
harm.  Rows with equal ids are kept, ordered by a hash of their text; null ids
come first; null texts are empty; a very long text is one value of a block of its own;
an empty table gives an empty manifest and no documents.  Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.llm.storage import materialize, open_store, scratch
from memlake.llm.tokens import library, slices

MAGIC = b"MLSSTAB1"
BLOCK_BYTES = 256 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7
_FOOTER = struct.Struct("<QQQQQQIB3x8s")  # index at, size; bloom at, size; entries; tokens; crc of both; id width
_BLOCK = struct.Struct("<9sQIIQ")  # last key; at; size; entries; tokens

MANIFEST = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("first_key", T.BinaryType()), T.StructField("last_key", T.BinaryType()), T.StructField("entries", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("size", T.LongType())]
)


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _bloom_slots(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.adler32(key[::-1]) * 0x9E3779B1 & 0xFFFFFFFF | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Streams entries in key order to one file; holds one block, the index and the keys."""

    def __init__(self, stream, width: int):
        self._out, self._width, self._at = stream, width, 0
        self._zip = zstandard.ZstdCompressor(level=1)
        self._block, self._raw, self._n, self._tokens = [], 0, 0, 0
        self._last, self._index, self._keys = b"", [], []
        self.first, self.entries, self.tokens = None, 0, 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.first is None:
            self.first = key
        shared = 0
        if self._block:
            while shared < len(key) and key[shared] == self._last[shared]:
                shared += 1
        value = ids.astype("<u2" if self._width == 2 else "<u4").tobytes()
        self._block.append(_varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value)
        self._raw += len(value) + 16
        self._last, self._n, self._tokens = key, self._n + 1, self._tokens + len(ids)
        self._keys.append(key)
        if self._raw >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self._block:
            data = self._zip.compress(b"".join(self._block))
            self._out.write(data)
            self._index.append(_BLOCK.pack(self._last, self._at, len(data), self._n, self._tokens))
            self._at += len(data)
            self.entries, self.tokens = self.entries + self._n, self.tokens + self._tokens
            self._block, self._raw, self._n, self._tokens = [], 0, 0, 0

    def close(self) -> int:
        self._flush()
        index = b"".join(self._index)
        bits = max(64, len(self._keys) * BLOOM_BITS)
        filled = np.zeros(bits, np.uint8)
        for key in self._keys:
            filled[_bloom_slots(key, bits)] = 1
        bloom = struct.pack("<Q", bits) + np.packbits(filled).tobytes()
        footer = _FOOTER.pack(self._at, len(index), self._at + len(index), len(bloom), self.entries, self.tokens, zlib.crc32(index + bloom), self._width, MAGIC)
        self._out.write(index + bloom + footer)
        return self._at + len(index) + len(bloom) + len(footer)

    @property
    def last(self) -> bytes:
        return self._last


class ShardReader:
    """Reads one shard by ranges: footer, index and filter first, then blocks as needed."""

    def __init__(self, path: str, size: int):
        store, name = open_store(path)
        self._file = store.open_input_file(name)
        foot = self._range(size - _FOOTER.size, _FOOTER.size)
        at, n, bloom_at, bloom_n, self.entries, self.tokens, crc, self._width, magic = _FOOTER.unpack(foot)
        index, bloom = self._range(at, n), self._range(bloom_at, bloom_n)
        if magic != MAGIC or zlib.crc32(index + bloom) != crc:
            raise ValueError(f"{path} is not a whole shard")
        self.index = [_BLOCK.unpack_from(index, i) for i in range(0, n, _BLOCK.size)]
        self._lasts = [b[0] for b in self.index]
        self._bits, self._bloom = struct.unpack_from("<Q", bloom)[0], bloom[8:]
        self._unzip = zstandard.ZstdDecompressor()

    def _range(self, at: int, n: int) -> bytes:
        self._file.seek(at)
        return self._file.read(n)

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, size, entries, _ = self.index[i]
        data, key, pos = self._unzip.decompress(self._range(at, size)), b"", 0
        for _ in range(entries):
            shared, pos = _read_varint(data, pos)
            more, pos = _read_varint(data, pos)
            n, pos = _read_varint(data, pos)
            key = key[:shared] + data[pos : pos + more]
            yield key, np.frombuffer(data, f"<u{self._width}", n // self._width, pos + more)
            pos += more + n

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of all documents with this id; reads no block unless the filter has the key."""
        key = key_of(doc_id)
        if not all(self._bloom[s >> 3] >> (7 - (s & 7)) & 1 for s in _bloom_slots(key, self._bits)):
            return []
        found, i = [], bisect.bisect_left(self._lasts, key)
        while i < len(self.index):
            own = [ids for k, ids in self.block(i) if k == key]
            found += own
            if not own or self._lasts[i] != key:
                break
            i += 1
        return found


def write_sstables(docs: DataFrame, tokenizer_json: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, append ``end_id`` to each document and write shards; returns the manifest.

    One range shuffle by id.  A task holds one slice of texts, one block and the
    keys of its shard.
    """
    folder = scratch(docs.sparkSession, "sstables")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = writer = None
        for batch in batches:
            for part in slices(batch, text):
                if writer is None:
                    tok = library(tokenizer_json)
                    path = f"{folder}/{uuid.uuid4().hex}.sst"
                    store, name = open_store(path)
                    store.create_dir(name.rpartition("/")[0], recursive=True)
                    stream = store.open_output_stream(name)
                    writer = ShardWriter(stream, 2 if tok.vocabulary <= 1 << 16 and end_id < 1 << 16 else 4)
                ids, counts = tok.encode(part.column(text))
                at = 0
                for doc_id, n in zip(part.column(key).to_pylist(), counts.tolist(), strict=True):
                    writer.add(key_of(doc_id), np.append(ids[at : at + n], np.uint32(end_id)))
                    at += n
        if writer is not None:
            size = writer.close()
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (path, writer.first, writer.last, writer.entries, writer.tokens, size)], names=MANIFEST.names)

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    rows = rows.repartitionByRange(key).sortWithinPartitions(F.col(key), F.xxhash64(text))
    return materialize(rows.mapInArrow(run, MANIFEST), "sstables-manifest")


def _one_shard_a_task(manifest: DataFrame) -> DataFrame:
    return manifest.repartition(max(1, manifest.count()))


def read_sstables(manifest: DataFrame, row: Callable[[np.ndarray], tuple], fields: list[T.StructField]) -> DataFrame:
    """One row for each stored document: doc_id, start (ids before it) and what ``row`` makes of its ids.

    One task a shard; documents stream through it.
    """
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("first_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = _one_shard_a_task(manifest.select("path", "size", "first_key", "tokens").withColumn("before", before).select("path", "size", "before"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), *fields])
    arrow = [pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                reader = ShardReader(path, size)
                for i in range(len(reader.index)):
                    out = []
                    for k, ids in reader.block(i):
                        out.append((id_of(k), start, *row(ids)))
                        start += len(ids)
                    columns = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*arrow, *[None] * len(fields)], strict=True)], names=schema.names)

    return shards.mapInArrow(run, schema)


def lookup(manifest: DataFrame, doc_ids: list[int | None]) -> DataFrame:
    """Rows (doc_id, ids) of a bounded list of ids: only shards that may hold one are opened."""
    wanted = sorted({key_of(i) for i in doc_ids})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, low, high in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                mine = wanted[bisect.bisect_left(wanted, low) : bisect.bisect_right(wanted, high)]
                if mine:
                    reader = ShardReader(path, size)
                    rows = [(id_of(k), ids.astype(np.int32).tolist()) for k in mine for ids in reader.get(id_of(k))]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _one_shard_a_task(manifest.select("path", "size", "first_key", "last_key")).mapInArrow(run, "doc_id long, ids array<int>")


def open_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(path)
