"""Sorted-string-table shards of token ids, keyed by document id.

A shard holds blocks of entries, a sparse index, a Bloom filter and a footer:

    entry   varint shared key bytes, varint new key bytes, varint value bytes, key bytes, value
    block   zstd frame over entries whose keys share prefixes with the key before
    index   per block: u64 offset, u32 size, u16 key size, last key
    bloom   bit array; BLOOM_HASHES probes by double hashing of the key
    footer  FOOTER struct, ends the file

Keys are 9 bytes: 0 for a null id or 1, then the id as big-endian unsigned with the sign bit
flipped, so byte order is id order with null first. Values are ids of 2 or 4 bytes each.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_path, pieces_of, staged, tasks
from .tokens import END_STORE, encoder

BLOCK_BYTES = 65_536
BLOOM_BITS, BLOOM_HASHES = 10, 7
MAGIC = b"QSST0001"
#: index offset and size, bloom offset and size, documents, tokens, bytes per id, magic
FOOTER = struct.Struct("<QQQQQQQ8s")


def key_of(doc_id: int | None) -> bytes:
    return bytes(9) if doc_id is None else b"\x01" + (doc_id + (1 << 63)).to_bytes(8, "big")


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
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Writes entries in ascending key order, one block in memory at a time."""

    def __init__(self, sink, id_bytes: int):
        import zstandard

        self._sink, self._id_bytes = sink, id_bytes
        self._zip = zstandard.ZstdCompressor(level=1).compress
        self._block, self._size, self._last = [], 0, b""
        self._index: list[tuple[int, int, bytes]] = []
        self._keys: list[bytes] = []
        self._at = self.docs = self.tokens = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> 8 * self._id_bytes:
            raise ValueError(f"id {ids.max()} needs more than {self._id_bytes} bytes")
        value = ids.astype("<u2" if self._id_bytes == 2 else "<u4").tobytes()
        shared = 0
        if self._block:
            while shared < len(key) and shared < len(self._last) and key[shared] == self._last[shared]:
                shared += 1
        entry = b"".join((_varint(shared), _varint(len(key) - shared), _varint(len(value)), key[shared:], value))
        self._block.append(entry)
        self._size += len(entry)
        self._last = key
        self._keys.append(key)
        self.docs += 1
        self.tokens += len(ids)
        if self._size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self._block:
            data = self._zip(b"".join(self._block))
            self._sink.write(data)
            self._index.append((self._at, len(data), self._last))
            self._at += len(data)
            self._block, self._size = [], 0

    def close(self) -> int:
        self._flush()
        index = b"".join(struct.pack("<QIH", o, n, len(k)) + k for o, n, k in self._index)
        bits = max(64, BLOOM_BITS * len(self._keys))
        bloom = np.zeros(bits, dtype=bool)
        for key in self._keys:
            bloom[_probes(key, bits)] = True
        packed = np.packbits(bloom, bitorder="little").tobytes()
        footer = FOOTER.pack(self._at, len(index), self._at + len(index), len(packed), self.docs, self.tokens, self._id_bytes, MAGIC)
        self._sink.write(index + struct.pack("<Q", bits) + packed + footer)
        return self._at + len(index) + 8 + len(packed) + FOOTER.size


class Reader:
    """Opens a shard; `get` looks one id up, `scan` gives all in order."""

    def __init__(self, source, size: int):
        import zstandard

        self._source, self._unzip = source, zstandard.ZstdDecompressor().decompress
        footer = self._read(size - FOOTER.size, FOOTER.size)
        at, n, bloom_at, bloom_n, self.docs, self.tokens, self._id_bytes, magic = FOOTER.unpack(footer)
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        raw = self._read(at, n)
        self._offsets, self._sizes, self._keys, i = [], [], [], 0
        while i < len(raw):
            offset, length, k = struct.unpack_from("<QIH", raw, i)
            self._offsets.append(offset)
            self._sizes.append(length)
            self._keys.append(raw[i + 14 : i + 14 + k])
            i += 14 + k
        raw = self._read(bloom_at, 8 + bloom_n)
        self._bits, self._bloom = struct.unpack_from("<Q", raw)[0], raw[8:]

    def _read(self, at: int, n: int) -> bytes:
        self._source.seek(at)
        return self._source.read(n)

    def _entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        data, at, key = self._unzip(self._read(self._offsets[block], self._sizes[block])), 0, b""
        kind = "<u2" if self._id_bytes == 2 else "<u4"
        while at < len(data):
            shared, at = _read_varint(data, at)
            fresh, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + fresh]
            at += fresh
            yield key, np.frombuffer(data, kind, n // self._id_bytes, at)
            at += n

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for block in range(len(self._keys)):
            for key, ids in self._entries(block):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of all documents with this id (none if it is absent), by binary search over the sparse index."""
        key, found = key_of(doc_id), []
        if not all(self._bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self._bits)):
            return found
        for block in range(bisect_left(self._keys, key), len(self._keys)):
            later = False
            for k, ids in self._entries(block):
                if k == key:
                    found.append(ids)
                later = later or k > key
            if later:
                break
        return found


def open_shard(path: str) -> Reader:
    store, at = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return Reader(store.open_input_file(at), store.get_file_info(at).size)


def _encode(path: str, bounds: list[int], id_bytes: int):
    def run(batches):
        import zstandard

        encode, pack = encoder(path).encode, zstandard.ZstdCompressor(level=1).compress
        end, edges = END_STORE.to_bytes(4, "little"), np.array(bounds, dtype=np.int64)
        for whole in batches:
            for batch in pieces_of(whole):
                keys = batch.column(0).to_pylist()
                shard = [0 if k is None else int(np.searchsorted(edges, k)) for k in keys]
                ids = [np.frombuffer(x + end, "<u4") for x in encode(batch.column(1).to_pylist())]
                data = [pack(x.astype("<u2" if id_bytes == 2 else "<u4").tobytes()) for x in ids]
                yield pa.record_batch([pa.array(shard, pa.int32()), batch.column(0), pa.array(data, pa.binary())], names=["shard", "doc_id", "ids"])

    return run


def _write(folder: str, id_bytes: int):
    kind = "<u2" if id_bytes == 2 else "<u4"

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        store, at = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(at, recursive=True)
        shard = writer = sink = None
        done: list[tuple] = []

        def close():
            if writer is not None:
                size = writer.close()
                sink.close()
                done.append((shard, f"{folder}/{name}", writer.docs, writer.tokens, size))

        for batch in batches:
            for number, key, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if number != shard:
                    close()
                    # a file of its own for every attempt: the manifest names those that count
                    shard, name = number, f"shard-{number:06d}-{uuid.uuid4().hex[:8]}.sst"
                    sink = store.open_output_stream(f"{at}/{name}")
                    writer = Writer(sink, id_bytes)
                writer.add(key_of(key), np.frombuffer(unpack(data), kind))
        close()
        yield pa.record_batch([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["shard", "path", "docs", "tokens", "bytes"])

    return run


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str | None = None, shards: int | None = None, id_bytes: int = 2) -> DataFrame:
    """Write token ids of all documents to shards in ascending doc_id order; returns the manifest.

    Shards split the ids at quantiles, from a scan of doc_id alone, so texts are encoded once and
    only compressed ids are shuffled. Each document is its ids and then id 1. Null or empty texts
    hold that id alone; null doc_ids come first; rows with equal ids stay apart, in the order of
    their ids' bytes. An empty table gives an empty manifest. Extra columns are ignored.

    Manifest: shard, path, docs, tokens, bytes.
    """
    spark = docs.sparkSession
    n = shards or tasks(spark)
    folder = folder or new_path(spark, "sst")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = [i / n for i in range(1, n)]
    bounds = found.agg(F.percentile_approx("doc_id", cuts, 20 * n)).first()[0] if cuts else None
    rows = found.mapInArrow(_encode(tokenizer_path, sorted(set(bounds or [])), id_bytes), "shard int, doc_id long, ids binary")
    dealt = rows.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "doc_id", "ids")
    return staged(dealt.mapInArrow(_write(folder, id_bytes), "shard int, path string, docs long, tokens long, bytes long"), "manifest")


def _scan(batches):
    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            out: list[tuple] = []
            for doc_id, ids in open_shard(path).scan():
                out.append((doc_id, base, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                base += len(ids)
                if len(out) == 10_000:
                    yield _rows(out)
                    out = []
            yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document of the shards of a manifest: doc_id, start, n_tokens, ids_crc32."""
    # one row per shard, so the running sum is over a short table
    base = F.sum("tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    based = manifest.withColumn("base", F.coalesce(base, F.lit(0)))
    return based.repartitionById(tasks(spark), F.col("shard")).select("path", "base").mapInArrow(_scan, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, doc_ids: list[int]) -> DataFrame:
    """Ids of the documents asked for, from every shard whose Bloom filter lets them through."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                shard = open_shard(path)
                rows = [(i, ids.tolist()) for i in doc_ids for ids in shard.get(i)]
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return manifest.select("path").mapInArrow(run, "doc_id long, ids array<long>")
