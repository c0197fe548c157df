"""Best-fit packing of token pieces into sequences of a fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bytes, pieces_of, staged
from .tokens import END_PACK, encoder

#: Open sequences that a packer keeps at most.
OPEN_BINS = 256
#: Words that a worker keeps the ids of; fewer where packing follows other stages in the same executors.
CACHE_WORDS = 500_000
#: Bytes of texts that go to a worker at once.
BATCH_BYTES = 4_000_000
#: Open sequences of all tasks that a task of the second round packs together, on average.
MERGE_ROWS = 200_000


class BestFit:
    """Bounded-space online best-fit.

    Open bins are keyed by their free space; a bitset holds which free spaces occur. An item goes
    to the bin with the least free space that holds it. Where none does, a new bin opens, and the
    fullest open bin closes first if `bins` are open.
    """

    def __init__(self, capacity: int, bins: int = OPEN_BINS):
        self.capacity, self.bins = capacity, bins
        self._free = 0  # bit f: an open bin has f free
        self._at: dict[int, list[int]] = {}
        self._open = self.opened = 0

    def _take(self, free: int) -> int:
        stack = self._at[free]
        bin_id = stack.pop()
        if not stack:
            del self._at[free]
            self._free &= ~(1 << free)
        self._open -= 1
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        """Bin number and offset there of an item of `length` (1 to the capacity)."""
        if fits := self._free >> length:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self._open >= self.bins:
                self._take((self._free & -self._free).bit_length() - 1)
            free, bin_id = self.capacity, self.opened
            self.opened += 1
        if left := free - length:
            self._at.setdefault(left, []).append(bin_id)
            self._free |= 1 << left
            self._open += 1
        return bin_id, self.capacity - free

    def left_open(self) -> Iterator[tuple[int, int]]:
        """Bin number and used space of each bin that is still open."""
        for free, stack in self._at.items():
            for bin_id in stack:
                yield bin_id, self.capacity - free


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, is_open boolean"


def _first_round(path: str, capacity: int, bins: int, cache_words: int):
    def run(batches):
        fit, encode = BestFit(capacity, bins), encoder(path, cache_words).encode
        base = TaskContext.get().partitionId() << 36
        end = END_PACK.to_bytes(4, "little")
        for whole in batches:
            for batch in pieces_of(whole):
                row, piece, length, crc, place, offset = ([] for _ in range(6))
                for i, ids in enumerate(encode(batch.column(1).to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    if n <= capacity:
                        cuts = ((0, ids),)
                    else:
                        cuts = ((k, ids[4 * k * capacity : 4 * (k + 1) * capacity]) for k in range(-(-n // capacity)))
                    for k, part in cuts:
                        bin_id, at = fit.place(len(part) // 4)
                        row.append(i)
                        piece.append(k)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        place.append(bin_id)
                        offset.append(at)
                k, n = np.array(piece, dtype=np.int32), len(row)
                yield pa.record_batch([batch.column(0).take(pa.array(row, pa.int64())), pa.array(k), pa.array(k.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.array(place, dtype=np.int64) + base), pa.array(offset, pa.int64()), pa.array(np.zeros(n, dtype=bool))], schema=_SCHEMA)
        left = list(fit.left_open())
        n = len(left)
        yield pa.record_batch([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.array([u for _, u in left], pa.int64()), pa.nulls(n, pa.int64()), pa.array([base + b for b, _ in left], pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.ones(n, dtype=bool))], schema=_SCHEMA)

    return run


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("is_open", pa.bool_())])


def _second_round(capacity: int, bins: int):
    def run(batches):
        fit, base = BestFit(capacity, bins), (1 << 62) + (TaskContext.get().partitionId() << 36)
        for batch in batches:
            placed = [fit.place(n) for n in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], names=["sequence_id", "merged_id", "shift"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, bins: int = OPEN_BINS, keep: tuple[str, ...] = (), cache_words: int = CACHE_WORDS) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens.

    A document is its ids and then id 0; a null or empty text is that id alone. Documents longer
    than `capacity` are cut into pieces of `capacity` tokens. Each input partition is packed in
    its own order with a fixed number of open bins. What the partitions leave open (at most `bins`
    each) goes through the same packer once more, MERGE_ROWS or so to a task and by falling use, so
    many small partitions waste no more than a few. Nothing is shuffled by document. Repeated rows are packed again; a null doc_id stays null. An empty table gives no
    rows. Extra columns are ignored. A worker keeps the ids of `cache_words` words.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    spark = docs.sparkSession
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with arrow_bytes(spark, BATCH_BYTES):
        pieces = staged(found.mapInArrow(_first_round(tokenizer_path, capacity, bins, cache_words), _PIECES), "pieces")
    left = pieces.where("is_open").select("sequence_id", "length")
    spread = left.repartition(1 + left.count() // MERGE_ROWS, "sequence_id")
    moved = staged(spread.sortWithinPartitions(F.desc("length"), "sequence_id").mapInArrow(_second_round(capacity, bins), "sequence_id long, merged_id long, shift long"), "open-bins")
    return (
        pieces.where(~F.col("is_open"))
        .join(moved, "sequence_id", "left")
        .select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("merged_id", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
    )
