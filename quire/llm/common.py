"""Helpers shared by the training-data operators: shared folders, staging, word caches."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a longest run of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Where `spark.checkpoint.dir` is unset and the master is local (tests), a temporary folder is set
    once; on a cluster a folder that only one machine sees would lose data, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there and executors may go."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._staged = path
    return found


def discard(*frames: DataFrame) -> None:
    """Delete the files of staged tables that nothing later reads."""
    for df in frames:
        path = getattr(df, "_staged", None)
        if path is not None:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def arrow_bytes(spark: SparkSession, most: int):
    """Jobs run inside send rows to Python in Arrow batches of about `most` bytes.

    Else 10,000 rows of text make a batch of tens of MB, which the JVM builds and of which a worker holds two.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, f"{most}b")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tasks(spark: SparkSession) -> int:
    """How many partitions a shuffle by key gets."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def least_by_hash(rows: DataFrame, by: str, most: int, parts: int = 64) -> DataFrame:
    """The `most` rows of each value of `by` whose doc_id has the least hash.

    Ranked first within `parts` shares of each value, so that one frequent value is not sorted in one task.
    """
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(parts))
    few = rows.withColumn("_k", F.row_number().over(Window.partitionBy(by, share).orderBy(*order))).where(F.col("_k") <= most)
    return few.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_k") <= most).drop("_k")


def raw(texts: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; none for null."""
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def byte_words(text: bytes) -> list[bytes]:
    """Words in the sense of `WORD`: bytes.split() cuts at ASCII white space and nothing else."""
    return text.split()


def pieces_of(batch: pa.RecordBatch, chars: int = 2_000_000, column: str = "text"):
    """Slices of an Arrow batch of about `chars` bytes of text each, so that long texts stay few at once."""
    i = batch.schema.get_field_index(column)
    sizes = pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for k, size in enumerate(sizes):
        if k > begin and total + size > chars:
            yield batch.slice(begin, k - begin)
            begin, total = k, 0
        total += int(size)
    if begin < len(sizes):
        yield batch.slice(begin)


_held: dict = {}


def held(key, make):
    """A worker's one large cache: what another operator left in a reused worker goes first."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


class _Numbers(dict):
    """Numbers new keys in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class WordTable:
    """A row of numbers for each distinct word, worked out once per worker.

    `compute` maps a list of new words (UTF-8) to an array with a row each. The table is emptied
    at `limit` words, so its memory is bounded whatever the vocabulary.
    """

    def __init__(self, compute, width: int, dtype, limit: int = 400_000):
        self._compute, self._width, self._dtype, self._limit = compute, width, dtype, limit
        self._clear()

    def _clear(self) -> None:
        self._at = _Numbers()
        self._rows = np.zeros((4096, self._width), dtype=self._dtype)

    def look_up(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of all words of all texts in turn, and the number of words of each text."""
        if len(self._at) > self._limit:
            self._clear()
        at, begin = self._at, len(self._at)
        counts = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        numbers = np.fromiter(map(at.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=int(counts.sum()))
        if len(at) > begin:
            if len(at) > len(self._rows):
                grown = np.zeros((2 * len(at), self._width), dtype=self._dtype)
                grown[:begin] = self._rows[:begin]
                self._rows = grown
            self._rows[begin : len(at)] = self._compute(list(islice(at, begin, None)))
        return numbers, counts

    @property
    def rows(self) -> np.ndarray:
        return self._rows
