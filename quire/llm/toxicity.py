"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordTable, byte_words, held, least_by_hash, raw, remainder

#: Size of the hashed feature space; a model has one weight at most for each.
SPACE = 1 << 20
#: Labelled rows of each class that the model is fitted on, at most: those with the least hash of the id.
ROWS_PER_CLASS = 6_000
EPOCHS = 4
#: Single words also count by their first letters, which inflected forms share.
STEM = 5
_STRIP = ".,;:!?\"'()[]{}<>*_-…«»„“”‘’¿¡"


@dataclass
class ToxicModel:
    """Non-zero weights by feature number, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    key: str = field(default_factory=lambda: uuid.uuid4().hex)  # tells models apart in a reused worker

    def dense(self) -> np.ndarray:
        found = np.zeros(SPACE, dtype=np.float32)
        found[self.features] = self.weights
        return found


def _hashes(new: list[bytes]) -> np.ndarray:
    """Hashes of each word, lower-cased and without marks around it, and of its stem."""
    read = [w.decode("utf-8", "surrogatepass") for w in new]
    forms = [w.lower().strip(_STRIP) or w for w in read]
    return np.array([[zlib.crc32(f.encode("utf-8", "surrogatepass")), zlib.crc32(f[:STEM].encode("utf-8", "surrogatepass"))] for f in forms], dtype=np.uint64).reshape(-1, 2)


def _mix(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    h = (a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(kind)) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(44)).astype(np.int64)  # the top 20 bits


def _features(table: WordTable, texts: list[bytes]):
    """Feature numbers of single words, stems, neighbours and pairs around one word, each with the text's number."""
    at, counts = table.look_up([byte_words(t) for t in texts])
    h = table.rows[at, 0]
    doc = np.repeat(np.arange(len(texts)), counts)
    stem = table.rows[at, 1]
    yield _mix(h, h, 1), doc
    yield _mix(stem, stem, 9), doc
    for gap in (1, 2):
        same = doc[gap:] == doc[:-gap]
        yield _mix(h[:-gap], h[gap:], 1 + gap)[same], doc[gap:][same]


def _worker_table() -> WordTable:
    return held("toxicity", lambda: WordTable(_hashes, 2, np.uint64))


def _extract(batches):
    for batch in batches:
        found = [np.unique(np.concatenate([f for f, _ in _features(_worker_table(), [text])])).astype("<i4").tobytes() for text in raw(batch.column(2))]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "toxic", "features"])


def _ftrl(alpha: float, beta: float, l1: float, l2: float):
    """Follow the regularised leader: per-coordinate rates, and weights that L1 holds at zero."""

    def run(batches):
        rows = [(f, y) for b in batches for f, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        z, n = np.zeros(SPACE + 1), np.zeros(SPACE + 1)

        def weights(at):
            zi = z[at]
            w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
            return np.where(np.abs(zi) <= l1, 0.0, w)

        order = np.random.default_rng(7)
        for _ in range(EPOCHS):
            for k in order.permutation(len(rows)):
                at = np.append(np.frombuffer(rows[k][0], "<i4"), SPACE)  # the last is the bias
                w = weights(at)
                g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - rows[k][1]
                z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
                n[at] += g * g
        w = weights(np.arange(SPACE + 1))
        at = np.union1d(np.flatnonzero(w), [SPACE])
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(w[at], pa.float64())], names=["feature", "weight"])

    return run


def train(docs: DataFrame, labels: DataFrame, alpha: float = 0.5, beta: float = 1.0, l1: float = 3.0, l2: float = 0.0, rows_per_class: int = ROWS_PER_CLASS) -> ToxicModel:
    """Fit on the texts of labelled rows whose crc32(doc_id) mod 5 is not 0.

    At most `rows_per_class` rows of each label are taken, by least hash of the id, so one task
    can run through them in turn. Labels other than 0 and 1 are left out. If one class is
    missing, the model has no weights and gives the share of label 1 (0 without any label).
    """
    known = labels.select("doc_id", F.col("toxic").cast("double").alias("toxic")).where(F.col("toxic").isin(0.0, 1.0) & (remainder("doc_id", 5) != 0))
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(total) < 2:
        return ToxicModel(np.array([], dtype=np.int64), np.array([]), 40.0 if 1.0 in total else -40.0)
    pick = least_by_hash(known, "toxic", rows_per_class)
    # two classes of rows_per_class ids each: the bound that makes this side fit for broadcast
    found = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id").select("doc_id", "toxic", F.col("text").cast("string"))
    features = found.mapInArrow(_extract, "doc_id long, toxic double, features binary")
    one = features.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "features").select("features", "toxic")
    rows = one.mapInArrow(_ftrl(alpha, beta, l1, l2), "feature long, weight double").collect()
    if not rows:  # no labelled row has a document
        return ToxicModel(np.array([], dtype=np.int64), np.array([]), -40.0)
    bias = next(r.weight for r in rows if r.feature == SPACE)
    kept = [r for r in rows if r.feature < SPACE and r.weight]
    return ToxicModel(np.array([r.feature for r in kept], dtype=np.int64), np.array([r.weight for r in kept]), float(bias))


_dense: dict[str, np.ndarray] = {}


def score(spark: SparkSession, model: ToxicModel, text: Column | str = "text") -> Column:
    """A column with the probability of label 1 for a text; each feature counts once per text.

    Null and empty texts have no features and get the bias alone.
    """
    sent = spark.sparkContext.broadcast(model)  # SPACE weights at most

    def run(texts: pa.Array) -> pa.Array:
        found = sent.value
        if found.key not in _dense:
            _dense.clear()
            _dense[found.key] = found.dense()
        dense, values = _dense[found.key], raw(texts)
        out = np.full(len(values), found.bias)
        for i in range(0, len(values), 256):
            part = values[i : i + 256]
            for f, doc in _features(_worker_table(), part):
                w = dense[f]
                hit = np.flatnonzero(w)
                once = np.unique(doc[hit] * SPACE + f[hit])
                out[i : i + len(part)] += np.bincount(once // SPACE, weights=dense[once % SPACE], minlength=len(part))
        return pa.array(1 / (1 + np.exp(-np.clip(out, -500, 500))), pa.float64())

    return F.arrow_udf(run, "double")(F.col(text) if isinstance(text, str) else text)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document, repeated rows included."""
    model = train(docs, labels)
    found = docs.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), score(docs.sparkSession, model, F.col("text").cast("string")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
