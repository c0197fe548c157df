"""Document fingerprints from closed syncmers.

A closed syncmer is a run of K characters whose least inner run of S characters is its first or
its last. Whether a run is one depends on its own characters only, so texts that share a passage
share its syncmers at the same distances. A fingerprint keeps the ANCHORS syncmers of least hash
with their positions; two are compared by the anchors that both hold in the same order.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of, tasks

K, S, ANCHORS = 12, 5, 64
_WINDOW = K - S + 1  # 8: three doublings
_BASE = 0x5851F42D4C957F2D
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]
_powers = np.ones((2, 1), dtype=np.uint64)


def _up_to(n: int) -> np.ndarray:
    """Powers of the base and of its inverse modulo 2**64."""
    global _powers
    if _powers.shape[1] <= n:
        size = 2 * n + 1024
        up = np.full(size, _BASE, dtype=np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _powers = np.stack([np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)])
    return _powers


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _MIX[0]
    h ^= h >> np.uint64(32)
    h *= _MIX[1]
    h ^= h >> np.uint64(29)
    return h


def _whole(text: str) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "<u8")


def syncmers(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in characters) and hashes of the closed syncmers of a text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(c)
    if n < K:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    up, down = _up_to(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((c + np.uint64(1)) * up[:n], out=total[1:])
    h = _mixed((total[S:] - total[:-S]) * down[: n - S + 1])
    least, step = h, 1
    while step < _WINDOW:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    at = np.flatnonzero((least == h[: len(least)]) | (least == h[_WINDOW - 1 :]))
    return at, _mixed((total[at + K] - total[at]) * down[at])


def _least(at: np.ndarray, h: np.ndarray) -> list[tuple[int, int]]:
    """(hash, position) of the ANCHORS least hashes, 32 bits each; equal hashes count once, at their first position."""
    h = h >> np.uint64(32)
    if len(h) > 4 * ANCHORS:
        some = h <= np.partition(h, 3 * ANCHORS)[3 * ANCHORS]
        at, h = at[some], h[some]
    found: dict[int, int] = {}
    for k, p in sorted(zip(h.tolist(), at.tolist())):
        if k not in found:
            if len(found) == ANCHORS:
                break
            found[k] = p
    return list(found.items())


def anchors(text: str, known: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int]]:
    """The fingerprint as (hash, position) pairs; a text without syncmers is one anchor, an empty one has none."""
    if not text:
        return []
    at, h = syncmers(text) if known is None else known
    return _least(at, h) if len(at) else [(int(_whole(text)[0] >> np.uint64(32)), 0)]


def written(found: list[tuple[int, int]]) -> str:
    return ".".join(f"{h:08x}@{p:x}" for h, p in found)


def parsed(fingerprint: str) -> list[tuple[int, int]]:
    return [(int(h, 16), int(p, 16)) for h, p in (x.split("@") for x in fingerprint.split("."))] if fingerprint else []


def likeness(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> float:
    """Of the least hashes of both, the share that both hold in one order; 1 for two without anchors."""
    if not a and not b:
        return 1.0
    if a == b:
        return 1.0
    left, right = dict(a), dict(b)
    pool = sorted(left.keys() | right.keys())[:ANCHORS]
    ends: list[int] = []
    for _, p in sorted((left[h], right[h]) for h in pool if h in left and h in right):
        i = bisect_left(ends, p)
        ends[i : i + 1] = [p]
    return len(ends) / len(pool)


def edit(text: str, following: str) -> tuple[str, int]:
    """The text with its last third replaced by as many first characters of the next, and where that begins."""
    cut = len(text) - len(text) // 3
    return text[:cut] + following[: len(text) // 3], cut


def _compare(text: str, following: str, anchors_of_next) -> tuple:
    at, h = syncmers(text)
    own = anchors(text, (at, h))
    edited, cut = edit(text, following)
    begin = max(0, cut - K + 1)
    tail_at, tail_h = syncmers(edited[begin:])
    keep = at + K <= cut
    changed = anchors(edited, (np.concatenate([at[keep], tail_at + begin]), np.concatenate([h[keep], tail_h])))
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return len(text), digest, own, changed, likeness(own, changed), likeness(own, anchors_of_next)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _run(batches):
    names = [p.split()[0] for p in _SCHEMA.split(", ")]
    before = None
    for whole in batches:
        for batch in pieces_of(whole, column="text"):
            out = []
            for guest, doc_id, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                text = text or ""
                own = anchors(text)
                if before is not None:
                    out.append(_row(before, text, own))
                before = None if guest else (doc_id, text)
                if not guest and doc_id is None:
                    out.append(_row(before, text, own))
                    before = None
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(_TYPES)], names=names)


def _row(before: tuple, following: str, own_of_next) -> tuple:
    n, digest, own, changed, near_edited, near_next = _compare(before[1], following, own_of_next)
    return before[0], n, digest, written(own), written(changed), near_edited, near_next


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like both, and the next text, are.

    The next document is that of the next lower doc_id, after the lowest the highest. Rows are
    dealt out by ranges of doc_id and read in order; the first row of each range also goes, as a
    guest, to the range before it, so texts are moved once and no task sees more than its range.
    Null and empty texts have no anchors. Rows of equal doc_id follow each other by text. A null
    doc_id has no place in the order and counts as its own next. An empty table gives no rows.
    """
    n = tasks(docs.sparkSession)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = [i / n for i in range(1, n)]
    bounds = sorted(set(found.agg(F.percentile_approx("doc_id", cuts, 20 * n)).first()[0] or [])) if cuts else []
    limits = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        """The range of an id: how many bounds, one less than there are ranges, lie below it."""
        return pd.Series(np.searchsorted(limits, ids.to_numpy(), side="left"))

    known = F.coalesce("doc_id", F.lit(0).cast("long"))  # a null would make floats of the ids

    placed = found.withColumn("shard", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(n))).otherwise(place(known)).cast("int"))
    # one row per range
    tops = sorted((r["shard"], r["top"]) for r in placed.where("doc_id IS NOT NULL").groupBy("shard").agg(F.max("doc_id").alias("top")).collect())
    guests = F.lit(None).cast("int")
    if tops:
        first = np.array([top for _, top in tops], dtype=np.int64)
        before = np.array([tops[(i + 1) % len(tops)][0] for i in range(len(tops))])

        @F.pandas_udf("int")
        def guest(ids: pd.Series) -> pd.Series:
            """The range before, if an id begins its own, else -1."""
            at = np.minimum(np.searchsorted(first, ids.to_numpy()), len(first) - 1)
            return pd.Series(np.where(first[at] == ids.to_numpy(), before[at], -1))

        found_before = guest(known)
        guests = F.when(F.col("doc_id").isNotNull() & (found_before >= 0), found_before).cast("int")
    seats = F.filter(F.array(F.struct(F.col("shard").alias("shard"), F.lit(False).alias("guest")), F.struct(guests.alias("shard"), F.lit(True).alias("guest"))), lambda s: s["shard"].isNotNull())
    dealt = placed.withColumn("seat", F.explode(seats)).select(F.col("seat.shard").alias("shard"), F.col("seat.guest").alias("guest"), "doc_id", "text")
    ordered = dealt.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "guest", F.desc_nulls_first("doc_id"), "text")
    return ordered.mapInArrow(_run, _SCHEMA)
