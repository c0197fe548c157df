"""Similarity join of documents by the Jaccard measure of their word n-gram sets.

The join is a sparse product of the document by n-gram incidence matrix with its transpose, cut
down by bounds that lose nothing. N-grams are put in one order, rare before frequent. Two sets
that are similar enough must share SHARE n-grams among the first few of each (the prefix), so only
the prefix columns are multiplied; overlap counts of the pairs met there are added up, and a pair
goes on only if it has that many and the count plus what the sizes still allow reaches the overlap
that the threshold asks for. A place counts the prefix n-grams before that other classes also have;
all n-grams from there on may be shared, as they may lie behind another set's prefix. The full
overlap of the pairs left is then counted.

Documents with equal sets are one class, joined once; a class is known by a 64-bit digest of its
set. Columns are multiplied in three blocks. First each column's rows of like size with the least of
them, the hub. Then the classes that are near one hub, its family: what each has more or less than
the hub is a short list, and products of those lists give the overlaps of a family's classes, of
which only links leave the task. Then rows that are neither of one family nor yet in one component.
So a group of copies costs its size, and a group of near copies sends no pairs but its links. A
column or family that is too large for a task is cut into square blocks, and the partners of one
class are verified HUB_ROWS to a task, so none is gathered whole. Packed texts travel to where sets
are compared, as a set's hashes fill twice its text.
"""

from __future__ import annotations

import zlib
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordTable, byte_words, discard, held, pieces_of, raw, staged, tasks
from .graph import components

#: Bits of the number of cells of the table of n-gram frequencies that is broadcast (a byte each), and blocks it travels in.
CELL_BITS, BLOCKS = 22, 16
CELLS = 1 << CELL_BITS
_CELL = np.uint64(64 - CELL_BITS)
#: N-grams that the prefixes of two similar sets must share (or the whole overlap, if that is less).
SHARE = 3
#: Bits of the filter of documents that share a prefix n-gram, in words of 64.
FILTER_WORDS = 1 << 18
#: Rows of a column that are multiplied in one block, and partners of a class that one task verifies.
COLUMN_ROWS, HUB_ROWS = 100_000, 2_000
#: Least Jaccard measure with a hub, in hundredths, that makes a class one of its family.
FAMILY = 60
#: Classes and bytes of their lists in one block of a family, and tokens that a product takes at once.
FAMILY_ROWS, FAMILY_BYTES, FAMILY_TOKENS = 1024, 16_000_000, 4096
#: Rows of a column that wait for its hubs, and bytes of packed texts whose sets are made at once.
WAITING_ROWS, PACKED_BYTES = 1_000_000, 500_000
#: Digests that a task remembers, so that copies within it are sent once.
SEEN = 1_000_000


def _word_hashes(new: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(blake2b(w, digest_size=8).digest(), "little") for w in new], dtype=np.uint64).reshape(-1, 1)


_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]


def _mixed(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for the word hashes at the same place of each part."""
    mixed = np.full(len(parts[0]), len(parts), dtype=np.uint64)
    for part in parts:
        mixed ^= part
        mixed *= _ODD[0]
        mixed ^= mixed >> np.uint64(29)
    mixed *= _ODD[1]
    mixed ^= mixed >> np.uint64(32)
    return mixed


def _ngrams(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the k-word n-grams of all texts in turn (of a text's whole words if fewer), and their number per text."""
    table = held("ngrams", lambda: WordTable(_word_hashes, 1, np.uint64))
    at, counts = table.look_up([byte_words(t.lower()) for t in texts])  # bytes: A-Z only
    h, ends = table.rows[at, 0], np.cumsum(counts)
    begin = ends - counts
    number = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out = np.empty(int(number.sum()), dtype=np.uint64)
    place = np.repeat(begin, number) + np.arange(len(out)) - np.repeat(np.cumsum(number) - number, number)
    full = np.repeat(counts >= k, number)
    out[full] = _mixed([h[place[full] + i] for i in range(k)])
    short = np.repeat(counts, number)
    for n in range(1, k):
        some = (short == n) & ~full
        if some.any():
            out[some] = _mixed([h[place[some] + i] for i in range(n)])
    return out, number


def _shingles(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    found, number = _ngrams(texts, k)
    out, begin = [], 0
    for n in number.tolist():
        part = np.sort(found[begin : begin + n])
        begin += n
        out.append(part[np.concatenate([[True], part[1:] != part[:-1]])] if n > 1 else part)
    return out


def _count_cells(k: int):
    def run(batches):
        cells = np.zeros(CELLS, dtype=np.int64)
        for whole in batches:
            for batch in pieces_of(whole):
                found, _ = _ngrams(raw(batch.column(0)), k)
                cells += np.bincount((found >> _CELL).astype(np.int64), minlength=CELLS)
        parts = cells.astype(np.uint32).reshape(BLOCKS, -1)
        yield pa.record_batch([pa.array(range(BLOCKS), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], names=["block", "cells"])

    return run


def _add_cells(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(zlib.decompress(data), np.uint32).astype(np.uint64)
            total[block] = total[block] + part if block in total else part
    packed = [zlib.compress(np.minimum(p, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1) for p in total.values()]
    yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array(packed, pa.binary())], names=["block", "cells"])


def frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """How often the n-grams of each hash cell occur, in steps of an eighth of a power of two: CELLS bytes, whatever the input."""
    found = docs.select("text").mapInArrow(_count_cells(k), "block int, cells binary")
    rows = found.repartitionById(BLOCKS, F.col("block")).mapInArrow(_add_cells, "block int, cells binary").collect()
    cells = np.zeros((BLOCKS, CELLS // BLOCKS), dtype=np.uint32)
    for r in rows:
        cells[r["block"]] = np.frombuffer(zlib.decompress(r["cells"]), np.uint32)
    return np.round(8 * np.log2(cells.reshape(-1).astype(np.float64) + 1)).clip(0, 255).astype(np.uint8)


def _digest(shingles: np.ndarray) -> int:
    return int.from_bytes(blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _prefixes(k: int, num: int, den: int, sent):
    """doc_id, set size and class of each row; with the prefix where the task meets the class first."""

    def run(batches):
        # any order serves that all tasks share; this one ranks by frequency, then by hash
        cells, seen = sent.value, set()
        for whole in batches:
            for batch in pieces_of(whole):
                n, classes, prefix = [], [], []
                for doc_id, s in zip(batch.column(0).to_pylist(), _shingles(raw(batch.column(1)), k)):
                    n.append(len(s))
                    classes.append(c := _digest(s))
                    if c in seen or doc_id is None or not len(s):
                        prefix.append(None)
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(c)
                    least = (num * len(s) + den - 1) // den  # overlap with any similar set
                    need = len(s) - least + min(SHARE, least)
                    rank = cells[(s >> _CELL).astype(np.int64)].astype(np.int64) << 52 | (s >> np.uint64(12)).astype(np.int64)
                    prefix.append(s[np.argsort(rank, kind="stable")[:need]].view(np.int64))
                yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(classes, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))], names=["doc_id", "n", "cid", "prefix"])

    return run


def _repeated(batches):
    """Rows (token, cid, at), sorted by the first two: one for each pair, of tokens that several classes have."""
    last, before = None, False  # the row that waits for the next one, and whether its token came before
    for batch in batches:
        if last is not None:
            batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        token, cid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (cid[1:] != cid[:-1])])
        if not new.all():
            batch, token = batch.filter(pa.array(new)), token[new]
        same = token[1:] == token[:-1]
        keep = np.concatenate([[before], same]) | np.concatenate([same, [False]])
        yield batch.slice(0, len(token) - 1).filter(pa.array(keep[:-1]))
        before = bool(keep[-1])
        last = batch.slice(len(token) - 1)
    if last is not None and before:
        yield last


def _sets(k: int, sent):
    """Class and packed text of rows whose id may be wanted."""

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        bits, seen = sent.value, set()
        for whole in batches:
            for batch in pieces_of(whole):
                some = batch.filter(pa.array(_may_hold(bits, batch.column(2))))
                if not some.num_rows:
                    continue
                out, texts = [], raw(some.column(1))
                for text, s in zip(texts, _shingles(texts, k)):
                    if (c := _digest(s)) not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(c)
                        out.append((c, pack(text)))
                yield pa.record_batch([pa.array([c for c, _ in out], pa.int64()), pa.array([t for _, t in out], pa.binary())], names=["cid", "packed"])

    return run


_CHECKED = "a long, b long, hit boolean, n long, m long, less long, apart binary"


def _verified(k: int, num: int, den: int, family: int | None):
    """Pairs of rows (hub, part, own, id, packed text), sorted: the hub's own row comes first, its partners follow.

    `hit`: whether they link. With `family`, pairs of that measure also tell the sizes of the class
    and of the hub, how many n-grams the class lacks, and those that only one of both has. Others
    are left out.
    """

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        key, hub = None, None
        for batch in (b for whole in batches for b in pieces_of(whole, PACKED_BYTES, "packed")):
            out, sets = [], _shingles([unpack(x) for x in batch.column(4).to_pylist()], k)
            for h, part, own, i, s in zip(*(c.to_pylist() for c in batch.columns[:4]), sets):
                if own:
                    key, hub = (h, part), s
                elif key == (h, part):
                    apart = None if family is None else np.setxor1d(hub, s, assume_unique=True)
                    common = len(np.intersect1d(hub, s, assume_unique=True)) if family is None else (len(hub) + len(s) - len(apart)) // 2
                    union = len(hub) + len(s) - common
                    hit, near = den * common >= num * union, family is not None and 100 * common >= family * union
                    if hit or near:
                        out.append((h, i, hit, len(s), len(hub), len(hub) - common, apart.tobytes() if near else None))
            columns = list(zip(*out)) if out else [[]] * 7
            types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=[f.split()[0] for f in _CHECKED.split(", ")])

    return run


def _family_links(num: int, den: int):
    """One task per pair of blocks of a family: edges that join its classes as their links do."""

    def tokens(part):
        lists = [np.frombuffer(x, np.uint64) for x in part.column("apart").to_pylist()]
        size = np.array([len(x) for x in lists], dtype=np.int64)
        return np.repeat(np.arange(len(lists)), size), np.concatenate(lists) if lists else np.zeros(0, np.uint64)

    def run(key, table):
        same = key[1].as_py() == 0 and key[2].as_py() == key[3].as_py()
        side = table.column("side").to_numpy()
        x = table.filter(pa.array(side == 0))
        y = x if same else table.filter(pa.array(side == 1))
        ids_x, ids_y = x.column("cid").to_numpy(), y.column("cid").to_numpy()
        (row_x, token_x), (row_y, token_y) = tokens(x), tokens(y)
        both = np.zeros((len(ids_x), len(ids_y)), dtype=np.float32)
        shared = np.intersect1d(token_x, token_y)
        for k in range(0, len(shared), FAMILY_TOKENS):
            some = shared[k : k + FAMILY_TOKENS]
            sides = []
            for row, token, n in ((row_x, token_x, len(ids_x)), (row_y, token_y, len(ids_y))):
                at = np.minimum(np.searchsorted(some, token), len(some) - 1)
                hit = some[at] == token
                m = np.zeros((n, len(some)), dtype=np.float32)
                m[row[hit], at[hit]] = 1
                sides.append(m)
            both += sides[0] @ sides[1].T
        n_x, n_y, less_x, less_y = (t.column(c).to_numpy() for c in ("n", "less") for t in (x, y))
        overlap = table.column("m")[0].as_py() - less_x[:, None] - less_y[None, :] + both.astype(np.int64) if len(table) else both
        link = (num + den) * overlap >= num * (n_x[:, None] + n_y[None, :])
        i, j = np.nonzero(link & (ids_x[:, None] != ids_y[None, :]))
        la = ids_x.copy()
        lb = la if same else ids_y.copy()
        while True:  # least numbers spread along links
            least = np.minimum(la[i], lb[j])
            if (la[i] == least).all() and (lb[j] == least).all():
                break
            np.minimum.at(la, i, least)
            np.minimum.at(lb, j, least)
        a = np.concatenate([low[ids != low] for ids, low in ((ids_x, la), (ids_y, lb))])
        b = np.concatenate([ids[ids != low] for ids, low in ((ids_x, la), (ids_y, lb))])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _within_families(families: DataFrame, num: int, den: int) -> DataFrame:
    """Links among classes near one hub (hub, cid, hit, n, m, less, apart), other than pairs that both link with the hub."""

    def blocks(which):
        rows, octets = F.count_if(which), F.coalesce(F.sum(F.when(which, F.octet_length("apart"))), F.lit(0))
        return F.greatest(F.ceil(rows / FAMILY_ROWS), F.ceil(octets / FAMILY_BYTES)).cast("int")

    size = families.groupBy("hub").agg(F.count("*").alias("c"), blocks(~F.col("hit")).alias("bu"), blocks(F.col("hit")).alias("bh")).where("c > 1 AND bu > 0")
    dealt = families.join(size, "hub").withColumn("block", F.pmod(F.xxhash64("cid"), F.when(F.col("hit"), F.greatest("bh", F.lit(1))).otherwise(F.col("bu"))).cast("int"))

    def seat(kind, left, right, side):
        return F.struct(F.lit(kind).alias("kind"), left.alias("left"), right.alias("right"), side.cast("int").alias("side"))

    block, free = F.col("block"), F.sequence(F.lit(0), F.col("bu") - 1)
    with_free = F.transform(free, lambda o: seat(0, F.least(o, block), F.greatest(o, block), block > o))
    with_linked = F.when(F.col("bh") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("bh") - 1, F.lit(0))), lambda o: seat(1, block, o, F.lit(0)))).otherwise(F.array().cast("array<struct<kind:int,left:int,right:int,side:int>>"))
    seats = F.when(F.col("hit"), F.transform(free, lambda o: seat(1, o, block, F.lit(1)))).otherwise(F.concat(with_free, with_linked))
    spread = dealt.withColumn("seat", F.explode(seats)).select("hub", "seat.kind", "seat.left", "seat.right", "seat.side", "cid", "n", "m", "less", "apart")
    return spread.groupBy("hub", "kind", "left", "right").applyInArrow(_family_links(num, den), "a long, b long")


_PAIRS = ("a", "b", "na", "nb", "ea", "eb", "pa", "pb")


def _near_hubs(batches):
    """Pairs of each row with its column's hub: the least class among those of its band and of the bands next to that.

    Rows (token, band, cid, n, most, pos) come sorted by the first three. Of a column of more than
    WAITING_ROWS rows, the last ones before each cut do not know the band that follows.
    """

    def bands(table):
        token, band = table.column("token").to_numpy(), table.column("band").to_numpy()
        return np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (band[1:] != band[:-1])]))

    def pairs(table, known):
        """Pairs of the rows of a table after the first `known`."""
        r = {name: table.column(name).to_numpy() for name in table.schema.names}
        token, band, cid, begin = r["token"], r["band"], r["cid"], bands(table)
        hub, low, high = begin.copy(), begin[:-1], begin[1:]
        beside = np.flatnonzero((token[low] == token[high]) & (band[high] - band[low] == 1))
        for at, other in ((beside, high[beside]), (beside + 1, low[beside])):
            hub[at] = np.where(cid[other] < cid[hub[at]], other, hub[at])
        a, b = np.repeat(hub, np.diff(np.append(begin, len(token)))), np.arange(len(token))
        some = (cid[a] != cid[b]) & (b >= known)
        a, b = a[some], b[some]
        return pa.record_batch([pa.array(r[c][x]) for c in ("cid", "n", "most", "pos") for x in (a, b)], names=list(_PAIRS))

    waits, known = [], 0  # rows of a column that may go on; the first of them have their pairs
    for batch in batches:
        if not batch.num_rows:
            continue
        token = batch.column(0).to_numpy()
        last = np.flatnonzero(token != token[-1])
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut or not waits or waits[-1].column(0)[-1].as_py() != token[0]:
            table = pa.Table.from_batches([*waits, batch.slice(0, cut)]).combine_chunks()
            if len(table):
                yield pairs(table, known)
            waits, known = [batch.slice(cut)], 0
        else:
            waits.append(batch)
        if sum(b.num_rows for b in waits) > WAITING_ROWS + known:
            table = pa.Table.from_batches(waits).combine_chunks()
            yield pairs(table, known)
            firsts = table.take(pa.array(bands(table)[-2:])).combine_chunks()
            waits, known = firsts.to_batches(), len(firsts)
    if waits:
        yield pairs(pa.Table.from_batches(waits).combine_chunks(), known)


def _crossed(num: int, den: int, near: int = 6, block: int = 1024):
    """Pairs of classes of different groups and families that one column holds and whose sizes and places allow the threshold.

    Rows (token, left, right, side, cid, n, most, pos, group, family) come sorted by the first three and n.
    """

    def fits(r, i, j):
        n, most, pos = r["n"], r["most"], r["pos"]
        rest = np.minimum(most[i] - pos[i], most[j] - pos[j]) + np.minimum(pos[i], pos[j])
        apart = (r["group"][i] != r["group"][j]) & (r["family"][i] != r["family"][j]) & ((r["left"][i] == r["right"][i]) | (r["side"][i] != r["side"][j]))
        return apart & (n[i] * den >= n[j] * num) & (n[j] * den >= n[i] * num) & ((num + den) * rest >= num * (n[i] + n[j]))

    def pairs(r, i, j):
        swap = r["cid"][i] > r["cid"][j]
        a, b = np.where(swap, j, i), np.where(swap, i, j)
        return pa.record_batch([pa.array(r[c][x]) for c in ("cid", "n", "most", "pos") for x in (a, b)], names=list(_PAIRS))

    def columns_of(table):
        """The pairs of a table of whole columns."""
        r = {name: table.column(name).to_numpy() for name in table.schema.names}
        if not len(r["token"]):
            return
        change = (r["token"][1:] != r["token"][:-1]) | (r["left"][1:] != r["left"][:-1]) | (r["right"][1:] != r["right"][:-1])
        begin = np.concatenate([[0], np.flatnonzero(change) + 1])
        size = np.diff(np.concatenate([begin, [len(r["token"])]]))
        several = np.minimum.reduceat(r["group"], begin) != np.maximum.reduceat(r["group"], begin)
        small = np.repeat(several & (size <= near), size)
        column = np.repeat(np.arange(len(begin)), size)
        for d in range(1, near):
            i = np.flatnonzero(small[:-d] & (column[d:] == column[:-d]))
            i = i[fits(r, i, i + d)]
            if len(i):
                yield pairs(r, i, i + d)
        for k in np.flatnonzero(several & (size > near)).tolist():
            for x in range(begin[k], begin[k] + size[k], block):
                own = np.arange(x, min(x + block, begin[k] + size[k]))
                for y in range(x, begin[k] + size[k], block):
                    other = np.arange(y, min(y + block, begin[k] + size[k]))
                    if r["n"][own[-1]] * den < r["n"][other[0]] * num:
                        break  # sorted by size: all that follow are larger still
                    i, j = np.meshgrid(own, other, indexing="ij")
                    i, j = i.ravel(), j.ravel()
                    hit = fits(r, i, j) & (i < j)
                    if hit.any():
                        yield pairs(r, i[hit], j[hit])

    def run(batches):
        waits = []  # the rows of a column that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            token, left, right = (batch.column(i).to_numpy() for i in range(3))
            last = np.flatnonzero((token != token[-1]) | (left != left[-1]) | (right != right[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if not cut and waits and (waits[-1].column(0)[-1].as_py(), waits[-1].column(1)[-1].as_py(), waits[-1].column(2)[-1].as_py()) == (token[0], left[0], right[0]):
                waits.append(batch)
                continue
            yield from columns_of(pa.Table.from_batches([*waits, batch.slice(0, cut)]).combine_chunks())
            waits = [batch.slice(cut)]
        if waits:
            yield from columns_of(pa.Table.from_batches(waits).combine_chunks())

    return run


def _possible(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs whose overlap in the prefixes, with what the sizes allow after it, can reach the threshold."""
    met = pairs.groupBy("a", "b").agg(F.count("*").alias("common"), *(F.first(c).alias(c) for c in ("na", "nb")), F.min(F.col("ea") - F.col("pa")).alias("ra"), F.min(F.col("eb") - F.col("pb")).alias("rb"))
    rest = F.least("ra", "rb") - 1  # n-grams after the last one met; those before it that were not met are not shared
    overlap = F.ceil((F.col("na") + F.col("nb")) * num / (num + den))
    return met.where((F.col("common") >= F.least(F.lit(SHARE), overlap)) & ((num + den) * (F.col("common") + rest) >= num * (F.col("na") + F.col("nb")))).select("a", "b")


def _may_hold(bits: np.ndarray, hashes: pa.Array) -> np.ndarray:
    """Whether each hash may be one of those that `bits` were made of."""
    h = hashes.to_numpy(zero_copy_only=False).astype(np.int64)
    return ((bits[h >> 6 & (FILTER_WORDS - 1)].view(np.uint64) >> (h & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def may_hold(spark: SparkSession, ids: DataFrame, column: str) -> Column:
    """Whether a column's value may be an `id` of `ids`: true for all that are, false for nearly all others."""
    sent = spark.sparkContext.broadcast(_filter_bits(spark, ids))

    def run(hashes: pa.Array) -> pa.Array:
        return pa.array(_may_hold(sent.value, hashes))

    return F.arrow_udf(run, "boolean")(F.xxhash64(column))


def _filter_bits(spark: SparkSession, ids: DataFrame) -> np.ndarray:
    h = F.xxhash64("id")
    word = F.shiftright(h, 6).bitwiseAND(FILTER_WORDS - 1)
    bit = F.expr("shiftleft(1L, cast(xxhash64(id) & 63 as int))")
    bits = np.zeros(FILTER_WORDS, dtype=np.int64)
    for r in ids.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("b")).toLocalIterator():  # FILTER_WORDS rows at most
        bits[r["w"]] = r["b"]
    return bits


def similar_components(docs: DataFrame, k: int = 3, threshold: tuple[int, int] = (90, 100)) -> DataFrame:
    """Link documents whose n-gram sets have a Jaccard measure of `threshold` or more.

    A-Z are lower-cased; words are runs of characters that are no ASCII white space; a text of
    fewer than k words is one n-gram. Texts without words, and null texts, have an empty set, link
    with nothing and are their own component. Rows that share a doc_id are one document, linked by
    the set of each row. A null doc_id stays null and gets the component of the other documents
    with its set, or null. Sets are compared by 64-bit hashes of their n-grams, equal ones found by
    64-bit digests. An empty table gives no rows; extra columns are ignored.

    Returns per row: doc_id, n_shingles, component_id (least doc_id reachable by links).
    """
    spark, (num, den) = docs.sparkSession, threshold
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = spark.sparkContext.broadcast(frequencies(docs, k))
    sized = staged(docs.mapInArrow(_prefixes(k, num, den, sent), "doc_id long, n long, cid long, prefix array<long>"), "prefixes")
    columns = sized.where("prefix IS NOT NULL").select(F.posexplode("prefix").alias("pos", "token"), "n", "cid").select("token", "cid", (F.col("n") * (1 << 31) + F.col("pos")).alias("at"))
    spread = columns.repartition(tasks(spark), "token").sortWithinPartitions("token", "cid")
    shared = spread.mapInArrow(_repeated, "token long, cid long, at long")
    n = F.shiftright("at", 31)
    band = F.floor(F.log(n.cast("double")) / F.lit(float(np.log(den / num))))
    shared = shared.select("token", "cid", n.alias("n"), F.col("at").bitwiseAND((1 << 31) - 1).alias("pos"), band.alias("band"))
    need = F.floor((F.col("n") * num + den - 1) / den)
    least = F.least(F.lit(SHARE), need)
    ranked = shared.withColumn("c", F.count("*").over(Window.partitionBy("cid"))).withColumn("place", F.row_number().over(Window.partitionBy("cid").orderBy("pos")).cast("long") - 1)
    shared = staged(ranked.where(F.col("c") >= least).select("token", "cid", "n", "band", (F.col("n") - F.col("pos") + F.col("place")).alias("most"), F.col("place").alias("pos")), "shared-ngrams")
    some = sized.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "cid")
    classes = staged(some.groupBy("cid").agg(F.min("doc_id").alias("rep")), "classes")
    texts = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).where("doc_id IS NOT NULL")

    def checked(possible: DataFrame, family: int | None = None) -> DataFrame:
        """What `_verified` says of the pairs; each wanted text travels once to every hub it is compared with."""
        pairs = staged(possible, "pairs")
        parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_ROWS).alias("parts"))
        to = pairs.join(parts, "a").select(F.col("b").alias("id"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.lit(False).alias("own"))
        hubs = parts.select(F.col("a").alias("id"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(True))
        wanted = staged(to.union(hubs), "wanted")
        ids = wanted.select("id").distinct().join(classes, F.col("id") == F.col("cid")).select(F.col("rep").alias("id"))
        bits = spark.sparkContext.broadcast(_filter_bits(spark, ids))
        found = texts.mapInArrow(_sets(k, bits), "cid long, packed binary")
        dealt = found.join(wanted, found["cid"] == wanted["id"]).select("hub", "part", "own", "id", "packed").repartition(tasks(spark), "hub", "part")
        links = staged(dealt.sortWithinPartitions("hub", "part", F.desc("own")).mapInArrow(_verified(k, num, den, family), _CHECKED), "checked")
        discard(pairs, wanted)
        return links

    by_band = shared.select("token", "band", "cid", "n", "most", "pos").repartition(tasks(spark), "token").sortWithinPartitions("token", "band", "cid")
    near = by_band.mapInArrow(_near_hubs, ", ".join(f"{c} long" for c in _PAIRS))
    around = checked(_possible(near, min(FAMILY, num * 100 // den), 100), FAMILY)
    families = around.where("apart IS NOT NULL").groupBy(F.col("b").alias("cid")).agg(F.min_by(F.struct(F.col("a").alias("hub"), "hit", "n", "m", "less", "apart"), "a").alias("f")).select("cid", "f.*")
    families = staged(families, "families")
    links = around.where("hit").select("a", "b").union(_within_families(families, num, den))
    label = components(links, "near").withColumnRenamed("node", "cid")

    known = shared.join(label, "cid", "left").join(families.select("cid", "hub"), "cid", "left")
    known = staged(known.select("token", "cid", "n", "most", "pos", F.coalesce("component", "cid").alias("group"), F.coalesce("hub", "cid").alias("family")), "grouped")
    discard(shared, around, families)
    # a row for each COLUMN_ROWS rows of the table at most
    heavy = known.groupBy("token").count().where(F.col("count") > COLUMN_ROWS).select("token", F.ceil(F.col("count") / COLUMN_ROWS).alias("blocks"))
    cut = known.join(F.broadcast(heavy), "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    cut = cut.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("token", F.least("o", "block").cast("int").alias("left"), F.greatest("o", "block").cast("int").alias("right"), (F.col("block") > F.col("o")).cast("int").alias("side"), "cid", "n", "most", "pos", "group", "family")
    met = cut.repartition(tasks(spark), "token", "left", "right").sortWithinPartitions("token", "left", "right", "n")
    wide = met.mapInArrow(_crossed(num, den), ", ".join(f"{c} long" for c in _PAIRS))
    more = checked(_possible(wide, num, den))
    discard(known)

    # a document of several rows holds the classes of all of them together
    several = some.groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("z")).where("a <> z").select("doc_id", "a")
    held_by = some.join(several, "doc_id").where("cid <> a").select("a", F.col("cid").alias("b")).distinct()
    joined = label.where("cid <> component").select(F.col("component").alias("a"), F.col("cid").alias("b"))
    final = staged(components(joined.union(more.select("a", "b")).union(held_by), "linked").withColumnRenamed("node", "cid"), "components")
    discard(more)
    lowest = final.join(classes, "cid").groupBy("component").agg(F.min("rep").alias("low"))
    of_class = final.join(lowest, "component").select("cid", "low")
    named = classes.join(of_class, "cid", "left").select("cid", F.coalesce("low", "rep").alias("component_id"))
    with_words = sized.where("n > 0").select("doc_id", "n", "cid").join(named, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return with_words.union(sized.where("n = 0").select("doc_id", "n", "doc_id"))
