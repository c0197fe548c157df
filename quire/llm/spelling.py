"""Spelling variants: words one code point apart, by pairs of trie nodes, and the frequent form that each leads to."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sql import query
from .common import WordTable, discard, pieces_of, staged

#: A run is a longest row of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; in Latin-1 each is one byte.
_RUN_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))
#: A run loses a code point where this divides its hash; words have at least so many code points and occurrences.
DAMAGED, LEAST_LENGTH, LEAST_COUNT = 97, 5, 3
#: A form occurs at least so many times as often as the words that take it.
OUTWEIGHS = 2
#: Distinct words that a task holds before it sends their counts on.
MOST_WORDS = 500_000
#: UTF-8 bytes up to which hashes are worked out from those of ids and words; longer runs are hashed as they are.
SHORT = 48


def runs(text: str) -> list[bytes]:
    """The lower-cased runs of a text in Latin-1."""
    return text.encode("latin-1", "replace").translate(_RUN_BYTES).split()


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def _followed(crc: np.ndarray, most: int) -> np.ndarray:
    """Row m: what checksums become when m zero bytes follow, before the last complement; a text's own checksum is then added by xor."""
    out = np.empty((most + 1, len(crc)), dtype=np.uint32)
    out[0] = crc
    for m in range(most):
        out[m + 1] = _CRC[out[m] & 255] ^ (out[m] >> 8)
    return out


def _facts(words: list[bytes]) -> np.ndarray:
    """Checksum, bytes in UTF-8 and code points of each word."""
    utf8 = [w if w.isascii() else w.decode("latin-1").encode() for w in words]
    return np.array([(zlib.crc32(u), len(u), len(w)) for u, w in zip(utf8, words)], dtype=np.int64)


class _WordCounter:
    def __init__(self):
        self._table = WordTable(_facts, 3, np.int64, limit=1 << 62)
        self._n = np.zeros(0, dtype=np.int64)
        self._damaged: Counter[bytes] = Counter()

    def add(self, ids: list, texts: list[str | None]) -> None:
        numbers, counts = self._table.look_up([[w for w in runs(t) if len(w) >= LEAST_LENGTH] if t else [] for t in texts])
        row = np.repeat(np.arange(len(texts)), counts)
        pairs, n = np.unique((row << 40) | numbers, return_counts=True)
        row, word = pairs >> 40, pairs & ((1 << 40) - 1)
        crc, octets, length = self._table.rows[word].T
        heads = [b":" if i is None else f"{i}:".encode() for i in ids]
        after = _followed(np.array([zlib.crc32(h) for h in heads], dtype=np.uint32), SHORT)
        h = after[np.minimum(octets, SHORT), row].astype(np.int64) ^ crc
        names = None
        for k in np.flatnonzero(octets > SHORT).tolist():
            names = list(self._table._at) if names is None else names
            h[k] = zlib.crc32(names[word[k]].decode("latin-1").encode(), zlib.crc32(heads[row[k]]))
        bad = h % DAMAGED == 0
        for k in np.flatnonzero(bad & (length > LEAST_LENGTH)).tolist():
            names = list(self._table._at) if names is None else names
            w, at = names[word[k]], int(h[k] % length[k])
            self._damaged[w[:at] + w[at + 1 :]] += int(n[k])
        size = len(self._table._at)
        self._n = np.concatenate([self._n, np.zeros(size - len(self._n), dtype=np.int64)])
        self._n += np.bincount(word[~bad], weights=n[~bad], minlength=size).astype(np.int64)

    def full(self) -> bool:
        return len(self._n) + len(self._damaged) > MOST_WORDS

    def rows(self) -> Iterator[pa.RecordBatch]:
        words = [*self._table._at, *self._damaged]
        n = np.concatenate([self._n, np.array(list(self._damaged.values()), dtype=np.int64)])
        kept = np.flatnonzero(n)
        for i in range(0, len(kept), 100_000):
            part = kept[i : i + 100_000]
            yield pa.record_batch([pa.array([words[k].decode("latin-1") for k in part.tolist()], pa.string()), pa.array(n[part])], names=["word", "n"])


def _counted(batches):
    counter = _WordCounter()
    for whole in batches:
        for batch in pieces_of(whole):
            counter.add(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if counter.full():
                yield from counter.rows()
                counter = _WordCounter()
    yield from counter.rows()


def word_counts(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of every word that occurs `least` times in all texts, some of them damaged as their hash says.

    Tasks add up what they read, so a hot document or word sends one row.
    """
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _shared_length(a: str, b: str) -> int:
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def _paths(batches):
    """Of sorted words, each word's nodes below the root, numbered from 1 in the order in which this partition first meets them."""
    part, before, path, nodes = TaskContext.get().partitionId(), "", [], 0
    for batch in batches:
        found = []
        for word in batch.column(0).to_pylist():
            shared = _shared_length(before, word)
            path = path[:shared] + list(range(nodes + 1, nodes + 1 + len(word) - shared))
            nodes += len(word) - shared
            before = word
            found.append(path)
        yield pa.record_batch([batch.column(0), pa.array([part] * len(found), pa.int32()), pa.array(found, pa.list_(pa.int64()))], names=["key", "part", "path"])


def trie_nodes(words: DataFrame, key: str, name: str) -> DataFrame:
    """(key, nodes): the numbers of the trie nodes on the way to each distinct `key`, the root's 0 first.

    Sorted words lie in ranges; each range numbers its own nodes. A range's first word shares its
    first nodes with the last word of the range before, and no other nodes are common, so one row
    for each range tells how its numbers move.
    """
    found = staged(words.select(F.expr(key).alias("key")).repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_paths, "key string, part int, path array<long>"), name)
    ranges = found.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.max_by("path", "key").alias("path")).orderBy("part").collect()
    moves, before, way, nodes = [], "", [], 0
    for r in ranges:
        common = way[: _shared_length(before, r["first"])]
        shift = nodes - len(common)
        moves.append((r["part"], shift, common))
        nodes = shift + r["path"][-1]
        before, way = r["last"], [common[p - 1] if p <= len(common) else p + shift for p in r["path"]]
    return query(
        "SELECT key, concat(array(0L), transform(path, p -> if(p <= size(common), common[cast(p AS int) - 1], p + shift))) AS nodes FROM {f} f JOIN {m} m ON f.part = m.part",
        f=found,
        m=words.sparkSession.createDataFrame(moves, "part int, shift long, common array<long>"),
    )


def _places(words: DataFrame) -> DataFrame:
    """(prefix, suffix, id, n, kind): a word's pairs of nodes around each of its code points, and around each seat between two.

    `kind` 0 is a seat, 1 and 2 a skipped code point, 2 where none like it stands before it, so that
    a code point inserted into a row of its like counts once.
    """
    return query(
        """SELECT id, n, inline(concat(
             transform(sequence(0, size(c)), i -> struct(f[i] AS prefix, r[size(c) - i] AS suffix, 0Y AS kind)),
             transform(sequence(0, size(c) - 1), i -> struct(f[i] AS prefix, r[size(c) - 1 - i] AS suffix, if(i > 0 AND c[i] = c[i - 1], 1Y, 2Y) AS kind))))
           FROM {w}""",
        w=words,
    )


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best): how many words are one code point away, and the most frequent of them as (n, -id).

    `words`: id, n, c (code points), f and r (nodes of the prefixes and suffixes). Two words that
    skip a code point between the same two nodes differ by it alone; one whose seat lies between them
    lacks it. At most one word has a seat there, and no more skip it than there are letters, so no
    pair of nodes has many words, and only one row for each of these leaves it.
    """
    return query(
        """SELECT id, sum(near) AS n_near, max(best) AS best FROM (
             SELECT inline(transform(words, x -> struct(x.id AS id, size(filter(words, y -> y.id <> x.id AND (x.kind > 0 OR y.kind = 2) AND (y.kind > 0 OR x.kind = 2))) AS near,
                      array_max(transform(filter(words, y -> y.id <> x.id AND (x.kind > 0 OR y.kind = 2) AND (y.kind > 0 OR x.kind = 2)), y -> struct(y.n AS n, -y.id AS least))) AS best)))
             FROM (SELECT collect_list(struct(id, n, kind)) AS words FROM {p} GROUP BY prefix, suffix HAVING count(*) > 1))
           WHERE near > 0 GROUP BY id""",
        p=_places(words),
    )


def _last_forms(forms: DataFrame) -> DataFrame:
    """(id, root) from (id, form_id): where the way over forms ends. Each round doubles the steps; counts double at every step, so rounds are few."""
    now = staged(forms.select("id", F.col("form_id").alias("root")), "forms")
    while True:
        further = query("SELECT a.id, coalesce(b.root, a.root) AS root, b.root IS NOT NULL AS moved FROM {a} a LEFT JOIN {b} b ON a.root = b.id", a=now, b=now)
        last, now = now, staged(further, "forms")
        discard(last)
        if now.where("moved").isEmpty():
            return now.select("id", "root")


def variants(docs: DataFrame, outweighs: int = OUTWEIGHS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the corpus.

    A word's form is its most frequent near word (the first in code-point order of equals) if that
    occurs `outweighs` times as often, its root the last form on the way from it, itself without one. A
    null text has no words; a null doc_id reads as empty text; a repeated row counts again. An empty
    table gives no rows; other columns are ignored.
    """
    counts = staged(word_counts(docs), "words")
    ahead, behind = trie_nodes(counts, "word", "prefixes"), trie_nodes(counts, "reverse(word)", "suffixes")
    words = staged(
        query(
            "SELECT w.word, w.n, f.nodes AS f, r.nodes AS r, split(w.word, '') AS c, element_at(f.nodes, -1) AS id FROM {w} w JOIN {f} f ON w.word = f.key JOIN (SELECT reverse(key) AS word, nodes FROM {r}) r ON w.word = r.word",
            w=counts,
            f=ahead,
            r=behind,
        ),
        "word-nodes",
    )
    named = words.select("id", "word", "n")
    judged = staged(
        query(
            f"SELECT w.*, coalesce(m.n_near, 0) AS n_near, if(m.best.n >= {outweighs} * w.n, m.best.n, NULL) AS form_n, if(m.best.n >= {outweighs} * w.n, -m.best.least, NULL) AS form_id FROM {{w}} w LEFT JOIN {{m}} m ON w.id = m.id",
            w=named,
            m=near_words(words),
        ),
        "near-words",
    )
    roots = _last_forms(judged.where("form_id IS NOT NULL"))
    return query(
        """SELECT j.word, f.word AS form, coalesce(r.word, j.word) AS root, j.n, j.n_near, j.form_n
           FROM {j} j LEFT JOIN {w} f ON j.form_id = f.id LEFT JOIN {l} l ON j.id = l.id LEFT JOIN {w} r ON l.root = r.id""",
        j=judged,
        w=named,
        l=roots,
    )
