"""How much the sources of each language differ in their terms, by quadtrees over the group-term count matrix.

The matrix of a language has a row for each source and a column for each kept term. All absent
terms of a row have one weight, so what a row's terms add against a row without any follows from
how often each count occurs in it, and what two empty places add from their number. Only terms
that both rows have are left: columns are dealt out in blocks, each block is a K-squared tree
whose empty quadrants are not stored, and two rows are compared by walking both their quadrants
at once, down to the leaves that they share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sql import query
from .common import WordTable, pieces_of, raw, staged

#: A term is a longest run of letters A-Z and characters beyond ASCII, A-Z lower-cased: byte by byte, all others blank.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Documents of its language that a term needs, and its share of the whole that a term's weight is counted in.
LEAST_DOCUMENTS, SCALE = 3, 1_000_000_000
TOP_TERMS = 200
#: Children of a quadrant along each side; leaves of a block; pairs of quadrants that are opened at once.
K, BLOCK_LEAVES, FRONT = 2, 50_000, 1 << 15
#: Counts that a task holds before it sends them on.
MOST_COUNTS = 800_000
#: Sums of pairs of rows that a task holds before it sends them on.
MOST_PAIRS = 1_000_000


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


_COUNTS = "lang string, source string, term string, n long, docs long"


def _lengths(words: list[bytes]) -> np.ndarray:
    return np.zeros((len(words), 1), dtype=np.int8)


class _Counter:
    """Sums of occurrences and documents by group and term."""

    def __init__(self):
        self._table = WordTable(_lengths, 1, np.int8, limit=1 << 62)
        self._groups: dict[tuple[str, str], int] = {}
        self._keys, self._sums = np.zeros(0, dtype=np.int64), np.zeros((0, 2), dtype=np.int64)
        self._new: list[tuple[np.ndarray, np.ndarray]] = []
        self._waiting = 0

    def add(self, texts: list[bytes], groups: list[tuple[str, str]]) -> None:
        numbers, counts = self._table.look_up([terms(t) for t in texts])
        group = np.array([self._groups.setdefault(g, len(self._groups)) for g in groups], dtype=np.int64)
        row = np.repeat(np.arange(len(texts)), counts)
        pairs, n = np.unique((row << 40) | numbers, return_counts=True)
        keys, at, docs = np.unique((group[pairs >> 40] << 40) | (pairs & ((1 << 40) - 1)), return_inverse=True, return_counts=True)
        occurrences = np.bincount(at, weights=n, minlength=len(keys)).astype(np.int64)
        self._new.append((keys, np.stack([occurrences, docs], axis=1)))
        self._waiting += len(keys)
        if self._waiting > MOST_COUNTS:
            self._merge()

    def _merge(self) -> None:
        self._keys, self._sums = _summed(np.concatenate([self._keys, *(k for k, _ in self._new)]), np.concatenate([self._sums, *(s for _, s in self._new)]))
        self._new, self._waiting = [], 0

    def full(self) -> bool:
        return len(self._keys) > MOST_COUNTS

    def rows(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        words, groups = list(self._table._at), list(self._groups)
        for i in range(0, len(self._keys), 100_000):
            keys, sums = self._keys[i : i + 100_000], self._sums[i : i + 100_000]
            group, word = (keys >> 40).tolist(), (keys & ((1 << 40) - 1)).tolist()
            text = pa.array([words[w] for w in word], pa.binary()).cast(pa.string())
            lang, source = (pa.array([groups[g][k] for g in group], pa.string()) for k in (0, 1))
            yield pa.record_batch([lang, source, text, pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=["lang", "source", "term", "n", "docs"])


def _counted(batches):
    counter = _Counter()
    for whole in batches:
        for batch in pieces_of(whole):
            counter.add(raw(batch.column(2)), list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))
            if counter.full():
                yield from counter.rows()
                counter = _Counter()
    yield from counter.rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group; nulls read as empty text.

    Tasks add up what they read before anything is shuffled, so a hot source sends no more than others.
    """
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return read.mapInArrow(_counted, _COUNTS).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


class QuadTree:
    """The stored quadrants of a block of the matrix, level by level: which children of a quadrant are there.

    `rows`, `columns`, `values`: the leaves, of distinct places. The side is the least power of K that
    holds the block. The number of set marks before a child's is its number on the next level.
    """

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, k: int = K):
        self.k, self.depth = k, 0
        most = int(max(rows.max(initial=0), columns.max(initial=0)))
        while k**self.depth <= most:
            self.depth += 1
        code = np.zeros(len(rows), dtype=np.int64)
        for level in reversed(range(self.depth)):
            code = code * k * k + (rows // k**level % k) * k + columns // k**level % k
        order = np.argsort(code)
        code, self.values = code[order], values[order]
        self.children: list[np.ndarray] = []
        for level in reversed(range(self.depth)):
            below = np.unique(code // (k * k) ** level)
            marks = np.zeros((len(np.unique(below // (k * k))), k * k), dtype=bool)
            marks[np.unique(below // (k * k), return_inverse=True)[1], below % (k * k)] = True
            before = np.cumsum(marks).reshape(marks.shape) - 1
            self.children.append(np.where(marks, before, -1))

    def joint(self, front: int = FRONT) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(row, other row, leaf, other leaf) for every column that two different rows both have.

        Pairs of quadrants over the same columns are opened together, at most `front` at a time, the
        deepest first; a pair of which one is empty is left out.
        """
        if not len(self.values):
            return
        k = self.k
        mine, other, column = (x.ravel() for x in np.meshgrid(np.arange(k), np.arange(k), np.arange(k), indexing="ij"))
        waiting = [(0, *(np.zeros(1, dtype=np.int64) for _ in range(4)))]
        while waiting:
            level, u, v, row, beside = waiting.pop()
            if level == self.depth:
                keep = row != beside
                yield row[keep], beside[keep], u[keep], v[keep]
            elif len(u) > front:
                waiting += [(level, *(x[i : i + front] for x in (u, v, row, beside))) for i in range(0, len(u), front)]
            else:
                below = self.children[level]
                a, b = below[u][:, mine * k + column], below[v][:, other * k + column]
                keep = (a >= 0) & (b >= 0)
                r, s = row[:, None] * k + mine, beside[:, None] * k + other
                waiting.append((level + 1, a[keep], b[keep], r[keep], s[keep]))


def difference(p, q):
    """What a term adds: the squared difference of its two weights by the second, rounded down."""
    return (p - q) * (p - q) // q


def _summed(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, sums = keys[order], sums[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(sums, first) if len(keys) else sums


def _shared(block: pa.Table, front: int = FRONT) -> Iterator[pa.RecordBatch]:
    """For two rows of a block (lang, block, term, row, p, absent), what their shared terms add beyond what was priced without looking."""
    rows, leaf, absent = (block.column(c).to_numpy() for c in ("row", "p", "absent"))
    columns = pc.dictionary_encode(block.column("term").combine_chunks()).indices.to_numpy()
    # columns with the same rows side by side: the more rows, the further left
    n = int(columns.max()) + 1
    lowest = np.full(n, rows.max(), dtype=np.int64)
    np.minimum.at(lowest, columns, rows)
    place = np.empty(n, dtype=np.int64)
    place[np.lexsort((lowest, -np.bincount(columns, minlength=n)))] = np.arange(n)
    tree = QuadTree(rows, place[columns], np.arange(len(rows)))
    keys, sums, waiting, lang = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), [], block.column("lang")[0]

    def rows_of(keys, sums):
        return pa.record_batch([pa.repeat(lang, len(keys)), pa.array(keys >> 31), pa.array(keys & (1 << 31) - 1), pa.array(sums)], names=["lang", "row", "beside", "shared"])

    for row, beside, u, v in tree.joint(front):
        u, v = tree.values[u], tree.values[v]
        p, q, p0, q0 = leaf[u], leaf[v], absent[u], absent[v]
        waiting.append(_summed(row << 31 | beside, difference(p, q) - difference(p, q0) - difference(p0, q) + difference(p0, q0)))
        if sum(len(k) for k, _ in waiting) > MOST_PAIRS:
            keys, sums = _summed(np.concatenate([keys, *(k for k, _ in waiting)]), np.concatenate([sums, *(x for _, x in waiting)]))
            waiting = []
            if len(keys) > MOST_PAIRS:
                yield rows_of(keys, sums)
                keys, sums = keys[:0], sums[:0]
    yield rows_of(*_summed(np.concatenate([keys, *(k for k, _ in waiting)]), np.concatenate([sums, *(x for _, x in waiting)])))


def _blocks(batches) -> Iterator[pa.RecordBatch]:
    """Blocks of a sorted partition, one held at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = pc.binary_join_element_wise(batch.column(0), batch.column(1).cast(pa.string()), "\0")
        codes = pc.dictionary_encode(key).indices.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            part = batch.slice(i, j - i)
            if held and (held[0].column(0)[0], held[0].column(1)[0]) != (part.column(0)[0], part.column(1)[0]):
                yield from _shared(pa.Table.from_batches(held))
                held = []
            held.append(part)
    if held:
        yield from _shared(pa.Table.from_batches(held))


def _weight(n: str, size: str, vocabulary: str) -> str:
    """1 + floor(SCALE * (n + 1) / (size + vocabulary)), exact for counts of any size; null without kept terms."""
    whole = f"nullif({size} + {vocabulary}, 0)"
    return f"(1 + if({n} < 9000000000, {SCALE} * ({n} + 1) div {whole}, cast({n} + 1 AS decimal(27, 0)) * {SCALE} div cast({whole} AS decimal(20, 0))))"


def _difference(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from each other one, and its most telling terms.

    Part `pair`: item is another source, value the sum over all kept terms of the difference of
    their weights. Part `term`: item is a term of the source that weighs more there than in its
    language, value that difference, the `top` greatest only. Ranks begin with 1 by falling value;
    ties go by item in the order of bytes. Null text, lang and source read as empty text; a
    repeated row counts again, as a document of its own; a group without terms has its pairs; where a
    language keeps no term they are all 0. An empty table gives no rows; other columns are ignored.
    """
    leaves = staged(
        query(
            f"""SELECT lang, source, term, n, in_lang, sources, first FROM (
                  SELECT *, sum(docs) OVER t AS found_in, sum(n) OVER t AS in_lang, count(*) OVER t AS sources, source = min(source) OVER t AS first FROM {{c}} WINDOW t AS (PARTITION BY lang, term))
                WHERE found_in >= {least_documents}""",
            c=term_counts(docs),
        ),
        "leaves",
    )
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = staged(
        query(
            f"""SELECT *, {_weight('0', 'size', 'vocabulary')} AS absent, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS row FROM (
                  SELECT g.lang, g.source, coalesce(n.size, 0) AS size, coalesce(n.held, 0) AS held, coalesce(l.vocabulary, 0) AS vocabulary, coalesce(l.size, 0) AS lang_size
                  FROM {{g}} g LEFT JOIN (SELECT lang, source, sum(n) AS size, count(*) AS held FROM {{x}} GROUP BY lang, source) n ON g.lang = n.lang AND g.source = n.source
                  LEFT JOIN (SELECT lang, sum(n) AS size, count_if(first) AS vocabulary FROM {{x}} GROUP BY lang) l ON g.lang = l.lang)""",
            g=named,
            x=leaves,
        ),
        "groups",
    )
    weighed = query(f"SELECT x.*, g.row, g.absent, {_weight('x.n', 'g.size', 'g.vocabulary')} AS p, {_weight('x.in_lang', 'g.lang_size', 'g.vocabulary')} AS q FROM {{x}} x JOIN {{g}} g ON x.lang = g.lang AND x.source = g.source", x=leaves, g=groups)
    # what the terms of a row add against a row that has none of them, by how often each count occurs
    alone = query(
        f"""SELECT h.lang, h.source, b.source AS beside, sum(h.terms * {_difference('h.p', 'b.absent')}) AS ahead, sum(h.terms * {_difference('b.absent', 'h.p')}) AS behind
            FROM (SELECT lang, source, p, count(*) AS terms FROM {{w}} GROUP BY lang, source, p) h JOIN {{g}} b ON h.lang = b.lang AND h.source <> b.source GROUP BY h.lang, h.source, b.source""",
        w=weighed,
        g=groups,
    )
    blocks = query(
        f"""SELECT w.lang, pmod(xxhash64(w.term), b.blocks) AS block, w.term, cast(w.row AS bigint) AS row, w.p, w.absent FROM {{w}} w
            JOIN (SELECT lang, 1 + count(*) div {BLOCK_LEAVES} AS blocks FROM {{x}} WHERE sources > 1 GROUP BY lang) b ON w.lang = b.lang WHERE w.sources > 1""",
        w=weighed,
        x=leaves,
    )
    walked = blocks.repartition("lang", "block").sortWithinPartitions("lang", "block").mapInArrow(_blocks, "lang string, row long, beside long, shared long")
    pairs = query(
        f"""SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
                   coalesce(o.ahead, 0) + coalesce(u.behind, 0) + (a.vocabulary - a.held - b.held) * coalesce({_difference('a.absent', 'b.absent')}, 0) + coalesce(s.shared, 0) AS value
            FROM {{g}} a JOIN {{g}} b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN {{o}} o ON o.lang = a.lang AND o.source = a.source AND o.beside = b.source
            LEFT JOIN {{o}} u ON u.lang = a.lang AND u.source = b.source AND u.beside = a.source
            LEFT JOIN (SELECT lang, row, beside, sum(shared) AS shared FROM {{s}} GROUP BY lang, row, beside) s ON s.lang = a.lang AND s.row = a.row AND s.beside = b.row""",
        g=groups,
        o=staged(alone, "alone"),
        s=staged(walked, "shared"),
    )
    telling = query(f"SELECT lang, source, 'term' AS part, term AS item, {_difference('p', 'q')} AS value FROM {{w}} WHERE p > q", w=weighed)
    ranked = "SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM {r}"
    return query(ranked, r=pairs).unionByName(query(f"SELECT * FROM ({ranked}) WHERE rank <= {top}", r=telling))
