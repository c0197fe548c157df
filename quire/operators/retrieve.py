"""Literal and vector retrieval for a batch of requests over the whole corpus.

Requests are broadcast, MOST_REQUESTS of them at a time, and all work on texts stays in the row.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.literal import BestSoFar, Joined, LiteralScorer, RequestMatcher, literal_form, literal_terms, mark_for, worker_cache
from ..functions.sql import query
from ..functions.staging import in_blocks, shared_path

RRF, TOP, PAGE_CAP = 60, 60, 3


def _scorer(requests: DataFrame, convert: Callable[[str], str] | None) -> tuple[np.ndarray, LiteralScorer]:
    """Ids of a block of requests in order, and what scores texts for them; empty requests are left out."""
    rows = requests.select("query_id", "query").orderBy("query_id").collect()
    asked = [(r.query_id, *literal_terms(q)) for r in rows if (q := literal_form(r["query"], convert))]
    return np.array([i for i, *_ in asked], dtype=np.int64), LiteralScorer([x[1:] for x in asked])


#: Characters of texts that are scored at a time.
TEXT_SLICE = 400_000


def literal_score(texts: DataFrame, requests: DataFrame, key: str, convert: Callable[[str], str] | None = None) -> DataFrame:
    """(query_id, key, literal_score) for every text and request that score above 0.

    Texts and queries are compared without white space, in one case and, with `convert`, in one script.
    5 for the whole query, the share of its pairs, and a fifth of the share of its terms. Texts
    stay where they are; inverted lists from pairs of characters to a block's requests name those
    that a text can score for.
    """
    return in_blocks(requests, lambda block: _literal_score(texts, block, key, convert), "query")


def _literal_score(texts: DataFrame, requests: DataFrame, key: str, convert: Callable[[str], str] | None) -> DataFrame:
    ids, scorer = _scorer(requests, convert)

    def run(batches):
        for batch in batches:
            found = [literal_form(t, convert) for t in batch.column(1).to_pylist()]
            for i, j in joined_slices([*map(len, found)], TEXT_SLICE):
                t, r, score = scorer.scores(found[i:j])
                yield pa.record_batch([pa.array(ids[r]), batch.column(0).take(pa.array(t + i)), pa.array(score)], names=["query_id", key, "literal_score"])

    return texts.select(key, "text").mapInArrow(run, f"query_id long, {key} {dict(texts.dtypes)[key]}, literal_score double")


#: Share of the score of its document's description that a text gets.
DESCRIBED = 0.3


def literal_best(texts: DataFrame, requests: DataFrame, key: str, k: int = TOP, convert: Callable[[str], str] | None = None) -> DataFrame:
    """(query_id, key, literal_score, rank): the k best texts of each request, with the share of their descriptions' scores.

    `texts`: key, text, described, and, where only some may be seen, owner_id, is_public and document_id;
    then `requests` has user_id and may have document_ids (null for all), and texts that a request's user may not
    see, or of other documents, never count for it.
    Each task remembers the k best scores of every request so far: a text that shares too few of a
    request's pairs to come up to the last of them, even with all of its terms and the best
    description at hand, is not looked at. Scores count to six decimals; ties go by key.
    """
    scoped = "owner_id" in texts.columns
    found = in_blocks(requests, lambda block: _literal_best(texts, block, key, k, scoped, convert), "query")
    return literal_topk(found, key, k)


def _literal_best(texts: DataFrame, requests: DataFrame, key: str, k: int, scoped: bool, convert: Callable[[str], str] | None) -> DataFrame:
    ids, scorer = _scorer(requests, convert)
    users, listed = _asking(requests, scoped)
    user = np.array([users[i] for i in ids.tolist()]) if scoped else None
    lists = [listed.get(i) for i in ids.tolist()]

    def run(batches):
        best = BestSoFar(scorer, k, DESCRIBED)
        for batch in batches:
            own = [literal_form(t, convert) for t in batch.column(1).to_pylist()]
            forms: dict[str | None, str] = {}
            described = [forms[t] if t in forms else forms.setdefault(t, literal_form(t, convert)) for t in batch.column(2).to_pylist()]
            keys = batch.column(0).to_pylist()
            for i, j in joined_slices([*map(len, own)], TEXT_SLICE):
                t, r, score = best.scores(own[i:j], described[i:j])
                if scoped:
                    owner, public = (batch.column(c).slice(i, j - i).to_numpy(zero_copy_only=False) for c in (3, 4))
                    seen = public.astype(bool)[t] | (owner[t] == user[r])
                    seen &= _listed(lists, r, batch.column(5).slice(i, j - i).to_numpy(zero_copy_only=False)[t]) if listed else True
                    t, r, score = t[seen], r[seen], score[seen]
                place = np.empty(j - i, dtype=np.int64)
                place[sorted(range(j - i), key=keys[i:j].__getitem__)] = np.arange(j - i)
                keep = best.keep(r, score, place[t])
                yield pa.record_batch([pa.array(ids[r[keep]]), batch.column(0).take(pa.array(t[keep] + i)), pa.array(score[keep])], names=["query_id", key, "literal_score"])

    columns = [key, "text", "described", *(["owner_id", "coalesce(is_public, false) AS is_public"] if scoped else []), *(["document_id"] if listed else [])]
    return texts.selectExpr(*columns).mapInArrow(run, f"query_id long, {key} {dict(texts.dtypes)[key]}, literal_score double")


def _asking(requests: DataFrame, scoped: bool) -> tuple[dict, dict[int, frozenset]]:
    """Users of a block of requests, and the documents of those that name some."""
    named = scoped and "document_ids" in requests.columns
    rows = requests.select("query_id", "user_id", *(["document_ids"] if named else [])).collect() if scoped else []
    return {r.query_id: r.user_id for r in rows}, {r.query_id: frozenset(r.document_ids) for r in rows if named and r.document_ids is not None}


def _listed(lists: list[frozenset | None], r: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Which of these requests may look at these documents."""
    seen = np.ones(len(r), dtype=bool)
    for k in np.unique(r).tolist():
        if lists[k] is not None:
            at = np.flatnonzero(r == k)
            seen[at] = [d in lists[k] for d in document[at].tolist()]
    return seen


#: What describes a document, as far as its table has it.
DESCRIPTION = ("title", "author", "year", "publisher", "tags", "file_name")


def description(documents: DataFrame) -> str:
    """The expression of a document's description: its fields one below the other, tags in their order."""
    kinds = dict(documents.dtypes)
    return f"concat_ws('\\n', {', '.join(c for c in DESCRIPTION if c in kinds)})"


def metadata_boost(scores: DataFrame, chunks: DataFrame, documents: DataFrame, requests: DataFrame, convert: Callable[[str], str] | None = None) -> DataFrame:
    """Adds 0.3 of the literal score of a document's description (title, author, year, publisher, tags, file name) to its chunks' scores."""
    described = documents.selectExpr("document_id", f"{description(documents)} AS text")
    return query(
        """SELECT coalesce(s.query_id, b.query_id) AS query_id, coalesce(s.page_id, b.page_id) AS page_id, coalesce(s.literal_score, 0D) + 0.3D * coalesce(b.literal_score, 0D) AS literal_score
           FROM {s} s FULL OUTER JOIN (SELECT m.query_id, c.page_id, m.literal_score FROM {m} m JOIN {c} c ON m.document_id = c.document_id) b ON s.query_id = b.query_id AND s.page_id = b.page_id""",
        s=scores,
        m=literal_score(described, requests, "document_id", convert),
        c=chunks,
    )


def literal_topk(scores: DataFrame, key: str, k: int = TOP) -> DataFrame:
    return query(f"SELECT query_id, {key}, literal_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY literal_score DESC, {key}) AS rank FROM {{s}} WHERE literal_score > 0) WHERE rank <= {k}", s=scores)


def literal_matches(sources: DataFrame, requests: DataFrame) -> DataFrame:
    """Every literal location of every request in every text, exact or partial, with sentence and context.

    `sources`: page_id, source_layer, source_hash, text. An automaton over the terms of a block of
    requests reads each text once; texts stay where they are.
    """
    return in_blocks(requests.select("query_id", "query"), lambda block: _literal_matches(sources, block), "query")


#: Rows that a task sends on at a time.
MATCH_ROWS = 20_000
_MATCHES = "query_id long, page_id string, source_layer string, source_hash string, match_start int, match_end int, level string, start int, end int, sentence_start int, sentence_end int, score double"
#: Characters of texts that are looked through as one.
JOINED = 200_000


def joined_slices(sizes: list[int], most: int):
    """Ranges of texts that have `most` characters together; a longer one is a range of its own."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def _literal_matches(sources: DataFrame, requests: DataFrame, shown: bool = False) -> DataFrame:
    """`shown`: with the texts of the context and the sentence."""
    asked = [(r.query_id, r["query"]) for r in requests.orderBy("query_id").collect() if r["query"]]  # a block of requests
    name = uuid.uuid4().hex
    ids, sizes, mark = np.array([i for i, _ in asked], dtype=np.int64), np.array([len(q) for _, q in asked], dtype=np.int64), mark_for(q for _, q in asked)
    levels = pa.array(["exact", "partial"])

    def run(batches):
        matcher = worker_cache(name, lambda: RequestMatcher(q for _, q in asked))
        for batch in batches:
            texts = [t or "" for t in batch.column(3).to_pylist()]
            for i, j in joined_slices([*map(len, texts)], JOINED):
                own = Joined(texts[i:j], mark)
                found = matcher.places(own)
                found += kernels.excerpts(own, *found[1:3])
                for k in range(0, len(found[0]), MATCH_ROWS):
                    yield rows(batch, i, own, *(x[k : k + MATCH_ROWS] for x in found))

    def rows(batch, at, own, of, a, b, partial, s, e):
        n = own.number(a)
        begin, end = own.begin[n], own.end[n]
        place = pa.array(n + at)
        first, last = np.maximum(begin, a - kernels.CONTEXT_BEFORE), np.minimum(end, b + kernels.CONTEXT_AFTER)
        columns = [pa.array(ids[of]), *(batch.column(c).take(place) for c in range(3)), pa.array((a - begin).astype(np.int32)), pa.array((b - begin).astype(np.int32)), levels.take(pa.array(partial.astype(np.int8)))]
        columns += [pa.array((x - begin).astype(np.int32)) for x in (first, last, s, e)] + [pa.array((b - a) / sizes[of])]
        names = [c.split()[0] for c in _MATCHES.split(", ")]
        if shown:
            columns += [pa.array([own.text[x:y] for x, y in zip(u.tolist(), v.tolist())], pa.string()) for u, v in ((first, last), (s, e))]
            names += ["text", "sentence"]
        return pa.record_batch(columns, names=names)

    return sources.select("page_id", "source_layer", "source_hash", "text").mapInArrow(run, _MATCHES + (", text string, sentence string" if shown else ""))


def match_text(sources: DataFrame, requests: DataFrame) -> DataFrame:
    """literal_matches with the texts of the context and the sentences, which are cut out where the matches are found."""
    return in_blocks(requests.select("query_id", "query"), lambda block: _literal_matches(sources, block, True), "query")


def exact_layers(sources: DataFrame, requests: DataFrame) -> DataFrame:
    """(query_id, page_id, source_layer) of sources that hold a request as it stands, a row each, without the places."""
    return in_blocks(requests.select("query_id", "query"), lambda block: _exact_layers(sources, block), "query")


def _exact_layers(sources: DataFrame, requests: DataFrame) -> DataFrame:
    asked = [(r.query_id, r["query"]) for r in requests.orderBy("query_id").collect() if r["query"]]  # a block of requests
    name, ids, mark = uuid.uuid4().hex, np.array([i for i, _ in asked], dtype=np.int64), mark_for(q for _, q in asked)

    def run(batches):
        matcher = worker_cache(name, lambda: RequestMatcher(q for _, q in asked))
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for i, j in joined_slices([*map(len, texts)], JOINED):
                text, of = matcher.holders(Joined(texts[i:j], mark))
                yield pa.record_batch([pa.array(ids[of]), *(batch.column(c).take(pa.array(text + i)) for c in range(2))], names=["query_id", "page_id", "source_layer"])

    return sources.select("page_id", "source_layer", "text").mapInArrow(run, "query_id long, page_id string, source_layer string")


def pick_match_layer(layer_hits: DataFrame, policy: str = "primary", reader: bool = False) -> DataFrame:
    """Of rows (query_id, page_id, source_layer, is_primary), those that show: one body layer per page, and notes and captions."""
    allowed = ["true"] + ["source_layer <> 'ocrText'"] * (policy == "processed") + ["(is_primary OR source_layer LIKE 'visual_caption:%')"] * reader
    body = "source_layer IN ('ocrText', 'punctuatedText')"
    return query(
        f"""SELECT query_id, page_id, source_layer FROM (
              SELECT *, row_number() OVER (PARTITION BY query_id, page_id, {body} ORDER BY is_primary DESC, source_layer DESC) AS n FROM {{h}} WHERE {' AND '.join(allowed)})
            WHERE NOT {body} OR n = 1""",
        h=layer_hits,
    )


def dedupe_sentence_hits(hits: DataFrame) -> DataFrame:
    """One hit per query, source and sentence: exact before partial, then the earliest; at one place by level, so that the choice is always the same."""
    return query("SELECT * EXCEPT (n) FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_id, sentence ORDER BY level <> 'exact', ordinal NULLS LAST, level) AS n FROM {h}) WHERE n = 1", h=hits)


def semantic_topk(vectors: DataFrame, wanted: DataFrame, threshold: float = 0.45, k: int | None = TOP) -> DataFrame:
    """(query_id, chunk_id, score, rank) by cosine above the threshold; ties go to the greater chunk id.

    Each task multiplies its vectors with all query vectors of a block, and of each batch only the
    k best go on (and those that tie with the last). Vectors of another dimension, or not finite,
    or zero are left out. With owner_id, is_public and document_id in `vectors`, and user_id and perhaps
    document_ids in `wanted`, vectors that a request's user may not see, or of other documents, are left out for it.
    """
    scoped = "owner_id" in vectors.columns
    asked = wanted.select("query_id", "vector", *(["user_id"] if scoped else []), *(["document_ids"] if scoped and "document_ids" in wanted.columns else []))
    found = in_blocks(asked, lambda block: _semantic_scores(vectors, block, threshold, k, scoped))
    ranked = query("SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id DESC) AS rank FROM {f}", f=found)
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def _semantic_scores(vectors: DataFrame, wanted: DataFrame, threshold: float, k: int | None, scoped: bool) -> DataFrame:
    rows = wanted.collect()
    ids = np.array([r.query_id for r in rows], dtype=np.int64)
    q = np.array([r.vector for r in rows], dtype=np.float64)
    norms = np.linalg.norm(q, axis=1, keepdims=True) if len(rows) else q
    q = q / np.where(norms > 0, norms, 1.0) if len(rows) else q
    user = np.array([r.user_id for r in rows]) if scoped else None
    named = scoped and "document_ids" in wanted.columns
    lists = [frozenset(r.document_ids) if named and r.document_ids is not None else None for r in rows]

    def run(batches):
        for pdf in batches:
            ok = [v is not None and len(v) == q.shape[1] for v in pdf["vector"]] if len(rows) else []
            pdf = pdf[ok] if len(rows) else pdf[:0]
            if not len(pdf):
                continue
            x = np.array(pdf["vector"].tolist(), dtype=np.float64)
            norm = np.linalg.norm(x, axis=1)
            good = np.isfinite(norm) & (norm > 0)
            s = q @ (x[good] / norm[good, None]).T
            if scoped:
                own, public = pdf["owner_id"].to_numpy()[good], pdf["is_public"].to_numpy().astype(bool)[good]
                s[~(public[None, :] | (own[None, :] == user[:, None]))] = -2.0
                for i, some in enumerate(lists):
                    if some is not None:
                        s[i, [d not in some for d in pdf["document_id"].to_numpy()[good].tolist()]] = -2.0
            chunk = pdf["chunk_id"].to_numpy()[good]
            hit = s > threshold
            if k is not None and s.shape[1] > k:
                hit &= s >= -np.partition(-s, k - 1, axis=1)[:, k - 1 : k] - 1e-9
            a, b = np.nonzero(hit)
            yield pd.DataFrame({"query_id": ids[a], "chunk_id": chunk[b], "score": s[a, b]})

    columns = ["chunk_id", "vector", *(["owner_id", "is_public"] if scoped else []), *(["document_id"] if any(x is not None for x in lists) else [])]
    return vectors.select(*columns).mapInPandas(run, f"query_id long, chunk_id {dict(vectors.dtypes)['chunk_id']}, score double")


#: Cells of vectors at most, and vectors that their centres are taken from.
CELLS, CENTRE_SAMPLE = 256, 4096


@dataclass
class VectorCells:
    """Unit vectors in cells around centres; a cell's radius is the greatest angle of one of its vectors to the centre.

    `table`: cell, chunk_id, vector, angle; files lie by cell, so cells that are skipped are not read.
    """

    table: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The greatest cosine that a vector of each cell can have with each query: angles obey the triangle inequality. -2 where there is none."""
        if queries.shape[1] != self.centres.shape[1] or not self.sizes.any():
            return np.full((len(queries), len(self.radii)), -2.0)
        return np.where(self.sizes > 0, np.cos(np.maximum(0.0, self.away(queries) - self.radii[None, :])), -2.0)

    def away(self, queries: np.ndarray) -> np.ndarray:
        """Angles of queries and centres."""
        return np.arccos(np.clip(queries @ self.centres.T, -1.0, 1.0))

    def skipped(self, wanted: DataFrame, threshold: float = 0.45) -> DataFrame:
        """(query_id, cells, skipped, vectors, vectors_skipped) for each query: what it does not look at."""
        return in_blocks(wanted.select("query_id", "vector"), lambda block: self._skipped(block, threshold))

    def _skipped(self, block: DataFrame, threshold: float) -> DataFrame:
        ids, q = _unit_queries(block.collect())
        off = self.bounds(q) <= threshold - 1e-9 if len(ids) else np.zeros((0, len(self.radii)), dtype=bool)
        rows = [(int(i), len(self.radii), int(o.sum()), int(self.sizes.sum()), int(self.sizes[o].sum())) for i, o in zip(ids, off)]
        return block.sparkSession.createDataFrame(rows, "query_id long, cells int, skipped int, vectors long, vectors_skipped long")


def _unit_queries(rows: list) -> tuple[np.ndarray, np.ndarray]:
    rows = [r for r in rows if r.vector is not None]
    q = np.array([r.vector for r in rows], dtype=np.float64) if rows else np.zeros((0, 1))
    norms = np.linalg.norm(q, axis=1, keepdims=True)
    return np.array([r.query_id for r in rows], dtype=np.int64), q / np.where(norms > 0, norms, 1.0)


def vector_cells(vectors: DataFrame, most: int = CELLS) -> VectorCells:
    """Cells of vectors (chunk_id, vector) of the most usual length, as many as the root of their number, `most` at most.

    Centres come from a bounded sample, the vectors of least hash, after a few rounds of
    k-means; every vector goes to the nearest centre. Which centres they are changes how much a search skips,
    never what it finds. Null, zero and not finite vectors are left out, and those of another length.
    """
    spark = vectors.sparkSession
    sample = vectors.where("vector IS NOT NULL").select("chunk_id", "vector").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(CENTRE_SAMPLE).collect()
    good = [r for r in sample if r.vector and all(v is not None and np.isfinite(v) for v in r.vector) and any(r.vector)]
    length = max(Counter(len(r.vector) for r in good).items(), key=lambda x: (x[1], x[0]), default=(0, 0))[0]
    _, x = _unit_queries([Row(query_id=0, vector=r.vector) for r in good if len(r.vector) == length])
    n = max(1, min(most, int(vectors.count() ** 0.5), len(x)))
    centres = x[:n].copy() if len(x) else np.zeros((1, 1))
    for _ in range(8 if len(x) else 0):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1.0), centres)

    def assign(batches):
        for pdf in batches:
            kept = [v is not None and len(v) == centres.shape[1] for v in pdf["vector"]]
            pdf = pdf[kept]
            if not len(pdf):
                continue
            v = np.array(pdf["vector"].tolist(), dtype=np.float64)
            norm = np.linalg.norm(v, axis=1)
            good = np.isfinite(norm) & (norm > 0)
            v = v[good] / norm[good, None]
            cosines = v @ centres.T
            cell = cosines.argmax(axis=1)
            yield pd.DataFrame({"cell": cell.astype(np.int32), "chunk_id": pdf["chunk_id"].to_numpy()[good], "vector": list(v), "angle": np.arccos(np.clip(cosines.max(axis=1), -1.0, 1.0))})

    schema = f"cell int, chunk_id {dict(vectors.dtypes)['chunk_id']}, vector array<double>, angle double"
    path = shared_path(spark, "vector-cells")
    # a large cell is written by several tasks
    vectors.select("chunk_id", "vector").mapInPandas(assign, schema).repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).write.partitionBy("cell").parquet(path)
    table = spark.read.schema(schema).parquet(path)
    found = {r.cell: r for r in table.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()}  # a row for each cell
    radii = np.array([found[i].radius + 1e-9 if i in found else 0.0 for i in range(len(centres))])
    return VectorCells(table, centres, radii, np.array([found[i].n if i in found else 0 for i in range(len(centres))], dtype=np.int64))


def semantic_topk_cells(cells: VectorCells, wanted: DataFrame, threshold: float = 0.45, k: int | None = TOP) -> DataFrame:
    """What semantic_topk finds, reading only cells that a query can find something in above the threshold.

    In a cell a query meets the vectors alone whose angle to the centre differs from its own by no more than the
    threshold allows. Ties go to the greater chunk id.
    """
    found = in_blocks(wanted.select("query_id", "vector"), lambda block: _cell_scores(cells, block, threshold, k))
    ranked = query("SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id DESC) AS rank FROM {f}", f=found)
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def _cell_scores(cells: VectorCells, wanted: DataFrame, threshold: float, k: int | None) -> DataFrame:
    ids, q = _unit_queries(wanted.collect())
    open_ = cells.bounds(q) > threshold - 1e-9 if len(ids) else np.zeros((0, len(cells.radii)), dtype=bool)
    away = cells.away(q) if open_.any() else np.zeros(open_.shape)
    reach = np.arccos(np.clip(threshold, -1.0, 1.0)) + 1e-9

    def run(batches):
        floor = np.full(len(ids), threshold)
        best = np.full((len(ids), k or 1), -np.inf)
        for pdf in batches:
            for cell, part in pdf.groupby("cell"):
                asked = np.flatnonzero(open_[:, cell])
                v, angle, chunk = np.array(part["vector"].tolist()), part["angle"].to_numpy(), part["chunk_id"].to_numpy()
                near = (np.abs(away[asked, cell][:, None] - angle[None, :]) <= reach).any(axis=0)
                if not near.any():
                    continue
                s = q[asked] @ v[near].T
                a, b = np.nonzero((s > threshold) & (s >= floor[asked][:, None] - 1e-9))
                yield pd.DataFrame({"query_id": ids[asked[a]], "chunk_id": chunk[near][b], "score": s[a, b]})
                if k is not None:
                    top = np.partition(np.concatenate([best[asked], s], axis=1), -k, axis=1)[:, -k:]
                    best[asked] = top
                    floor[asked] = np.maximum(threshold, top.min(axis=1))

    needed = np.flatnonzero(open_.any(axis=0)).tolist()
    chosen = cells.table.where(F.col("cell").isin(needed)) if needed else cells.table.limit(0)
    return chosen.mapInPandas(run, f"query_id long, chunk_id {dict(cells.table.dtypes)['chunk_id']}, score double")


def rrf_fuse(literal: DataFrame, semantic: DataFrame) -> DataFrame:
    """Reciprocal-rank sums of two ranked lists (query_id, chunk_id, rank), ordered by sum and id."""
    return query(
        f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS position FROM (
              SELECT query_id, chunk_id, sum(1D / ({RRF} + rank)) AS score, concat_ws(',', sort_array(collect_list(by))) AS matched_by
              FROM (SELECT query_id, chunk_id, rank, 'literal' AS by FROM {{l}} UNION ALL SELECT query_id, chunk_id, rank, 'semantic' FROM {{s}}) GROUP BY query_id, chunk_id)""",
        l=literal,
        s=semantic,
    )


def dedupe_cap_hits(hits: DataFrame, limit: int | None = 30, duplicate: str = "text", cap: int | None = PAGE_CAP) -> DataFrame:
    """Drop repeats of a page's `duplicate` columns, cap each page, then each query.

    Windows stand for the greedy pass: a dropped repeat never counts towards the cap.
    """
    caps = " AND ".join([*([f"on_page <= {cap}"] if cap else []), "true"])
    ends = f"WHERE position <= {limit}" if limit else ""
    order = "ORDER BY score DESC, chunk_id"
    return query(
        f"""SELECT query_id, page_id, chunk_id, score, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id {order}) AS position FROM (
              SELECT *, row_number() OVER (PARTITION BY query_id, page_id {order}) AS on_page FROM (
                SELECT *, row_number() OVER (PARTITION BY query_id, page_id, {duplicate} {order}) AS seen FROM {{h}}) WHERE seen = 1) WHERE {caps}) {ends}""",
        h=hits,
    )


def rank_levels(hits: DataFrame) -> DataFrame:
    """Full order within a query: level, score, document, page, place, id."""
    return query(
        """SELECT query_id, chunk_id, level, row_number() OVER (PARTITION BY query_id ORDER BY CASE level WHEN 'exact' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END, score DESC, document_id, page_number, match_start, chunk_id) AS position FROM {h}""",
        h=hits,
    )


def diversify_chronicle(hits: DataFrame, chunks: DataFrame, limit: int = 30) -> DataFrame:
    """Hits with one per page first, two thirds of the limit of them, their neighbours, then the rest; three per page at most.

    `hits`: query_id, position, chunk_id, page_id, source_layer, ordinal, score. Each query's
    candidates (a few times the limit) are settled in one small group, which it stays where many chunks share a
    place; those come by id.
    """
    base = max(1, limit * 2 // 3)
    first = query(
        f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY on_page > 1, position) AS turn FROM (
              SELECT *, row_number() OVER (PARTITION BY query_id, page_id ORDER BY position) AS on_page FROM {{h}})""",
        h=hits,
    )
    # of chunks at one place, as many of the least ids as can be passed over and taken: those that stand already, and a page's most
    places = query(
        f"""SELECT DISTINCT page_id, source_layer, ordinal, chunk_id FROM (
              SELECT *, dense_rank() OVER (PARTITION BY page_id, source_layer, ordinal ORDER BY chunk_id) AS n FROM {{c}}) WHERE n <= {limit + PAGE_CAP}""",
        c=chunks.select("page_id", "source_layer", "ordinal", "chunk_id"),
    )
    near = query(
        f"""SELECT f.query_id, f.turn, 1 AS kind, c.ordinal - f.ordinal AS step, c.chunk_id, c.page_id, f.score FROM {{f}} f JOIN {{c}} c
            ON f.page_id = c.page_id AND f.source_layer = c.source_layer AND c.ordinal IN (f.ordinal - 1, f.ordinal + 1) WHERE f.turn <= {base}""",
        f=first,
        c=places,
    )
    pool = first.where(F.col("turn") <= 4 * limit).selectExpr("query_id", "turn", "0 AS kind", "0 AS step", "chunk_id", "page_id", "score").unionByName(near)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf.kind == 0].sort_values("turn")
        picked = [(r.chunk_id, r.page_id, r.score, "hit") for r in own[own.turn <= base].itertuples()]
        seen, pages = {p[0] for p in picked}, pd.Series([p[1] for p in picked]).value_counts().to_dict()
        rest = [(r, "neighbor") for r in pdf[pdf.kind == 1].sort_values(["turn", "step", "chunk_id"]).itertuples()] + [(r, "hit") for r in own[own.turn > base].itertuples()]
        for r, how in rest:
            if len(picked) < limit and r.chunk_id not in seen and pages.get(r.page_id, 0) < PAGE_CAP:
                picked.append((r.chunk_id, r.page_id, r.score, how))
                seen.add(r.chunk_id)
                pages[r.page_id] = pages.get(r.page_id, 0) + 1
        out = pd.DataFrame(picked, columns=["chunk_id", "page_id", "score", "how"])
        out.insert(0, "query_id", pdf.query_id.iloc[0])
        out["position"] = range(1, len(out) + 1)
        return out

    kinds = dict(hits.dtypes)
    return pool.groupBy("query_id").applyInPandas(settle, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, page_id {kinds['page_id']}, score double, how string, position int")


def attachment_matches(attachments: DataFrame, requests: DataFrame) -> DataFrame:
    """literal_matches over attachment texts, with ids made of the place."""
    sources = attachments.selectExpr("attachment_id AS page_id", "'attachment' AS source_layer", "sha2(text, 256) AS source_hash", "text")
    return literal_matches(sources, requests).selectExpr("query_id", "concat_ws(':', 'attachment', page_id, left(source_hash, 16), match_start, match_end, level) AS match_id", "page_id AS attachment_id", "match_start", "match_end", "level")


def attachment_topk(scored: DataFrame, k: int) -> DataFrame:
    """The best k parts (query_id, attachment_id, part, score) of each query, regrouped by attachment."""
    return query(
        f"""SELECT query_id, attachment_id, sort_array(collect_list(part)) AS parts FROM (
              SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, attachment_id, part) AS n FROM {{s}}) WHERE n <= {k} GROUP BY query_id, attachment_id""",
        s=scored,
    )


def interleave_materials(library: DataFrame, attachments: DataFrame) -> DataFrame:
    """L1 A1 L2 A2 … of two ranked lists (query_id, item_id, rank)."""
    return query(
        """SELECT query_id, item_id, side, row_number() OVER (PARTITION BY query_id ORDER BY rank, side DESC) AS position
           FROM (SELECT query_id, item_id, rank, 'library' AS side FROM {l} UNION ALL SELECT query_id, item_id, rank, 'attachment' FROM {a})""",
        l=library,
        a=attachments,
    )


def retrieval_summary(requests: DataFrame, fused: DataFrame, known: DataFrame) -> DataFrame:
    """Per query: whether vectors, literals or nothing matched, how many of each, and warnings.

    `known`: query_id, candidates (texts that were searched), indexed_pages, total_pages, stale_hits.
    Warned of are a search that found nothing in what there was, an index that does not cover all pages
    yet, and hits dropped because their text changed.
    """
    return query(
        """SELECT f.query_id, f.mode, f.hits, f.both_ways,
                  array_compact(array(if(f.hits = 0 AND k.candidates > 0, 'no relevant material', NULL), if(k.indexed_pages < k.total_pages, concat('index covers ', k.indexed_pages, ' of ', k.total_pages, ' pages'), NULL), if(k.stale_hits > 0, 'material changed meanwhile', NULL))) AS warnings
           FROM (SELECT r.query_id, CASE WHEN count_if(contains(f.matched_by, 'semantic')) > 0 THEN 'hybrid' WHEN count(f.chunk_id) > 0 THEN 'literal' ELSE 'empty' END AS mode,
                        count(f.chunk_id) AS hits, count_if(f.matched_by = 'literal,semantic') AS both_ways
                 FROM {r} r LEFT JOIN {f} f ON r.query_id = f.query_id GROUP BY r.query_id) f LEFT JOIN {k} k ON f.query_id = k.query_id""",
        r=requests,
        f=fused,
        k=known,
    )
