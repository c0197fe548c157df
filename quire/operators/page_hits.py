"""What requests find on a page, worked out where the page is read: no row leaves it but its hits."""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import kernels
from ..functions.literal import Joined, RequestMatcher, mark_for, worker_cache
from . import index, retrieve

LEVELS = ("exact", "partial", "semantic", "attachment")
BODY = ("ocrText", "punctuatedText")
_LISTS = ("levels", "starts", "ends", "sentence_starts", "sentence_ends")
#: A row for each request and source with its literal hits in lists, and one for each chunk that is like a request.
HITS = "query_id long, document_id string, page_id string, page_number int, source_layer string, source_hash string, fresh boolean, size int, query_size int, cosine double, apart boolean, levels array<int>, starts array<int>, ends array<int>, sentence_starts array<int>, sentence_ends array<int>"
#: Matchers of listed documents that a worker holds at a time.
LISTED = 1000


def unit_rows(vectors: list, dimensions: int) -> np.ndarray:
    """Unit vectors in double precision, through single precision as they are stored; zero for one that is missing, of another length, not finite or zero."""
    ok = [v is not None and len(v) == dimensions for v in vectors]
    x = np.array([v if good else [0.0] * dimensions for v, good in zip(vectors, ok)], dtype=np.float32).astype(np.float64).reshape(len(vectors), dimensions)
    norm = np.linalg.norm(x, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return np.where(good[:, None], x, 0.0) / np.where(good, norm, 1.0)[:, None]


def page_chunks(texts: list[str | None], embedder) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Of texts: the text, start and end of each chunk, and their vectors; a text that occurs again among them is embedded once."""
    found = [(i, a, b) for i, t in enumerate(texts) if t for a, b in kernels.chunks(t)]
    said = [texts[i][a:b] for i, a, b in found]
    distinct = list(dict.fromkeys(said))
    known = dict(zip(distinct, embedder(distinct) if distinct else []))
    of, start, end = np.array(found, dtype=np.int64).reshape(len(found), 3).T
    return of, start, end, [known[t] for t in said]


class Asking:
    """A block of requests by who may see a page: its documents' readers, then those that name its document."""

    def __init__(self, rows: list):
        self.ids = np.array([r.query_id for r in rows], dtype=np.int64)
        self.queries = [r["query"] or "" for r in rows]
        self.sizes = np.array([max(1, len(q)) for q in self.queries], dtype=np.int64)
        self.mark, self.name = mark_for(self.queries), uuid.uuid4().hex
        self._users = [r.user_id for r in rows]
        self._open = [i for i, r in enumerate(rows) if r.document_ids is None]
        self._by_user, self._listed = defaultdict(list), defaultdict(list)
        for i in self._open:
            self._by_user[self._users[i]].append(i)
        for i, r in enumerate(rows):
            for d in dict.fromkeys(r.document_ids or ()):
                self._listed[d].append(i)

    def readers(self, owner, public: bool, document: str) -> list[tuple]:
        """Keys of the groups of requests that see a page; no request is in two of them."""
        return [("all",) if public else ("user", owner), *([("document", document, None if public else owner)] if document in self._listed else [])]

    def requests(self, key: tuple) -> np.ndarray:
        if key[0] == "document":
            found = [i for i in self._listed[key[1]] if key[2] is None or self._users[i] == key[2]]
        else:
            found = self._open if key[0] == "all" else self._by_user.get(key[1], [])
        return np.array(found, dtype=np.int64)

    def matcher(self, key: tuple) -> tuple[np.ndarray, RequestMatcher]:
        held = worker_cache(self.name, dict)
        if key not in held:
            for old in [k for k in held if k[0] == "document"][LISTED:]:
                del held[old]
            own = self.requests(key)
            held[key] = own, RequestMatcher(self.queries[i] for i in own.tolist())
        return held[key]


def page_hits(pages: DataFrame, requests: DataFrame, embedder, model: str, dimensions: int, threshold: float) -> DataFrame:
    """HITS of a block of requests on pages that their users may see.

    `pages`: page_id, document_id, page_number, owner_id, is_public, primary_layer, and of its sources the lists layers,
    hashes, texts and fresh. Literal hits come from one body layer, the primary one if it has any, and from the others
    that are no body; one to a sentence, exact before partial. Chunks of the primary layer that are as like as
    `threshold` follow, `apart` where no literal place of the request overlaps them.
    """
    spark = pages.sparkSession
    asking = Asking(requests.select("query_id", "user_id", "query", "document_ids").orderBy("query_id").collect())  # a block of requests
    none = spark.createDataFrame([], "text_hash string, model_fingerprint string, vector array<float>")
    vectors = index.embed_chunks(requests.selectExpr("cast(query_id AS string) AS chunk_id", "query AS chunk_text"), none, embedder, model, dimensions)
    known = {int(r.chunk_id): r.vector for r in vectors.select("chunk_id", "vector").collect()}
    wanted = unit_rows([known.get(i) for i in asking.ids.tolist()], dimensions)

    def run(batches):
        for batch in batches:
            column = {n: c for n, c in zip(batch.schema.names, batch.columns)}
            own = {n: column[n].to_pylist() for n in ("document_id", "owner_id", "is_public", "primary_layer")}
            many = np.array([len(x) for x in column["layers"]], dtype=np.int64)
            page = np.repeat(np.arange(batch.num_rows), many)
            layers, texts = column["layers"].flatten().to_pylist(), column["texts"].flatten().to_pylist()
            first = np.append(0, np.cumsum(many))
            sizes = np.zeros(batch.num_rows, dtype=np.int64)
            np.add.at(sizes, page, [len(t) for t in texts])
            primary = np.array([own["primary_layer"][p] == x for p, x in zip(page.tolist(), layers)], dtype=bool)
            facts = {"page": page, "primary": primary, "body": np.array([x in BODY for x in layers], dtype=bool), "rank": 2 * primary + np.array([x == "punctuatedText" for x in layers], dtype=np.int64)}
            for i, j in retrieve.joined_slices(sizes.tolist(), retrieve.JOINED):
                groups = defaultdict(list)
                for p in range(i, j):
                    for key in asking.readers(own["owner_id"][p], own["is_public"][p], own["document_id"][p]):
                        groups[key] += range(first[p], first[p + 1])
                at = np.arange(first[i], first[j])[primary[first[i] : first[j]]]
                of, start, end, vector = page_chunks([texts[k] for k in at.tolist()], embedder)
                chunks = at[of], start, end, unit_rows(vector, dimensions)
                for key, sources in groups.items():
                    who, matcher = asking.matcher(key)
                    if len(who):
                        yield from rows(column, facts, texts, np.array(sources, dtype=np.int64), who, matcher, chunks)

    def rows(column, facts, texts, sources, who, matcher, chunks):
        joined = Joined([texts[k] for k in sources.tolist()], asking.mark)
        of, a, b, partial = matcher.places(joined)
        n = joined.number(a)
        # chunks that are alike, and whether a place overlaps them: a request's places are in order by their ends too
        inside = np.flatnonzero(np.isin(chunks[0], sources))
        cosines = wanted[who] @ chunks[3][inside].T
        r, c = np.nonzero(cosines > threshold)
        text = np.searchsorted(sources, chunks[0][inside[c]])
        x, y, wide = joined.begin[text] + chunks[1][inside[c]], joined.begin[text] + chunks[2][inside[c]], len(joined.text) + 1
        apart = np.searchsorted(np.sort(of * wide + a), r * wide + y, "left") <= np.searchsorted(np.sort(of * wide + b), r * wide + x, "right")
        # one body layer of a page for each request
        source = sources[n]
        body = facts["body"][source]
        pair, rank = facts["page"][source] * len(who) + of, facts["rank"][source]
        pairs, where = np.unique(pair[body], return_inverse=True)
        best = np.full(len(pairs), -1)
        np.maximum.at(best, where, rank[body])
        shown = ~body
        shown[body] = rank[body] == best[where]
        of, a, b, partial, n = of[shown], a[shown], b[shown], partial[shown], n[shown]
        # one hit of a sentence
        s, e = kernels.excerpts(joined, a, b)
        order = np.lexsort((b, a, partial, e, s, of, n))
        key = np.stack([n[order], of[order], s[order], e[order]])
        kept = order[np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))] if len(order) else order
        kept = kept[np.lexsort((b[kept], a[kept], of[kept], n[kept]))]
        of, a, b, partial, n, s, e = (v[kept] for v in (of, a, b, partial, n, s, e))
        cuts = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (n[1:] != n[:-1]))) if len(of) else np.zeros(0, dtype=np.int64)
        base = joined.begin[n]
        if len(cuts):
            yield sent(column, facts, sources, joined, who[of[cuts]], n[cuts], np.append(cuts, len(of)), None, np.ones(len(cuts), dtype=bool), (partial.astype(np.int64), a - base, b - base, s - base, e - base))
        if len(r):
            s, e = kernels.excerpts(joined, x, y)
            base = joined.begin[text]
            yield sent(column, facts, sources, joined, who[r], text, np.arange(len(r) + 1), cosines[r, c], apart, (np.full(len(r), LEVELS.index("semantic")), x - base, y - base, s - base, e - base))

    def sent(column, facts, sources, joined, request, text, cuts, cosine, apart, lists):
        source = sources[text]
        page, place = pa.array(facts["page"][source]), pa.array(source)
        offsets = pa.array(cuts.astype(np.int32))
        out = [pa.array(asking.ids[request]), *(column[c].take(page) for c in ("document_id", "page_id", "page_number"))]
        out += [column[c].flatten().take(place) for c in ("layers", "hashes", "fresh")]
        out += [pa.array((joined.end - joined.begin)[text].astype(np.int32)), pa.array(asking.sizes[request].astype(np.int32)), pa.nulls(len(text), pa.float64()) if cosine is None else pa.array(cosine), pa.array(apart)]
        out += [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in lists]
        return pa.record_batch(out, names=[c.split()[0] for c in HITS.split(", ")])

    return pages.select("page_id", "document_id", "page_number", "owner_id", "is_public", "primary_layer", "layers", "hashes", "texts", "fresh").mapInArrow(run, HITS)
