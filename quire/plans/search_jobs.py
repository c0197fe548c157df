"""Queries: scope and filters, literal and vector retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sql import normalized
from ..functions.staging import staged
from ..operators import index, retrieve, scope, search, text
from ..sources import corpus as C
from .registry import job
from .text_jobs import hashed_embedder

#: Ranked hits with the shape that the ranking jobs take, from order lines.
HITS = """SELECT l_suppkey % 50 AS query_id, concat('p', l_partkey % 200) AS page_id, concat(l_orderkey, '-', l_linenumber) AS chunk_id, CAST(l_extendedprice AS DOUBLE) AS score,
  CASE l_returnflag WHEN 'A' THEN 'exact' WHEN 'N' THEN 'partial' ELSE 'semantic' END AS level, CAST(l_partkey % 20 AS INT) AS document_id, CAST(l_partkey % 200 AS INT) AS page_number,
  CAST(l_quantity AS INT) * 10 AS match_start, CAST(l_quantity AS INT) AS text, 'ocrText' AS source_layer, l_linenumber AS ordinal FROM {l}"""
DUCK_HITS = HITS.replace("{l}", "lineitem").replace("concat('p', l_partkey % 200)", "'p' || (l_partkey % 200)").replace("concat(l_orderkey, '-', l_linenumber)", "l_orderkey || '-' || l_linenumber")


def hits(spark, sf):
    return spark.sql(HITS, l=C.table(spark, sf, "lineitem"))


def _corpus(spark, sf):
    return C.corpus_documents(spark, sf), C.corpus_pages(spark, sf), C.corpus_users(spark, sf)


def _scoped_requests(spark, sf):
    return C.requests(spark, sf).selectExpr("query_id", "user_id", "query", "CASE WHEN query_id % 4 = 1 THEN array(concat('doc-', query_id), 'doc-3') WHEN query_id % 4 = 2 THEN cast(array() AS array<string>) END AS document_ids")


DUCK_VISIBLE = """vis AS (SELECT r.query_id, p.page_id, p.document_id FROM (SELECT *, CASE WHEN query_id%4=1 THEN ['doc-'||query_id,'doc-3'] WHEN query_id%4=2 THEN CAST([] AS VARCHAR[]) END AS ids FROM rq) r,
  cp p JOIN cd d USING (document_id) JOIN cu u ON u.user_id = d.owner_id WHERE NOT d.is_deleted AND NOT u.is_deleted AND (d.visibility='public' OR d.owner_id = r.user_id) AND (r.ids IS NULL OR list_contains(r.ids, p.document_id)))"""


@job(f"WITH {DUCK_VISIBLE} SELECT * FROM vis", "rq cp cd cu")
def visible_scope(spark, sf):
    d, p, u = _corpus(spark, sf)
    return scope.visible_scope(_scoped_requests(spark, sf), p, d, u)


@job(f"WITH {DUCK_VISIBLE} SELECT rq.query_id, count(vis.page_id) AS pages FROM rq LEFT JOIN vis USING (query_id) GROUP BY 1", "rq cp cd cu")
def visible_page_counts(spark, sf):
    d, p, u = _corpus(spark, sf)
    numbered, bits = scope.scope_bitmaps(p, d, u)
    return scope.visible_page_counts(_scoped_requests(spark, sf), numbered, bits)


@job(f"WITH {DUCK_VISIBLE} SELECT page_number%40 AS query_id, page_id FROM cp SEMI JOIN vis ON vis.query_id = page_number%40 AND vis.page_id = cp.page_id", "rq cp cd cu")
def probe_scopes(spark, sf):
    d, p, u = _corpus(spark, sf)
    return scope.probe_scopes(p.selectExpr("page_number % 40 AS query_id", "page_id"), _scoped_requests(spark, sf), *scope.scope_bitmaps(p, d, u))


def _anchors(spark, sf):
    sources = text.explode_sources(C.corpus_pages(spark, sf))
    stale = sources.selectExpr("page_number % 5 AS query_id", "page_id", "source_layer", "if(page_number % 4 = 1, 'gone', source_hash) AS source_hash", "3 AS start", "if(page_number % 7 = 2, 100000, 20) AS end", "5 AS match_start", "9 AS match_end", "substring(text, 4, 17) AS text", "'exact' AS level")
    return stale.union(stale), sources


@job("SELECT DISTINCT page_number % 5 AS query_id, page_id, source_layer, 'exact' AS level, 3 AS start, 20 AS end, 3 AS start_utf16, 20 AS end_utf16 FROM src WHERE page_number % 4 <> 1 AND page_number % 7 <> 2 AND length(text) >= 20", "src")
def verify_anchors(spark, sf):
    return scope.verify_anchors(*_anchors(spark, sf))


@job("WITH p AS (SELECT page_id, row_number() OVER (PARTITION BY document_id ORDER BY page_number, page_id) AS position FROM cp), m AS (SELECT page_id, CASE WHEN page_number%2=0 THEN 'exact' ELSE 'semantic' END AS level FROM cp) SELECT m.*, CAST(position AS INTEGER) AS position FROM m JOIN p USING (page_id) WHERE level='exact' AND position BETWEEN 2 AND 6", "cp")
def reader_filter(spark, sf):
    p = C.corpus_pages(spark, sf)
    return scope.reader_filter(p.selectExpr("page_id", "if(page_number % 2 = 0, 'exact', 'semantic') AS level"), p, ["exact", "partial"], 2, 6)


def _locators(sources):
    return sources.selectExpr("page_number % 40 AS query_id", "page_id", "if(page_number % 9 = 4, 'other', source_layer) AS source_layer", "if(page_number % 3 = 1, source_hash, 'earlier') AS source_hash")


@job(f"""WITH {DUCK_VISIBLE}, l AS (SELECT page_number%40 AS query_id, page_id, CASE WHEN page_number%9=4 THEN 'other' ELSE source_layer END AS source_layer, CASE WHEN page_number%3=1 THEN sha256(text) ELSE 'earlier' END AS source_hash, sha256(text) AS cur FROM src)
SELECT query_id, page_id, source_layer, source_hash, cur AS current_hash, cur <> source_hash AS historical FROM l SEMI JOIN vis USING (query_id, page_id) WHERE source_layer <> 'other'""", "rq cp cd cu src")
def validate_evidence(spark, sf):
    d, p, u = _corpus(spark, sf)
    sources = text.explode_sources(p)
    seen = scope.visible_rows(_locators(sources), _scoped_requests(spark, sf), p, d, u)
    return scope.validate_evidence(seen, sources.select("page_id", "source_layer", "source_hash"))


@job("""WITH h AS (SELECT page_number%40 AS query_id, page_id, CASE WHEN page_number%9=4 THEN 'other' ELSE source_layer END AS source_layer, CASE WHEN page_number%3=1 THEN sha256(text) ELSE 'earlier' END AS source_hash FROM src), k AS (SELECT DISTINCT page_id, source_layer, sha256(text) AS source_hash, true AS t FROM src)
SELECT h.*, t IS NOT NULL AS fresh, CAST(count(*) FILTER (t IS NULL) OVER (PARTITION BY query_id) AS BIGINT) AS stale_hits FROM h LEFT JOIN k USING (page_id, source_layer, source_hash)""", "src")
def drop_stale_hits(spark, sf):
    sources = text.explode_sources(C.corpus_pages(spark, sf))
    return scope.drop_stale_hits(_locators(sources), sources)


@job(f"WITH h AS ({DUCK_HITS}), s AS (SELECT query_id, page_id, source_layer, chunk_id, match_start AS start, match_start + 60 AS end FROM h WHERE level = 'semantic'), l AS (SELECT query_id, page_id, source_layer, match_start, match_start + 25 AS match_end FROM h WHERE level = 'exact') SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.query_id = s.query_id AND l.page_id = s.page_id AND l.source_layer = s.source_layer AND l.match_start < s.end AND l.match_end > s.start)")
def suppress_overlaps(spark, sf):
    h = hits(spark, sf)
    semantic = h.where("level = 'semantic'").selectExpr("query_id", "page_id", "source_layer", "chunk_id", "match_start AS start", "match_start + 60 AS end")
    return scope.suppress_overlaps(semantic, h.where("level = 'exact'").selectExpr("query_id", "page_id", "source_layer", "match_start", "match_start + 25 AS match_end"))


@job("""WITH c AS (SELECT conv_id, conv_id%7+1 AS owner_id, 'doc-'||(conv_id*7 + turn) AS document_id FROM conversations), p AS (SELECT document_id, count(*) AS pages, count(*) FILTER (trim(coalesce(punctuated_text,''), E' \\n\\t\\r') <> '') AS done FROM cp GROUP BY 1)
SELECT conv_id, count(*) FILTER (d.document_id IS NULL) AS missing, count(*) FILTER (d.document_id IS NOT NULL AND coalesce(done,0)=0) AS unprocessed, count(*) FILTER (done > 0 AND done < pages) AS partial
FROM c LEFT JOIN (SELECT * FROM cd WHERE NOT is_deleted) d ON c.document_id = d.document_id AND c.owner_id = d.owner_id LEFT JOIN p ON p.document_id = d.document_id GROUP BY conv_id""", "cd cp")
def reference_scope_report(spark, sf):
    chosen = C.table(spark, sf, "conversations").selectExpr("conv_id", "conv_id % 7 + 1 AS owner_id", "concat('doc-', conv_id * 7 + turn) AS document_id")
    return scope.reference_scope_report(chosen, C.corpus_documents(spark, sf), C.corpus_pages(spark, sf))


@job(r"""WITH t AS (SELECT page_id, document_id, page_number, CASE WHEN punctuated_text <> '' THEN punctuated_text WHEN page_number%8=0 THEN ' draft '||ocr_text WHEN page_number%3=0 AND ocr_text <> '' THEN ocr_text END AS text FROM cp),
b AS (SELECT page_id, regexp_replace(last_value(text IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '^\s+|\s+$', '', 'g') AS before FROM t)
SELECT page_id, CASE WHEN length(before) > 300 THEN '…… '||regexp_replace(right(before,300), '^\s+', '') ELSE coalesce(before, '') END AS tail FROM b""", "cp")
def previous_page_tail(spark, sf):
    p = C.corpus_pages(spark, sf)
    return scope.previous_page_tail(p.selectExpr("page_id", "document_id", "page_number", "punctuated_text", "if(page_number % 8 = 0, concat(' draft ', ocr_text), '') AS draft_text", "if(page_number % 3 = 0, ocr_text, NULL) AS normalized_text"))


@job("SELECT document_id, CASE WHEN sort_order%5=0 THEN 'found '||title ELSE title END AS title, author, CASE WHEN sort_order%7=0 THEN '1900' ELSE year END AS year, publisher FROM cd", "cd")
def merge_metadata(spark, sf):
    d = C.corpus_documents(spark, sf)
    return scope.merge_metadata(d.selectExpr("document_id", "if(sort_order % 5 = 0, ' ', title) AS title", "author", "if(sort_order % 7 = 0, NULL, year) AS year", "publisher"), d.selectExpr("document_id", "concat('found ', title) AS title", "author", "'1900' AS year", "publisher"))


@job("""SELECT page_id, CASE WHEN page_number%5=4 THEN 'stored' WHEN page_number%3<>2 THEN 'client' WHEN page_number%4=1 THEN 'stored' WHEN page_number%2=0 THEN 'stored' ELSE 'client' END AS title,
  CASE WHEN page_number%5<>4 AND page_number%6<>3 AND page_number%3<>0 AND (page_number%4<>2 OR page_number%7=1) THEN 'edited' ELSE ocr_text END AS text, CASE WHEN page_number%5=4 OR page_number%9=5 THEN notes ELSE 'mine' END AS notes FROM cp""", "cp")
def three_way_merge(spark, sf):
    """Revisions differ on every third page, a baseline is missing on every fourth, on the others every second title is unchanged."""
    p = C.corpus_pages(spark, sf)
    stored = p.selectExpr("page_id", "3 AS revision", "7 AS page_revision", "'stored' AS title", "ocr_text AS text", "notes", "page_number % 4 = 2 AS active", "page_number % 7 = 1 AS proofread")
    base = p.where("page_number % 4 <> 1").selectExpr("page_id", "if(page_number % 2 = 0, 'client', 'base') AS title")
    incoming = p.where("page_number % 5 <> 4").selectExpr("page_id", "if(page_number % 3 = 2, 2, 3) AS revision", "if(page_number % 3 = 0, 6, 7) AS page_revision", "'client' AS title", "if(page_number % 6 = 3, NULL, 'edited') AS text", "if(page_number % 9 = 5, NULL, 'mine') AS notes")
    return scope.three_way_merge(stored, base, incoming)


DUCK_TERMS = r"""qn AS (SELECT query_id, replace(lower(regexp_replace(query, '\s', '', 'g')), 'ß', 'ss') AS q FROM rq),
qt AS (SELECT query_id, q, CASE WHEN length(q)=1 THEN [q] ELSE list_distinct(list_transform(range(1, length(q)), lambda i: substr(q, i, 2))) END AS grams, list_distinct(regexp_extract_all(q, '[a-z0-9]+')) AS terms FROM qn WHERE q <> ''),
pn AS (SELECT page_id, document_id, replace(lower(regexp_replace(text, '\s', '', 'g')), 'ß', 'ss') AS t FROM prim),
raw AS (SELECT query_id, page_id, document_id, t, grams, terms, contains(t, q) AS whole, len(list_filter(grams, lambda g: contains(t, g))) AS pairs FROM pn, qt),
ls AS (SELECT query_id, page_id, document_id, (CASE WHEN whole THEN 5.0::DOUBLE ELSE 0 END) + pairs / len(grams) + len(list_filter(terms, lambda x: contains(t, x))) / greatest(1, len(terms)) * 0.2::DOUBLE AS literal_score FROM raw WHERE whole OR pairs >= CASE WHEN len(grams) >= 6 THEN 2 ELSE 1 END)"""


def _scores(spark, sf):
    return retrieve.literal_score(text.select_primary_text(C.corpus_pages(spark, sf)), C.requests(spark, sf), "page_id")


@job(f"WITH {DUCK_TERMS} SELECT query_id, page_id, round(literal_score, 6) AS literal_score FROM ls", "rq prim")
def literal_score(spark, sf):
    return _scores(spark, sf).withColumn("literal_score", F.round("literal_score", 6))


DUCK_BOOST = DUCK_TERMS + r""", dn AS (SELECT document_id, replace(lower(regexp_replace(concat_ws(chr(10), title, author, year, publisher), '\s', '', 'g')), 'ß', 'ss') AS t FROM cd),
dr AS (SELECT query_id, document_id, t, grams, terms, contains(t, q) AS whole, len(list_filter(grams, lambda g: contains(t, g))) AS pairs FROM dn, qt),
ds AS (SELECT query_id, document_id, (CASE WHEN whole THEN 5.0::DOUBLE ELSE 0 END) + pairs / len(grams) + len(list_filter(terms, lambda x: contains(t, x))) / greatest(1, len(terms)) * 0.2::DOUBLE AS s FROM dr WHERE whole OR pairs >= CASE WHEN len(grams) >= 6 THEN 2 ELSE 1 END),
db AS (SELECT query_id, page_id, s FROM ds JOIN cp USING (document_id)),
mb AS (SELECT query_id, page_id, round(coalesce(ls.literal_score, 0) + 0.3::DOUBLE * coalesce(s, 0), 6) AS literal_score FROM ls FULL JOIN db USING (query_id, page_id))"""


def _boosted(spark, sf):
    found = retrieve.metadata_boost(_scores(spark, sf), C.corpus_pages(spark, sf), C.corpus_documents(spark, sf), C.requests(spark, sf))
    return found.withColumn("literal_score", F.round("literal_score", 6))


@job(f"WITH {DUCK_BOOST} SELECT * FROM mb", "rq prim cd cp")
def metadata_boost(spark, sf):
    return _boosted(spark, sf)


@job(f"WITH {DUCK_BOOST}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY literal_score DESC, page_id) AS rank FROM mb WHERE literal_score > 0) SELECT query_id, page_id, literal_score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 60", "rq prim cd cp")
def literal_topk(spark, sf):
    return retrieve.literal_best(_described(spark, sf), C.requests(spark, sf), "page_id")


def _described(spark, sf):
    """Every page with its best text, or none, and the description of its document."""
    return spark.sql(
        """SELECT p.page_id, t.text, concat_ws('\\n', d.title, d.author, d.year, d.publisher) AS described
           FROM {p} p LEFT JOIN {t} t ON p.page_id = t.page_id LEFT JOIN {d} d ON p.document_id = d.document_id""",
        p=C.corpus_pages(spark, sf),
        t=text.select_primary_text(C.corpus_pages(spark, sf)),
        d=C.corpus_documents(spark, sf),
    )


@job()
def literal_matches(spark, sf):
    return retrieve.literal_matches(text.explode_sources(C.corpus_pages(spark, sf)), C.requests(spark, sf))


@job("SELECT query_id, page_id, CAST(instr(text, query) - 1 AS INTEGER) AS first_start, CAST((length(text) - length(replace(text, query, ''))) / length(query) AS BIGINT) AS n FROM prim, rq WHERE contains(text, query)", "prim rq")
def literal_exact_matches(spark, sf):
    return _exact_matches(spark, sf, C.requests(spark, sf))


def _exact_matches(spark, sf, wanted):
    sources = text.select_primary_text(C.corpus_pages(spark, sf)).withColumn("source_hash", F.lit(""))
    found = retrieve.literal_matches(sources, wanted).where("level = 'exact'")
    return found.groupBy("query_id", "page_id").agg(F.min("match_start").alias("first_start"), F.count("*").alias("n"))


@job()
def match_text(spark, sf):
    return retrieve.match_text(text.explode_sources(C.corpus_pages(spark, sf)), C.requests(spark, sf))


@job("""WITH h AS (SELECT query_id, page_id, source_layer, source_layer = CASE WHEN page_number%4=0 THEN 'ocrText' ELSE 'punctuatedText' END AS is_primary FROM src, rq WHERE contains(text, query)),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, page_id, source_layer <> 'notes' ORDER BY is_primary DESC, source_layer DESC) AS n FROM h) SELECT query_id, page_id, source_layer FROM n WHERE source_layer = 'notes' OR n = 1""", "src rq")
def pick_match_layer(spark, sf):
    sources = text.explode_sources(C.corpus_pages(spark, sf))
    found = retrieve.exact_layers(sources, C.requests(spark, sf))
    primary = C.corpus_pages(spark, sf).selectExpr("page_id", "if(page_number % 4 = 0, 'ocrText', 'punctuatedText') AS layer")
    return retrieve.pick_match_layer(found.join(primary, "page_id").selectExpr("query_id", "page_id", "source_layer", "source_layer = layer AS is_primary"))


@job(f"WITH h AS ({DUCK_HITS}), n AS (SELECT query_id, page_id AS source_id, text AS sentence, level, chunk_id AS ordinal, row_number() OVER (PARTITION BY query_id, page_id, text ORDER BY level <> 'exact', chunk_id) AS n FROM h) SELECT * EXCLUDE (n) FROM n WHERE n = 1")
def dedupe_sentence_hits(spark, sf):
    return retrieve.dedupe_sentence_hits(hits(spark, sf).selectExpr("query_id", "page_id AS source_id", "text AS sentence", "level", "chunk_id AS ordinal"))


def _semantic(spark, sf):
    """Every vector whose id 100 divides asks among all."""
    v = C.table(spark, sf, "embeddings")
    return retrieve.semantic_topk(v.selectExpr("vec_id AS chunk_id", "embedding AS vector"), v.where("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "embedding AS vector"))


DUCK_SEMANTIC = "sem0 AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0), sem AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id DESC) AS rank FROM sem0 WHERE score > 0.45)"


@job(f"WITH {DUCK_SEMANTIC} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM sem WHERE rank <= 60")
def semantic_topk(spark, sf):
    return _semantic(spark, sf).withColumn("score", F.round("score", 6))


#: Vectors that lie in groups: their label's own direction added.
GROUPED = "transform(embedding, (x, i) -> cast(x AS double) + if(i = label % 16, 30D, 0D))"


@job("""WITH g AS (SELECT vec_id, list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) + CASE WHEN i - 1 = label % 16 THEN 30 ELSE 0 END) AS v FROM embeddings WHERE label IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_cosine_similarity(q.v, v.v) AS score FROM g v, g q WHERE q.vec_id % 100 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id DESC) AS rank FROM s WHERE score > 0.45)
SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 60""")
def semantic_topk_cells(spark, sf):
    v = C.table(spark, sf, "embeddings").where("label IS NOT NULL").selectExpr("vec_id AS chunk_id", f"{GROUPED} AS vector")
    wanted = v.where("chunk_id % 100 = 0").selectExpr("chunk_id AS query_id", "vector")
    return retrieve.semantic_topk_cells(retrieve.vector_cells(v), wanted).withColumn("score", F.round("score", 6))


#: The literal list of a vector: the ids from its own on, up to the next whole hundred.
DUCK_LITERAL = "lit AS (SELECT vec_id - vec_id%100 AS query_id, vec_id AS chunk_id, row_number() OVER (PARTITION BY vec_id - vec_id%100 ORDER BY vec_id) AS rank FROM embeddings)"


@job(f"""WITH {DUCK_SEMANTIC}, {DUCK_LITERAL},
u AS (SELECT query_id, chunk_id, rank, 'literal' AS side FROM lit WHERE rank <= 60 UNION ALL SELECT query_id, chunk_id, rank, 'semantic' FROM sem WHERE rank <= 60), f AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE/(60+rank)) AS score, string_agg(side, ',' ORDER BY side) AS matched_by FROM u GROUP BY 1, 2)
SELECT query_id, chunk_id, round(score, 6) AS score, matched_by, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS position FROM f""")
def rrf_fuse(spark, sf):
    return _fused(spark, sf).withColumn("score", F.round("score", 6))


def _fused(spark, sf):
    literal = spark.sql("SELECT vec_id - vec_id % 100 AS query_id, vec_id AS chunk_id, row_number() OVER (PARTITION BY vec_id - vec_id % 100 ORDER BY vec_id) AS rank FROM {v}", v=C.table(spark, sf, "embeddings")).where("rank <= 60")
    return retrieve.rrf_fuse(literal, _semantic(spark, sf))


@job(f"WITH h AS ({DUCK_HITS}), a AS (SELECT *, row_number() OVER (PARTITION BY query_id, page_id, text ORDER BY score DESC, chunk_id) AS seen FROM h), b AS (SELECT *, row_number() OVER (PARTITION BY query_id, page_id ORDER BY score DESC, chunk_id) AS on_page FROM a WHERE seen = 1), c AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS position FROM b WHERE on_page <= 3) SELECT query_id, page_id, chunk_id, score, position FROM c WHERE position <= 30")
def dedupe_cap_hits(spark, sf):
    return retrieve.dedupe_cap_hits(hits(spark, sf))


@job(f"""WITH h AS (SELECT *, CASE WHEN level = 'partial' THEN 'visual_caption:v:' || (ordinal % 3) ELSE '' END AS caption FROM ({DUCK_HITS})), a AS (SELECT *, row_number() OVER (PARTITION BY query_id, page_id, match_start, match_start + text, caption ORDER BY score DESC, chunk_id) AS seen FROM h)
SELECT query_id, page_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS position FROM a WHERE seen = 1""")
def dedupe_full_hits(spark, sf):
    """Without bounds: only repeats of a place go, captions apart from each other."""
    h = hits(spark, sf).withColumn("caption", F.expr("if(level = 'partial', concat('visual_caption:v:', ordinal % 3), '')")).withColumn("match_end", F.expr("match_start + text"))
    return retrieve.dedupe_cap_hits(h, limit=None, duplicate="match_start, match_end, caption", cap=None)


@job(f"WITH h AS ({DUCK_HITS}) SELECT query_id, chunk_id, level, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE level WHEN 'exact' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END, score DESC, document_id, page_number, match_start, chunk_id) AS INTEGER) AS position FROM h")
def rank_levels(spark, sf):
    return retrieve.rank_levels(hits(spark, sf))


@job()
def diversify_chronicle(spark, sf):
    h = spark.sql("SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS position FROM {h}", h=hits(spark, sf))
    return retrieve.diversify_chronicle(h, hits(spark, sf).select("chunk_id", "page_id", "source_layer", "ordinal"))


@job()
def attachment_matches(spark, sf):
    return retrieve.attachment_matches(C.table(spark, sf, "conversations").selectExpr("concat(conv_id, '-', turn) AS attachment_id", "text"), C.requests(spark, sf))


@job("WITH s AS (SELECT o_custkey%100 AS query_id, o_orderkey%50 AS attachment_id, o_orderkey AS part, CAST(o_totalprice AS DOUBLE) AS score FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, attachment_id, part) AS n FROM s) SELECT query_id, attachment_id, string_agg(CAST(part AS VARCHAR), ',' ORDER BY part) AS parts FROM n WHERE n <= 12 GROUP BY ALL")
def attachment_topk(spark, sf):
    scored = C.table(spark, sf, "orders").selectExpr("o_custkey % 100 AS query_id", "o_orderkey % 50 AS attachment_id", "o_orderkey AS part", "cast(o_totalprice AS double) AS score")
    return retrieve.attachment_topk(scored, 12).selectExpr("query_id", "attachment_id", "array_join(transform(parts, p -> cast(p AS string)), ',') AS parts")


@job("WITH r AS (SELECT o_custkey%100 AS query_id, o_orderkey AS item_id, row_number() OVER (PARTITION BY o_custkey%100, o_orderkey%2 ORDER BY o_orderkey) AS rank, CASE WHEN o_orderkey%2=0 THEN 'library' ELSE 'attachment' END AS side FROM orders) SELECT query_id, item_id, side, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, side DESC) AS INTEGER) AS position FROM r")
def interleave_materials(spark, sf):
    r = spark.sql("SELECT o_custkey % 100 AS query_id, o_orderkey AS item_id, row_number() OVER (PARTITION BY o_custkey % 100, o_orderkey % 2 ORDER BY o_orderkey) AS rank, o_orderkey % 2 AS odd FROM {o}", o=C.table(spark, sf, "orders"))
    return retrieve.interleave_materials(r.where("odd = 0"), r.where("odd = 1"))


@job(f"""WITH {DUCK_SEMANTIC}, {DUCK_LITERAL},
u AS (SELECT query_id, chunk_id, 'literal' AS side FROM lit WHERE rank <= 60 UNION ALL SELECT query_id, chunk_id, 'semantic' FROM sem WHERE rank <= 60), f AS (SELECT query_id // 100 AS query_id, chunk_id, string_agg(side, ',' ORDER BY side) AS m FROM u GROUP BY 1, 2),
g AS (SELECT r.item_id AS query_id, CASE WHEN count(*) FILTER (contains(m, 'semantic')) > 0 THEN 'hybrid' WHEN count(chunk_id) > 0 THEN 'literal' ELSE 'empty' END AS mode, count(chunk_id) AS hits, count(*) FILTER (m = 'literal,semantic') AS both_ways FROM benchmark r LEFT JOIN f ON f.query_id = r.item_id GROUP BY 1)
SELECT *, concat_ws(', ', CASE WHEN hits = 0 AND query_id%4 <> 0 THEN 'no relevant material' END, CASE WHEN query_id%5 <> 0 THEN 'index covers ' || (query_id%5) || ' of 5 pages' END, CASE WHEN query_id%3 = 2 THEN 'material changed meanwhile' END) AS warnings FROM g""")
def retrieval_summary(spark, sf):
    """Request i asks with the vector of id 100 i; what is known of each request is made up from its number."""
    known = C.requests(spark, sf).selectExpr("query_id", "if(query_id % 4 = 0, 0, 3) AS candidates", "if(query_id % 5 = 0, 5, query_id % 5) AS indexed_pages", "5 AS total_pages", "if(query_id % 3 = 2, 1, 0) AS stale_hits")
    found = retrieve.retrieval_summary(C.requests(spark, sf), _fused(spark, sf).withColumn("query_id", F.expr("query_id div 100")), known)
    return found.withColumn("warnings", F.array_join("warnings", ", "))


@job()
def hybrid_search(spark, sf):
    """The whole of a batch search over chunks: permission first, then literal and vector lists, fused by rank, repeats dropped, pages capped."""
    d, p, u = _corpus(spark, sf)
    wanted = C.requests(spark, sf)
    live = scope.live_pages(p, d, u).selectExpr("page_id", "owner_id", "visibility = 'public' AS is_public")
    chunks = index.chunk_sources(text.select_primary_text(p).withColumn("source_hash", F.sha2("text", 256)))
    seen = staged(
        spark.sql(
            """SELECT c.chunk_id, c.page_id, c.source_layer, c.chunk_text, l.owner_id, l.is_public, concat_ws('\\n', d.title, d.author, d.year, d.publisher) AS described
               FROM {c} c JOIN {l} l ON c.page_id = l.page_id JOIN {d} d ON c.document_id = d.document_id""",
            c=chunks,
            l=live,
            d=d,
        ),
        "search-chunks",
    )
    literal = retrieve.literal_best(seen.withColumnRenamed("chunk_text", "text"), wanted, "chunk_id")
    none = spark.createDataFrame([], "text_hash string, model_fingerprint string, vector array<float>")
    embedded = index.embed_chunks(seen, none, hashed_embedder, "pairs", 16).join(seen.select("chunk_id", "owner_id", "is_public"), "chunk_id")
    asked = wanted.withColumn("chunk_id", F.col("query_id").cast("string")).withColumn("chunk_text", F.col("query"))
    vectors = index.embed_chunks(asked, none, hashed_embedder, "pairs", 16).selectExpr("cast(chunk_id AS bigint) AS query_id", "vector").join(wanted.select("query_id", "user_id"), "query_id")
    fused = retrieve.rrf_fuse(literal, retrieve.semantic_topk(embedded, vectors))
    same = f"concat(if(source_layer LIKE 'visual_caption:%', source_layer, ''), '|', {normalized('chunk_text').format()})"
    hits = fused.drop("position").join(seen.selectExpr("chunk_id", "page_id", f"{same} AS same"), "chunk_id")
    kept = retrieve.dedupe_cap_hits(hits, duplicate="same")
    return kept.join(fused.select("query_id", "chunk_id", "matched_by"), ["query_id", "chunk_id"])


def _searched(spark, sf, reader=False):
    """Every request over the corpus; turns of conversation i are attachments of request i, and pages whose number 7 divides have changed since."""
    d, p, u = _corpus(spark, sf)
    attachments = C.table(spark, sf, "conversations").join(C.requests(spark, sf), F.col("conv_id") == F.col("query_id")).selectExpr("query_id", "concat(conv_id, '-', turn) AS attachment_id", "text")
    current = text.explode_sources(p).where("page_number % 7 <> 0").select("page_id", "source_layer", "source_hash")
    failed = p.where("page_number % 5 = 3").select("page_id")
    return search.full_search(p, d, u, _scoped_requests(spark, sf), hashed_embedder, 16, attachments, current, failed, reader=reader, threshold=0.9)


@job()
def full_search(spark, sf):
    return _searched(spark, sf).hits


@job()
def reader_search(spark, sf):
    return _searched(spark, sf, reader=True).hits


@job(f"""WITH {DUCK_VISIBLE}, live AS (SELECT vis.query_id, count(*) AS n FROM vis JOIN prim USING (page_id) GROUP BY 1)
SELECT rq.query_id, coalesce(n, 0) AS total_pages, coalesce(n, 0) AS indexed_pages, CAST(0 AS BIGINT) AS failed_pages, CAST(0 AS BIGINT) AS pending_pages FROM rq LEFT JOIN live USING (query_id)""", "rq cp cd cu prim")
def search_coverage(spark, sf):
    """Of each request, the pages that it may see and those with all their vectors; here every chunk has one."""
    d, p, u = _corpus(spark, sf)
    return search.search_coverage(p, d, u, _scoped_requests(spark, sf), hashed_embedder, 16, p.where("page_number % 5 = 3").select("page_id"))


@job()
def chronicle_search(spark, sf):
    """The material of a chronology for every request, with neighbours."""
    d, p, u = _corpus(spark, sf)
    return search.bounded_search(p, d, u, _scoped_requests(spark, sf), hashed_embedder, 16)
