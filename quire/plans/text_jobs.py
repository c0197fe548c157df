"""Queries: sources and sinks, scalar text jobs, chunks and index upkeep."""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import functions as F

from ..functions.sql import query
from ..operators import index, text
from ..sources import corpus as C
from .registry import job


@job("SELECT p.document_id, p.page_id, p.page_number, d.owner_id, d.visibility, d.is_deleted, d.title, d.author, d.year, d.publisher, p.ocr_text, p.punctuated_text, p.notes FROM cp p JOIN cd d USING (document_id)", "cd cp")
def load_corpus(spark, sf):
    return C.load_corpus(C.document_payloads(C.corpus_documents(spark, sf)), C.page_payloads(C.corpus_pages(spark, sf)))


#: Headers of conversations: an owner for each, every ninth of them gone.
DUCK_HEADERS = "ch AS (SELECT conv_id, CAST(conv_id%7+1 AS INTEGER) AS owner_id, count(*) AS turns FROM conversations WHERE conv_id%9<>0 GROUP BY 1)"


def _conversations(spark, sf):
    return query("SELECT conv_id, cast(conv_id % 7 + 1 AS int) AS owner_id, conv_id % 9 = 0 AS is_deleted, sort_array(collect_list(struct(turn, role, text))) AS turns FROM {c} GROUP BY conv_id", c=C.table(spark, sf, "conversations"))


@job(f"""WITH {DUCK_HEADERS} SELECT 'document' AS kind, d.document_id AS id, d.owner_id, d.title, CAST(count(p.page_id) AS BIGINT) AS n_parts, coalesce(string_agg(p.page_id, ',' ORDER BY page_number), '') AS part_ids, coalesce(string_agg(p.ocr_text, '|' ORDER BY page_number), '') AS texts, 9 AS schema_version
FROM cd d LEFT JOIN cp p USING (document_id) WHERE NOT d.is_deleted GROUP BY ALL
UNION ALL SELECT 'conversation', CAST(ch.conv_id AS VARCHAR), ch.owner_id, NULL, CAST(count(*) AS BIGINT), string_agg(CAST(c.turn AS VARCHAR), ',' ORDER BY c.turn), string_agg(c.text, '|' ORDER BY c.turn), 9 FROM ch JOIN conversations c USING (conv_id) JOIN cu ON cu.user_id = ch.owner_id GROUP BY ch.conv_id, ch.owner_id""", "cd cp cu")
def export_snapshot(spark, sf):
    found = C.export_snapshot(C.corpus_documents(spark, sf), C.corpus_pages(spark, sf), _conversations(spark, sf), C.corpus_users(spark, sf))
    return found.selectExpr(
        "kind", "id", "owner_id", "title", "cast(if(kind = 'document', size(pages), size(turns)) AS bigint) AS n_parts",
        "if(kind = 'document', array_join(pages.page_id, ','), array_join(transform(turns, t -> cast(t.turn AS string)), ',')) AS part_ids", "if(kind = 'document', array_join(pages.ocr_text, '|'), array_join(turns.text, '|')) AS texts", "schema_version",
    )


@job("SELECT d.document_id, d.owner_id, d.title, p.page_id, p.page_number, p.ocr_text, p.punctuated_text, p.notes FROM cd d JOIN cp p USING (document_id) WHERE NOT d.is_deleted AND d.owner_id IN (SELECT user_id FROM cu WHERE user_id <> 4)", "cd cp cu")
def import_snapshot(spark, sf):
    users = C.corpus_users(spark, sf)
    records = C.export_snapshot(C.corpus_documents(spark, sf), C.corpus_pages(spark, sf), _conversations(spark, sf), users)
    return C.import_snapshot(records, users.where("user_id <> 4"))


@job(f"WITH {DUCK_HEADERS} SELECT ch.conv_id, ch.owner_id, c.turn, c.role, c.text FROM ch JOIN conversations c USING (conv_id) WHERE ch.owner_id IN (SELECT user_id FROM cu WHERE user_id <> 4)", "cd cu")
def import_conversations(spark, sf):
    users = C.corpus_users(spark, sf)
    records = C.export_snapshot(C.corpus_documents(spark, sf), C.corpus_pages(spark, sf), _conversations(spark, sf), users)
    return C.import_conversations(records, users.where("user_id <> 4")).selectExpr("cast(conv_id AS bigint) AS conv_id", "owner_id", "turn", "role", "text")


@job()
def html_visible_text(spark, sf):
    return C.table(spark, sf, "pages").select("page_id", text.html_visible_text(F.col("html")).alias("visible"))


@job()
def clean_text(spark, sf):
    return text.clean_text(C.table(spark, sf, "pages").select("page_id", "html"), "html").select("page_id", "clean", "truncated", "warning")


@job("SELECT doc_id, text, CASE WHEN doc_id%2=0 OR text = '' THEN 'utf-8-sig' ELSE 'utf-16' END AS encoding, 0 AS replaced FROM documents")
def decode_bytes(spark, sf):
    raw = C.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "UTF-16")).alias("raw"))
    return raw.select("doc_id", text.decode_bytes(F.col("raw")).alias("d")).select("doc_id", "d.text", "d.encoding", "d.replaced")


@job("SELECT * FROM prim", "prim")
def select_primary_text(spark, sf):
    return text.select_primary_text(C.corpus_pages(spark, sf))


@job("""SELECT document_id, page_id, page_number, source_layer, sha256(text) AS source_hash, text FROM src
UNION ALL SELECT document_id, page_id, page_number, 'visual_caption:v%20'||page_number||':c*1'.replace('*','%2A'), sha256(substr(ocr_text,1,20)), substr(ocr_text,1,20) FROM cp WHERE page_number%3=0 AND trim(substr(ocr_text,1,20), E' \\n\\t\\r') <> ''""", "src cp")
def explode_sources(spark, sf):
    visuals = "if(page_number % 3 = 0, array(named_struct('id', concat('v ', page_number), 'captions', array(named_struct('id', 'c*1', 'text', substring(ocr_text, 1, 20))))), NULL) AS visuals"
    return text.explode_sources(C.corpus_pages(spark, sf).selectExpr("*", visuals))


#: A seed of the dictionary, simplified to traditional and back; a deployment gives its own tables.
PHRASES, CHARACTERS = {"头发": "頭髮", "发展": "發展", "理发师": "理髮師"}, {"发": "發", "头": "頭", "国": "國", "学": "學", "书": "書", "师": "師"}
TABLES = {"traditional": (PHRASES, CHARACTERS), "simplified": ({v: k for k, v in PHRASES.items()}, {v: k for k, v in CHARACTERS.items()})}
#: Letters of the pages as ideographs, so that phrases and characters of the dictionary occur.
LATIN, HAN = "abcdefghijklmnopqrstuvwxyz", "头发展理师国学书甲头发展师国发头展理发师学书乙丙丁戊"


@job(f"SELECT page_id, translate(replace(replace(replace(h, '理发师', '理髮師'), '头发', '頭髮'), '发展', '發展'), '发头国学书师', '發頭國學書師') AS traditional, h AS simplified FROM (SELECT page_id, coalesce(translate(ocr_text, '{LATIN}', '{HAN}'), '') AS h FROM cp)", "cp")
def convert_variant(spark, sf):
    pages = C.corpus_pages(spark, sf).select("page_id", F.coalesce(F.translate("ocr_text", LATIN, HAN), F.lit("")).alias("h"))
    there = pages.select("page_id", text.variant_converter(TABLES, "zh-TW")("h").alias("traditional"))
    return there.select("page_id", "traditional", text.variant_converter(TABLES, "unknown")("traditional").alias("simplified"))


@job(r"""SELECT page_id, trim(regexp_replace(array_to_string(list_transform(string_split(ocr_text, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), chr(10)), '\n{3,}', chr(10)||chr(10), 'g'), chr(10)) AS layout FROM cp""", "cp")
def normalize_layout_text(spark, sf):
    return query(f"SELECT page_id, {text.normalize_layout_text('ocr_text')} AS layout FROM {{p}}", p=C.corpus_pages(spark, sf))


@job()
def normalize_generated_text(spark, sf):
    return C.corpus_pages(spark, sf).select("page_id", text.normalize_generated_text(F.col("ocr_text")).alias("generated"))


@job(r"""SELECT page_id, regexp_replace(ocr_text, '[\p{P}\p{Z}\s]', '', 'g') AS content, CAST(length(regexp_replace(ocr_text, '[\p{P}\p{Z}\s]', '', 'g')) AS INTEGER) AS content_chars, CAST(len(regexp_extract_all(ocr_text, '\p{P}')) AS INTEGER) AS punctuation FROM cp""", "cp")
def content_stats(spark, sf):
    return text.content_stats(C.corpus_pages(spark, sf))


@job()
def split_sentences(spark, sf):
    return text.split_sentences(text.select_primary_text(C.corpus_pages(spark, sf)))


@job()
def sentence_excerpt(spark, sf):
    """The sentences around every `the` of every page."""
    hits = query(
        """SELECT page_id, ocr_text, hit, hit + 3 AS hit_end FROM {p} LATERAL VIEW explode(transform(slice(split(ocr_text, 'the'), 1, size(split(ocr_text, 'the')) - 1), (x, i) -> cast(aggregate(slice(split(ocr_text, 'the'), 1, i + 1), 0, (a, y) -> a + length(y)) + 3 * i AS int))) t AS hit""",
        p=C.corpus_pages(spark, sf),
    )
    return text.sentence_excerpt(hits, "ocr_text", "hit", "hit_end").drop("ocr_text")


@job()
def pack_text_chunks(spark, sf):
    return C.table(spark, sf, "documents").select("doc_id", F.posexplode(text.pack_text_chunks(F.col("text"))).alias("part", "piece"))


@job()
def split_attachment_text(spark, sf):
    return C.table(spark, sf, "documents").select("doc_id", F.posexplode(text.split_attachment_text(F.col("text"))).alias("part", "piece"))


@job("SELECT doc_id, CAST(1 + 3 * len(list_filter(list_filter(string_split_regex(lower(lang || ' the ' || source), '[ ,，、；;]+'), lambda t: t <> ''), lambda t: contains(lower(text), t))) AS INTEGER) AS score FROM documents")
def relevance_score(spark, sf):
    return query(f"SELECT doc_id, {text.relevance_score('text', 'q')} AS score FROM (SELECT doc_id, text, concat(lang, ' the ', source) AS q FROM {{d}})", d=C.table(spark, sf, "documents"))


@job("""WITH h AS (SELECT doc_id, text, instr(lower(text), 'of the') - 1 AS pos FROM documents), r AS (SELECT *, greatest(0, pos - 36) AS b, least(length(text), pos + 6 + 72) AS e FROM h)
SELECT doc_id, CASE WHEN pos < 0 THEN '' ELSE (CASE WHEN b > 0 THEN '...' ELSE '' END) || substr(text, b + 1, e - b) || (CASE WHEN e < length(text) THEN '...' ELSE '' END) END AS snippet FROM r""")
def snippet(spark, sf):
    return query(f"SELECT doc_id, {text.snippet('text', 'q')} AS snippet FROM (SELECT doc_id, text, 'of the' AS q FROM {{d}})", d=C.table(spark, sf, "documents"))


#: Dates, some of them no real ones, from order keys.
DATES = "CASE o_orderkey % 4 WHEN 0 THEN {y} WHEN 1 THEN {y} || '-' || {m} WHEN 2 THEN {y} || '-' || {m} || '-' || {d} ELSE {y} || '/' || {m} END"
SPARK_DATE = DATES.format(y="lpad(cast(o_orderkey % 2100 as string), 4, '0')", m="lpad(cast(o_orderkey % 14 as string), 2, '0')", d="lpad(cast(o_custkey % 33 as string), 2, '0')")
DUCK_DATE = DATES.format(y="lpad(cast(o_orderkey % 2100 as varchar), 4, '0')", m="lpad(cast(o_orderkey % 14 as varchar), 2, '0')", d="lpad(cast(o_custkey % 33 as varchar), 2, '0')")
DUCK_PARTS = f"""t AS (SELECT o_orderkey, {DUCK_DATE} AS d FROM orders),
x AS (SELECT *, CASE WHEN regexp_full_match(d, '[0-9]{{4}}(-[0-9]{{2}}(-[0-9]{{2}})?)?') THEN string_split(d, '-') END AS p FROM t),
y AS (SELECT *, CAST(p[1] AS INTEGER) AS yy, coalesce(CAST(p[2] AS INTEGER), 0) AS mm, coalesce(CAST(p[3] AS INTEGER), 0) AS dd FROM x),
z AS (SELECT *, coalesce(yy >= 1 AND mm <= 12 AND (dd = 0 OR try_cast(d AS DATE) IS NOT NULL), false) AS valid FROM y)"""


@job(f"WITH {DUCK_PARTS} SELECT o_orderkey, d, valid, CASE WHEN valid THEN yy END AS year, CASE WHEN valid THEN mm END AS month, CASE WHEN valid THEN dd END AS day FROM z")
def parse_partial_date(spark, sf):
    p = text.parse_partial_date("d")
    return query(
        f"SELECT o_orderkey, d, valid, if(valid, y, NULL) AS year, if(valid, m, NULL) AS month, if(valid, dd, NULL) AS day FROM (SELECT o_orderkey, d, {p['valid']} AS valid, {p['year']} AS y, {p['month']} AS m, {p['day']} AS dd FROM (SELECT o_orderkey, {SPARK_DATE} AS d FROM {{o}}))",
        o=C.table(spark, sf, "orders"),
    )


@job(f"""WITH {DUCK_PARTS}, w AS (SELECT o_orderkey, CASE WHEN valid THEN d ELSE '' END AS g, d, CASE len(p) WHEN 3 THEN yy||'年'||mm||'月'||dd||'日' WHEN 2 THEN yy||'年'||mm||'月' ELSE yy||'年' END AS words FROM z)
SELECT o_orderkey, CASE WHEN g = '' THEN d WHEN d <> words THEN words||'（'||d||'）' ELSE words END AS label FROM w""")
def date_label(spark, sf):
    p = text.parse_partial_date("d")
    return query(
        f"SELECT o_orderkey, {text.date_label('g', 'd')} AS label FROM (SELECT o_orderkey, d, if({p['valid']}, d, '') AS g FROM (SELECT o_orderkey, {SPARK_DATE} AS d FROM {{o}}))",
        o=C.table(spark, sf, "orders"),
    )


@job()
def parse_llm_json(spark, sf):
    answers = C.table(spark, sf, "conversations").selectExpr("conv_id", "turn", "CASE turn % 3 WHEN 0 THEN concat('```json\\n', to_json(struct(text AS quote)), '\\n```') WHEN 1 THEN concat('Here: ', to_json(struct(text AS quote)), ' done') ELSE text END AS answer")
    return answers.select("conv_id", "turn", text.parse_llm_json(F.col("answer"), "quote string").alias("o")).select("conv_id", "turn", "o.quote")


@job()
def chunk_sources(spark, sf):
    return index.chunk_sources(text.explode_sources(C.corpus_pages(spark, sf)))


def _keys(spark, sf, where, layer_hash="sha2(text, 256)"):
    return text.explode_sources(C.corpus_pages(spark, sf)).selectExpr("page_id", "source_layer", f"{layer_hash} AS source_hash", "page_number").where(where)


STALE = "CASE WHEN page_number % 2 = 0 THEN sha256(text || 'old') ELSE sha256(text) END"


@job(f"""WITH st AS (SELECT page_id, source_layer, {STALE} AS h FROM src WHERE page_number % 6 <> 5), cur AS (SELECT page_id, source_layer, sha256(text) AS h FROM src)
SELECT page_id, source_layer, h AS source_hash, 'keep' AS action FROM st SEMI JOIN cur USING (page_id, source_layer, h)
UNION ALL SELECT page_id, source_layer, h, 'drop' FROM st ANTI JOIN cur USING (page_id, source_layer, h) UNION ALL SELECT page_id, source_layer, h, 'chunk' FROM cur ANTI JOIN st USING (page_id, source_layer, h)""", "src")
def reconcile_chunks(spark, sf):
    stored = _keys(spark, sf, "page_number % 6 <> 5", "if(page_number % 2 = 0, sha2(concat(text, 'old'), 256), sha2(text, 256))").drop("page_number")
    parts = index.reconcile_chunks(stored, _keys(spark, sf, "true").drop("page_number"))
    keep, drop, fresh = (p.select("page_id", "source_layer", "source_hash", F.lit(a).alias("action")) for p, a in zip(parts, ("keep", "drop", "chunk")))
    return keep.union(drop).union(fresh)


@job(f"""WITH n AS (SELECT page_id, 'primary' AS policy, source_layer, sha256(text) AS h FROM prim WHERE page_number % 7 <> 3), s AS (SELECT page_id, 'primary' AS policy, source_layer, {STALE} AS h FROM prim WHERE page_number % 6 <> 5)
SELECT coalesce(n.page_id, s.page_id) AS page_id, coalesce(n.policy, s.policy) AS policy, n.source_layer, n.h AS source_hash, CASE WHEN s.page_id IS NULL THEN 'insert' WHEN n.page_id IS NULL THEN 'delete' WHEN s.h = n.h AND s.source_layer = n.source_layer THEN 'keep' ELSE 'update' END AS action
FROM s FULL JOIN n ON s.page_id = n.page_id AND s.policy = n.policy""", "prim")
def reconcile_policy_sources(spark, sf):
    primary = text.select_primary_text(C.corpus_pages(spark, sf))
    new = primary.where("page_number % 7 <> 3").selectExpr("page_id", "'primary' AS policy", "source_layer", "sha2(text, 256) AS source_hash")
    old = primary.where("page_number % 6 <> 5").selectExpr("page_id", "'primary' AS policy", "source_layer", "if(page_number % 2 = 0, sha2(concat(text, 'old'), 256), sha2(text, 256)) AS source_hash")
    return index.reconcile_policy_sources(old, new)


@job("SELECT s.page_id, s.source_layer, sha256(s.text) AS source_hash FROM src s JOIN cd d USING (document_id) JOIN cu u ON u.user_id = d.owner_id WHERE NOT d.is_deleted AND NOT u.is_deleted", "src cd cu")
def purge_inactive(spark, sf):
    pages = C.corpus_pages(spark, sf)
    return index.purge_inactive(text.explode_sources(pages).select("page_id", "source_layer", "source_hash"), pages, C.corpus_documents(spark, sf), C.corpus_users(spark, sf))


@job("SELECT DISTINCT page_id, source_layer, sha256(text) AS source_hash, 'model-a' AS model_fingerprint FROM src WHERE NOT (page_number % 2 = 1 AND source_layer = 'ocrText')", "src")
def embedding_backlog(spark, sf):
    sources = text.explode_sources(C.corpus_pages(spark, sf))
    jobs = sources.where("page_number % 2 = 1 AND source_layer = 'ocrText'").select("page_id", "source_layer", "source_hash", F.lit("model-a").alias("model_fingerprint"))
    return index.embedding_backlog(sources, jobs, spark.sql("SELECT 'model-a' AS model_fingerprint"))


@cache
def _bucket(pair: int, dimensions: int) -> int:
    import zlib

    return zlib.crc32((chr(pair >> 32) + chr(pair & 0xFFFFFFFF)).encode()) % dimensions


def hashed_embedder(texts: list[str], dimensions: int = 16) -> list[list[float]]:
    """A stand-in for an embedding model: counts of hashed character pairs."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    pairs, at = np.unique(points[:-1] << 32 | points[1:], return_inverse=True)
    same = owner[:-1] == owner[1:]
    # pairs across two texts do not count
    used = np.unique(at[same])
    buckets = np.zeros(len(pairs), dtype=np.int64)
    buckets[used] = [_bucket(p, dimensions) for p in pairs[used].tolist()]
    return np.bincount(owner[:-1][same] * dimensions + buckets[at[same]], minlength=len(texts) * dimensions).reshape(len(texts), dimensions).astype(float).tolist()


@job()
def embed_chunks(spark, sf):
    chunks = index.chunk_sources(text.explode_sources(C.corpus_pages(spark, sf)))
    fingerprint = index.model_fingerprint({"model": "pairs", "dimensions": 16, "chunker": index.CHUNKER})
    cached = spark.createDataFrame([], "text_hash string, model_fingerprint string, vector array<float>")
    return index.embed_chunks(chunks, cached, hashed_embedder, fingerprint, 16)


@job("SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 'empty' WHEN vec_id % 13 = 0 THEN 'norm' END AS reason, CASE WHEN vec_id % 11 <> 0 AND vec_id % 13 <> 0 THEN round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) END AS first_component FROM embeddings")
def normalize_vectors(spark, sf):
    v = C.table(spark, sf, "embeddings").selectExpr("vec_id", "CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 13 = 0 THEN array_repeat(0D, 64) ELSE cast(embedding AS array<double>) END AS vector")
    return index.normalize_vectors(v, 64).selectExpr("vec_id", "reason", "round(unit[0], 6) AS first_component")


@job("""WITH a AS (SELECT user_id || '-' || (CAST(props->>'$.k' AS INTEGER) % 20) AS key, ts, event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'unavailable' WHEN 'purchase' THEN 'success' ELSE 'failed' END AS outcome FROM events),
l AS (SELECT *, max(CASE WHEN outcome = 'success' THEN struct_pack(t := ts, e := event_id) END) OVER (PARTITION BY key) AS won FROM a),
g AS (SELECT key, CAST(count(*) FILTER (outcome = 'failed' AND (won IS NULL OR struct_pack(t := ts, e := event_id) > won)) AS BIGINT) AS failures, arg_max(outcome, struct_pack(t := ts, e := event_id)) AS last FROM l GROUP BY key)
SELECT key, CASE WHEN last = 'success' THEN 'ready' WHEN failures >= 3 THEN 'failed' ELSE 'waiting' END AS status, failures FROM g""")
def attempt_log_status(spark, sf):
    a = C.table(spark, sf, "events").selectExpr("concat(user_id, '-', cast(get_json_object(props, '$.k') AS int) % 20) AS key", "ts AS at", "event_id AS seq", "CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'unavailable' WHEN 'purchase' THEN 'success' ELSE 'failed' END AS outcome")
    return index.attempt_log_status(a).select("key", "status", "failures")


@job("""WITH s AS (SELECT document_id, lower(concat_ws(chr(10), coalesce(title,'-'), coalesce(author,'-'), coalesce(year,'-'), coalesce(publisher,'-'), visibility)) AS shelf FROM cd), q AS (SELECT item_id AS query_id, string_split('title ' || item_id || ' src', ' ') AS terms FROM benchmark)
SELECT query_id, document_id FROM q JOIN s ON len(list_filter(terms, lambda t: NOT contains(shelf, t))) = 0""", "cd")
def shelf_search(spark, sf):
    wanted = C.requests(spark, sf).selectExpr("query_id", "concat('title ', query_id, ' src') AS query")
    return text.shelf_search(C.corpus_documents(spark, sf), wanted, ["title", "author", "year", "publisher", "visibility"])


@job("""SELECT p_partkey AS model_id, sha256('{"chunkerVersion": "paragraph-v1", "digest": "' || replace(p_type, '"', '\\"') || '", "dimensions": ' || p_size || ', "documentPrefix": "", "model": "' || replace(p_name, '"', '\\"') || '", "provider": "local", "queryPrefix": "' || replace(p_brand, '"', '\\"') || ': "}') AS fingerprint FROM part""")
def model_fingerprint(spark, sf):
    models = C.table(spark, sf, "part").selectExpr("p_partkey AS model_id", "p_name AS model", "p_type AS digest", "cast(p_size AS int) AS dimensions", "'' AS document_prefix", "concat(p_brand, ': ') AS query_prefix", "'local' AS provider", f"'{index.CHUNKER}' AS chunker_version")
    return index.model_fingerprints(models).select("model_id", "fingerprint")
