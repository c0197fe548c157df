"""Queries: reports, merges, trees, integrity, streams."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions.sql import query
from ..functions.staging import shared_path
from ..operators import merge, reports, text
from ..sources import corpus as C
from ..streaming import streams
from .registry import job


def _expected(spark, sf):
    return query("SELECT document_id, page_id, cast(ceil(length(text) / 500) AS int) AS chunks, page_number FROM {p}", p=text.select_primary_text(C.corpus_pages(spark, sf)))


@job("""WITH e AS (SELECT document_id, page_id, page_number, CAST(ceil(length(text)/500.0) AS INTEGER) AS chunks FROM prim), x AS (SELECT document_id, chunks > 0 AND CASE WHEN page_number%3=2 THEN chunks-1 ELSE chunks END = chunks AS done, page_number%5=2 AS bad FROM e)
SELECT document_id, count(*) FILTER (done) AS indexed, count(*) FILTER (NOT done AND bad) AS failed, greatest(0, count(*) - count(*) FILTER (done) - count(*) FILTER (NOT done AND bad)) AS pending FROM x GROUP BY 1""", "prim")
def index_coverage(spark, sf):
    e = _expected(spark, sf)
    vectors = query("SELECT page_id, explode(sequence(1, if(page_number % 3 = 2, chunks - 1, chunks))) AS n FROM {e} WHERE if(page_number % 3 = 2, chunks - 1, chunks) > 0", e=e)
    return reports.index_coverage(e, vectors, e.where("page_number % 5 = 2").select("page_id"))


def _staged_pages(spark, sf):
    return C.corpus_pages(spark, sf).selectExpr("document_id", "page_id", "map('ocr', if(page_number % 7 = 3, 'failed', 'done'), 'variant', if(page_number % 5 = 4, 'failed', 'done'), 'punctuation', if(page_number % 4 = 0, 'running', 'done'), 'finalize', 'waiting') AS status", "page_number = 6 AS omitted")


@job("""SELECT document_id, 'ocr' AS stage, count(*) AS done, count(*) AS total FROM cp GROUP BY 1 UNION ALL SELECT document_id, 'variant', count(*), count(*) FROM cp GROUP BY 1
UNION ALL SELECT document_id, 'punctuation', count(*) FILTER (page_number=6 OR page_number%4<>0 OR page_number%7=3 OR page_number%5=4), count(*) FROM cp GROUP BY 1 UNION ALL SELECT document_id, 'finalize', count(*) FILTER (page_number=6 OR page_number%7=3 OR page_number%5=4), count(*) FROM cp GROUP BY 1""", "cp")
def stage_progress(spark, sf):
    return reports.stage_progress(_staged_pages(spark, sf))


@job("SELECT document_id, string_agg(page_number||':ocr:low contrast', ',' ORDER BY page_number) AS failures FROM cp WHERE page_number%7=3 GROUP BY 1", "cp")
def failed_pages(spark, sf):
    found = reports.failed_pages(C.corpus_pages(spark, sf).selectExpr("document_id", "page_number", "if(page_number % 7 = 3, 'ocr', NULL) AS stage", "'low contrast' AS message"))
    return found.selectExpr("document_id", "array_join(transform(failures, f -> concat(f.page_number, ':', f.stage, ':', f.message)), ',') AS failures")


@job("""WITH j AS (SELECT user_id AS document_id, CASE event_type WHEN 'purchase' THEN 'ready' WHEN 'error' THEN 'failed' WHEN 'view' THEN CASE WHEN user_id%3=0 THEN 'pending' ELSE 'ready' END WHEN 'click' THEN CASE WHEN user_id%7=1 THEN 'running' ELSE 'ready' END ELSE CASE WHEN user_id%5=0 THEN 'waiting' ELSE 'ready' END END AS status FROM events WHERE event_type <> 'error' OR user_id%2=0),
g AS (SELECT document_id, count(*) AS total, count(*) FILTER (status='ready') AS ready, count(*) FILTER (status='running') AS running, count(*) FILTER (status='pending') AS pending, count(*) FILTER (status='waiting') AS waiting, count(*) FILTER (status='failed') AS failed FROM j GROUP BY 1),
b AS (SELECT coalesce(g.document_id, d.doc_id) AS document_id, coalesce(total, 0) AS total, coalesce(ready, 0) AS ready, running, pending, waiting, coalesce(failed, 0) AS failed FROM g FULL JOIN (SELECT DISTINCT doc_id FROM documents) d ON g.document_id = d.doc_id)
SELECT document_id, CASE WHEN running > 0 THEN 'running' WHEN pending > 0 THEN 'queued' WHEN waiting > 0 THEN 'waiting' WHEN failed > 0 THEN 'failed' ELSE 'queued' END AS stage, ready, total, CASE WHEN total = 0 THEN 25 ELSE CAST(least(99, 25 + round_even(75 * ready / total, 0)) AS INTEGER) END AS percent, failed FROM b WHERE total = 0 OR ready < total""")
def preparation_state(spark, sf):
    status = "CASE event_type WHEN 'purchase' THEN 'ready' WHEN 'error' THEN 'failed' WHEN 'view' THEN if(user_id % 3 = 0, 'pending', 'ready') WHEN 'click' THEN if(user_id % 7 = 1, 'running', 'ready') ELSE if(user_id % 5 = 0, 'waiting', 'ready') END"
    jobs = C.table(spark, sf, "events").where("event_type <> 'error' OR user_id % 2 = 0").selectExpr("user_id AS document_id", f"{status} AS status")
    return reports.preparation_state(jobs, C.table(spark, sf, "documents").selectExpr("doc_id AS document_id"))


@job("SELECT document_id, owner_id FROM cd WHERE sort_order%2=0 AND (sort_order%6=0 OR (sort_order%3<>0 AND document_id IN (SELECT document_id FROM prim)))", "cd prim")
def preparation_candidates(spark, sf):
    d = C.corpus_documents(spark, sf).selectExpr("document_id", "owner_id", "sort_order", "if(sort_order % 2 = 0, concat('from-', sort_order), NULL) AS source_document_id")
    jobs = d.where("sort_order % 3 = 0").selectExpr("document_id", "if(sort_order % 6 = 0, 'pending', 'ready') AS status")
    return reports.preparation_candidates(d, text.select_primary_text(C.corpus_pages(spark, sf)).select("document_id"), jobs)


@job("SELECT 'documents' AS kind, count(*) FILTER (NOT is_deleted) AS live FROM cd UNION ALL SELECT 'pages', count(*) FROM cp UNION ALL SELECT 'users', count(*) FILTER (NOT is_deleted) FROM cu", "cd cp cu")
def live_counts(spark, sf):
    return reports.live_counts({"documents": C.corpus_documents(spark, sf), "pages": C.corpus_pages(spark, sf).withColumn("is_deleted", F.lit(False)), "users": C.corpus_users(spark, sf)})


@job("""WITH p AS (SELECT document_id, bool_or(trim(coalesce(punctuated_text,''), E' \\n\\t\\r')<>'') AS part, bool_and(trim(coalesce(punctuated_text,''), E' \\n\\t\\r')<>'') AS every FROM cp GROUP BY 1)
SELECT d.document_id, coalesce(CASE WHEN sort_order%5=0 THEN 'running' END, CASE WHEN sort_order%7=0 THEN 'registered' END, CASE WHEN NOT coalesce(part,false) THEN 'no text' WHEN every THEN 'saved' ELSE 'in progress' END) AS status FROM cd d LEFT JOIN p USING (document_id)""", "cd cp")
def document_status(spark, sf):
    d = C.corpus_documents(spark, sf).selectExpr("document_id", "if(sort_order % 5 = 0, 'running', '') AS task_status", "if(sort_order % 7 = 0, 'registered', NULL) AS registration")
    return reports.document_status(d, C.corpus_pages(spark, sf))


@job("SELECT document_id, coalesce(string_agg('['||page_number||']'||chr(10)||ocr_text, chr(10)||chr(10) ORDER BY page_number) FILTER (page_number<=3), '') AS text, count(*) FILTER (page_number<=3) AS pages_read, count(*) AS pages_total FROM cp GROUP BY 1", "cp")
def metadata_candidate_text(spark, sf):
    return reports.metadata_candidate_text(C.corpus_pages(spark, sf))


@job("SELECT conv_id, count(*) FILTER (turn%4=1) AS pending, count(*) FILTER (turn%4=2 AND turn%3<>0) AS ready, count(*) FILTER (turn%4 IN (0,3) OR (turn%4=2 AND turn%3=0)) AS failed, array_to_string(list_sort(list(DISTINCT 'w'||(turn%2))), ',') AS warnings FROM conversations GROUP BY 1")
def attachment_report(spark, sf):
    a = C.table(spark, sf, "conversations").selectExpr("conv_id", "CASE turn % 4 WHEN 1 THEN 'processing' WHEN 2 THEN 'ready' ELSE 'failed' END AS status", "if(turn % 3 = 0, ' ', 'x') AS text", "array(concat('w', turn % 2)) AS warnings")
    return reports.attachment_report(a).withColumn("warnings", F.array_join("warnings", ","))


@job("SELECT page_id, CASE WHEN page_number%5=0 THEN 'unavailable' WHEN page_number%3=0 OR page_number%7=0 THEN 'stale' ELSE 'ready' END AS status FROM cp", "cp")
def derived_index_status(spark, sf):
    p = C.corpus_pages(spark, sf).selectExpr("page_id", "page_number", "2 AS revision", "md5(ocr_text) AS text_hash")
    stored = p.where("page_number % 5 <> 0").selectExpr("page_id", "if(page_number % 3 = 0, 1, 2) AS revision", "if(page_number % 7 = 0, 'other', text_hash) AS text_hash", "4 AS version", "'ready' AS status")
    return reports.derived_index_status(p, stored, 4)


@job("""WITH c AS (SELECT o_orderkey AS conv_id, o_custkey AS owner_id, CASE WHEN o_orderkey%9=0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS tm FROM orders)
SELECT conv_id, CASE WHEN tm IS NULL THEN 'unfiled' WHEN tm >= TIMESTAMP '1997-01-01' - INTERVAL 30 DAYS THEN 'within 30 days' ELSE strftime(tm, '%Y-%m') END AS label, CAST(row_number() OVER (PARTITION BY owner_id ORDER BY tm DESC NULLS LAST, conv_id) AS INTEGER) AS position FROM c""")
def conversation_groups(spark, sf):
    c = C.table(spark, sf, "orders").selectExpr("o_orderkey AS conv_id", "o_custkey AS owner_id", "if(o_orderkey % 2 = 0 AND o_orderkey % 9 <> 0, cast(o_orderdate AS timestamp), NULL) AS updated", "if(o_orderkey % 9 = 0, NULL, cast(o_orderdate AS timestamp)) AS created")
    return reports.conversation_groups(c, "1997-01-01 00:00:00")


def _stored_documents(spark, sf):
    return C.corpus_documents(spark, sf).selectExpr("document_id", "owner_id", "title", "sort_order % 4 + 1 AS version", "sort_order", "is_deleted")


@job("""WITH i AS (SELECT 'doc-'||(doc_id*2) AS document_id, 'new '||doc_id AS title, CAST(doc_id AS INTEGER) AS position FROM documents), t AS (SELECT s.*, i.document_id AS id2, i.title AS t2, i.position, i.document_id IS NOT NULL AND (s.document_id IS NULL OR s.owner_id=3) AS take FROM cd s FULL JOIN i ON s.document_id = i.document_id)
SELECT coalesce(document_id, id2) AS document_id, coalesce(owner_id, 3) AS owner_id, CASE WHEN take THEN t2 ELSE title END AS title, CASE WHEN take THEN coalesce(sort_order%4+1, 0)+1 ELSE sort_order%4+1 END AS version, CASE WHEN take THEN position ELSE sort_order END AS sort_order, CASE WHEN take THEN false ELSE is_deleted END AS is_deleted FROM t""", "cd")
def merge_documents(spark, sf):
    incoming = C.table(spark, sf, "documents").selectExpr("concat('doc-', doc_id * 2) AS document_id", "concat('new ', doc_id) AS title", "cast(doc_id AS int) AS position")
    return merge.merge_documents(_stored_documents(spark, sf), incoming, 3)


@job("""WITH i AS (SELECT page_id, CASE WHEN page_number%11=5 THEN 'elsewhere' ELSE document_id END AS document_id, 'new' AS text FROM cp WHERE page_number%3<>0), t AS (SELECT DISTINCT document_id FROM i),
x AS (SELECT s.page_id, s.document_id, s.ocr_text, i.page_id IS NOT NULL AND s.document_id = i.document_id AS take, i.page_id IS NULL AND t.document_id IS NOT NULL AS gone FROM cp s LEFT JOIN i ON s.page_id = i.page_id LEFT JOIN t ON t.document_id = s.document_id)
SELECT page_id, document_id, CASE WHEN take THEN 'new' ELSE ocr_text END AS text, CASE WHEN take THEN 2 ELSE 1 END AS version, CASE WHEN take THEN false ELSE gone END AS is_deleted FROM x""", "cp")
def merge_pages(spark, sf):
    p = C.corpus_pages(spark, sf)
    return merge.merge_pages(p.selectExpr("page_id", "document_id", "ocr_text AS text", "1 AS version", "false AS is_deleted"), p.where("page_number % 3 <> 0").selectExpr("page_id", "if(page_number % 11 = 5, 'elsewhere', document_id) AS document_id", "'new' AS text"))


@job("SELECT conv_id, turn AS attachment_id, CASE WHEN conv_id%2=0 AND turn%2=0 THEN 'kept' ELSE 'old' END AS name, conv_id%2=0 AND turn%2<>0 AS is_deleted FROM conversations")
def merge_conversations(spark, sf):
    c = C.table(spark, sf, "conversations")
    listed = c.where("conv_id % 2 = 0 AND turn % 2 = 0").selectExpr("conv_id", "turn AS attachment_id", "'kept' AS name")
    return merge.merge_conversations(c.selectExpr("conv_id", "turn AS attachment_id", "'old' AS name", "false AS is_deleted"), c.where("conv_id % 2 = 0").select("conv_id").distinct(), listed)


@job("""WITH g AS (SELECT document_id FROM cd WHERE owner_id=2 AND NOT is_deleted AND sort_order%4=1) SELECT 'document' AS kind, document_id AS id, 'deleted' AS action FROM g UNION ALL SELECT 'page', page_id, 'deleted' FROM cp WHERE document_id IN (SELECT document_id FROM g) AND page_number%6<>0
UNION ALL SELECT 'file', page_id||':scan', 'deleted' FROM cp WHERE document_id IN (SELECT document_id FROM g) AND page_number%4<>0 UNION ALL SELECT 'job', document_id, 'cancelled' FROM cd WHERE document_id IN (SELECT document_id FROM g) AND sort_order%3=0""", "cd cp")
def soft_delete(spark, sf):
    d, p = C.corpus_documents(spark, sf), C.corpus_pages(spark, sf)
    files = p.selectExpr("concat(page_id, ':scan') AS file_id", "document_id", "page_number % 4 = 0 AS is_deleted")
    return merge.soft_delete(d, p.withColumn("is_deleted", F.expr("page_number % 6 = 0")), files, d.where("sort_order % 3 = 0").select("document_id"), d.where("sort_order % 4 = 1").selectExpr("concat(' ', document_id, ' ') AS document_id"), 2)


@job("""WITH f AS (SELECT document_id, list(page_number ORDER BY page_number) FILTER (page_number%7=3 AND page_number%2=1) AS gone, list(page_number ORDER BY page_number) FILTER (page_number%7=3 AND page_number%2=0) AS rest FROM cp GROUP BY 1)
SELECT document_id, array_to_string(list_sort(list_distinct(list_concat([1], coalesce(gone, [])))), ',') AS omitted, coalesce(array_to_string(rest, ','), '') AS failed FROM f""", "cp")
def retire_failed_pages(spark, sf):
    p = C.corpus_pages(spark, sf).withColumn("failure_stage", F.when(F.col("page_number") % 7 == 3, "ocr"))
    d = query("SELECT document_id, array(1) AS omitted, sort_array(collect_list(if(failure_stage IS NOT NULL, page_number, NULL))) AS failed FROM {p} GROUP BY document_id", p=p)
    found = merge.retire_failed_pages(d, p, p.where("page_number % 2 = 1").select("document_id", "page_number"))
    return found.selectExpr("document_id", "array_join(transform(omitted, x -> cast(x AS string)), ',') AS omitted", "array_join(transform(failed, x -> cast(x AS string)), ',') AS failed")


@job("SELECT o_orderkey AS document_id, CASE WHEN o_orderstatus='F' AND o_custkey%2=0 THEN 'queued' WHEN o_orderstatus='F' THEN 'failed' ELSE 'ready' END AS status, CASE WHEN o_orderstatus='F' AND o_custkey%2=0 THEN 0 ELSE 3 END AS failures, CASE WHEN o_orderstatus='F' AND o_custkey%2=0 THEN 0 ELSE 99 END AS retry_at FROM orders")
def reset_failed_jobs(spark, sf):
    o = C.table(spark, sf, "orders")
    return merge.reset_failed_jobs(o.selectExpr("o_orderkey AS document_id", "if(o_orderstatus = 'F', 'failed', 'ready') AS status", "3 AS failures", "99 AS retry_at"), o.where("o_custkey % 2 = 0").selectExpr("o_orderkey AS document_id"))


@job("SELECT page_id||':v' AS file_id FROM cp WHERE page_number%2=0 AND page_number%3<>0", "cp")
def retire_visual_files(spark, sf):
    p = C.corpus_pages(spark, sf)
    files = p.selectExpr("concat(page_id, ':v') AS file_id", "page_id", "'page-visual:v1' AS role", "false AS is_deleted")
    return merge.retire_visual_files(files, p.where("page_number % 2 = 0").selectExpr("page_id", "'v1' AS visual_id", "if(page_number % 3 = 0, 'ready', 'failed') AS status"))


@job("""WITH p AS (SELECT document_id, string_agg(page_id, ',' ORDER BY page_number) AS pages FROM cp GROUP BY 1)
SELECT d.document_id, u.name AS owner_name, d.owner_id=2 AS can_edit, CASE WHEN d.owner_id=2 THEN d.owner_id END AS owner_id, coalesce(pages,'') AS pages, CAST(row_number() OVER (ORDER BY d.sort_order%20, d.sort_order*37%101 DESC, d.document_id) AS INTEGER) AS position FROM cd d JOIN cu u ON u.user_id=d.owner_id AND NOT u.is_deleted LEFT JOIN p USING (document_id) WHERE NOT d.is_deleted AND (d.owner_id=2 OR visibility='public')""", "cd cp cu")
def user_snapshot(spark, sf):
    d = C.corpus_documents(spark, sf).withColumn("updated_at", F.expr("sort_order * 37 % 101")).withColumn("sort_order", F.expr("sort_order % 20"))
    return merge.user_snapshot(d, C.corpus_pages(spark, sf), C.corpus_users(spark, sf), 2).withColumn("pages", F.expr("array_join(pages.page_id, ',')"))


@job("""WITH c AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id%9<>0 AND conv_id%3=1)
SELECT conv_id, 1 AS owner_id, CASE WHEN conv_id%4=0 THEN 'token-'||conv_id END AS token, CASE WHEN conv_id%4=0 THEN '0,2' END AS selected_turns, CAST(row_number() OVER (ORDER BY conv_id%10, conv_id*31%97 DESC, conv_id) AS INTEGER) AS position FROM c""")
def user_conversations(spark, sf):
    """Every third conversation is the user's; every fourth is shared, half of the others were."""
    c = C.table(spark, sf, "conversations").select("conv_id").distinct()
    headers = c.selectExpr("conv_id", "cast(conv_id % 3 AS int) AS owner_id", "conv_id % 9 = 0 AS is_deleted", "conv_id % 10 AS sort_order", "conv_id * 31 % 97 AS updated_at")
    shares = c.where("conv_id % 2 = 0").selectExpr("conv_id", "concat('token-', conv_id) AS token", "array(0, 2) AS selected_turns", "conv_id % 4 = 0 OR conv_id % 6 = 2 AS active", "conv_id % 4 <> 0 AS is_deleted")
    return merge.user_conversations(headers, shares, 1).withColumn("selected_turns", F.expr("array_join(transform(selected_turns, t -> cast(t AS string)), ',')"))


#: Public documents that user 4 may copy.
DUCK_COPIED = "pub AS (SELECT * FROM cd WHERE owner_id<>4 AND visibility='public' AND NOT is_deleted)"


@job(f"WITH {DUCK_COPIED} SELECT left(sha256('4:'||d.document_id),32) AS document_id, left(sha256('4:'||p.page_id),32) AS page_id, p.page_number, d.document_id AS source_document_id, 4 AS owner_id, CASE WHEN bool_and(coalesce(p.punctuated_text, '') <> '') OVER (PARTITION BY d.document_id) THEN 'complete' ELSE 'partial' END AS status FROM pub d JOIN cp p USING (document_id)", "cd cp")
def clone_documents(spark, sf):
    return merge.clone_documents(C.corpus_documents(spark, sf), C.corpus_pages(spark, sf), 4)


@job(f"""WITH {DUCK_COPIED}, t AS (SELECT document_id, bool_and(coalesce(punctuated_text, '') <> '') AS complete FROM cp GROUP BY 1)
SELECT left(sha256('4:'||d.document_id),32) AS document_id, 4 AS owner_id, 'private' AS visibility, d.title, d.document_id AS source_document_id, CASE WHEN sort_order%2=0 THEN 'maker '||sort_order ELSE u.name END AS creator, 'user 4' AS modifier, CASE WHEN complete THEN 'complete' ELSE 'partial' END AS status
FROM pub d JOIN cu u ON u.user_id = d.owner_id LEFT JOIN t USING (document_id)""", "cd cp cu")
def clone_headers(spark, sf):
    d = C.corpus_documents(spark, sf).withColumn("creator", F.expr("if(sort_order % 2 = 0, concat('maker ', sort_order), NULL)"))
    return merge.clone_headers(d, C.corpus_pages(spark, sf), C.corpus_users(spark, sf), 4)


@job(f"""WITH {DUCK_COPIED}, i AS (SELECT left(sha256('4:'||document_id),32) AS new, document_id FROM pub)
SELECT new||'::source' AS file_id, new AS document_id, NULL AS page_id, 'source' AS role, sha256(document_id) AS sha256, 10 AS size FROM i
UNION ALL SELECT new||':'||left(sha256('4:'||page_id),32)||':scan', new, left(sha256('4:'||page_id),32), 'scan', sha256(page_id), length(page_text) FROM i JOIN (SELECT p.*, coalesce(ocr_text, '') AS page_text FROM cp p) USING (document_id) WHERE page_number%5<>0""", "cd cp")
def clone_files(spark, sf):
    d, p = C.corpus_documents(spark, sf), C.corpus_pages(spark, sf)
    own = d.selectExpr("document_id", "cast(NULL AS string) AS page_id", "'source' AS role", "sha2(document_id, 256) AS sha256", "10 AS size", "false AS is_deleted")
    scans = p.selectExpr("document_id", "page_id", "'scan' AS role", "sha2(page_id, 256) AS sha256", "length(coalesce(ocr_text, '')) AS size", "page_number % 5 = 0 AS is_deleted")
    lost = p.selectExpr("document_id", "concat(page_id, '-gone') AS page_id", "'scan' AS role", "sha2(page_id, 256) AS sha256", "1 AS size", "false AS is_deleted")
    return merge.clone_files(d, p, own.union(scans).union(lost), 4)


@job("WITH r AS (SELECT user_id, CAST(props->>'$.k' AS INTEGER) AS k, ts, event_id, event_type, row_number() OVER (PARTITION BY user_id, CAST(props->>'$.k' AS INTEGER) ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, k, event_id, event_type FROM r WHERE n = 1 AND event_type <> 'error'")
def latest_by_key(spark, sf):
    r = C.table(spark, sf, "events").selectExpr("user_id", "cast(get_json_object(props, '$.k') AS int) AS k", "ts", "event_id", "event_type")
    return merge.latest_by_key(r, ["user_id", "k"], "ts", "event_id", "last.event_type <> 'error'").select("user_id", "k", "event_id", "event_type")


def _folders(spark, sf):
    f = C.table(spark, sf, "customer").selectExpr("c_nationkey AS owner_id", "c_custkey AS folder_id", "CASE c_custkey % 4 WHEN 0 THEN c_custkey WHEN 1 THEN NULL ELSE cast(c_custkey / 2 AS bigint) END AS parent_id", "concat(' folder ', c_custkey) AS name")
    m = C.table(spark, sf, "orders").selectExpr("o_custkey AS folder_id", "o_orderkey % 1000 AS document_id", "o_orderkey AS position").join(f.select("owner_id", "folder_id"), "folder_id")
    v = C.table(spark, sf, "documents").selectExpr("doc_id AS document_id")
    return merge.folder_tree(f, m, v)


@job("""WITH f AS (SELECT c_nationkey AS owner_id, c_custkey AS folder_id, 'folder '||c_custkey AS name, CASE WHEN c_custkey%4 IN (0, 1) THEN NULL ELSE c_custkey//2 END AS pid FROM customer)
SELECT f.owner_id, f.folder_id, f.name, p.folder_id AS parent_id FROM f LEFT JOIN f p ON f.owner_id = p.owner_id AND f.pid = p.folder_id""")
def folder_tree(spark, sf):
    return _folders(spark, sf)[0]


@job("""WITH RECURSIVE f AS (SELECT c_nationkey AS owner_id, c_custkey AS folder_id, 'folder '||c_custkey AS name, CASE c_custkey%4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE c_custkey//2 END AS pid FROM customer), t AS (SELECT f.owner_id, f.folder_id, f.name, p.folder_id AS parent_id FROM f LEFT JOIN f p ON f.owner_id=p.owner_id AND f.pid=p.folder_id),
m AS (SELECT owner_id, folder_id, document_id FROM (SELECT owner_id, folder_id, o_orderkey%1000 AS document_id, row_number() OVER (PARTITION BY owner_id, o_orderkey%1000 ORDER BY o_orderkey) AS n FROM orders JOIN t ON o_custkey=folder_id) WHERE n=1 AND document_id IN (SELECT doc_id FROM documents)),
up AS (SELECT owner_id, folder_id, folder_id AS anc, parent_id, 0 AS depth, name AS path FROM t UNION ALL SELECT u.owner_id, u.folder_id, t.folder_id, t.parent_id, u.depth+1, t.name||'/'||u.path FROM up u JOIN t ON u.owner_id=t.owner_id AND u.parent_id=t.folder_id),
own AS (SELECT DISTINCT c_nationkey AS owner_id, doc_id AS document_id FROM customer JOIN documents ON c_custkey % 1000 = doc_id % 150),
deep AS (SELECT owner_id, max(depth) + 1 AS height FROM up GROUP BY 1)
SELECT u.owner_id, anc AS folder_id, max(depth) AS height, CAST(coalesce(sum((SELECT count(*) FROM m WHERE m.owner_id=u.owner_id AND m.folder_id=u.folder_id)), 0) AS BIGINT) AS documents,
  (SELECT max(x.depth) FROM up x WHERE x.owner_id=u.owner_id AND x.folder_id=u.anc) AS depth, (SELECT max_by(x.path, x.depth) FROM up x WHERE x.owner_id=u.owner_id AND x.folder_id=u.anc) AS path, CAST(NULL AS BIGINT) AS unfiled FROM up u GROUP BY 1, 2
UNION ALL SELECT o.owner_id, NULL, max(coalesce(d.height, 0)), count(*), 0, '', count(*) FILTER (m.document_id IS NULL) FROM own o LEFT JOIN (SELECT DISTINCT owner_id, document_id FROM m) m USING (owner_id, document_id) LEFT JOIN deep d USING (owner_id) GROUP BY 1""")
def folder_rollup(spark, sf):
    tree, members = _folders(spark, sf)
    own = spark.sql("SELECT DISTINCT c.c_nationkey AS owner_id, d.doc_id AS document_id FROM {c} c JOIN {d} d ON c.c_custkey % 1000 = d.doc_id % 150", c=C.table(spark, sf, "customer"), d=C.table(spark, sf, "documents"))
    return merge.folder_rollup(tree, members, own).withColumn("path", F.array_join("path", "/"))


@job("SELECT doc_id AS file_id, CASE doc_id%4 WHEN 1 THEN 'missing' WHEN 2 THEN 'size' WHEN 3 THEN 'checksum' ELSE 'ok' END AS finding FROM documents WHERE doc_id%11<>0")
def integrity_report(spark, sf):
    d = C.table(spark, sf, "documents")
    files = d.selectExpr("doc_id AS file_id", "concat('f', doc_id) AS path", "if(doc_id % 4 = 3, 'other', sha2(text, 256)) AS sha256", "octet_length(text) + if(doc_id % 4 = 2, 1, 0) AS size", "doc_id % 11 = 0 AS is_deleted")
    return merge.integrity_report(files, d.where("doc_id % 4 <> 1").selectExpr("concat('f', doc_id) AS path", "encode(text, 'UTF-8') AS content"))


@job("SELECT DISTINCT 'order-customer' AS relation, CAST(o_custkey AS VARCHAR) AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT DISTINCT 'line-order', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey%100<>0)")
def orphan_check(spark, sf):
    o = C.table(spark, sf, "orders")
    return merge.orphan_check([("order-customer", o, "o_custkey", C.table(spark, sf, "customer"), "c_custkey"), ("line-order", C.table(spark, sf, "lineitem"), "l_orderkey", o.where("o_orderkey % 100 <> 0"), "o_orderkey")])


@job("SELECT event_id AS upload_id FROM events WHERE event_type <> 'purchase' AND epoch(ts) < (SELECT epoch(max(ts)) FROM events) - 86400")
def expired_uploads(spark, sf):
    e = C.table(spark, sf, "events")
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    now = e.selectExpr("cast(max(unix_micros(ts)) / 1000000D AS double) AS t").first()["t"]
    return merge.expired_uploads(e.selectExpr("event_id AS upload_id", "if(event_type = 'purchase', 'registered', 'open') AS status", "unix_micros(ts) / 1000000D AS updated_at"), now)


def _folder(spark) -> str:
    return shared_path(spark, "stream")


def _streamed(spark, df, where: str):
    """The rows as a file stream: written once to the shared folder, read as they lie there."""
    df.write.parquet(f"{where}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(f"{where}/in")


def _kept(spark, stream, where: str, mode: str) -> list[str]:
    """Run a stream to the end of its input; the folders of its batches in the shared folder, in order."""
    done = []

    def keep(batch, n):
        batch.write.mode("overwrite").parquet(f"{where}/out/{n}")
        done.append(f"{where}/out/{n}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return done


def _page_changes(spark, sf):
    """Three changes of pages: all as they are, then a third of them edited, a fifth deleted; not in order, and some twice."""
    p = C.corpus_pages(spark, sf)
    changes = query(
        """SELECT *, false AS is_deleted, 1 AS version FROM {p}
           UNION ALL SELECT page_id, document_id, page_number, concat(ocr_text, ' edited'), punctuated_text, notes, false, 2 FROM {p} WHERE page_number % 3 = 1
           UNION ALL SELECT page_id, document_id, page_number, ocr_text, punctuated_text, notes, true, 3 FROM {p} WHERE page_number % 5 = 2
           UNION ALL SELECT *, false, 1 FROM {p} WHERE page_number % 2 = 0""",
        p=p,
    )
    return changes.repartitionByRange(6, F.xxhash64("page_id", "version"))


@job()
def stream_index_pages(spark, sf):
    where = _folder(spark)
    streams.stream_index_pages(_streamed(spark, _page_changes(spark, sf), where), f"{where}/chunks", f"{where}/checkpoint").start().awaitTermination()
    return streams.indexed_chunks(spark, f"{where}/chunks")


@job("""WITH c AS (SELECT *, page_number%5 = 2 AS gone, CASE WHEN page_number%3=1 THEN ocr_text||' edited' ELSE ocr_text END AS ocr FROM cp)
SELECT page_id, CASE WHEN gone THEN 3 WHEN page_number%3=1 THEN 2 ELSE 1 END AS version, gone AS is_deleted,
  CAST(CASE WHEN gone THEN 0 ELSE CAST(trim(ocr, E' \\n\\t\\r') <> '' AS INTEGER) + CAST(trim(coalesce(punctuated_text, ''), E' \\n\\t\\r') <> '' AS INTEGER) + CAST(trim(notes, E' \\n\\t\\r') <> '' AS INTEGER) END AS BIGINT) AS sources,
  CAST(CASE WHEN gone THEN 0 ELSE CASE WHEN trim(ocr, E' \\n\\t\\r') <> '' THEN length(ocr) ELSE 0 END + CASE WHEN trim(coalesce(punctuated_text, ''), E' \\n\\t\\r') <> '' THEN length(punctuated_text) ELSE 0 END + CASE WHEN trim(notes, E' \\n\\t\\r') <> '' THEN length(notes) ELSE 0 END END AS BIGINT) AS characters FROM c""", "cp")
def stream_index_sources(spark, sf):
    """What the streamed index holds of each page: its version, its sources, and how far their chunks reach."""
    where = _folder(spark)
    streams.stream_index_pages(_streamed(spark, _page_changes(spark, sf), where), f"{where}/chunks", f"{where}/checkpoint").start().awaitTermination()
    return query(
        """SELECT v.page_id, v.version, v.is_deleted, count(s.source_hash) AS sources, coalesce(sum(s.reach), 0) AS characters FROM {v} v
           LEFT JOIN (SELECT page_id, source_layer, source_hash, max(end) AS reach FROM {c} GROUP BY page_id, source_layer, source_hash) s ON v.page_id = s.page_id GROUP BY v.page_id, v.version, v.is_deleted""",
        v=streams.indexed_versions(spark, f"{where}/chunks"),
        c=streams.indexed_chunks(spark, f"{where}/chunks"),
    )


@job("WITH e AS (SELECT DISTINCT 'd'||(user_id%20) AS document_id, user_id AS page_id, event_type AS stage FROM events WHERE event_type <> 'view') SELECT document_id, stage, count(*) AS done FROM e GROUP BY 1, 2")
def stream_stage_progress(spark, sf):
    where = _folder(spark)
    e = C.table(spark, sf, "events").selectExpr("concat('d', user_id % 20) AS document_id", "user_id AS page_id", "event_type AS stage", "if(event_type = 'view', 'running', 'done') AS status")
    last = _kept(spark, streams.stream_stage_progress(_streamed(spark, e, where)), where, "complete")
    return spark.read.parquet(last[-1])


@job()
def stream_latest_progress(spark, sf):
    e = C.table(spark, sf, "events").selectExpr("cast(user_id AS string) AS key", "cast(ts AS timestamp) AS at", "cast(value AS double) AS percent", "if(event_type = 'purchase', 'done', 'running') AS status")
    return latest_progress(spark, e)


def latest_progress(spark, e):
    """The latest progress of each key, replayed through the stream; files come in any order, so the watermark waits for the whole range of times."""
    where = _folder(spark)
    seconds = e.selectExpr("cast(ceil((max(unix_micros(at)) - min(unix_micros(at))) / 1000000) AS long) + 1 AS s").first()["s"] or 1
    batches = _kept(spark, streams.stream_latest_progress(_streamed(spark, e, where), f"{seconds} seconds"), where, "update")
    return spark.read.parquet(*batches).where("NOT expired").groupBy("key").agg(F.max_by("percent", "at").alias("percent"), F.max("at").alias("at"))
