"""Registered queries against a second engine on the smallest tables, and edge cases of single jobs."""

import datetime
import math
import os

import duckdb
import pytest

from quire.operators import evidence, merge, outline, retrieve, scope, text
from quire.plans import answer_jobs, search_jobs, store_jobs, text_jobs  # noqa: F401
from quire.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def second():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, (str, bool, int)):
        return v
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()[:19]
    f = float(v)
    return None if math.isnan(f) else int(f) if f == int(f) else round(f, 6)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, second, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        return
    found = second.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in df.columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in rows), key=repr) == theirs


def test_visible_scope_leaks_nothing(spark):
    d = spark.createDataFrame([("a", 1, "private", False), ("b", 2, "public", False), ("c", 2, "private", False), ("d", 3, "public", False), ("e", 1, "public", True)], "document_id string, owner_id int, visibility string, is_deleted boolean")
    p = d.selectExpr("concat(document_id, '1') AS page_id", "document_id", "1 AS page_number")
    u = spark.createDataFrame([(1, False), (2, False), (3, True)], "user_id int, is_deleted boolean")
    r = spark.createDataFrame([(1, 1, None), (2, 2, ["a", "b"]), (3, 1, [])], "query_id int, user_id int, document_ids array<string>")
    assert sorted((x.query_id, x.document_id) for x in scope.visible_scope(r, p, d, u).collect()) == [(1, "a"), (1, "b"), (2, "b")]


def test_citations_and_numbers(spark):
    e = spark.createDataFrame([(1, "c", "say it, say it", 10, "ocrText")], "answer_id int, chunk_id string, text string, start int, source_layer string")
    q = spark.createDataFrame([(1, 1, "c", "say it"), (1, 2, "c", "no"), (1, 3, "x", "say"), (1, 4, "c", " ")], "answer_id int, position int, chunk_id string, quote string")
    found = {r.position: (r.valid, r.start, r.end) for r in evidence.validate_citations(q, e).collect()}
    assert found == {1: (True, 10, 16), 2: (False, None, None), 3: (False, None, None), 4: (False, None, None)}


def test_folder_cycles(spark):
    f = spark.createDataFrame([(1, i, p, f" n{i} ") for i, p in [(1, 1), (2, 3), (3, 2), (4, 5), (5, 6), (6, 4), (7, 99), (8, 7), (9, 2)]], "owner_id int, folder_id int, parent_id int, name string")
    m = spark.createDataFrame([(1, 8, 5, 2), (1, 7, 5, 1)], "owner_id int, folder_id int, document_id int, position int")
    tree, first = merge.folder_tree(f, m, m.select("document_id"))
    parents = {r.folder_id: r.parent_id for r in tree.collect()}
    assert parents == {1: None, 2: None, 3: 2, 4: None, 5: 6, 6: 4, 7: None, 8: 7, 9: 2}
    assert [(r.folder_id, r.document_id) for r in first.collect()] == [(7, 5)]


def test_rrf_and_caps_ignore_input_order(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1)], "query_id int, chunk_id string, rank int")
    one = [(r.chunk_id, r.matched_by) for r in retrieve.rrf_fuse(a, b).orderBy("position").collect()]
    assert one == [("y", "literal,semantic"), ("x", "literal")]


def test_outline(spark):
    rows = [("d", "p1", 1, "第一卷\nyears\n𠀀 text"), ("d", "p2", 2, "第一章 start"), ("d", "p3", 3, "第一章 start\n一、a\n二、b"), ("d", "p4", 4, "目 录\n第九章")]
    pages = spark.createDataFrame(rows, "document_id string, page_id string, page_number int, text string")
    items = outline.build_outline(outline.classify_headings(pages), pages).orderBy("item").collect()
    assert [(r.title, r.level, r.page_id) for r in items] == [("第一卷 years", 1, "p1"), ("第一章 start", 2, "p2")]


def test_generated_text(spark):
    df = spark.createDataFrame([("a b\nc\n\n\n\n甲\n乙",), (None,), ("x\\ny",)], "t string")
    from pyspark.sql import functions as F

    assert [r.t for r in df.select(text.normalize_generated_text(F.col("t")).alias("t")).collect()] == ["a b c\n\n甲乙", "", "x y"]


def test_whole_queries_answer_every_request(spark, second):
    import numpy as np

    rows = second.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    x = np.array([r[1] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for i, (q, _) in enumerate(rows):
        if q % 100 == 0:
            want[q] = sorted(((round(s, 6), r[0]) for s, r in zip((x @ x[i]).tolist(), rows) if s > 0.45), reverse=True)[:60]
    found = {}
    for r in QUERIES["semantic_topk"](spark, SF).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((round(r.score, 6), r.chunk_id))
    assert {q: len(v) for q, v in found.items()} == {q: len(v) for q, v in want.items()} and len(want) > 1
    assert {q: {c for _, c in v} for q, v in found.items()} == {q: {c for _, c in v} for q, v in want.items()}
    fused = {r.query_id for r in QUERIES["rrf_fuse"](spark, SF).collect()}
    assert fused >= set(want)
    summary = {r.query_id: r["mode"] for r in QUERIES["retrieval_summary"](spark, SF).collect()}
    items = {r[0] for r in second.execute("SELECT item_id FROM benchmark").fetchall()}
    assert set(summary) == items and {q for q, m in summary.items() if m == "hybrid"} == {q // 100 for q in want} & items
    asked = {r.query_id for r in QUERIES["match_text"](spark, SF).select("query_id").distinct().collect()}
    assert {q % 3 for q in asked} == {0, 1, 2}


def test_requests_beyond_one_block_are_answered(spark, monkeypatch):
    from quire.functions import staging

    texts = spark.createDataFrame([(f"p{i}", "ocrText", "h", f"w{i} common tail") for i in range(8)], "page_id string, source_layer string, source_hash string, text string")
    asked = spark.createDataFrame([(i, f"w{i}", i % 3) for i in range(8)] + [(9, "common", 1)], "query_id long, query string, user_id int")
    vectors = spark.createDataFrame([(i, [float(i == j) + 0.3 for j in range(8)]) for i in range(8)], "chunk_id long, vector array<double>")
    documents = texts.selectExpr("page_id AS document_id", "1 AS owner_id", "if(page_id < 'p4', 'public', 'private') AS visibility", "false AS is_deleted", "text AS title")
    pages = texts.selectExpr("page_id", "page_id AS document_id", "1 AS page_number")
    users = spark.createDataFrame([(1, False)], "user_id int, is_deleted boolean")

    def answers():
        found = [
            retrieve.literal_matches(texts, asked),
            retrieve.literal_score(texts, asked, "page_id"),
            retrieve.semantic_topk(vectors, vectors.withColumnRenamed("chunk_id", "query_id"), 0.0, 5),
            scope.visible_scope(asked.selectExpr("query_id", "user_id", "cast(null AS array<string>) AS document_ids"), pages, documents, users),
            text.shelf_search(documents, asked, ["title"]),
        ]
        return [sorted(map(tuple, df.collect()), key=repr) for df in found]

    whole = answers()
    assert all(whole)
    monkeypatch.setattr(staging, "MOST_REQUESTS", 4)
    assert answers() == whole


def test_stream_latest_progress_keeps_early_files(spark):
    from pyspark.sql import functions as F

    # sixteen files, the latest events written first; keys without later events are in the last files alone
    rows = spark.range(400).selectExpr("cast(id % 100 + 100 * (id div 200) AS string) AS key", "timestamp_seconds(1700000000 + id * 600) AS at", "cast(id % 90 AS double) AS percent", "'running' AS status")
    e = rows.repartitionByRange(16, F.desc("at"))
    want = sorted((r.key, int(r.percent), r.at) for r in rows.groupBy("key").agg(F.max_by("percent", "at").alias("percent"), F.max("at").alias("at")).collect())
    assert sorted((r.key, r.percent, r.at) for r in store_jobs.latest_progress(spark, e).collect()) == want


def test_folders_that_only_lead_into_a_cycle_keep_their_parents(spark):
    f = spark.createDataFrame([(1, i, p, f"n{i}") for i, p in [(9, 1), (1, 5), (5, 6), (6, 5), (20, 21), (21, 22), (22, 20), (3, 22), (30, 31), (31, None)]] + [(2, 5, 6, "x"), (2, 6, None, "y"), (1, 9, 7, "again")], "owner_id int, folder_id int, parent_id int, name string")
    m = spark.createDataFrame([], "owner_id int, folder_id int, document_id int, position int")
    tree, _ = merge.folder_tree(f, m, m.select("document_id"))
    found = {(r.owner_id, r.folder_id): r.parent_id for r in tree.collect()}
    # the way up from folder 1 meets its cycle at 5, that from 3 at 22
    assert found == {(1, 9): 1, (1, 1): 5, (1, 5): None, (1, 6): 5, (1, 20): 21, (1, 21): 22, (1, 22): None, (1, 3): 22, (1, 30): 31, (1, 31): None, (2, 5): 6, (2, 6): None}


def test_marks_follow_the_order_of_citation(spark):
    claims = spark.createDataFrame([(1, 1, " first "), (1, 2, "second"), (1, 3, "none"), (2, 1, "lost")], "answer_id int, position int, claim string")
    cited = spark.createDataFrame([(1, 1, 1, "b"), (1, 1, 2, "a"), (1, 2, 1, "a"), (1, 2, 2, "c"), (1, 2, 3, "a")], "answer_id int, position int, ordinal int, source_id string")
    found = {r.answer_id: r.text for r in evidence.number_claims(claims, cited).collect()}
    assert found == {1: "first [1][2]\n\nsecond [2][3][2]", 2: evidence.NO_CLAIM}


def test_search_sees_only_what_a_user_may_see(spark):
    texts = spark.createDataFrame([("p1", "the red fox", "", 1, False), ("p2", "the red fox", "", 2, False), ("p3", "a red hen", "fox", 2, True), ("p4", None, "red fox", 1, True), ("p5", "", "", 1, True)], "page_id string, text string, described string, owner_id int, is_public boolean")
    asked = spark.createDataFrame([(1, "red fox", 1), (2, "red fox", 2), (3, "red fox", 3)], "query_id long, query string, user_id int")
    found = {}
    for r in retrieve.literal_best(texts, asked, "page_id", 3).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.page_id)
    assert found == {1: ["p1", "p4", "p3"], 2: ["p2", "p4", "p3"], 3: ["p4", "p3"]}
    vectors = spark.createDataFrame([("a", [1.0, 0.0], 1, False), ("b", [1.0, 0.1], 2, True)], "chunk_id string, vector array<double>, owner_id int, is_public boolean")
    wanted = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 2)], "query_id long, vector array<double>, user_id int")
    assert sorted((r.query_id, r.chunk_id) for r in retrieve.semantic_topk(vectors, wanted).collect()) == [(1, "a"), (1, "b"), (2, "b")]


def test_hybrid_search_keeps_scope_and_caps(spark):
    from quire.plans import search_jobs
    from quire.sources import corpus

    found = QUERIES["hybrid_search"](spark, SF).collect()
    live = {r.page_id: r for r in scope.live_pages(*search_jobs._corpus(spark, SF)[1::-1], search_jobs._corpus(spark, SF)[2]).collect()}
    user = {r.query_id: r.user_id for r in corpus.requests(spark, SF).collect()}
    pages, places = {}, {}
    for r in found:
        assert live[r.page_id].visibility == "public" or live[r.page_id].owner_id == user[r.query_id]
        pages[r.query_id, r.page_id] = pages.get((r.query_id, r.page_id), 0) + 1
        places.setdefault(r.query_id, []).append(r.position)
    assert max(pages.values()) <= retrieve.PAGE_CAP and all(sorted(p) == list(range(1, len(p) + 1)) and len(p) <= 30 for p in places.values())
    assert {m for r in found for m in r.matched_by.split(",")} == {"literal", "semantic"}
