"""What came up on larger tables, in small."""

import os

import duckdb
import pytest

from quire.functions import kernels, staging
from quire.functions.literal import Joined, RequestMatcher, mark_for
from quire.operators import outline, retrieve, search, text
from quire.plans import answer_jobs, search_jobs  # noqa: F401
from quire.plans.registry import ORACLES, QUERIES
from quire.streaming import streams


@pytest.fixture(scope="module")
def addressed(spark, tmp_path_factory):
    """Documents with lines that begin with a number: an address, a telephone number, a list."""
    where = str(tmp_path_factory.mktemp("addressed"))
    lines = ["Plain words.", "10.20.3.4 Ent hal.", "(555) 123-4567 ab", "", "3. item", "  1.2 deep \t"]
    rows = [(i, "\n".join(lines[(i + k) % 6] for k in range(60)), "en", "web") for i in range(6)] + [(6, "10.0.0.1 one", "en", "web"), (7, " \n\t", "en", "web"), (8, None, "en", "web")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{where}/documents.parquet")
    second = duckdb.connect()
    second.execute(f"CREATE VIEW documents AS SELECT * FROM '{where}/documents.parquet/*.parquet'")
    return where, second


def _same(spark, addressed, name):
    where, second = addressed
    found = sorted(tuple(r) for r in QUERIES[name](spark, where).collect())
    assert found and found == sorted(second.execute(ORACLES[name]).fetchall())


def test_lines_that_begin_with_a_number_are_no_made_headings(spark, addressed):
    _same(spark, addressed, "classify_headings")
    # the operator itself keeps the rules of headings
    page = spark.createDataFrame([("p", "d", 1, "10.20.3.4 Ent hal.\nwords")], "page_id string, document_id string, page_number int, text string")
    assert [r.family for r in outline.classify_headings(page).orderBy("line").collect()] == ["multi_level", None]


def test_outlines_count_made_headings_alone(spark, addressed):
    _same(spark, addressed, "outline_coverage")
    _same(spark, addressed, "toc_pages")


def test_hits_of_one_place_are_chosen_by_level(spark):
    """The same choice whatever the order of rows; places without a number come last, as in the SQL."""
    rows = [(1, "p", "s", level, "7-1") for level in ("semantic", "partial")] * 3 + [(2, "p", "s", "partial", None), (2, "p", "s", "semantic", "9-1")]
    for order in (rows, rows[::-1]):
        h = spark.createDataFrame(order, "query_id int, source_id string, sentence string, level string, ordinal string")
        assert sorted(tuple(r) for r in retrieve.dedupe_sentence_hits(h.coalesce(1)).collect()) == [(1, "p", "s", "partial", "7-1"), (2, "p", "s", "semantic", "9-1")]


def test_shelf_search_sends_no_list_to_all_tasks(spark):
    """What grows with the documents is joined by a shuffle, whatever size Spark takes it for."""
    documents = spark.range(3000).selectExpr("concat('d', id) AS document_id", "concat('title ', id) AS title")
    wanted = spark.range(40).selectExpr("id AS query_id", "concat('title ', id) AS query")
    found = text.shelf_search(documents, wanted, ["title"])
    pairs = {(r.query_id, r.document_id) for r in found.collect()}
    assert pairs == {(q, f"d{i}") for q in range(40) for i in range(3000) if str(q) in str(i)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan and "strategy=broadcast" in plan


def test_joined_texts_give_what_each_gives(spark):
    """Places, sentences and holders of joined texts, and no place across two of them."""
    texts = ["the cat. A", "at the ca", "t", "", " .\n\n the cat！” aa aaa", "甲乙丙 X9 x9"]
    asked = ["the cat", "aa", "A", "at", "cat", "甲丙", "X9", "", "\U0010fffd"]
    matcher, own = RequestMatcher(asked), Joined(texts, mark_for(asked))
    of, a, b, partial = matcher.places(own)
    n = own.number(a)
    s, e = kernels.excerpts(own, a, b)
    got = [tuple(map(int, x)) for x in zip(n, of, a - own.begin[n], b - own.begin[n], partial, s - own.begin[n], e - own.begin[n])]
    want = [(i, q, x, y, int(level == "partial"), *kernels.excerpt(t, x, y)) for i, t in enumerate(texts) for q, found in RequestMatcher(asked).matches(t) for x, y, level in found]
    assert got == want and len(want) > 10
    holds = [(i, q) for i, t in enumerate(texts) for q, w in enumerate(asked) if w and w in t]
    assert sorted(zip(*(x.tolist() for x in matcher.holders(own)))) == holds
    sources = spark.createDataFrame([(f"p{i}", "ocrText", "h", t) for i, t in enumerate(texts)], "page_id string, source_layer string, source_hash string, text string")
    shown = retrieve.match_text(sources, spark.createDataFrame(list(enumerate(asked)), "query_id long, query string"))
    assert "Join" not in shown._jdf.queryExecution().optimizedPlan().toString()
    rows = {(r.page_id, r.query_id, r.match_start): (r.text, r.sentence) for r in shown.collect()}
    assert rows == {(f"p{i}", q, x): (texts[i][max(0, x - 160) : y + 240], texts[i][s:e]) for i, q, x, y, _, s, e in want}


@pytest.mark.parametrize("name", ["full_search", "reader_search"])
def test_searches_write_nothing_and_deal_hits_once(spark, monkeypatch, name):
    """Hits are worked out in the rows of pages: no table of them is written, and two shuffles of pages and hits suffice."""
    monkeypatch.setattr(search, "staged", lambda df, what: pytest.fail(f"wrote {what}"))
    found = QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 2 and "query_id" in plan
    assert found.count() > 1000


def test_coverage_reads_pages_without_searching_them(spark, monkeypatch):
    monkeypatch.setattr(search, "full_search", lambda *a, **b: pytest.fail("searched"))
    found = {r.query_id: r for r in QUERIES["search_coverage"](spark, "/root/testdata/sf0.001").collect()}
    assert any(r.total_pages for r in found.values()) and all(r.total_pages == r.indexed_pages and not r.pending_pages for r in found.values())
    # a chunk without a vector leaves its page pending, or failed
    pages = spark.createDataFrame([("a", "d", 1, "one", "", ""), ("b", "d", 2, "two", "", ""), ("c", "d", 3, "three", "", "")], "page_id string, document_id string, page_number int, ocr_text string, punctuated_text string, notes string")
    documents, users = spark.createDataFrame([("d", 1, "public", False)], "document_id string, owner_id int, visibility string, is_deleted boolean"), spark.createDataFrame([(1, False)], "user_id int, is_deleted boolean")
    asked = spark.createDataFrame([(1, 1, "one", None), (2, 1, "one", [])], "query_id long, user_id int, query string, document_ids array<string>")
    part = lambda texts: [[1.0, 2.0] if t == "one" else None for t in texts]
    counted = search.search_coverage(pages, documents, users, asked, part, 2, spark.createDataFrame([("b",), ("a",)], "page_id string"))
    assert sorted(tuple(r) for r in counted.collect()) == [(1, 3, 1, 1, 1), (2, 0, 0, 0, 0)]


def test_many_chunks_at_one_place_stay_a_small_group(spark, monkeypatch):
    """50,000 chunks beside a hit: the least ids that are not taken yet, and few rows are settled."""
    hits = spark.createDataFrame([(1, 1, "h1", "p", "o", 5, 2.0), (1, 2, "h2", "q", "o", 1, 1.0), (1, 3, "c00001", "r", "o", 9, 0.5)], "query_id int, position int, chunk_id string, page_id string, source_layer string, ordinal int, score double")
    chunks = spark.range(50_000).selectExpr("concat('c', lpad(id, 5, '0')) AS chunk_id", "'p' AS page_id", "'o' AS source_layer", "cast(4 + id % 2 * 2 AS int) AS ordinal")
    sizes = spark.sparkContext.accumulator(0)
    whole = type(hits.groupBy("query_id")).applyInPandas

    def counted(self, f, schema):
        def settle(pdf):
            sizes.add(len(pdf))
            return f(pdf)

        return whole(self, settle, schema)

    monkeypatch.setattr(type(hits.groupBy("query_id")), "applyInPandas", counted)
    found = [(r.chunk_id, r.how) for r in retrieve.diversify_chronicle(hits, chunks.union(chunks), 6).orderBy("position").collect()]
    assert found == [("h1", "hit"), ("h2", "hit"), ("c00001", "hit"), ("c00000", "neighbor"), ("c00002", "neighbor")]
    assert sizes.value <= 100  # read twice for the order at the end


def test_taken_changes_are_not_left_on_disk(spark, tmp_path):
    """A batch's changes are written once and go when the index has them."""
    there = lambda: {p for p in os.listdir(staging._local_folder()) if p.startswith("page-changes")}
    before, kept = there(), streams.PageIndex(spark, f"{tmp_path}/index", 2)
    schema = "page_id string, document_id string, page_number int, ocr_text string, punctuated_text string, notes string, is_deleted boolean, version int"
    row = lambda page, text, gone, version: (page, "d", 1, text, text, "", gone, version)
    assert kept.apply(spark.createDataFrame([row("a", "one", False, 1), row("b", "two", False, 1), row("c", "three", False, 2)], schema)) == 3
    assert kept.apply(spark.createDataFrame([row("a", "one", False, 2), row("b", "other", False, 2), row("c", "old", False, 1)], schema)) == 2
    assert kept.apply(spark.createDataFrame([row("a", "gone", True, 3), row("c", "old", False, 2)], schema)) == 1
    assert kept.apply(spark.createDataFrame([row("a", "late", False, 2)], schema)) == 0
    assert there() == before
    assert sorted((r.page_id, r.source_layer, r.chunk_text) for r in kept.read("chunks").collect()) == [(p, x, t) for p, t in (("b", "other"), ("c", "three")) for x in ("ocrText", "punctuatedText")]
    assert sorted((r.page_id, r.version) for r in kept.read("versions").collect()) == [("a", 3), ("b", 2), ("c", 2)]


def test_sources_are_told_in_the_row_of_their_page(spark):
    pages = spark.createDataFrame([("a", "d", 1, "one", "One.", " "), ("b", "d", 2, " ", None, "note")], "page_id string, document_id string, page_number int, ocr_text string, punctuated_text string, notes string")
    for policy, reader, want in (("primary", False, [("a", "ocrText", False), ("a", "punctuatedText", True)]), ("primary", True, [("a", "punctuatedText", True)]), ("processed", False, [("a", "punctuatedText", True)])):
        found = search.search_sources(pages, policy, reader)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert sorted((r.page_id, r.source_layer, r.is_primary) for r in found.collect()) == want
