"""Scopes, sweeps, shelf search and vector cells against the slow way."""

import random
import time

import numpy as np
import pytest

from quire.operators import retrieve, scope, text


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sweep", [1, 7, 4096])
def test_sweep_equals_the_pairs(spark, monkeypatch, sweep):
    monkeypatch.setattr(scope, "SWEEP", sweep)
    rng = random.Random(sweep)
    hits = [(rng.randrange(3), f"p{rng.randrange(4)}", rng.choice("ab"), i, s := rng.randrange(60), s + rng.randrange(0, 25), None) for i in range(300)]
    ranges = [(rng.randrange(3), f"p{rng.randrange(4)}", rng.choice("ab"), s := rng.randrange(60), s + rng.randrange(0, 6)) for _ in range(40)]
    hits += [(1, "p1", "a", 900, None, 5, "x"), (9, "p9", "a", 901, 1, 2, None)]
    s = spark.createDataFrame(hits, "query_id int, page_id string, source_layer string, hit int, start int, end int, extra string")
    l = spark.createDataFrame(ranges, "query_id int, page_id string, source_layer string, match_start int, match_end int")
    want = {h[3] for h in hits if h[4] is None or not any(r[:3] == h[:3] and r[3] < h[5] and r[4] > h[4] for r in ranges)}
    found = scope.suppress_overlaps(s, l)
    assert found.columns == s.columns
    assert sorted(r.hit for r in found.collect()) == sorted(want)
    assert scope.suppress_overlaps(s, l.limit(0)).count() == len(hits) and scope.suppress_overlaps(s.limit(0), l).count() == 0


def test_a_page_of_a_million_ranges(spark):
    hits = spark.range(500_000).selectExpr("1 AS query_id", "'p' AS page_id", "'o' AS source_layer", "id * 3 AS start", "id * 3 + 2 AS end")
    ranges = spark.range(500_000).selectExpr("1 AS query_id", "'p' AS page_id", "'o' AS source_layer", "id * 6 + 1 AS match_start", "id * 6 + 3 AS match_end")
    began = time.time()
    assert scope.suppress_overlaps(hits, ranges).count() == 250_000
    assert time.time() - began < 120


def test_bitmaps_hold_what_the_expanded_scope_does(spark):
    rng = random.Random(3)
    d = spark.createDataFrame([(f"d{i}", rng.randrange(1, 6), rng.choice(("public", "private")), rng.random() < 0.1) for i in range(60)], "document_id string, owner_id int, visibility string, is_deleted boolean")
    p = spark.createDataFrame([(f"d{i}-p{k}", f"d{i}", k) for i in range(62) for k in range(rng.randrange(0, 6))], "page_id string, document_id string, page_number int")
    u = spark.createDataFrame([(i, i == 4) for i in range(1, 6)], "user_id int, is_deleted boolean")
    r = spark.createDataFrame([(q, rng.randrange(1, 7), rng.choice((None, [], [f"d{rng.randrange(60)}" for _ in range(5)], ["d1", "d1", "d2"]))) for q in range(25)], "query_id int, user_id int, document_ids array<string>")
    seen = {(x.query_id, x.page_id) for x in scope.visible_scope(r, p, d, u).collect()}
    rows = r.select("query_id").crossJoin(p.select("page_id")).selectExpr("query_id", "page_id", "1 AS mark")
    numbered, bits = scope.scope_bitmaps(p, d, u)
    probed = scope.probe_scopes(rows, r, numbered, bits)
    assert probed.columns == rows.columns
    for found in (probed, scope.visible_rows(rows, r, p, d, u)):
        pairs = [(x.query_id, x.page_id) for x in found.collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == seen
    assert {x.query_id: x.pages for x in scope.visible_page_counts(r, numbered, bits).collect()} == {q: sum(a == q for a, _ in seen) for q in range(25)}
    # public pages are held once, whatever the requests
    assert bits.where("scope = 'public'").count() == 1
    assert scope.visible_page_counts(r, *scope.scope_bitmaps(p.limit(0), d, u)).agg({"pages": "sum"}).first()[0] == 0


def test_shelf_search_equals_a_look_at_every_document(spark):
    rng = random.Random(8)
    words = ["title", "Straße", "ＡＢＣ", "x", "ab", "甲乙", "甲乙丙丁", "1900", "ﬁsh", ""]
    shelves = [(f"d{i}", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 6))), rng.choice(words) or None) for i in range(120)]
    asked = [(q, " ".join(rng.choice([*words, "tle", "b", "缺", "fi", "abc", "FISH"]) for _ in range(rng.randrange(0, 4)))) for q in range(60)] + [(90, None), (91, "　 ")]
    d = spark.createDataFrame(shelves, "document_id string, title string, author string")
    w = spark.createDataFrame(asked, "query_id int, query string")
    import unicodedata

    fold = lambda t: unicodedata.normalize("NFKC", t).lower()
    want = {(q, i) for q, x in asked if x is not None for i, a, b in shelves if all(t in fold(f"{a}\n{b if b is not None else '-'}") for t in fold(x).split())}
    found = text.shelf_search(d, w, ["title", "author"])
    pairs = [tuple(r) for r in found.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    assert "NestedLoop" not in _plan(found) and "Cartesian" not in _plan(found)


def test_cells_find_what_a_full_scan_finds(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 24)) * 3
    data = [(i, (centres[i % 12] + rng.normal(size=24) * 0.6).tolist()) for i in range(1500)] + [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, [1.0]), (5004, (centres[0]).tolist()), (5005, (centres[0]).tolist())]
    v = spark.createDataFrame(data, "chunk_id long, vector array<double>")
    wanted = spark.createDataFrame([(q, (centres[q % 12] + rng.normal(size=24)).tolist()) for q in range(30)] + [(77, rng.normal(size=24).tolist())], "query_id long, vector array<double>")
    cells = retrieve.vector_cells(v, 24)
    for threshold, k in ((0.45, 60), (0.9, 5), (-1.0, 3), (0.8, None)):
        whole = {(r.query_id, r.chunk_id, r["rank"], round(r.score, 9)) for r in retrieve.semantic_topk(v, wanted, threshold, k).collect()}
        assert {(r.query_id, r.chunk_id, r["rank"], round(r.score, 9)) for r in retrieve.semantic_topk_cells(cells, wanted, threshold, k).collect()} == whole
    told = cells.skipped(wanted, 0.8).agg({"skipped": "sum", "cells": "sum", "vectors_skipped": "sum", "vectors": "sum"}).first().asDict()
    assert told["sum(skipped)"] > 0.5 * told["sum(cells)"] and told["sum(vectors_skipped)"] > 0.5 * told["sum(vectors)"]
    assert retrieve.semantic_topk_cells(retrieve.vector_cells(v.limit(0)), wanted).count() == 0


def test_scores_fold_case_and_script(spark):
    from quire.functions.kernels import WordConverter
    from quire.plans.text_jobs import TABLES

    texts = spark.createDataFrame([(1, "頭髮 很長"), (2, "ﬁne STRAẞE ΌΣΟΣ"), (3, "nothing"), (4, None)], "page_id int, text string")
    asked = spark.createDataFrame([(1, "头发"), (2, "FINE straße"), (3, "όσος"), (4, " "), (5, None)], "query_id long, query string")
    found = {(r.query_id, r.page_id): r.literal_score for r in retrieve.literal_score(texts, asked, "page_id", WordConverter(*TABLES["simplified"])).collect()}
    assert {k for k, v in found.items() if v > 5} == {(1, 1), (2, 2), (3, 2)}
    assert (1, 1) not in {(r.query_id, r.page_id) for r in retrieve.literal_score(texts, asked, "page_id").collect()}
