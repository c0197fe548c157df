"""The training-data operators on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import embedding_dedup, fingerprints, langid, lm_scoring, mixing, ngram_join, packing, sstable, toxicity, url_filters
from quire.llm.queries import RULES, _tokenizer

EN = "the quick brown fox jumps over the lazy dog and runs away with all of them"
DE = "über die größten Häuser der Straße läuft schöner Regen für müde Vögel nach Süden"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double"


def rows():
    rng = np.random.default_rng(1)
    out = []
    for i in range(120):
        base = (EN if i % 2 else DE).split()
        words = [base[j] for j in rng.integers(0, len(base), 30 + i % 7)]
        if i % 5 == 1:
            words.insert(3, "idiotic")
        out.append((i, " ".join(words), "en" if i % 2 else "de", f"s{i % 3}", 0, 0, 0.0))
    long = " ".join(f"w{i}" for i in range(9000))
    extra = [(200, None, None, None, None, None, None), (201, "", "en", None, 0, 0, 0.0), (202, " \t\n", None, "s0", 0, 0, 0.0), (203, long, "en", "s1", 0, 0, 0.0), (204, out[7][1], "en", "s1", 0, 0, 0.0), (205, long + " end", None, "s1", 0, 0, 0.0), (206, "one two", "en", "s2", 0, 0, 0.0), (207, "ONE two", "en", "s2", 0, 0, 0.0), (208, "\x1f\xa0 x　y", "en", "s2", 0, 0, 0.0), (206, "one two", "en", "s2", 0, 0, 0.0)]
    return out + extra


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(_tokenizer())
    return lambda text, end: np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_packing(docs, empty, ids):
    found = packing.pack(docs, _tokenizer(), 2048).collect()
    want = Counter((i, p, len(x[s : s + 2048]), zlib.crc32(x[s : s + 2048].tobytes())) for i, t, *_ in rows() for x in [ids(t, 0)] for p, s in enumerate(range(0, len(x), 2048)))
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in found) == want
    bins = {}
    for r in sorted(found, key=lambda r: r.offset):
        assert bins.setdefault(r.sequence_id, 0) == r.offset
        bins[r.sequence_id] += r.length
    total = sum(r.length for r in found)
    assert max(bins.values()) <= 2048 and len(bins) <= total / 2048 * 1.1 + 1
    assert packing.pack(empty, _tokenizer()).count() == 0


def test_best_fit():
    fit = packing.BestFit(10, bins=2)
    assert [fit.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert fit.place(5) == (2, 0) and fit.place(6) == (3, 0) and fit.place(9) == (4, 0)


def test_sstable(spark, docs, empty, ids):
    manifest = sstable.write_shards(docs, _tokenizer(), shards=3)
    found = sorted(sstable.read_shards(spark, manifest).collect(), key=lambda r: r.start)
    want = sorted(((i, ids(t, 1)) for i, t, *_ in rows()), key=lambda x: x[0])
    assert [r.doc_id for r in found] == [i for i, _ in want]
    start = 0
    for r in found:
        assert r.start == start
        start += r.n_tokens
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in want)
    got = sstable.lookup(manifest, [203, 206, 999]).collect()
    assert sorted(r.doc_id for r in got) == [203, 206, 206]
    assert next(r.ids for r in got if r.doc_id == 203) == ids(rows()[123][1], 1).tolist()
    assert sstable.read_shards(spark, sstable.write_shards(empty, _tokenizer())).count() == 0


def test_mixing(docs, empty):
    found = mixing.decide(docs).select("doc.*", "size", "source_size", "target", "copies").toDF(*[f"c{i}" for i in range(7)], "words", "source_size", "target", "copies").collect()
    assert len(found) == len(rows())
    by = {}
    for r in found:
        assert 0 <= r.copies <= 2
        assert r.words == len(re.findall(r"[^\x20\x09-\x0D]+", r.c1 or ""))
        s = by.setdefault(r.c3, [0, 0, r.target, 0])
        s[0] += r.words
        s[1] += r.words * r.copies
        s[3] = max(s[3], r.words)
    assert abs(sum(s[2] for s in by.values()) - 1.5 * sum(s[0] for s in by.values())) < 1e-6
    assert all(s[2] <= 2 * s[0] + 1e-9 and abs(s[1] - s[2]) <= s[3] for s in by.values())
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("k, threshold", [(3, (90, 100)), (5, (80, 100)), (1, (50, 100))])
def test_ngram_join(spark, docs, empty, k, threshold):
    num, den = threshold
    found = ngram_join.similar_components(docs, k, threshold).collect()
    sets = {}
    for i, t, *_ in rows():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    for _ in range(len(sets)):
        before = dict(label)
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == Counter((i, len(sets[i]), label[i]) for i, *_ in rows())
    assert ngram_join.similar_components(empty, k, threshold).count() == 0


def test_near_copies_in_one_group(spark):
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(w if j != 7 * i % 400 else f"x{i}" for j, w in enumerate(base)) for i in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.component_id for r in ngram_join.similar_components(df).collect()} == {0}


def test_lm_scoring(docs, empty):
    found = lm_scoring.scored(docs).collect()
    tokens = [(i, [*(t or "").encode().lower().split(), b"\n"]) for i, t, *_ in rows()]
    count = Counter(w for i, ws in tokens if zlib.crc32(str(i).encode()) % 10 for w in ws)
    total, kinds = sum(count.values()), len(count)
    want = Counter((i, len(ws), sum(count[w] > 0 for w in ws), total, round(sum(np.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws), 4)) for i, ws in tokens)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found) == want
    assert all(r.score < 0 for r in found)
    assert lm_scoring.scored(empty).count() == 0


def test_language(spark, docs, empty):
    found = langid.identified(docs).collect()
    assert len(found) == len(rows())
    assert all((r.lang_pred == "und") == (r.doc_id in (200, 201, 202)) for r in found)
    sure = [r for r in found if r.doc_id < 120]
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "de") and 0.5 < r.score <= 1 for r in sure)
    assert langid.identified(empty).count() == 0


def test_gru_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in langid._init(3, rng).items()}
    text, label = rng.integers(0, 256, (4, 5)).astype(np.uint8), np.array([0, 1, 2, 1])

    def loss():
        q = langid._probabilities(p, text)
        return -np.log(q[:, np.arange(4), label]).mean()

    g = langid._gradients(p, text, label)
    for name in p:
        at = tuple(int(i) for i in np.unravel_index(np.abs(g[name]).argmax(), p[name].shape))
        kept = p[name][at]
        p[name][at] = kept + 1e-3
        up = loss()
        p[name][at] = kept - 1e-3
        down = loss()
        p[name][at] = kept
        assert abs((up - down) / 2e-3 - g[name][at]) < 2e-3 * max(1, abs(g[name][at]))


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(i, int("idiotic" in (t or "")), None) for i, t, *_ in rows()] + [(None, 1, None), (5000, 1, None), (3, None, None)], "doc_id long, toxic int, score double")
    found = toxicity.scored(docs, labels).collect()
    held = [(r.score, "idiotic" in rows()[r.doc_id][1]) for r in found if r.doc_id < 120 and r.held_out]
    assert min(s for s, y in held if y) > max(s for s, y in held if not y)
    assert len(found) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert toxicity.scored(empty, labels).count() == 0
    assert {r.predicted for r in toxicity.scored(docs, labels.limit(0)).collect()} == {0}


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    data = [(i, [float(x) for x in base[i % 40] + rng.normal(scale=0.05 * (i % 7), size=16)], i % 2) for i in range(400)]
    data += [(1000 + i, data[0][1], 0) for i in range(50)] + [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 0), (2003, [1.0, None], 0), (2004, data[0][1], None), (2005, [], 0), (2006, [1.0, 2.0], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumnRenamed("vec_id", "vec_id")
    found = {r.vec_id: r for r in embedding_dedup.linked_vectors(df).collect()}
    good = [(i, np.array(v), l) for i, v, l in data if l is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: sum(j != i and k == l and len(w) == len(v) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93 for j, w, k in good) for i, v, l in good}
    assert len(found) == len(data)
    assert sum(found[i].n_links for i in links) >= 0.9 * sum(links.values())
    assert all(found[i].n_links <= n for i, n in links.items())
    assert all(found[i].n_links == 0 and found[i].kept for i in range(2000, 2007))
    assert found[1049].component_id == found[0].component_id
    assert embedding_dedup.linked_vectors(df.limit(0)).count() == 0


def test_fingerprints(docs, empty):
    found = Counter(tuple(r) for r in fingerprints.compared(docs).collect())
    ring = sorted(((i, t or "") for i, t, *_ in rows()), key=lambda x: (-x[0], x[1]))
    want = Counter()
    for n, (i, t) in enumerate(ring):
        following = ring[(n + 1) % len(ring)][1]
        edited, _ = fingerprints.edit(t, following)
        a, b, c = fingerprints.anchors(t), fingerprints.anchors(edited), fingerprints.anchors(following)
        import hashlib

        want[(i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.written(a), fingerprints.written(b), fingerprints.likeness(a, b), fingerprints.likeness(a, c))] += 1
        assert fingerprints.parsed(fingerprints.written(a)) == a
    assert found == want
    assert fingerprints.compared(empty).count() == 0


def test_url_verdicts(spark):
    link = '<a href="https://{}/x">'
    data = [(1, "http://A.Com/x", None), (2, "https://www.example.com/en/1?q", None), (3, "https://sub.example.com/en/", None), (4, "http://z.net/es/1", link.format("bad.org")), (5, None, "x"), (6, "nothing", None), (7, "http://bad.org/a", link.format("z.net")), (8, "http://example.com", None), (9, "http://z.net/es/2", None), (10, "http://good.org/#x", link.format("a.com"))]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(df, RULES).collect()}
    assert found[1] == ("a.com", "/x", "com/", "allow") and found[2][2:] == ("www.example.com/en/", "allow") and found[3][2:] == ("example.com/en/", "block")
    assert found[5] == ("", "", None, "allow") and found[6] == ("", "", None, "allow") and found[8] == ("example.com", "", None, "allow")
    assert found[7] == ("bad.org", "/a", None, "block") and found[10] == ("good.org", "/", None, "allow")
    assert url_filters.judge(df.limit(0), RULES).count() == 0


def test_pipeline_keeps_columns(spark, tmp_path, docs):
    import corpus_pipeline as cp

    unique = docs.dropDuplicates(["doc_id"])
    unique.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int("idiotic" in (t or ""))) for i, t, *_ in rows()], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
    kept = {r.doc_id for r in at.select("doc_id").collect()}
    assert not kept & {200, 201, 202, 204, 205, 207}
    assert cp.run(spark, str(tmp_path)).count() > 0
