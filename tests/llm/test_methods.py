"""The training-data operators against slow versions of their methods, and on repeated ids, ties and odd rows."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from quire.llm import embedding_dedup, fingerprints, langid, lm_scoring, mixing, ngram_join, packing, toxicity, url_filters
from quire.llm.queries import _tokenizer
from quire.llm.tokens import WordEncoder


def test_word_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    plain, words = Tokenizer.from_file(_tokenizer()), WordEncoder(_tokenizer(), cache_words=300)
    rng = np.random.default_rng(4)
    letters = list("abcdeEÉéßÄäİıŉŒ.,,..  \n!'-0123é̇日中\x00\U0001f600ªǅ")
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(3000)] + ["İ,", "İ. x", "İ", "aİ,", "Straße.", "don't, you", "x" * 5000, "", None]
    for i in range(0, len(texts), 100):
        part = texts[i : i + 100]
        for text, found in zip(part, words.encode(part)):
            assert np.frombuffer(found, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids, text


def test_word_encoder_learns_each_word_once_in_order(monkeypatch):
    words, learned = WordEncoder(_tokenizer()), []
    learn = words._learn
    monkeypatch.setattr(words, "_learn", lambda new: (learned.append(list(new)), learn(new)))
    first = words.encode(["bo Aé bo", "Aé c,"])
    assert words.encode(["d c,", "bo Aé bo"])[1] == first[0] and learned == [["bo", "Aé", "c,"], ["d"]]


def test_packing_takes_texts_a_few_mb_at_once(spark, monkeypatch, tmp_path):
    first, seen = packing._first_round, str(tmp_path)

    def watched(*settings):
        run = first(*settings)

        def noted(batches):
            for i, batch in enumerate(batches):
                with open(f"{seen}/{i}", "w") as f:
                    f.write(str(batch.nbytes))
                yield batch

        return lambda batches: run(noted(batches))

    monkeypatch.setattr(packing, "_first_round", watched)
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('bo ', 14000) AS text").coalesce(1)
    found = packing.pack(docs, _tokenizer(), 2048).groupBy("doc_id").agg({"length": "sum"}).collect()
    sizes = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert sum(sizes) > 12_000_000 and max(sizes) < 5_000_000
    assert len(found) == 300 and len({n for _, n in found}) == 1 and spark.conf.get(setting) == before


def test_pipeline_stages_take_texts_a_few_mb_at_once(spark, monkeypatch):
    import corpus_pipeline
    from pyspark.sql import functions as F

    def told(texts: pa.Array) -> pa.Array:
        kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
        return pa.array([{"lang_pred": "en" if texts.nbytes < 5_000_000 else "und", "score": 1.0}] * len(texts), kind)

    monkeypatch.setattr(langid, "train", lambda docs: None)
    monkeypatch.setattr(langid, "predict", lambda spark, model, text: F.arrow_udf(told, "struct<lang_pred: string, score: double>")(text))
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    docs = spark.range(0, 300, 1, 1).selectExpr("id AS doc_id", "repeat('bo ', 14000) AS text")
    try:
        assert corpus_pipeline.STAGES[0][1](spark, docs, "").count() == 300
    finally:
        spark.conf.set(setting, before)


def test_best_fit_closes_the_fullest():
    fit = packing.BestFit(10, bins=2)
    assert [fit.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert [fit.place(n) for n in (5, 6, 9)] == [(2, 0), (3, 0), (4, 0)]  # the third closes bin 3, which has less room than bin 2
    assert fit.place(5) == (2, 5) and fit.place(1) == (4, 9) and fit.place(4) == (5, 0)


def _groups(sets: dict, num: int, den: int) -> dict:
    """Least id reachable by links; `sets` has (id, set) rows."""
    label = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if a and b and (i == j or den * len(a & b) >= num * len(a | b)) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


@pytest.mark.parametrize("turn", [1, -1])
def test_rows_of_one_id_hold_their_sets_together(spark, turn):
    one, two = [f"a{i}" for i in range(120)], [f"b{i}" for i in range(120)]
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, " ".join(one[:-1] + ["z"])), (3, " ".join(two[:-1] + ["z"])), (4, None), (None, " ".join(two)), (5, "alone")]
    df = spark.createDataFrame(rows[::turn], "doc_id long, text string")
    found = Counter((r.doc_id, r.component_id) for r in ngram_join.similar_components(df).collect())
    assert found == Counter({(1, 1): 2, (2, 1): 1, (3, 1): 1, (4, 4): 1, (None, 1): 1, (5, 5): 1})


@pytest.mark.parametrize("k, num, family", [(3, 90, 60), (5, 80, 60), (5, 80, 101)])
def test_families_of_near_copies(spark, monkeypatch, k, num, family):
    """Near copies around the threshold, in blocks and without families: the links that brute force finds."""
    monkeypatch.setattr(ngram_join, "FAMILY", family)
    monkeypatch.setattr(ngram_join, "FAMILY_ROWS", 16)
    monkeypatch.setattr(ngram_join, "COLUMN_ROWS", 20)
    rng = np.random.default_rng(7)
    bases = [[f"{b}w{i}" for i in range(130)] for b in range(3)]
    rows = []
    for i in range(150):
        words = list(bases[i % 3])
        for at in rng.integers(0, len(words), rng.integers(0, 5)):
            words[at] = f"e{rng.integers(0, 40)}"
        rows.append((i * 7 % 150, " ".join(words[: 130 - int(rng.integers(0, 6))])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = [(i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}) for i, t in rows for w in [t.split()]]
    assert {r.doc_id: r.component_id for r in ngram_join.similar_components(df, k, (num, 100)).collect()} == _groups(sets, num, 100)


@pytest.mark.parametrize("waiting", [1_000_000, 40])
def test_pairs_with_the_hub_of_a_column(monkeypatch, waiting):
    """The least class of a row's band and the bands beside it; past WAITING_ROWS of a column, of those seen so far."""
    monkeypatch.setattr(ngram_join, "WAITING_ROWS", waiting)
    rng = np.random.default_rng(5)
    columns = [(t, 3 if t == 9 else int(rng.integers(0, 6)), int(c)) for t in range(12) for c in rng.choice(10_000, 130 if t > 8 else int(rng.integers(1, 9)), replace=False)]
    rows = sorted(columns)
    table = pa.table([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1, 2, 2, 2, 2)], names=["token", "band", "cid", "n", "most", "pos"])
    found = Counter((r["a"], r["b"]) for b in ngram_join._near_hubs(table.to_batches(max_chunksize=7)) for r in b.to_pylist())
    want = Counter()
    for t, band, c in rows:
        least = min(x for u, v, x in rows if u == t and abs(v - band) <= 1)
        want[least, c] += least != c
    if waiting > len(rows):
        assert found == +want
    else:
        assert sum(found.values()) <= len(rows) and len({b for _, b in +want} - {b for _, b in found}) < 10


def _shuffled(spark, run) -> int:
    """Bytes that stages write to shuffles while `run` runs, without broadcasts."""

    def written():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.length()))

    before, threshold = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run().write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    return written() - before


def test_sets_travel_as_packed_texts():
    import zstandard

    words = np.random.default_rng(8).choice(list("abcdefghijklmnopqrstuvwxyz"), 3000).tolist()
    texts = [" ".join(words), " ".join(words[::-1]), " ".join(words)]
    every = type("Sent", (), {"value": np.full(ngram_join.FILTER_WORDS, -1, dtype=np.int64)})
    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array(texts), pa.array([1, 2, 3], pa.int64())], names=["doc_id", "text", "h"])
    (found,) = ngram_join._sets(3, every)([batch])
    packed = found.column(found.num_columns - 1).to_pylist()
    assert len(packed) == 2 and sum(map(len, packed)) < sum(map(len, texts[:2]))
    assert [zstandard.ZstdDecompressor().decompress(x).decode() for x in packed] == texts[:2]


def test_near_duplicates_deals_no_texts_that_surely_stay(spark, tmp_path):
    import corpus_pipeline as cp

    rng = np.random.default_rng(9)
    texts = [rng.bytes(50_000).hex() for _ in range(60)]
    rows = [*enumerate(texts), (100, texts[7]), (3, texts[3]), (None, texts[5]), (None, texts[5])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    assert _shuffled(spark, lambda: cp.near_duplicates(spark, docs, "")) < 2_000_000
    found = cp.near_duplicates(spark, docs, "").collect()
    assert Counter(r.doc_id for r in found) == Counter([*range(60), None, None]) and all(r.text == dict(rows[:60]).get(r.doc_id, texts[5]) for r in found)


def test_inclusion_follows_the_probabilities(spark):
    rng = np.random.default_rng(3)
    size = rng.choice([1, 3, 9, 40, 200], 8000)
    df = spark.createDataFrame([(i, "w " * int(n), "s" if i % 4 else "t") for i, n in enumerate(size)], "doc_id long, text string, source string").repartition(3)
    found = mixing.decide(df, weights=(1, 9), share=1.0).select("doc.doc_id", "doc.source", "size", "target", "copies").collect()
    for source in "st":
        own = [r for r in found if r.source == source]
        words = defaultdict(int)
        for r in own:
            words[r.size.bit_length()] += r.size
        target, capped = own[0].target, set()
        while True:  # c * (1 + class), 2 at most
            c = (target - 2 * sum(words[b] for b in capped)) / max(1e-9, sum((1 + b) * w for b, w in words.items() if b not in capped))
            more = {b for b in words if b not in capped and c * (1 + b) > 2}
            if not more:
                break
            capped |= more
        for b in words:
            copies = [r.copies for r in own if r.size.bit_length() == b]
            want = 2.0 if b in capped else c * (1 + b)
            assert abs(np.mean(copies) - want) < 0.01 + 5 * math.sqrt(max(0.0, (want % 1) * (1 - want % 1)) / len(copies)), (source, b)
            assert set(copies) <= {math.floor(want), math.floor(want) + 1}
        assert abs(sum(r.size * r.copies for r in own) - target) <= max(r.size for r in own)


def _slow_score(doc: list[int], known: bool, model) -> float:
    """One bit after the other, as the method says, with updates at the end of each run."""
    length, begin, nodes, bits = model.tree
    size, total = len(doc), 0.0
    leaf = np.array(doc, dtype=np.int64)
    contexts = lm_scoring._contexts(leaf, np.array([size]))
    local, weights = defaultdict(lambda: [0, 0]), defaultdict(lambda: list(lm_scoring.START_WEIGHTS))
    centres = [(i - (lm_scoring.STEPS - 1) / 2) * 0.75 for i in range(lm_scoring.STEPS)]
    ones, seen = [lm_scoring.SURE / (1 + math.exp(-c)) for c in centres], [lm_scoring.SURE] * lm_scoring.STEPS
    for start in range(0, size, lm_scoring.RUN):
        coded = []
        for t in range(start, min(size, start + lm_scoring.RUN)):
            for k in range(begin[leaf[t]], begin[leaf[t]] + length[leaf[t]]):
                node, bit = int(nodes[k]), int(bits[k])
                cells = [int(model.nodes[node])] + [int(model.cells[c][lm_scoring._cells(contexts[c][t : t + 1], np.array([node], dtype=np.uint64) * lm_scoring._K[4], model.bits)[0]]) for c in range(lm_scoring.HASHED)]
                x, counts = [], []
                for both in cells:
                    n = [both & 0xFFFF, both >> 16]
                    if known and n[bit]:
                        n[bit] -= 1
                    x.append(math.log(n[1] + lm_scoring.ADDED) - math.log(n[0] + lm_scoring.ADDED))
                    counts.append(sum(n))
                n = local[node % lm_scoring.LOCAL]
                x.append(math.log(n[1] + lm_scoring.ADDED) - math.log(n[0] + lm_scoring.ADDED))
                gate = sum(counts[2] > m for m in (0, 1, 4)) + 4 * sum(counts[1] > m for m in (1, 7, 63))
                logit = sum(a * b for a, b in zip(x, weights[gate]))
                p = 1 / (1 + math.exp(-logit))
                at = min(max(int(logit / 0.75 + lm_scoring.STEPS / 2), 0), lm_scoring.STEPS - 1)
                q = min(max((p + ones[at] / seen[at]) / 2, 1e-6), 1 - 1e-6)
                total += math.log10(q if bit else 1 - q)
                coded.append((node, bit, gate, x, bit - p, at))
        for gate in {c[2] for c in coded}:
            own = [c for c in coded if c[2] == gate]
            for k in range(lm_scoring.PREDICTORS):
                weights[gate][k] += lm_scoring.RATE * sum(c[4] * c[3][k] for c in own) / (len(own) + 1)
        for node, bit, _, _, _, at in coded:
            local[node % lm_scoring.LOCAL][bit] += 1
            ones[at] += bit
            seen[at] += 1
    return total


def test_context_mixing_equals_a_slow_version():
    rng = np.random.default_rng(9)
    counts = rng.integers(0, 50, 300)
    tree = lm_scoring.code(counts)
    docs = [rng.integers(0, 300, n).astype(np.uint32) for n in (1, 2, 63, 64, 65, 200, 131, 5, 90, 33)]
    nodes = lm_scoring.packed_counts(rng.integers(1, 90, 300).astype(float), rng.integers(1, 90, 300).astype(float))
    cells = lm_scoring.packed_counts(rng.integers(1, 7, (3, 1 << 10)).astype(float), rng.integers(1, 7, (3, 1 << 10)).astype(float))
    model = lm_scoring.MixModel(tree, nodes, cells)
    known = np.array([i % 2 == 0 for i in range(len(docs))])
    fast = lm_scoring.log_probabilities(docs, known, model)
    slow = [_slow_score(d.tolist(), k, model) for d, k in zip(docs, known)]
    assert np.allclose(fast, slow, rtol=2e-4, atol=1e-3)
    alone = [lm_scoring.log_probabilities([d], k[None], model)[0] for d, k in zip(docs, known)]
    assert np.allclose(fast, alone, rtol=1e-5)  # no document depends on another
    # what may come next is a distribution
    last = [lm_scoring.log_probabilities([np.append(docs[5], np.uint32(leaf))], np.array([False]), model)[0] - lm_scoring.log_probabilities([docs[5]], np.array([False]), model)[0] for leaf in range(300)]
    assert abs(sum(10.0**x for x in last) - 1) < 1e-3


def test_words_of_a_shared_leaf_are_a_distribution():
    c = np.array([5, 3, 1, 1])
    s, t = np.full(4, c.sum()), np.full(4, len(c))
    known = 10.0 ** lm_scoring.within_leaf(c, s, t, np.zeros(4))
    new = 10.0 ** lm_scoring.within_leaf(np.array([0]), s[:1], t[:1], np.zeros(1))
    assert abs(known.sum() + new.sum() - 1) < 1e-12
    table = lm_scoring.spelling(np.random.default_rng(1).integers(0, 9, lm_scoring.BACK << 16).astype(float))
    assert np.allclose((10.0 ** table.astype(np.float64)).reshape(-1, 256).sum(axis=1), 1, atol=1e-5)
    words = ["a", "ab", "", "éx"]
    word, cell = lm_scoring._spelled([w.encode() for w in words])
    for i, w in enumerate(words):
        raw = w.encode() + b" "
        want = [((raw[j - 2] if j > 1 else 0) % lm_scoring.BACK) << 16 | (raw[j - 1] if j else 0) << 8 | raw[j] for j in range(len(raw))]
        assert cell[word == i].tolist() == want


def test_context_scores_of_whole_texts(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice([f"{'ab'[i % 2]}w{k}" for k in range(40)], 80))) for i in range(200)] + [(900, None), (901, ""), (901, "aw1 bw2"), (902, "nie gesehen " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    one = sorted(map(tuple, lm_scoring.scored(df).collect()), key=repr)
    two = sorted(map(tuple, lm_scoring.scored(df.repartition(7)).collect()), key=repr)
    assert [(r[0], r[2], r[3]) for r in one] == [(r[0], r[2], r[3]) for r in two]
    assert np.allclose([r[6] for r in one], [r[6] for r in two], rtol=1e-4)
    assert all(r[6] < 0 and np.isfinite(r[6]) for r in one)
    text = dict((i, t) for i, t in rows if i < 200)
    assert all(abs(r[7] + r[6] / math.log10(2) / len(text[r[0]].encode())) < 1e-9 for r in one if r[0] in text)
    held = [r for r in one if r[1] and r[0] < 200]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)  # better than words without context: a text keeps to one half of the words


@pytest.mark.parametrize("n", [600, 3000])
def test_recall_and_components_of_vectors(spark, n):
    rng = np.random.default_rng(n)
    base = rng.normal(size=(n // 10, 24))
    x = base[rng.integers(0, len(base), n)] + rng.normal(size=(n, 24)) * rng.choice([0.05, 0.2, 0.35, 1.0], (n, 1))
    df = spark.createDataFrame([(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: r for r in embedding_dedup.linked_vectors(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = (u @ u.T >= 0.93) & (np.arange(n)[:, None] % 2 == np.arange(n) % 2) & ~np.eye(n, dtype=bool)
    got = np.array([found[i].n_links for i in range(n)])
    assert (got <= hit.sum(axis=1)).all() and got.sum() >= 0.9 * hit.sum() > 0
    label = np.arange(n)
    while True:
        low = np.minimum(label, np.where(hit, label, n).min(axis=1))
        if (low == label).all():
            break
        label = low
    assert np.mean([found[i].component_id == label[i] for i in range(n)]) >= 0.9
    assert all(found[i].component_id >= label[i] for i in range(n))


def test_vectors_of_many_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(0)
    rows = []
    for d in range(2, 80):
        v = rng.normal(size=d)
        rows += [(10 * d, v.tolist(), 1), (10 * d + 1, (v * 3 + 1e-3).tolist(), 1)]
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows += [(1, a, 9), (1, b, 9), (2, [1.0, 0.1, 0.0, 0.0], 9), (3, [0.1, 1.0, 0.0, 0.0], 9), (3, [0.1, 1.0, 0.0, 0.0], 9), (None, a, 9)]
    for turn in (1, -1):
        found = defaultdict(list)
        for r in embedding_dedup.linked_vectors(spark.createDataFrame(rows[::turn], "vec_id long, embedding array<double>, label int")).collect():
            found[r.vec_id].append((r.n_links, r.component_id, r.kept))
        assert all(found[10 * d + 1] == [(1, 10 * d, False)] for d in range(2, 80))
        assert {c for i in (1, 2, 3) for _, c, _ in found[i]} == {1} and found[2] == [(1, 1, False)] and found[3] == [(2, 1, False)] * 2
        assert found[None] == [(0, None, False)]


def test_closed_syncmers_one_by_one():
    k, s = fingerprints.K, fingerprints.S
    rng = np.random.default_rng(6)

    def mixed(run: str) -> int:
        total = sum((ord(c) + 1) * pow(fingerprints._BASE, i, 1 << 64) for i, c in enumerate(run)) % (1 << 64)
        return int(fingerprints._mixed(np.array([total], dtype=np.uint64))[0])

    for text in ["", "short", "x" * 40, "".join(rng.choice(list("abcé \U0001f600"), 300)), "a" * k]:
        want = []
        for i in range(len(text) - k + 1):
            run = text[i : i + k]
            inner = [mixed(run[j : j + s]) for j in range(k - s + 1)]
            if min(inner) in (inner[0], inner[-1]):
                want.append((i, mixed(run)))
        at, h = fingerprints.syncmers(text)
        assert list(zip(at.tolist(), h.tolist())) == want


def test_ranks_equal_a_dense_solution(spark):
    rng = np.random.default_rng(8)
    n = 12
    links = rng.integers(0, 3, (n, n)) * (rng.random((n, n)) < 0.3) * (1 - np.eye(n, dtype=int))
    seeds = rng.integers(0, 3, (2, n)) * (rng.random((2, n)) < 0.4)
    edges = spark.createDataFrame([(f"h{i}", f"h{j}", int(links[i, j])) for i in range(n) for j in range(n) if links[i, j]], "source string, target string, links long")
    given = spark.createDataFrame([(f"h{i}", int(seeds[0, i]), int(seeds[1, i])) for i in range(n)], "host string, trust long, distrust long")
    found = {r.host: (r.trust, r.distrust) for r in url_filters.propagated(given, edges, tolerance=1e-6).collect()}
    down = links / np.maximum(1, links.sum(axis=1, keepdims=True))
    up = (links / np.maximum(1, links.sum(axis=0, keepdims=True))).T
    for k, flow in enumerate((down, up)):
        rank = np.linalg.solve(np.eye(n) - url_filters.DAMPING * flow.T, seeds[k].astype(float))
        assert np.allclose([found.get(f"h{i}", (0.0, 0.0))[k] for i in range(n)], rank, atol=1e-3)


def test_links_without_a_scheme(spark):
    df = spark.createDataFrame([("a.org", '<a href="//B.org/x"><a href=/local><a HREF=\'https://c.org?q\'>'), ("b.org", None)], "host string, html string")
    assert sorted(map(tuple, url_filters.host_edges(df).collect())) == [("a.org", "b.org", 1), ("a.org", "c.org", 1)]


def test_ftrl_equals_a_plain_loop():
    rng = np.random.default_rng(1)
    rows = [(np.unique(rng.integers(0, 60, rng.integers(1, 9))).astype("<i4"), float(rng.integers(0, 2))) for _ in range(80)]
    batch = pa.record_batch([pa.array([f.tobytes() for f, _ in rows], pa.binary()), pa.array([y for _, y in rows])], names=["features", "toxic"])
    alpha, beta, l1, l2 = 0.3, 1.0, 0.2, 0.1
    found = {r["feature"]: r["weight"] for b in toxicity._ftrl(alpha, beta, l1, l2)([batch]) for r in b.to_pylist()}
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(toxicity.EPOCHS):
        for k in order.permutation(len(rows)):
            at = [*rows[k][0].tolist(), toxicity.SPACE]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - rows[k][1]
            for i in at:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    assert all(abs(found.get(i, 0.0) - weight(i)) < 1e-9 for i in [*range(60), toxicity.SPACE])


def test_language_of_running_bytes():
    rng = np.random.default_rng(5)
    p = langid._init(3, rng)
    model = langid.LanguageModel(["x", "y", "z"], p)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (1, 7, 50, langid.SPAN, 300)] + [b""]
    found = model.label(texts)
    for text, row in zip(texts[:4], found):
        want = langid._probabilities(p, np.frombuffer(text, np.uint8)[None, :])[:, 0].mean(axis=0)
        assert np.allclose(row, want, atol=1e-4)
    assert not found[5].any() and abs(found[4].sum() - 1) < 1e-4
    assert np.allclose(model.label([texts[4]] * 3 + [texts[1]])[0], found[4], atol=1e-6)  # no text depends on another
    assert [langid.has_letter(t.encode()) for t in ("", " \t1.", "é", "x", "日")] == [False, False, True, True, True]


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline as cp

    rng = np.random.default_rng(12)
    words = {"en": "the quick brown fox jumps over a lazy dog while most children watch".split(), "de": "über die größten Häuser läuft schöner Regen für müde Vögel nach Süden".split()}
    rows = []
    for i in range(160):
        lang = "en" if i % 2 else "de"
        text = [str(w) for w in rng.choice(words[lang], 40 + i % 11)]
        if i % 7 == 3:
            text[::5] = ["idiotic"] * len(text[::5])
        rows.append((i, " ".join(text), lang, f"s{i % 3}", len(text)))
    copy = rows[8][1].split()
    rows += [(300, rows[9][1], "en", "s1", 0), (301, " ".join([*copy[:-1], "anders"]), "de", None, 0), (302, None, None, "s0", 0), (303, "", "en", "s0", 0), (304, "12 34", None, None, 0), (305, "the fox " * 2500, "en", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int("idiotic" in (t or ""))) for i, t, *_ in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    lang = {r.doc_id: r for r in langid.identified(docs).collect()}
    left = [r for r in rows if lang[r[0]].lang_pred != "und" and lang[r[0]].score >= cp.LEAST_LANGUAGE_SCORE]
    assert {r[0] for r in left} == {r[0] for r in rows if any(map(str.isalpha, r[1] or ""))}
    toxic = {r.doc_id: r.score for r in toxicity.scored(spark.createDataFrame(left, docs.schema), labels).collect()}
    left = [r for r in left if toxic[r[0]] < cp.TOXIC_SCORE]
    assert not any("idiotic" in r[1] for r in left) and len(left) > 100
    sets = [(r[0], {tuple(w[j : j + 5]) for j in range(len(w) - 4)}) for r in left for w in [r[1].lower().split()]]
    label = _groups(sets, 80, 100)
    left = [r for r in left if label[r[0]] == r[0]]
    assert not {300, 301} & {r[0] for r in left}
    mixed = mixing.decide(spark.createDataFrame(left, docs.schema)).select("doc.doc_id", "copies").collect()
    tokens = WordEncoder(_tokenizer())
    want = Counter()
    for r in mixed:
        n = len(tokens.encode([next(x[1] for x in left if x[0] == r.doc_id)])[0]) // 4 + 1
        for k in range(-(-n // 2048)):
            want[r.doc_id, k, min(2048, n - 2048 * k)] += r.copies
    found = cp.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.length) for r in found) == +want
    at = Counter()
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 2048


def test_logits_of_counts_are_worked_out_once(monkeypatch):
    rng = np.random.default_rng(3)
    tree = lm_scoring.code(rng.integers(1, 500, 300))
    nodes = lm_scoring.packed_counts(rng.integers(0, 90, 300).astype(float), rng.integers(0, 90, 300).astype(float))
    cells = lm_scoring.packed_counts(rng.integers(0, 90, (3, 1 << 10)).astype(float), rng.integers(0, 9, (3, 1 << 10)).astype(float))
    model = lm_scoring.MixModel(tree, nodes, cells)
    docs = [rng.integers(0, 300, n).astype(np.uint32) for n in (1, 700, 40, 129)]
    bits = sum(int(tree[0][d].sum()) for d in docs)
    look, met, logits = model.lookups(), [], lm_scoring._logits
    monkeypatch.setattr(lm_scoring, "_logits", lambda both, own: met.append(len(both)) or logits(both, own))
    no = np.zeros(len(docs), dtype=bool)
    fast = lm_scoring.log_probabilities(docs, no, look)
    assert sum(met) == bits  # the document's own counts alone; with those of the model it was five times that
    # by counts: the last document alone is marked, so the others take nothing off
    slow = lm_scoring.log_probabilities([*docs, docs[0]], np.append(no, True), model)
    assert np.allclose(fast, slow[:-1], rtol=1e-6)


def test_counts_of_nodes_and_cells_are_those_of_every_bit():
    rng = np.random.default_rng(4)
    tree = lm_scoring.code(rng.integers(1, 500, 300))
    docs = [rng.integers(0, 300, n).astype(np.uint32) for n in (1, 700, 40)]
    pack = zstandard.ZstdCompressor().compress
    batch = pa.record_batch([pa.array([pack(d.tobytes()) for d in docs], pa.binary())], names=["leaves"])
    sent = type("Sent", (), {"value": tree})
    blocks = {r.column(0)[0].as_py(): np.frombuffer(zstandard.ZstdDecompressor().decompress(r.column(1)[0].as_py()), np.uint32) for r in lm_scoring._count(sent, 16)(iter([batch]))}
    _, node, bit = lm_scoring._spread(np.concatenate(docs).astype(np.int64), tree)
    assert (blocks[-1] == np.bincount(2 * node + bit, minlength=600)).all()
    assert [sum(int(v.sum()) for k, v in blocks.items() if k // lm_scoring.BLOCKS == t and k >= 0) for t in range(3)] == [len(bit)] * 3


def test_the_code_is_whole():
    tree = lm_scoring.code(np.array([5, 1, 1, 8]))
    assert abs(sum(2.0 ** -int(n) for n in tree[0]) - 1) < 1e-12 and tree[0].argmin() == 3
