"""Null ids, repeated ids with different rows, and a text beyond every slice, for each operator on documents."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import divergence, fingerprints, langid, lm_scoring, mixing, ngram_join, packing, sentence_pieces, spelling, sstable, toxicity, url_filters
from quire.llm.queries import RULES, _tokenizer

LONG = " ".join(f"word{i % 5000} Is-{i % 7}" for i in range(190_000))
ROWS = [(1, "the first text of one", "en", "a"), (1, "another row of the same id", "de", "a"), (1, "the first text of one", "en", "b"), (None, "no id here at all", "en", "a"), (None, "no id here at all", "en", None), (None, None, None, None), (2, LONG, "en", "a"), (3, "", "de", "b"), (-5, "negative ids come too", "en", "a"), (2**62, "ids beyond doubles", "en", "a"), (2**62 + 1, "ids beyond doubles, next", "en", "a")]


@pytest.fixture(scope="module")
def docs(spark):
    assert len(LONG) > 2_500_000
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(3)


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(_tokenizer())
    return lambda text, end: np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_packing(docs, encode):
    found = packing.pack(docs, _tokenizer(), 2048).collect()
    want = Counter((i, p, len(x[s : s + 2048]), zlib.crc32(x[s : s + 2048].tobytes())) for i, t, *_ in ROWS for x in [encode(t, 0)] for p, s in enumerate(range(0, len(x), 2048)))
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in found) == want


def test_sstable(spark, docs, encode):
    known = docs.where("doc_id IS NOT NULL")
    found = sstable.read_shards(spark, sstable.write_shards(known, _tokenizer(), shards=2)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, t, *_ in ROWS if i is not None for x in [encode(t, 1)])


def test_mixing_and_join(docs):
    taken = mixing.decide(docs).select("doc.doc_id", "size", "copies").collect()
    assert Counter((r.doc_id, r["size"]) for r in taken) == Counter((i, len((t or "").split())) for i, t, *_ in ROWS)
    linked = ngram_join.similar_components(docs).collect()
    assert Counter(r.doc_id for r in linked) == Counter(r[0] for r in ROWS)
    assert next(r.n_shingles for r in linked if r.doc_id == 2) == len({tuple(w) for words in [LONG.lower().split()] for w in zip(words, words[1:], words[2:])})


def test_models(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (-5, 1), (None, 1)], "doc_id long, toxic int")
    for found in (lm_scoring.scored(docs), langid.identified(docs), toxicity.scored(docs, labels)):
        rows = found.collect()
        assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ROWS)
        assert {r.score for r in rows if r.doc_id == 1} and all(np.isfinite(r.score) for r in rows)
    scored = {(r.doc_id, r.n_tokens): r for r in lm_scoring.scored(docs).collect()}
    assert scored[2, len(LONG.split()) + 1].score < 0


def test_fingerprints(docs):
    found = fingerprints.compared(docs).collect()
    ring = sorted(((i, t or "") for i, t, *_ in ROWS if i is not None), key=lambda x: (-x[0], x[1]))
    want = Counter()
    for n, (i, t) in enumerate(ring):
        edited, _ = fingerprints.edit(t, ring[(n + 1) % len(ring)][1])
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found if r.doc_id is not None) == want
    assert sum(r.doc_id is None for r in found) == 3


def test_audits_and_pieces(docs):
    from sentencepiece import SentencePieceProcessor

    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_file=path)
    found = sentence_pieces.decode(sentence_pieces.encode(docs, path), path).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in found) == Counter((r[0], tuple(x), library.decode(x)) for r in ROWS for x in [library.encode(r[1] or "")])
    counts = {r.word: r.n for r in spelling.variants(docs).collect()}
    assert counts == {}  # `word` and `Is` are too short, no other run occurs three times
    assert {(r.lang, r.source) for r in divergence.audit(docs).where("part = 'pair'").collect()} == {("en", "a"), ("en", "b"), ("de", "a"), ("de", "b"), ("en", "")}


def test_pages(spark):
    pages = spark.createDataFrame([(None, "http://a.com/x", "<a href='http://b.net/es/'>"), (1, "http://b.net/es/1", None), (1, None, "x" * 2_500_000), (2**62 + 1, "://", "")], "page_id long, url string, html string")
    found = url_filters.judge(pages, RULES).collect()
    assert Counter((r.page_id, r.verdict) for r in found) == Counter([(None, "allow"), (1, "block"), (1, "allow"), (2**62 + 1, "allow")])
