"""The source audit, the spelling variants and the sentence pieces against slow versions, on small tables with all edges."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quire.llm import divergence, sentence_pieces, spelling
from quire.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, word string, ids long, n long, rank int"


def rows():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(1, 8))) for _ in range(70)]
    words += [w[:k] + w[k + 1 :] for w in words for k in (1, 3) if len(w) > 5] + ["aaaaab", "aaaab", "aaaaaab", "Straße", "STRASSE", "strasse", "×÷ÿÀ", "x" * 70, "x" * 71]
    out = []
    for i in range(160):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))
        out.append((i, text if i % 3 else text.upper() + ".\n" + text, ["en", "de", None][i % 3], f"s{i * i % 7}" if i % 11 else None))
    out += [(200, None, "en", "s0"), (201, "", "xx", "lonely"), (202, " \t\n\x00", "xx", "other"), (203, " ".join(words) * 40, "de", "s1"), (204, out[7][1], "en", "s1"), (7, out[7][1], "en", "s1"), (7, "other words altogether", "en", "s1"), (None, out[5][1], "de", "s2"), (205, "汉字 漢字　汉字 𠀀𠀀 ﬁ ①", None, None), (206, "<s>▁a ▁▁ b</s> <0x41>", "", "")]
    return [(*r, 1, "t", "w", 2, 3, 4) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(6)


def test_audit(docs):
    texts = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in r[1] or "")), r[2] or "", r[3] or "") for r in rows()]
    found_in, count, groups = Counter(), Counter(), {(lang, source) for _, lang, source in texts}
    for terms, lang, source in texts:
        found_in.update({(lang, t) for t in terms})
        count.update((lang, source, t) for t in terms)
    want = Counter()
    for lang in {x for x, _ in groups}:
        kept = sorted(t for x, t in found_in if x == lang and found_in[x, t] >= 3)
        own = sorted(s for x, s in groups if x == lang)
        sums = {s: [count[lang, s, t] for t in kept] for s in own}
        sums[None] = [sum(count[lang, s, t] for s in own) for t in kept]
        p = {s: [1 + 1_000_000_000 * (n + 1) // (sum(c) + len(kept)) for n in c] for s, c in sums.items()}
        for s in own:
            pairs = [(sum((x - y) ** 2 // y for x, y in zip(p[s], p[o])), o) for o in own if o != s]
            terms = [((x - y) ** 2 // y, t) for t, n, x, y in zip(kept, sums[s], p[s], p[None]) if n and x > y]
            for part, items, most in (("pair", pairs, None), ("term", terms, 200)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    want[lang, s, part, item, value, rank] += 1
    found = divergence.audit(docs)
    assert Counter(tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect()) == want
    assert {k[0] for k in want} == {"", "en", "de", "xx"} and any(k[0] == "xx" and k[4] == 0 for k in want)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_blocks_of_any_size_give_the_same(docs, monkeypatch):
    whole = Counter(tuple(r) for r in divergence.audit(docs).collect())
    for name, value in (("BLOCK_LEAVES", 20), ("FRONT", 7), ("MOST_PAIRS", 5), ("MOST_COUNTS", 30)):
        monkeypatch.setattr(divergence, name, value)
    assert Counter(tuple(r) for r in divergence.audit(docs).collect()) == whole


def test_weights_of_huge_counts_are_exact(spark):
    n, size, vocabulary = 7_123_456_789_012, 98_765_432_109_876, 1234
    got = spark.sql(f"SELECT {divergence._weight('n', 'size', 'v')} AS p FROM (SELECT {n}L AS n, {size}L AS size, {vocabulary}L AS v)").first().p
    assert got == 1 + 1_000_000_000 * (n + 1) // (size + vocabulary)


@pytest.mark.parametrize("k", [2, 3, 4])
def test_quadtree_meets_every_shared_leaf_once(k):
    rng = np.random.default_rng(k)
    places = np.unique(rng.integers(0, 40 * 130, 900))
    rows_, columns = places % 40, places // 40
    tree = divergence.QuadTree(rows_, columns, places, k)
    got = Counter((int(a), int(b), int(tree.values[u]), int(tree.values[v])) for row, other, us, vs in tree.joint(50) for a, b, u, v in zip(row, other, us, vs))
    by = defaultdict(list)
    for r, c, p in zip(rows_.tolist(), columns.tolist(), places.tolist()):
        by[c].append((r, p))
    assert got == Counter((a, b, x, y) for held in by.values() for a, x in held for b, y in held if a != b)
    assert list(divergence.QuadTree(rows_[:0], columns[:0], places[:0], k).joint()) == []


def _slow_variants(data):
    count = Counter()
    for i, text, *_ in data:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += len(w) >= 5
    words = {w: n for w, n in count.items() if n >= 3}
    near = defaultdict(set)
    letters = sorted({c for w in words for c in w})
    for w in words:
        for k in range(len(w) + 1):
            tries = [w[:k] + c + w[k:] for c in letters] + ([w[:k] + w[k + 1 :]] + [w[:k] + c + w[k + 1 :] for c in letters] if k < len(w) else [])
            near[w] |= {t for t in tries if t in words and t != w}
    form = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: f for w, f in form.items() if words[f] >= 2 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def test_variants(docs):
    found = [tuple(r) for r in spelling.variants(docs).collect()]
    want = _slow_variants(rows())
    assert len(found) == len(want) and set(found) == want
    assert any(w[1] for w in want) and any(len(w[0]) > 60 for w in want)
    assert spelling.variants(docs.limit(0)).count() == 0


def test_chains_of_forms(spark):
    chain = {f"word{'abcdefghij'[i]}{'x' * i}": 3 * 2**i for i in range(9)}
    data = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(chain.items())]
    data = [(i + 1000, t) for i, t in data]
    found = {tuple(r) for r in spelling.variants(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert found == _slow_variants(data)
    words = [f"aaaa{'b' * k}" for k in range(1, 8)]
    data = [(1, " ".join(" ".join([w] * (3 * 3**k)) for k, w in enumerate(words)))]
    found = {r.word: r.root for r in spelling.variants(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert {tuple(r) for r in spelling.variants(spark.createDataFrame(data, "doc_id long, text string")).collect()} == _slow_variants(data)
    assert set(found.values()) == {max(found, key=lambda w: data[0][1].split().count(w))}


def test_trie_nodes_over_many_ranges(spark):
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(400)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    numbers = {}
    for parts in (1, 9, 60):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        found = {r.key: r.nodes for r in spelling.trie_nodes(df, "word", "nodes").collect()}
        assert sorted(found) == words
        for w, nodes in found.items():
            assert len(nodes) == len(w) + 1 and nodes[0] == 0
            for k, node in enumerate(nodes):
                assert numbers.setdefault((parts, w[:k]), node) == node
        assert sorted(n for (p, _), n in numbers.items() if p == parts) == list(range(len({w[:k] for w in words for k in range(len(w) + 1)})))
        assert [found[w][-1] for w in words] == sorted(found[w][-1] for w in words)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_checksums_add_up():
    heads = np.array([zlib.crc32(h) for h in (b":", b"7:", b"123456789:")], dtype=np.uint32)
    after = spelling._followed(heads, spelling.SHORT)
    for w in (b"a", b"hello", "straße".encode(), b"x" * spelling.SHORT):
        assert (after[len(w)].astype(np.int64) ^ zlib.crc32(w)).tolist() == [zlib.crc32(h + w) for h in (b":", b"7:", b"123456789:")]


def _library():
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    return path, SentencePieceProcessor(model_file=path)


def test_pieces(docs):
    path, library = _library()
    found = sentence_pieces.decode(sentence_pieces.encode(docs, path), path).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in found) == Counter((r[0], tuple(ids), library.decode(ids)) for r in rows() for ids in [library.encode(r[1] or "")])
    texts = defaultdict(set)
    for r in rows():
        texts[r[0]].add((r[1] or "").encode())
    for r in found:
        spans = [(a, b, library.id_to_piece(i)) for i, a, b in zip(r.ids, r.begins, r.ends)]
        assert any(all(library.is_byte(i) or p.replace("▁", " ").lstrip(" ") == t[a:b].decode().replace("▁", " ").lstrip(" ") for i, (a, b, p) in zip(r.ids, spans)) and (not spans or spans[-1][1] == len(t)) for t in texts[r.doc_id])
    assert sentence_pieces.encode(docs.limit(0), path).count() == 0 and sentence_pieces.decode(sentence_pieces.encode(docs.limit(0), path), path).count() == 0


def test_segments_do_not_change_the_pieces(monkeypatch):
    path, library = _library()
    rng = random.Random(1)
    letters = list("ab  \n\t.é̂漢𠀀ｆ　▁<0x41>\x00▁the")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["", " ", "\n", " \n", "  ", "x" * 5000]
    monkeypatch.setattr(sentence_pieces, "MOST_SEGMENTS", 500)  # emptied again and again
    encoder = sentence_pieces.PieceEncoder(path)
    assert encoder._apart is not None
    whole = sentence_pieces.PieceEncoder(path)
    whole._apart = None
    for i in range(0, len(texts), 100):
        part = [t.encode() for t in texts[i : i + 100]]
        found, counts = encoder.encode(part)
        at = 0
        for t, n in zip(part, counts):
            assert found[0, at : at + n].tolist() == library.encode(t.decode())
            at += n
        again, same = whole.encode(part)
        assert counts.tolist() == same.tolist() and (found == again).all()


def _double_array(rules):
    """A compiled map of rules: a double-array trie, laid out by trying offsets."""
    trie = {}
    for key in rules:
        at = trie
        for byte in key:
            at = at.setdefault(byte, {})
        at[None] = key
    text, place = b"", {}
    for key, value in rules.items():
        place[key], text = len(text), text + value + b"\0"
    units, used, bases = {0: 0}, {0}, set()

    def lay(node, at):
        labels = [b for b in node if b is not None] + ([0] if None in node else [])
        # the offset is exclusive-ored: the children of `at` lie at base ^ label
        base = next(b for b in range(1, 1 << 20) if b not in bases and not any((b ^ x) in used for x in labels) and (at ^ b) < 1 << 21)
        bases.add(base)  # no two nodes share one, so a label tells whose a unit is
        used.update(base ^ x for x in labels)
        units[at] |= (at ^ base) << 10 | (256 if None in node else 0)
        for x in labels:
            units[base ^ x] = 1 << 31 | place[node[None]] if x == 0 else x
        for b in node:
            if b is not None:
                lay(node[b], base ^ b)

    lay(trie, 0)
    array = np.zeros((max(units) // 256 + 1) * 256, dtype="<u4")
    for i, u in units.items():
        array[i] = u
    return array.nbytes.to_bytes(4, "little") + array.tobytes() + text


RULES = {"ﬁ": "fi", "Ａ": "A", "Ｂ": "B", "é": "é", "　": " ", "\t": " ", "①": "1", "½": "1/2", "éx": "éx", "​": ""}


@pytest.mark.parametrize("trim, dummy, escape, last", [(True, True, True, False), (False, True, True, False), (True, False, True, False), (False, False, False, False), (True, True, True, True)])
def test_maps_normalise_as_the_library_does(trim, dummy, escape, last):
    from sentencepiece import SentencePieceProcessor

    path, _ = _library()
    with open(path, "rb") as file:
        data = file.read()
    blob = _double_array({k.encode(): v.encode() for k, v in RULES.items()})
    spec = sentence_pieces._message([(1, b"made"), (2, blob), (3, int(dummy)), (4, int(trim)), (5, int(escape))])
    made = data + sentence_pieces._message([(sentence_pieces.NORMALIZER, spec), (sentence_pieces.TRAINER, sentence_pieces._message([(24, int(last))]))])
    model = sentence_pieces.Model.read(made)
    assert dict(model.characters.items()) == {k.encode(): v.encode() for k, v in RULES.items()}
    library = SentencePieceProcessor(model_proto=made)
    normalizer = sentence_pieces.Normalizer(model)
    encoder = sentence_pieces.PieceEncoder.__new__(sentence_pieces.PieceEncoder)
    encoder._model, encoder._normalizer = model, normalizer
    encoder._library = SentencePieceProcessor(model_proto=model.bare())
    encoder._octets = np.array([1 if kind == sentence_pieces.BYTE else -1 if kind == sentence_pieces.UNKNOWN else len(p) for p, kind in model.pieces], dtype=np.int64)
    encoder._apart = encoder._segments()
    encoder._clear()
    rng = random.Random(3)
    letters = [*"ab  ", *RULES, "e", "́", "x", "▁", "\n"]
    for _ in range(800):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
        wide, begin, end = normalizer.whole(text.encode())
        assert wide.decode() == library.normalize(text), text
        assert (np.diff(begin) >= 0).all() and (begin <= end).all() and len(begin) == len(wide)
        found, counts = encoder.encode([text.encode()])
        assert found[0].tolist() == library.encode(text), text
        assert counts.tolist() == [found.shape[1]]


def test_registered(spark):
    assert {"op11_source_divergence", "op12_spelling_variants", "op13_sentence_pieces"} <= QUERIES.keys() and "op11_source_divergence" in ORACLES
    _, library = _library()
    want = Counter()
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = library.encode(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in QUERIES["op13_sentence_pieces"](spark, "/root/testdata/sf0.001").collect()) == want
