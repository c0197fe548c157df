"""Helpers against values worked out by hand, and their properties."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.functions import kernels as k
from quire.functions.literal import BestSoFar, LiteralScorer, RequestMatcher


def test_visible_text():
    assert k.visible_text("<p>a<script>x</script>b</p><br>c&amp;d") == "\nab\n\nc&d"
    assert k.visible_text(None) is None


def test_sentences_cover_and_count_utf16():
    text = "甲。乙！”\n\n丙𠀀 3.5 end. x"
    found = k.sentences(text)
    assert "".join(s["text"] for s in found) == text
    assert found[-1]["end"] == len(text) + 1
    assert found[0]["text"] == "甲。"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab。\n ", max_size=3000))
def test_chunks_cover(text):
    found = k.chunks(text)
    assert (not text) == (not found)
    if found:
        assert found[0][0] == 0 and found[-1][1] == len(text)
    for (a, b), (c, _) in zip(found, found[1:]):
        assert a < c <= b and b - c <= 80
    assert all(0 < b - a <= 800 for a, b in found)


def test_chunks_edges():
    assert k.chunks("x" * 800) == [(0, 800)]
    assert k.chunks("x" * 801) == [(0, 800), (720, 801)]
    assert k.chunks("x" * 249 + "。" + "x" * 700)[0] == (0, 250)


def places(text, query):
    return next((found for _, found in RequestMatcher([query]).matches(text)), [])


def test_literal_matches():
    assert [m[:2] for m in places("aaa", "aa") if m[2] == "exact"] == [(0, 2), (1, 3)]
    assert places("甲，乙丙", "甲乙") == [(0, 3, "partial")]
    assert places("cat1 cats cat", "Cat") == [(10, 13, "partial")]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab 甲乙。", max_size=40), st.text(alphabet="ab甲乙", min_size=1, max_size=4))
def test_partials_keep_clear(text, query):
    found = places(text, query)
    assert found == sorted(found)
    exact, partial = ([m for m in found if m[2] == level] for level in ("exact", "partial"))
    assert all(text[a:b] == query for a, b, _ in exact)
    assert not any(a < d and c < b for a, b, _ in partial for c, d, _ in exact)


def test_excerpt_and_packing():
    text = "One. Two here. Three."
    assert k.excerpt(text, 6, 8) == (5, 14)
    assert k.pack_chunks("aa\n\nbb\n\ncc", 6) == ["aa\n\nbb", "cc"]
    assert k.pack_chunks("x" * 10, 4) == ["xxxx", "xxxx", "xx"]
    assert k.attachment_parts("a\n\nb", 10) == ["a\n\nb"]


def test_audit_and_repair():
    assert k.audit_punctuation("甲乙丙", "甲，乙丙。") == ("ok", 1.0)
    assert k.audit_punctuation("甲" * 50, "甲" * 50)[0] == "unpunctuated"
    assert k.audit_punctuation("甲乙", " ")[0] == "empty"
    one, two, three = "first paragraph of it all", "second paragraph is lost here", "third one closes the page"
    assert k.repair_paragraphs("\n\n".join([one, two, three]), "\n\n".join([one, three])) == "\n\n".join([one, two, three])


def test_conversion_and_decoding():
    assert k.WordConverter({"头发": "頭髮"}, {"发": "發"})("头发发") == "頭髮發"
    assert k.decode_bytes("汉字".encode("gb18030")) == ("汉字", "gb18030", 0)
    assert k.decode_bytes(b"\xef\xbb\xbfa") == ("a", "utf-8-sig", 0)
    assert k.decode_bytes(b"\xff\xff\xef\xbf\xbd") == ("\ufffd\ufffd\ufffd", None, 2) and k.decode_bytes(None) == (None, None, 0)


def test_hidden_elements_still_break_lines():
    read = k.visible_text
    assert read("a<noscript><p>x</p></noscript>b") == "a\n\nb"
    assert read("a &amp; b<br/>c<BR>d<script>if(a<b){}</script>x") == "a & b\nc\ndx"
    assert read("x <!-- <p> --> y<p title='a>b'>t</p>") == "x  y\nt\n"
    assert read("<style>p{}") == "" and read("1 < 2 and 3 > 2") == "1 < 2 and 3 > 2" and read(None) is None


def test_lost_paragraphs_go_back_to_their_places():
    parts = [f"paragraph number {w} has quite some words" for w in ("one", "two", "three", "four", "five")]
    source = "\n\n".join(parts)
    for kept in ((0, 2, 4), (1, 2), (4,), (0,), (3, 4), (0, 1, 2, 3, 4)):
        heads = [f"{'abcde'[i] * 14} {p} {'vwxyz'[i] * 14}" for i, p in enumerate(parts)]
        have = "\n\n".join(heads)
        out = "\n\n".join(heads[i] for i in kept)
        found = k.repair_paragraphs(have, out).split("\n\n")
        assert [h for h in heads if h in found] == [f for f in found if f in heads]
    assert k.repair_paragraphs(source, None) is None and k.repair_paragraphs("", "x") == "x"


def test_literal_scores_one_by_one():
    rng = np.random.default_rng(3)
    texts = ["", "a", "ab", *("".join(rng.choice(list("abc1"), rng.integers(1, 30))) for _ in range(60))]
    asked = []
    for q in ["a", "ab", "abc", "cab1a", "abcabca1", "zz", *("".join(rng.choice(list("abc1"), rng.integers(1, 9))) for _ in range(20))]:
        grams = [q] if len(q) == 1 else list(dict.fromkeys(q[i : i + 2] for i in range(len(q) - 1)))
        asked.append((q, grams, list(dict.fromkeys(re.findall("[a-c]+|1", q)))))
    found = np.zeros((len(texts), len(asked)))
    t, r, score = LiteralScorer(asked).scores(texts)
    found[t, r] = score
    for i, t in enumerate(texts):
        for j, (q, grams, terms) in enumerate(asked):
            pairs = sum(g in t for g in grams)
            whole = q in t
            want = 0.0
            if t and (whole or pairs >= (2 if len(grams) >= 6 else 1)):
                want = 5.0 * whole + pairs / len(grams) + sum(x in t for x in terms) / max(1, len(terms)) * 0.2
            assert abs(found[i, j] - want) < 1e-9, (t, q)


def test_automaton_equals_a_search_for_each_request():
    import unicodedata

    def slow(text, query):
        bare, source = "", []
        for i, c in enumerate(text):
            if not (c.isspace() or unicodedata.category(c)[0] == "P"):
                bare, source = bare + c.lower(), source + [i] * len(c.lower())
        han = lambda c: c == "〇" or "CJK UNIFIED" in unicodedata.name(c, "") or "CJK COMPATIBILITY IDEOGRAPH" in unicodedata.name(c, "")
        letter = lambda c: unicodedata.category(c)[0] == "N" or "LATIN" in unicodedata.name(c, "")
        exact = [(i, i + len(query)) for i in range(len(text)) if text.startswith(query, i)]
        own = "".join(c.lower() for c in query if not (c.isspace() or unicodedata.category(c)[0] == "P"))
        terms = {own} | {own[i : i + 2] for i in range(len(own) - 1) if all(map(han, own[i : i + 2]))} | {w for w in re.findall(r"[^\W_]+", query.lower()) if not any(map(han, w))}
        loose = []
        for t in terms - {""}:
            for i in range(len(bare)):
                if bare.startswith(t, i):
                    s, e = source[i], source[i + len(t) - 1] + 1
                    if all(map(letter, t)) and ((s and letter(text[s - 1])) or (e < len(text) and letter(text[e]))):
                        continue
                    if not any(s < d and c < e for c, d in exact):
                        loose.append((s, e))
        merged = []
        for s, e in sorted(loose):
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        return sorted([(s, e, "exact") for s, e in exact] + [(s, e, "partial") for s, e in merged])

    rng = np.random.default_rng(8)
    letters = list("abA1 ,。甲乙〇İß_𠀀")
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(150)]
    asked = ["".join(rng.choice(letters, rng.integers(1, 6))) for _ in range(60)] + ["", "。", "甲乙", "a", "aa"]
    matcher = RequestMatcher(asked)
    for t in texts:
        found = dict(matcher.matches(t))
        for i, q in enumerate(asked):
            assert found.get(i, []) == (slow(t, q) if q else []), (t, q)


def test_time_of_matching_does_not_grow_with_the_requests():
    import time

    rng = np.random.default_rng(5)
    page = "".join(rng.choice(list("甲乙丙丁戊己庚辛壬癸"), 20_000))
    took = []
    for n in (100, 10_000):
        others = RequestMatcher(["".join(map(chr, rng.integers(0x5000, 0x9000, 20))) for _ in range(n)])
        list(others.matches(page))
        began = time.perf_counter()
        for _ in range(5):
            assert list(others.matches(page)) == []
        took.append(time.perf_counter() - began)
    assert took[1] < 25 * took[0] + 0.2  # a hundred times the requests; caches differ


def test_best_scores_look_at_few_texts():
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(300)]
    texts = ["".join(rng.choice(words, rng.integers(0, 30))) for _ in range(1500)]
    described = [f"title{i % 5}{words[i % 7]}" for i in range(1500)]
    asked = []
    for q in ["a", "ab", *("".join(rng.choice(words, 3)) for _ in range(20))]:
        grams = [q] if len(q) == 1 else list(dict.fromkeys(q[i : i + 2] for i in range(len(q) - 1)))
        asked.append((q, grams, [q]))
    whole, few = LiteralScorer(asked), LiteralScorer(asked)
    table = np.zeros((len(texts), len(asked)))
    t, r, score = whole.scores(texts)
    table[t, r] = score
    t, r, score = whole.scores(described)
    extra = np.zeros_like(table)
    extra[t, r] = score
    want = np.round(table + 0.3 * extra, 6)
    best, rows = BestSoFar(few, 10, 0.3), []
    for i in range(0, 1500, 100):
        t, r, score = best.scores(texts[i : i + 100], described[i : i + 100])
        keep = best.keep(r, score, t)
        rows += zip((t[keep] + i).tolist(), r[keep].tolist(), score[keep].tolist())
    for j in range(len(asked)):
        top = sorted((-want[i, j], i) for i in range(1500) if want[i, j] > 0)[:10]
        assert sorted((-s, i) for i, q, s in rows if q == j)[:10] == top
    assert few.scored < 0.6 * whole.scored


def test_many_long_requests_fit_in_memory():
    import tracemalloc

    rng = np.random.default_rng(7)
    asked = []
    for _ in range(10_000):
        q = "".join(map(chr, rng.integers(0x4E00, 0x9FFF, 20)))
        asked.append((q, list(dict.fromkeys(q[i : i + 2] for i in range(19))), [q[i : i + 2] for i in range(0, 20, 2)]))
    tracemalloc.start()
    t, r, score = LiteralScorer(asked).scores([asked[7][0] + "x", "none", asked[9][0][:5]])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1e9 and {(0, 7), (2, 9)} <= set(zip(t.tolist(), r.tolist()))


def test_longest_phrases_first():
    convert = k.WordConverter({"ab": "1", "abc": "2", "bd": "3"}, {"a": "x", "c": "y"})
    assert convert("abcabdaab") == "2" + "1" + "d" + "x" + "1" and convert(None) == "" and convert("") == ""
    assert k.WordConverter({}, {"a": "b"})("aa") == "bb"


def test_visible_text_equals_the_standard_parser():
    from html.parser import HTMLParser

    class Shown(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.depth = [], 0

        def handle_starttag(self, tag, attrs):
            if tag in k.SKIPPED_TAGS:
                self.depth += 1
            elif tag in k.OPENING_BREAKS:
                self.out.append("\n")

        def handle_endtag(self, tag):
            if tag in k.SKIPPED_TAGS:
                self.depth = max(0, self.depth - 1)
            elif tag in k.CLOSING_BREAKS:
                self.out.append("\n")

        def handle_data(self, data):
            if not self.depth:
                self.out.append(data)

    rng = np.random.default_rng(12)
    parts = ["<p>", "</p>", "<script>", "</script>", "<script/>", "<noscript/>", "<noscript>", "</noscript>", "<style >", "</ style >", "<br/>", "<BR>", "<div class='a>b'>", '<li x="<p>" y=z>', "</li >", "</ junk>", "</>", "<!-- <p> -->", "<!doctype html>", "<?pi x>", "<h1>", "</h1>", "< 3", "a < b", "&amp;", "&lt;p&gt;", "x", " text ", "甲", "<tr / >", "<p/ >", "<x a=/>", "</div x>", '<p "q">', "\n"]
    for _ in range(4000):
        page = "".join(rng.choice(parts, rng.integers(1, 14))) + " .\n"
        want = Shown()
        want.feed(page)
        assert k.visible_text(page) == "".join(want.out), page


def test_broken_markup_takes_no_time():
    import time

    for piece in ("<a b", "<", "</", "<!--", "<script", '<a b="', "<p a='x' b=\"", "<![CDATA[", "&", "</ a"):
        began = time.perf_counter()
        k.visible_text(piece * (1_000_000 // len(piece)))
        assert time.perf_counter() - began < 5, piece
