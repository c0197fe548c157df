"""Blocks, runs and alignments against the slow way."""

import random
import time
from difflib import SequenceMatcher

import pytest

from quire.functions import blocks, kernels
from quire.functions.literal import occurrences


def _texts(rng, n):
    for t in range(n):
        letters = "ab" if t % 3 == 0 else "abcdefgh甲\U00020000"
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60) if t % 5 else rng.randint(100, 400)))
        b = list(a) if t % 2 else [rng.choice(letters) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 8)):
            if b:
                k = rng.randrange(len(b))
                b[k : k + rng.randint(0, 3)] = rng.choice(letters) * rng.randint(0, 3)
        yield a, "".join(b)


@pytest.mark.parametrize("few", [0, 50, blocks.FEW])
def test_blocks_are_those_of_the_slow_matcher(monkeypatch, few):
    monkeypatch.setattr(blocks, "FEW", few)
    for a, b in _texts(random.Random(few), 400):
        slow = SequenceMatcher(None, a, b, autojunk=False)
        assert blocks.matching_blocks(a, b) == [tuple(m) for m in slow.get_matching_blocks() if m.size]
        assert blocks.likeness(a, b) == slow.ratio()


def test_a_long_page_takes_seconds():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    a = "".join(rng.choice(words) for _ in range(190_000))[:1_000_000]
    b = list(a)
    for _ in range(300):
        b[rng.randrange(len(b))] = rng.choice("xyz")
    began = time.time()
    assert blocks.likeness(a, "".join(b)) > 0.999
    assert blocks.likeness("ab" * 100_000, "ba" * 100_000) > 0.99
    assert time.time() - began < 60


def test_coverage_of_runs():
    rng = random.Random(5)
    for _ in range(200):
        letters = "ab" if rng.random() < 0.5 else "abcdefgh甲\U00020000"
        other = "".join(rng.choice(letters) for _ in range(rng.randint(0, 300)))
        own = ["", *("".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(4)), other[5:60], other[:9]]
        want = [1.0 if not c else float(c in other) if len(c) < 16 else sum(c[i : i + 8] in other for i in range(len(c) - 7)) / (len(c) - 7) for c in own]
        assert blocks.coverages(own, other) == pytest.approx(want)
    assert blocks.coverages([], "") == [] and blocks.coverages(["x" * 20], "") == [0.0]


def test_runs_that_share_a_hash_are_told_apart(monkeypatch):
    import numpy as np

    monkeypatch.setattr(blocks, "_FACTORS", np.ones(blocks.RUN, dtype=np.uint64))  # every order of the same characters
    other = "hgfedcba" + "abcdefgh" * 3
    assert blocks.coverages(["abcdefghabcdefgh", "badcfehgbadcfehg"], other) == [1.0, 0.0]


def test_occurrences_overlap():
    assert {w: p.tolist() for w, p in occurrences(["aa", "a", "b", "aa", ""], "aaa").items()} == {"aa": [0, 1], "a": [0, 1, 2], "b": []}


def _slow_align(displayed, lines):
    spans, flat = [], ""
    for line in lines:
        own = kernels.content_of(line["text"])
        spans.append((len(flat), len(flat) + len(own), line["id"]))
        flat += own
    matched = [tuple(m) for m in SequenceMatcher(None, kernels.content_of(displayed), flat, autojunk=False).get_matching_blocks() if m.size]
    out, at, floor = [], 0, 0
    for s in kernels.sentences(displayed):
        own = kernels.content_of(s["text"])
        begin, end, at = at, at + len(own), at + len(own)
        if not own:
            continue
        found = flat.find(own, floor)
        several = sum(flat.startswith(own, i) for i in range(len(flat)))
        if found >= 0 and (several == 1 or found == floor):
            first, last, kind, sure = found, found + len(own), "exact", 1.0
        else:
            hits = [(max(begin, a) - a + b, min(end, a + n) - a + b) for a, b, n in matched if a < end and a + n > begin]
            if not hits:
                continue
            first, last, got = hits[0][0], hits[-1][1], sum(b - a for a, b in hits)
            exact = got == len(own) and last - first == len(own)
            close = len(own) >= 8 and several <= 1 and got >= 0.9 * len(own) and len(own) - got <= 2 and last - first <= len(own) + max(5, len(own) // 20) // 2
            if first < floor or not (exact or close):
                continue
            kind, sure = "exact" if exact else "fuzzy", got / len(own)
        floor = last
        out.append({"id": s["id"], "lines": [i for a, b, i in spans if a < last and b > first], "kind": kind, "confidence": sure})
    return out


def test_alignment_equals_the_slow_way():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 7))) for _ in range(30)]
    for _ in range(150):
        sentences = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 12))]
        text = list("".join(sentences))
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(len(text))] = rng.choice("xyz")
        text = "".join(text)
        cuts = sorted({0, len(text), *(rng.randrange(len(text) + 1) for _ in range(6))})
        lines = [{"id": f"l{i}", "text": text[a:b]} for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        shown = ". ".join(sentences) + "."
        assert kernels.align(shown, lines) == _slow_align(shown, lines)
