"""Token ids of whole texts by a `tokenizers` file, with a bounded cache of words.

The tokenizer cuts at white space before it merges, so a text's ids are those of its
blank-separated words one after the other; each distinct word is encoded once per worker.
"""

from __future__ import annotations

import os
from collections import defaultdict
from itertools import chain, count, islice
from unicodedata import is_normalized

import numpy as np

from .common import held

END_PACK, END_STORE = 0, 1


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as `Tokenizer.encode` gives them.

    Only blanks and line feeds cut words here, which no pre-token of the tokenizer spans, so
    the ids equal those of the whole text. Words are numbered, and their ids lie in one array, from
    which those of a batch of texts are taken at once. The table of words is emptied at
    `cache_words` entries; as many lower-case forms are kept, in two halves: when the newer is full
    the older goes, and forms met again move to the newer.
    """

    def __init__(self, path: str, cache_words: int = 1_200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._limit = cache_words
        self._clear()
        self._forms: dict[str, bytes] = {"": b""}
        self._older: dict[str, bytes] = {}
        # in a byte-level vocabulary a character stands for a byte, but for the mark of a word's end
        vocabulary, end = self._tokenizer.get_vocab(), getattr(self._tokenizer.model, "end_of_word_suffix", None) or ""
        self._octets = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self._octets[i] = len(token.removesuffix(end))
        self._points = {p: self._ids(p).tobytes() for p in ".,"}

    def _clear(self) -> None:
        # numbers words in the order in which they come
        self._words, self._used = defaultdict(count().__next__), 0
        self._flat = np.zeros(1 << 16, dtype="<u4")
        self._begin, self._size = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") if t else [] for t in texts]
        if len(self._words) > self._limit:
            self._clear()
        counts, before = np.fromiter(map(len, split), dtype=np.int64, count=len(split)), len(self._words)
        words = np.fromiter(map(self._words.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(counts.sum()))
        if len(self._words) > before:
            self._learn([*islice(reversed(self._words), len(self._words) - before)][::-1])
        size = self._size[words]
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        raw = self._flat[np.repeat(self._begin[words] - upto + size, size) + np.arange(total)].tobytes()
        ends = np.concatenate([[0], upto])[np.concatenate([[0], np.cumsum(counts)])] * 4
        return [raw[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def _learn(self, new: list[str]) -> None:
        """A word of plain letters shares its lower-case form's ids, with a point or comma after it apart; so do all words of ASCII.

        Letters whose lower-case form is no letter (a capital that becomes a letter and a mark) are
        spelled as they are: such a mark would join the point after it.
        """
        if len(self._forms) > self._limit // 2:
            self._forms, self._older = {"": b""}, self._forms
        points, forms, shapes, tails = self._points, self._forms, [], []
        for w, low in zip(new, map(str.lower, new)):
            if w.isalpha() and w.isascii():
                shapes.append(low)
                tails.append(b"")
                continue
            tail = points.get(w[-1:], b"")
            stem = w[:-1] if tail else w
            if stem.isalpha() and (stem.isascii() or (max(stem) < "\u0250" and stem.lower().isalpha())):
                shapes.append(stem.lower())
                tails.append(tail)
            else:
                shapes.append(low if w.isascii() else w)
                tails.append(b"")
        need = set(shapes).difference(forms)
        for f in need & self._older.keys():
            forms[f] = self._older[f]
        self._encode_forms([f for f in need if f not in forms])
        found = [forms[f] + t for f, t in zip(shapes, tails)]
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        ids = np.frombuffer(b"".join(found), dtype="<u4")
        first, n = len(self._words) - len(new), len(self._words)
        if n > len(self._size):
            self._begin, self._size = (np.concatenate([x[:first], np.zeros(2 * n - first, dtype=np.int64)]) for x in (self._begin, self._size))
        if self._used + len(ids) > len(self._flat):
            self._flat = np.concatenate([self._flat[: self._used], np.zeros(2 * (self._used + len(ids)) - self._used, dtype="<u4")])
        self._size[first:n] = size
        self._begin[first:n] = self._used + np.cumsum(size) - size
        self._flat[self._used : self._used + len(ids)] = ids
        self._used += len(ids)

    def _encode_forms(self, need: list[str]) -> None:
        """Many forms at once, with blanks between: each id stands for a known number of bytes, which tells whose it is.

        Forms that the tokenizer may change before it cuts them (unprintable, not in lower case or
        not composed) are encoded apart.
        """
        plain = [f for f in need if f.isprintable() and (f.isascii() or (f.lower() == f and is_normalized("NFC", f)))]  # those of ASCII come in lower case
        for i in range(0, len(plain), 20_000):
            part = plain[i : i + 20_000]
            ids = self._ids(" ".join(part))
            upto = np.cumsum(self._octets[ids])
            want = np.cumsum(np.fromiter(map(len, map(str.encode, part)), dtype=np.int64, count=len(part)))
            ends = np.searchsorted(upto, want)
            if len(ids) == 0 or upto[-1] != want[-1] or not np.array_equal(upto[np.minimum(ends, len(ids) - 1)], want):
                continue  # ids that do not end where the forms do: encoded apart below
            raw, begin = ids.tobytes(), 0
            for f, end in zip(part, ((ends + 1) * 4).tolist()):
                self._forms[f] = raw[begin:end]
                begin = end
        rest = [f for f in need if f not in self._forms]
        for f, found in zip(rest, self._tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self._forms[f] = np.array(found.ids, dtype="<u4").tobytes()


def encoder(path: str, cache_words: int = 1_200_000) -> WordEncoder:
    """One encoder per worker process and file."""
    return held(("encoder", path), lambda: WordEncoder(path, cache_words))
