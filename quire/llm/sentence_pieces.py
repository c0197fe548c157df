"""SentencePiece ids with the place of every piece in the original text, and texts from ids.

A text is normalised by longest prefix through the model's compiled character map; every
normalised byte keeps the source bytes that it came from, so pieces project to original spans.
The library cuts the normalised text into pieces; it does so once for each distinct segment
where the model's vocabulary shows that segments cannot influence each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, pieces_of, raw

# Field numbers and piece kinds of the model format, and the mark that stands for a blank
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BLANK = "▁".encode()
MALFORMED = "\ufffd".encode()

#: Segments that a worker keeps, and ids of them.
MOST_SEGMENTS, MOST_IDS = 250_000, 4_000_000
#: Bytes of text that are encoded at a time.
TEXT_SLICE = 1_000_000


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message; fixed-width values stay bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def _message(pairs: list[tuple[int, int | bytes]]) -> bytes:
    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    return b"".join(varint(k << 3) + varint(v) if isinstance(v, int) else varint(k << 3 | 2) + varint(len(v)) + v for k, v in pairs)


class CharacterMap:
    """The compiled map: a double-array trie of byte strings, each leading to its replacement.

    A unit holds a label, an offset to its children and whether a key ends there; the value of a
    key is the place of its replacement in the text after the trie.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self._units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self._text = blob[4 + size :]

    def _offset(self, unit: int) -> int:
        return (unit >> 10) << (8 if unit & 512 else 0)

    def _step(self, node: int, byte: int) -> tuple[int, int | None] | None:
        """The node below `node` by `byte`, and its value if a key ends there."""
        at = node ^ byte
        if at >= len(self._units) or (unit := self._units[at]) & 0x800000FF != byte:
            return None
        below = at ^ self._offset(unit)
        return below, self._units[below] & 0x7FFFFFFF if unit & 256 else None

    def _replacement(self, value: int) -> bytes:
        return self._text[value : self._text.index(b"\0", value)]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that begins at `at`."""
        node, found = self._offset(self._units[0]), None
        for i in range(at, len(text)):
            step = self._step(node, text[i])
            if step is None:
                break
            node, value = step
            if value is not None:
                found = i + 1 - at, value
        return found and (found[0], self._replacement(found[1]))

    def items(self) -> Iterator[tuple[bytes, bytes]]:
        """All keys with their replacements."""
        below = [(self._offset(self._units[0]), b"")]
        while below:
            node, key = below.pop()
            for byte in range(256):
                if byte and (step := self._step(node, byte)) is not None:
                    below.append((step[0], key + bytes([byte])))
                    if step[1] is not None:
                        yield below[-1][1], self._replacement(step[1])


@dataclass
class Model:
    """What a model file says of pieces and normalisation."""

    data: bytes
    pieces: list[tuple[bytes, int]] = field(default_factory=list)
    characters: CharacterMap | None = None
    dummy_prefix: bool = True
    trim: bool = True
    escape: bool = True
    blank_last: bool = False

    @classmethod
    def read(cls, data: bytes) -> Model:
        found = cls(data)
        for number, value in _fields(data):
            if number == PIECES:
                own = dict(_fields(value))
                found.pieces.append((own[1], own.get(3, NORMAL)))
            elif number == TRAINER:
                found.blank_last = bool(dict(_fields(value)).get(24, 0))
            elif number == NORMALIZER:
                own = dict(_fields(value))
                found.characters = CharacterMap(own[2]) if own.get(2) else None
                found.dummy_prefix, found.trim, found.escape = (bool(own.get(k, 1)) for k in (3, 4, 5))
        return found

    def bare(self) -> bytes:
        """The model with a normaliser that leaves texts as they are; a later message overrides."""
        return self.data + _message([(NORMALIZER, _message([(1, b"identity"), (2, b""), (3, 0), (4, 0), (5, 0)]))])


_CHARACTER = re.compile(rb"[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")


class Normalizer:
    """Normalised bytes of a text, and of each of them where its source begins and ends."""

    def __init__(self, model: Model):
        self._model = model
        own = sorted({p for p, kind in model.pieces if kind == USER_DEFINED}, key=len, reverse=True)
        self._kept = re.compile(b"|".join(map(re.escape, own))) if own else None
        self._space = BLANK if model.escape else b" "
        self.plain = model.characters is None and self._kept is None

    def units(self, text: bytes) -> Iterator[tuple[bytes, int, int]]:
        """(replacement, begin, end) of the longest prefix that the map knows, of one character elsewhere; symbols of the user stay."""
        at, characters = 0, self._model.characters
        while at < len(text):
            kept = self._kept and self._kept.match(text, at)
            if kept:
                size, out = kept.end() - at, kept[0]
            elif characters is not None and (found := characters.longest(text, at)) is not None:
                size, out = found
            elif (one := _CHARACTER.match(text, at)) is not None:
                size, out = one.end() - at, one[0]
            else:
                size, out = 1, MALFORMED
            yield out, at, at + size
            at += size

    def _laid(self, units: list[tuple[bytes, int, int]]) -> tuple[bytes, np.ndarray, np.ndarray]:
        sizes = [len(u) for u, _, _ in units]
        return b"".join(u for u, _, _ in units), np.repeat(np.array([b for _, b, _ in units], dtype=np.int64), sizes), np.repeat(np.array([e for _, _, e in units], dtype=np.int64), sizes)

    def segment(self, text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """As `whole`, for a segment inside of a text: nothing is added or taken away."""
        return self._laid([(u.replace(b" ", self._space), b, e) for u, b, e in self.units(text)])

    def whole(self, text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        model, out, begin = self._model, [], 0
        units = list(self.units(text))
        if model.trim:
            first = next((i for i, u in enumerate(units) if u[0] != b" "), len(units))
            begin = units[first][1] if first < len(units) else len(text)
            units = units[first:]
        if not units:
            return self._laid([])
        added = [(self._space, begin, begin)] if model.dummy_prefix else []
        after_blank = model.trim
        for u, b, e in units:
            u = u.lstrip(b" ") if after_blank else u
            if u:
                out.append((u, b, e))
                after_blank = model.trim and u.endswith(b" ")
        out = [(u.replace(b" ", self._space), b, e) for u, b, e in out]
        if not model.blank_last:
            out = added + out
        while model.trim and out and out[-1][0].endswith(self._space):
            u, b, e = out.pop()
            if rest := u[: -len(self._space)]:
                out.append((rest, b, e))
        if model.blank_last and added:
            end = out[-1][2] if out else begin
            out.append((self._space, end, end))
        return self._laid(out)


class _Numbers(dict):
    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


class PieceEncoder:
    """Ids of texts, and for each id where its source begins and ends, in bytes of the text.

    A piece spans every source character that it holds a byte of: the byte pieces of one character
    all span that character, and a blank put before the text spans nothing.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as file:
            self._model = Model.read(file.read())
        self._library = SentencePieceProcessor(model_proto=self._model.bare())
        self._normalizer = Normalizer(self._model)
        pieces = self._model.pieces
        #: bytes of the normalised text that an id stands for; -1 where that depends on the text
        self._octets = np.array([1 if kind == BYTE else -1 if kind == UNKNOWN else len(p) for p, kind in pieces], dtype=np.int64)
        self._apart = self._segments()
        self._clear()

    def _segments(self) -> re.Pattern | None:
        """How texts are cut before they are normalised; None if segments could influence each other.

        They cannot where no piece has a blank behind another character, so that none spans a
        segment's begin, where blanks stay one by one, and where no key or replacement of the map
        touches them. A line feed stands alone if no piece holds one. (A text that holds the mark
        itself is one segment.)
        """
        model = self._model
        usual = [p for p, kind in model.pieces if kind in (NORMAL, UNUSED, USER_DEFINED)]
        mapped = list(model.characters.items()) if model.characters else []
        blanks = any(b" " in k or b" " in v or BLANK in v for k, v in mapped)
        if model.trim or model.blank_last or not (model.dummy_prefix and model.escape) or blanks or any(kind == USER_DEFINED for _, kind in model.pieces):
            return None
        if any(BLANK in p.lstrip(BLANK) or (BLANK in p and not p.startswith(BLANK)) for p in usual):
            return None
        feed = not any(b"\n" in p for p in usual) and not any(b"\n" in k or b"\n" in v for k, v in mapped)
        return re.compile(rb" *[^ \n]+|\n| +" if feed else rb" *[^ ]+| +")

    def _clear(self) -> None:
        self._known, self._used = _Numbers(), 0
        self._flat = np.zeros((3, 1 << 16), dtype=np.int32)
        self._begin, self._size, self._bytes = (np.zeros(1 << 14, dtype=np.int64) for _ in range(3))

    def _cut(self, texts: list[bytes], begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (ids, begins, ends) of normalised texts, whose bytes' places lie one after the other, and the number of ids of each."""
        found = self._library.encode([t.decode() for t in texts], num_threads=1)
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ids = np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(counts.sum()))
        size, edges = self._octets[ids], np.concatenate([[0], np.cumsum(counts)])
        for i in np.unique(np.searchsorted(edges, np.flatnonzero(size < 0), side="right") - 1).tolist():
            pieces = self._library.encode(texts[i].decode(), out_type="immutable_proto").pieces
            size[edges[i] : edges[i + 1]] = [len(p.surface.encode()) for p in pieces]
        upto = np.cumsum(size)
        if not np.array_equal(np.concatenate([[0], upto])[edges], np.cumsum([0, *map(len, texts)])):
            raise ValueError("pieces do not cover the normalised text")
        return np.stack([ids, begin[upto - size], end[upto - 1]]).astype(np.int32), counts

    def _learn(self, new: list[bytes]) -> None:
        laid = self._plain(new) if self._normalizer.plain else _together([self._normalizer.segment(s) for s in new])
        rows, size = self._cut(*laid)
        total, n = int(size.sum()), len(self._known)
        first = n - len(new)
        if n > len(self._size):
            self._begin, self._size, self._bytes = (np.concatenate([x[:first], np.zeros(2 * n - first, dtype=np.int64)]) for x in (self._begin, self._size, self._bytes))
        if self._used + total > self._flat.shape[1]:
            self._flat = np.concatenate([self._flat[:, : self._used], np.zeros((3, self._used + 2 * total), dtype=np.int32)], axis=1)
        self._size[first:n], self._begin[first:n] = size, self._used + np.cumsum(size) - size
        self._bytes[first:n] = [len(s) for s in new]
        self._flat[:, self._used : self._used + total] = rows
        self._used += total

    @staticmethod
    def _plain(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Without a map the characters of segments stay; their blanks become marks."""
        octets = np.frombuffer(b"".join(texts), dtype=np.uint8)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        starts = np.flatnonzero(octets & 0xC0 != 0x80)
        ends = np.append(starts[1:], len(octets))
        size = np.where(octets[starts] == 32, len(BLANK), ends - starts)
        first = np.repeat(np.cumsum(lengths) - lengths, lengths)[starts]
        return [t.replace(b" ", BLANK) for t in texts], np.repeat(starts - first, size), np.repeat(ends - first, size)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Three rows (ids, begins, ends) of all texts in turn, and the number of ids of each text."""
        texts = [t if t.isascii() else t.decode("utf-8", "replace").encode() for t in texts]
        if self._apart is None:
            return self._cut(*_together([self._normalizer.whole(t) for t in texts]))
        if len(self._known) > MOST_SEGMENTS or self._used > MOST_IDS:
            self._clear()
        # a blank stands before every text; its place is taken off again below
        split = [([b" " + t] if BLANK in t else self._apart.findall(b" " + t)) if t else [] for t in texts]
        had = len(self._known)
        per_text = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        numbers = np.fromiter(map(self._known.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(per_text.sum()))
        if len(self._known) > had:
            self._learn(_tail(self._known, len(self._known) - had))
        size = self._size[numbers]
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        found = self._flat[:, np.repeat(self._begin[numbers] - upto + size, size) + np.arange(total)]
        begins = np.cumsum(self._bytes[numbers]) - self._bytes[numbers]
        heads = np.cumsum(per_text) - per_text
        begins -= np.repeat(begins[np.minimum(heads, max(0, len(begins) - 1))] if len(begins) else np.zeros(len(per_text), dtype=np.int64), per_text)
        shift = np.repeat(begins - 1, size)
        found[1:] = np.maximum(found[1:] + shift, 0)
        edges = np.concatenate([[0], upto])
        counts = np.diff(edges[np.concatenate([[0], np.cumsum(per_text)])])
        return found, counts


def _together(laid: list[tuple[bytes, np.ndarray, np.ndarray]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    none = np.zeros(0, dtype=np.int64)
    return [t for t, _, _ in laid], np.concatenate([none, *(b for _, b, _ in laid)]), np.concatenate([none, *(e for _, _, e in laid)])


def _tail(known: dict, n: int) -> list[bytes]:
    """The `n` keys that came last, in order."""
    return list(islice(reversed(known), n))[::-1]


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and model."""
    return held(("pieces", path), lambda: PieceEncoder(path))


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, and the begin and end of every piece in bytes of the document's UTF-8 text.

    Without begin or end ids; a null or empty text has no pieces. Repeated rows are encoded again, a
    null doc_id stays null, an empty table gives no rows, and other columns are ignored. Texts are
    encoded where they lie, whole, in slices of TEXT_SLICE bytes or so.
    """

    def run(batches):
        encoding = encoder(model_path)
        for whole in batches:
            for batch in pieces_of(whole, TEXT_SLICE):
                found, counts = encoding.encode(raw(batch.column(1)))
                edges = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                yield pa.record_batch([batch.column(0), *(pa.ListArray.from_arrays(edges, pa.array(row)) for row in found)], names=["doc_id", "ids", "begins", "ends"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, ids array<int>, begins array<int>, ends array<int>")


#: Ids that are handed to the library at a time.
SLICE = 200_000


def decode(encoded: DataFrame, model_path: str, column: str = "decoded") -> DataFrame:
    """`encoded` with the text of its `ids` in `column`, as the library's decode gives it; none for null."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        from sentencepiece import SentencePieceProcessor

        library = held(("decoder", model_path), lambda: SentencePieceProcessor(model_file=model_path))
        out, part, size = [], [], 0
        for row in ids:
            part.append([] if row is None else row.tolist())
            size += len(part[-1])
            if size > SLICE:
                out += library.decode(part, num_threads=1)
                part, size = [], 0
        return pd.Series(out + (library.decode(part, num_threads=1) if part else []), dtype=object)

    return encoded.withColumn(column, text("ids"))
