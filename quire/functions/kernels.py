"""Pure-Python helpers of the Arrow UDFs: text in, small values out, testable without Spark."""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import numpy as np

from .blocks import likeness, matching_blocks
from .literal import SPACE, Joined, occurrences

# Fixed values
SKIPPED_TAGS = {"script", "style", "noscript"}
OPENING_BREAKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6"}
CLOSING_BREAKS = {"p", "div", "li", "tr"}
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "big5", "utf-16")
CHUNK_MOST, CHUNK_LEAST, CHUNK_IDEAL, CHUNK_OVERLAP = 800, 250, 500, 80
CONTEXT_BEFORE, CONTEXT_AFTER = 160, 240

# Fixed patterns: where sentences, paragraphs and chunks may end
_SENTENCE_ENDS = re.compile(r"[。！？!?]+[”’」』）】]*|\.(?=\s|$)")
_EXCERPT_ENDS = re.compile(r"[。！？!?]+[”’」』）】\"']*|\.[”’」』）】\"']*(?=\s|$)|\r?\n[ \t]*\r?\n")
_CHUNK_ENDS = re.compile(r"\n\s*\n|[。！？!?；;](?:[”’」』])?")
_BLANK_LINE = re.compile(r"\n[ \t]*\n")


# Fixed patterns of markup: a tag's name, the rest of a start tag (quotes count behind `=`; one left open takes all),
# an end tag, and where declarations of each kind end
_NAME = re.compile(r"[a-zA-Z][^\t\n\r\f />\x00]*")
_REST = re.compile(r"""(?:[^>=]|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+>""")
_END = re.compile(r"\s*+([a-zA-Z][-.a-zA-Z0-9:_]*+)\s*+>")
_COMMENT_END, _SECTION_END, _TAG_END = re.compile(r"--\s*>"), re.compile(r"\]\]>"), re.compile(">")
_RAW_END = {tag: re.compile(rf"(?i)</\s*{tag}\s*>") for tag in ("script", "style")}


def _markup(value: str, at: int) -> tuple[str, bool, bool, int] | None:
    """Of what begins with the `<` at `at`: (name, whether it opens, whether it closes, place behind it); no name for comments and the like, None if it has no end."""
    follows = value[at + 1 : at + 2]
    if follows == "/":
        if end := _END.match(value, at + 2):
            return end[1].lower(), False, True, end.end()
        name = _NAME.match(value, at + 2)
        stop = value.find(">", name.end() if name else at + 2) + 1
        return (name[0].lower() if name else "", False, bool(name), stop) if stop else None
    if follows in ("!", "?"):
        ends = _COMMENT_END if value.startswith("<!--", at) else _SECTION_END if value[at : at + 9].lower() == "<![cdata[" else _TAG_END
        end = ends.search(value, at + (4 if ends is _COMMENT_END else 2))
        return ("", False, False, end.end()) if end else None
    name = _NAME.match(value, at + 1)
    end = _REST.match(value, name.end())
    if end is None:
        return None
    return name[0].lower(), True, value[end.end() - 2] == "/", end.end()


def visible_text(value: str | None) -> str | None:
    """Text outside of SKIPPED_TAGS, entities read; tags that break lines do so inside of those too.

    A tag that ends in `/>` opens and closes. What lies in a script or style is no markup. Markup that
    has no end takes the rest of the page with it. The cursor never goes back.
    """
    if value is None:
        return None
    out, hidden, at = [], 0, 0
    while at < len(value):
        less = value.find("<", at)
        if not hidden:
            out.append(html.unescape(value[at : less if less >= 0 else None]))
        if less < 0:
            break
        if not (value[less + 1 : less + 2] in ("/", "!", "?") or _NAME.match(value, less + 1)):
            if not hidden and less + 1 < len(value):
                out.append("<")
            at = less + 1
            continue
        found = _markup(value, less)
        if found is None:
            break
        tag, opens, closes, at = found
        if tag in SKIPPED_TAGS:
            hidden = max(0, hidden + opens - closes)
            if opens and not closes and tag in _RAW_END:
                end = _RAW_END[tag].search(value, at)
                if end is None:
                    break
                hidden, at = hidden - 1, end.end()
        else:
            out += ["\n"] * ((opens and tag in OPENING_BREAKS) + (closes and tag in CLOSING_BREAKS))
    return "".join(out)


def unescape(value: str | None) -> str | None:
    return None if value is None else html.unescape(value)


def decode_bytes(value: bytes | None) -> tuple[str | None, str | None, int]:
    """Text of the first of ENCODINGS that reads all of the bytes, and its name; else UTF-8 with marks for what it cannot read, no name, and their number."""
    if value is None:
        return None, None, 0
    for name in ENCODINGS:
        try:
            return value.decode(name), name, 0
        except UnicodeError:
            continue
    text = value.decode("utf-8", "replace")
    return text, None, text.count("\ufffd") - value.count("\ufffd".encode())


def nfkc_lower(value: str | None) -> str | None:
    return None if value is None else unicodedata.normalize("NFKC", value).lower()


def utf16_length(text: str) -> int:
    return len(text) + sum(c > "￿" for c in text)


def sentences(text: str | None) -> list[dict]:
    """Sentences that cover the text, with UTF-16 offsets; a blank line starts one."""
    if not text:
        return []
    cuts = {m.end() for m in _SENTENCE_ENDS.finditer(text)} | {m.start() for m in _BLANK_LINE.finditer(text)} | {0, len(text)}
    edges, out, at = sorted(cuts), [], 0
    for begin, end in zip(edges, edges[1:]):
        n = utf16_length(text[begin:end])
        out.append({"id": f"sentence-{len(out) + 1:03d}", "text": text[begin:end], "start": at, "end": at + n})
        at += n
    return out


def excerpt_edges(text: str) -> list[int]:
    return sorted({0, len(text)} | {m.end() for m in _EXCERPT_ENDS.finditer(text)})


def excerpt(text: str, start: int, end: int, edges: list[int] | None = None) -> tuple[int, int]:
    """The whole sentences around a range, without blanks at their ends, never less than the range."""
    edges = excerpt_edges(text) if edges is None else edges
    first, last = edges[max(0, bisect_right(edges, start) - 1)], edges[min(len(edges) - 1, bisect_left(edges, end))]
    head, tail = text[first:start], text[end:last]
    return first + len(head) - len(head.lstrip()), last - (len(tail) - len(tail.rstrip()))


def excerpts(texts: Joined, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """excerpt for many ranges of joined texts."""
    edges = np.unique(np.concatenate([texts.begin, texts.end, np.array([m.end() for m in _EXCERPT_ENDS.finditer(texts.text)], dtype=np.int64)]))
    ink = np.flatnonzero(texts.kinds & SPACE == 0)
    head = np.append(ink, len(texts.text))[np.searchsorted(ink, edges[np.searchsorted(edges, start, "right") - 1])]
    tail = np.append(-1, ink)[np.searchsorted(ink, edges[np.searchsorted(edges, end, "left")])] + 1
    return np.minimum(head, start), np.maximum(tail, end)


def chunks(text: str | None) -> list[tuple[int, int]]:
    """Ranges that cover a text: at most CHUNK_MOST long, ending where a sentence does if one ends in reach, overlapping a little."""
    if not text:
        return []
    ends, out, start = [m.end() for m in _CHUNK_ENDS.finditer(text)], [], 0
    while True:
        stop = min(len(text), start + CHUNK_MOST)
        if stop < len(text):
            reach = ends[bisect_left(ends, start + CHUNK_LEAST) : bisect_right(ends, stop)]
            if reach:
                k = bisect_left(reach, start + CHUNK_IDEAL)
                near = reach[max(0, k - 1) : k + 1]
                stop = min(near, key=lambda e: abs(e - start - CHUNK_IDEAL))
        out.append((start, stop))
        if stop == len(text):
            return out
        start = max(start + 1, stop - min(CHUNK_OVERLAP, (stop - start) // 5))


def _line_pieces(block: str, limit: int) -> list[str]:
    pieces: list[str] = []
    held = ""
    for line in block.split("\n"):
        joined = f"{held}\n{line}" if held else line
        if len(joined) <= limit:
            held = joined
            continue
        if held:
            pieces.append(held)
        held = line
        if len(line) > limit:
            pieces += [line[i : i + limit] for i in range(0, len(line), limit)]
            held = ""
    return [*pieces, held] if held else pieces


def pack_chunks(text: str | None, limit: int) -> list[str]:
    """Paragraphs, then lines, packed in turn into parts of at most `limit` characters."""
    if text is None:
        return []
    if limit <= 0 or len(text) <= limit:
        return [text]
    parts: list[str] = []
    for block in re.split(r"\n\s*\n", text):
        for piece in [block] if len(block) <= limit else _line_pieces(block, limit):
            if not piece.strip():
                continue
            if parts and len(parts[-1]) + 2 + len(piece) <= limit:
                parts[-1] += "\n\n" + piece
            else:
                parts.append(piece)
    return parts or [text]


def attachment_parts(text: str | None, limit: int = 1600) -> list[str]:
    """Paragraphs packed up to `limit`; longer ones are cut hard."""
    parts: list[str] = []
    room = False
    for paragraph in re.split(r"\n\s*\n", text or ""):
        paragraph = paragraph.strip()
        if not paragraph:
            continue
        if len(paragraph) > limit:
            parts += [paragraph[i : i + limit] for i in range(0, len(paragraph), limit)]
            room = False
        elif room and len(parts[-1]) + 2 + len(paragraph) <= limit:
            parts[-1] += "\n\n" + paragraph
        else:
            parts.append(paragraph)
            room = True
    return parts


def content_of(text: str) -> str:
    return "".join(c for c in text if unicodedata.category(c)[0] not in "PZ" and not c.isspace())


def punctuation_in(text: str) -> int:
    return sum(unicodedata.category(c)[0] == "P" for c in text)


def audit_punctuation(source: str | None, output: str | None, least: float = 0.95) -> tuple[str, float]:
    """Status and likeness of a punctuated text to its source by their content characters.

    Likeness counts every character; a matcher that drops those which fill more than a hundredth of
    a long page gives less for the same texts.
    """
    a, b = content_of(source or ""), content_of(output or "")
    if not (output or "").strip():
        return "empty", 0.0
    ratio = likeness(a, b)
    if ratio < least:
        return "changed", ratio
    if len(a) >= 40 and not punctuation_in(source or "") and not punctuation_in(output or ""):
        return "unpunctuated", ratio
    return "ok", ratio


def paragraphs(text: str) -> list[str]:
    return [p for p in map(str.strip, re.split(r"\n{2,}", text)) if p]


def runs_of(content: str, size: int = 8) -> set[str]:
    return {content[i : i + size] for i in range(len(content) - size + 1)}


def coverage(paragraph: str, other: str, other_runs: set[str], size: int = 8) -> float:
    """Share of a paragraph's runs of `size` content characters, each as often as it occurs, that the other content holds."""
    own = content_of(paragraph)
    if len(own) < 2 * size:
        return float(own in other)
    often = Counter(own[i : i + size] for i in range(len(own) - size + 1))
    return sum(often[r] for r in often.keys() & other_runs) / often.total()


#: Content characters that a paragraph is looked for by, least that can be, and least that is put back.
PROBE, LEAST_PROBE, LEAST_LOST = 12, 8, 12


def repair_paragraphs(source: str | None, output: str | None) -> str | None:
    """The output with the source paragraphs that it lacks put back: before the next one found there, else after the last one found, else at the end."""
    if output is None:
        return None
    have, out = paragraphs(source or ""), paragraphs(output)
    if not have or not out:
        return output
    inside = [content_of(p) for p in out]
    joined, ends = "\n".join(inside), list(accumulate(len(c) + 1 for c in inside))

    def number(probe: str) -> int:
        at = joined.find(probe)
        return bisect_right(ends, at) if at >= 0 else len(out)

    contents = [content_of(p) for p in have]
    found = [min(number(c[:PROBE]), number(c[-PROBE:])) if len(c) >= LEAST_PROBE else len(out) for c in contents]
    whole = content_of(output)
    runs = runs_of(whole)
    lost = {i for i, c in enumerate(contents) if len(c) >= LEAST_LOST and coverage(have[i], whole, runs) < 0.5}
    # going backwards, the seat before the next paragraph found; going forwards, the seat after the last
    seats, seat = {}, None
    for i in reversed(range(len(have))):
        if i in lost:
            seats[i] = seat
        if found[i] < len(out):
            seat = found[i]
    seat = len(out)
    for i in range(len(have)):
        if i in lost:
            seats[i] = seat = seat if seats[i] is None else seats[i]
        elif found[i] < len(out):
            seat = found[i] + 1
    put = sorted(lost, key=lambda i: (seats[i], i))
    pieces, at = [], 0
    for i in put:
        pieces += out[at : seats[i]] + [have[i]]
        at = seats[i]
    return "\n\n".join(pieces + out[at:])


class WordConverter:
    """Converts texts by a table of phrases and one of characters, the longest phrase first."""

    def __init__(self, phrases: dict[str, str], characters: dict[str, str]):
        self._phrases, self._table = phrases, str.maketrans(characters)
        self._lengths: dict[str, list[int]] = {}
        for n in sorted({len(p) for p in phrases}, reverse=True):
            for c in {p[0] for p in phrases if len(p) == n}:
                self._lengths.setdefault(c, []).append(n)
        self._first = re.compile("[" + "".join(map(re.escape, self._lengths)) + "]") if self._lengths else None

    def __call__(self, text: str | None) -> str:
        if not text:
            return text or ""
        out, at, seek = [], 0, 0
        while self._first is not None and (m := self._first.search(text, seek)):
            i = m.start()
            size = next((n for n in self._lengths[m[0]] if text[i : i + n] in self._phrases), 0)
            if size:
                out += [text[at:i].translate(self._table), self._phrases[text[i : i + size]]]
                at = i + size
            seek = i + max(1, size)
        return "".join([*out, text[at:].translate(self._table)])


def align(displayed: str, lines: list[dict]) -> list[dict]:
    """For each sentence of the displayed text, the recognised lines that hold it and how surely."""
    flat, ends = [], []
    for line in lines:
        flat.append(content_of(line.get("text") or ""))
        ends.append((ends[-1] if ends else 0) + len(flat[-1]))
    page, body, starts = "".join(flat), content_of(displayed), [e - len(f) for e, f in zip(ends, flat)]
    parts = [(s["id"], content_of(s["text"])) for s in sentences(displayed)]
    places = occurrences({own for _, own in parts}, page)
    blocks = None  # worked out for the first sentence that the page does not hold as it is
    out, at, floor = [], 0, 0

    def ids(begin: int, end: int) -> list:
        # a line without content lies inside when its place does
        return [lines[i]["id"] for i in range(bisect_right(ends, begin), bisect_left(starts, end))]

    for name, own in parts:
        begin, end, at = at, at + len(own), at + len(own)
        there = places[own] if own else ()
        k = bisect_left(there, floor)
        if k < len(there) and (len(there) == 1 or there[k] == floor):
            found = int(there[k])
            floor = found + len(own)
            out.append({"id": name, "lines": ids(found, floor), "kind": "exact", "confidence": 1.0})
            continue
        if blocks is None:
            blocks = matching_blocks(body, page)
            block_starts, block_ends = [a for a, _, _ in blocks], [a + n for a, _, n in blocks]
        near = blocks[bisect_right(block_ends, begin) : bisect_left(block_starts, end)]
        hits = [(max(begin, a) - a + b, min(end, a + n) - a + b) for a, b, n in near]
        got = sum(b - a for a, b in hits)
        if not own or not hits:
            continue
        first, last = hits[0][0], hits[-1][1]
        exact = got == len(own) and last - first == len(own)
        close = len(own) >= 8 and len(there) <= 1 and got >= 0.9 * len(own) and len(own) - got <= 2 and last - first <= len(own) + max(5, len(own) // 20) // 2
        if first < floor or not (exact or close):
            continue
        floor = last
        out.append({"id": name, "lines": ids(first, last), "kind": "exact" if exact else "fuzzy", "confidence": got / len(own)})
    return out
