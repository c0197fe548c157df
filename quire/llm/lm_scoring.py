"""Language-model scores: online logistic mixing of hashed-context bit predictors.

A token is coded in two steps. Its leaf is a path of bits in a Huffman tree: frequent words have a
leaf each, all other words share leaves by a hash of their last two characters. Within a shared leaf a word has its share of the
training tokens there, and a word never seen is spelled in bytes.

For every bit of the path, predictors look up how often 0 and 1 came before at that tree node: over
all, after the leaf before, after the two leaves before, under the document's topic (the one of
the TOPICS most frequent leaves that it has used most so far), and in the document so far. Their logits are combined by weights that a gate selects (how often the contexts
of two and of one leaf have been seen), and an adaptive table refines the sum. The first four
are counts of all training documents, which Spark adds up; the fifth, the weights and the table
start anew at each document and learn along it, RUN tokens at a time. So a document's score depends
on the training counts and on its own text alone, not on the order or the parts of the table. A
training document is scored as if each occurrence of a bit in it had not been counted itself.

The lexicon grows with the corpus; the hashed tables grow with the tokens up to MOST_CELL_BITS.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import byte_words, discard, pieces_of, raw, remainder, staged, tasks

#: Words with a leaf of their own at most, and leaves that the others share.
OWN_LEAVES, SHARED_LEAVES = 1 << 11, 1 << 9
#: Bits of a cell's number in a hashed table, at least and at most (3 tables of 4 bytes a cell and 2 of one: 59 MB in each worker).
CELL_BITS, MOST_CELL_BITS, BLOCKS = 16, 22, 16
#: Bytes of text whose tokens share one dictionary, and training tokens that one task counts contexts of.
CHUNK_BYTES, COUNT_TOKENS = 64_000_000, 32_000_000
#: Tokens of a document between two updates; tokens that are worked out side by side.
RUN, GROUP_TOKENS = 128, 16_384
#: Cells of the counts of a document so far.
LOCAL = 4096
#: Leaves that can be a topic; tokens after which it is looked up again.
TOPICS, TOPIC_RUN = 64, 16
#: Hashed contexts; predictors; weights that each document starts from; rate of the weights.
HASHED, PREDICTORS = 3, 5
START_WEIGHTS = (0.1, 0.3, 0.4, 0.55, 0.1)
RATE = 0.1
GATES, STEPS, SURE = 16, 24, 24.0
ADDED = 0.4
END, STOP = b"\n", 0x20
#: Spelling: bits kept of the byte before the last, and what is added to each count.
BACK, SPELL_ADDED = 32, 0.02

_TOKENS = "chunk long, doc_id long, held_out boolean, n_bytes long, ids binary, lid int, word string, n long"


def _names(schema: str) -> list[str]:
    return [p.split()[0] for p in schema.split(", ")]


def _tokenise(batches):
    """Documents as numbers of tokens in the dictionary of their chunk, and the dictionaries with training counts."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    names, chunk = _names(_TOKENS), TaskContext.get().partitionId() << 24

    def fresh():
        seen = defaultdict()
        seen.default_factory = seen.__len__
        return seen, 0, np.zeros(1 << 16, dtype=np.int64)

    def dictionary():
        words = list(seen)
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            m = len(part)
            text = pa.array([w.decode("utf-8", "surrogatepass") for w in part], pa.string())
            yield pa.record_batch([pa.array(np.full(m, chunk)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(np.arange(i, i + m, dtype=np.int32)), text, pa.array(counts[i : i + m])], names=names)

    seen, size, counts = fresh()
    for whole in batches:
        for batch in pieces_of(whole):
            out, sizes, rows = [], [], []
            for text in raw(batch.column(1)):
                size += len(text)
                sizes.append(len(text))
                found = byte_words(text.lower())  # bytes: A-Z only
                found.append(END)
                rows.append(row := np.fromiter(map(seen.__getitem__, found), dtype=np.uint32, count=len(found)))
                out.append(pack(row.tobytes()))
            if len(seen) > len(counts):
                counts = np.concatenate([counts, np.zeros(max(len(counts), len(seen)), dtype=np.int64)])
            train = [row for row, apart in zip(rows, batch.column(2).to_pylist()) if not apart]
            if train:
                counts[: len(seen)] += np.bincount(np.concatenate(train), minlength=len(seen))
            m = len(out)
            yield pa.record_batch([pa.array(np.full(m, chunk)), batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(out, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64())], names=names)
            if size > CHUNK_BYTES:
                yield from dictionary()
                seen, size, counts = fresh()
                chunk += 1
    yield from dictionary()


def code(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The Huffman tree of leaf counts: length and begin of each leaf's path, and the nodes and bits of all paths."""
    n = len(counts)
    heap = [(int(c) + 1, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    above, side = np.zeros(2 * n - 1, dtype=np.int64), np.zeros(2 * n - 1, dtype=np.uint8)
    for node in range(n, 2 * n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        above[i] = above[j] = node
        side[j] = 1
        heapq.heappush(heap, (a + b, node))
    root, nodes, bits, length = 2 * n - 2, [], [], np.zeros(n, dtype=np.int64)
    for leaf in range(n):
        path, at = [], leaf
        while at != root:
            path.append((above[at], side[at]))
            at = above[at]
        nodes += [int(root - v) for v, _ in reversed(path)]  # the root is node 0
        bits += [int(b) for _, b in reversed(path)]
        length[leaf] = len(path)
    return length, np.cumsum(length) - length, np.array(nodes, dtype=np.int64), np.array(bits, dtype=np.int64)


_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _topics(leaf: np.ndarray, size: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each token 1 + the frequent leaf that its document has most often so far (ties: the more frequent one), or 0."""
    slots = (size + TOPIC_RUN - 1) // TOPIC_RUN
    begin = np.cumsum(slots) - slots
    slot = np.repeat(begin, size) + place // TOPIC_RUN
    some = leaf < TOPICS
    counts = np.bincount(slot[some] * TOPICS + leaf[some], minlength=int(slots.sum()) * TOPICS).reshape(-1, TOPICS)
    before = np.cumsum(counts, axis=0) - counts
    before -= np.repeat(before[begin], slots, axis=0)
    return np.where(before.max(axis=1) > 0, before.argmax(axis=1) + 1, 0)[slot]


def _contexts(leaf: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """For each token the hashes of the leaf before, of the two before, and of the topic; `size` are the documents' tokens."""
    place = _places(size)
    one, two = np.zeros(len(leaf), dtype=np.uint64), np.zeros(len(leaf), dtype=np.uint64)
    one[1:], two[2:] = leaf[:-1] + 1, leaf[:-2] + 1
    one[place < 1] = 0
    two[place < 2] = 0
    first = _mixed((one + np.uint64(1)) * _K[0])
    return [first, _mixed((first ^ (two + np.uint64(1)) * _K[1]) * _K[2]), _mixed((_topics(leaf, size, place).astype(np.uint64) + np.uint64(1)) * _K[3])]


def _mixed(h: np.ndarray) -> np.ndarray:
    return (h ^ h >> np.uint64(31)) * _K[1]


def _cells(context: np.ndarray, turned: np.ndarray, bits: int) -> np.ndarray:
    """Cells of bits, from the hash of each one's context and its tree node times _K[4]."""
    h = context + turned
    h *= _K[2]
    h >>= np.uint64(64 - bits)
    return h.view(np.int64)


@dataclass
class MixModel:
    """The tree, and counts of 0 (low 16 bits) and 1 (high 16 bits) by node and by cell of each hashed context."""

    tree: tuple
    nodes: np.ndarray
    cells: np.ndarray  # HASHED x cells

    @property
    def bits(self) -> int:
        return self.cells.shape[1].bit_length() - 1

    def lookups(self) -> Lookups:
        """The logits and gates of all counts, each worked out once instead of at every bit that meets it."""
        logits = np.empty(self.cells.shape, dtype=np.float32)
        gates = np.empty((2, self.cells.shape[1]), dtype=np.uint8)
        step = 1 << 16  # cells at once
        for t, table in enumerate(self.cells):
            for i in range(0, len(table), step):
                logits[t, i : i + step], count = _logits(table[i : i + step], None)
                if t < 2:
                    gates[t, i : i + step] = _GATES[t](count)
        return Lookups(self.tree, _logits(self.nodes, None)[0], logits, gates)


@dataclass
class Lookups:
    """What documents that the model has not counted read: the tree, logits by node and by cell, and gates by cell of the first two contexts."""

    tree: tuple
    nodes: np.ndarray
    cells: np.ndarray  # HASHED x cells
    gates: np.ndarray  # 2 x cells

    @property
    def bits(self) -> int:
        return self.cells.shape[1].bit_length() - 1


def packed_counts(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Both counts in 32 bits; pairs with a larger one are scaled down together."""
    most = np.maximum(np.maximum(zero, one), 1)
    scale = np.where(most > 0xFFFF, 0xFFFF / most, 1.0)
    zero, one = (np.maximum(x * scale, np.minimum(x, 1)).astype(np.uint32) for x in (zero, one))  # what was seen stays so
    return zero | one << np.uint32(16)


def _spread(leaf: np.ndarray, tree):
    """All bits of the tokens: the token's number, node and bit."""
    length, begin, nodes, bits = tree
    steps = length[leaf]
    token = np.repeat(np.arange(len(leaf)), steps)
    at = np.arange(len(token)) + np.repeat(begin[leaf] - (np.cumsum(steps) - steps), steps)
    return token, nodes[at], bits[at]


def _unpacked(column: pa.Array) -> list[np.ndarray]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return [np.frombuffer(unpack(x), "<u4") for x in column.to_pylist()]


def _places(size: np.ndarray) -> np.ndarray:
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def _count(sent, cell_bits: int):
    """Counts of bits by node and by cell over a task's training documents, in blocks."""

    def run(batches):
        import zstandard

        tree = sent.value
        leaves = np.zeros(len(tree[0]), dtype=np.int64)
        cells = [np.zeros(2 << cell_bits, dtype=np.uint32) for _ in range(HASHED)]
        waits, size = [], 0

        def add():
            leaf, n = np.concatenate(waits).astype(np.int64), np.array([len(w) for w in waits])
            contexts = _contexts(leaf, n)
            token, node, bit = _spread(leaf, tree)
            one = np.ones(len(bit), dtype=np.uint32)
            leaves[:] += np.bincount(leaf, minlength=len(leaves))
            turned = node.view(np.uint64) * _K[4]
            for table, context in zip(cells, contexts):
                np.add.at(table, 2 * _cells(context[token], turned, cell_bits) + bit, one)

        for batch in batches:
            for leaf in _unpacked(batch.column(0)):
                waits.append(leaf)
                size += len(leaf)
                if size > 4 * GROUP_TOKENS:
                    add()
                    waits, size = [], 0
        if waits:
            add()
        pack = zstandard.ZstdCompressor(level=1).compress
        of, node, bit = _spread(np.arange(len(leaves)), tree)
        nodes = np.zeros(2 * len(leaves), dtype=np.uint32)
        np.add.at(nodes, 2 * node + bit, leaves[of].astype(np.uint32))  # a leaf counts at each node of its path
        blocks = [(-1, nodes)] + [(t * BLOCKS + b, part) for t, table in enumerate(cells) for b, part in enumerate(np.split(table, BLOCKS))]
        for block, part in blocks:
            if part.any():
                yield pa.record_batch([pa.array([block], pa.int32()), pa.array([pack(part.tobytes())], pa.binary())], names=["block", "data"])

    return run


def _add_blocks(batches):
    import zstandard

    unpack, total = zstandard.ZstdDecompressor().decompress, {}
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(unpack(data), np.uint32).astype(np.float64)
            total[block] = total[block] + part if block in total else part
    pack = zstandard.ZstdCompressor(level=1).compress
    for block, part in total.items():
        both = packed_counts(part[0::2], part[1::2])
        yield pa.record_batch([pa.array([block], pa.int32()), pa.array([pack(both.tobytes())], pa.binary())], names=["block", "data"])


_LOG = np.log(np.arange(1 << 16, dtype=np.float32) + np.float32(ADDED))
#: A bit's gate is the sum of these, of how often the contexts of one and of two leaves have been seen there.
_GATES = (
    lambda n: 4 * ((n > 1).astype(np.uint8) + (n > 7) + (n > 63)),
    lambda n: (n > 0).astype(np.uint8) + (n > 1) + (n > 4),
)
_CENTRES = (np.arange(STEPS) - (STEPS - 1) / 2) * 0.75


def _logits(both: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Logit and number of earlier bits of each; `own`, if given, is what to take off there, packed alike."""
    if own is not None:
        both = both - own
    one, zero = both >> np.uint32(16), both & np.uint32(0xFFFF)
    return _LOG[one] - _LOG[zero], one + zero


def log_probabilities(docs: list[np.ndarray], known: np.ndarray, model: MixModel | Lookups) -> np.ndarray:
    """log10 probability of the leaves of each document. Those that `known` marks are scored as if the model had not counted them: one count less for each of their bits; that takes the counts of a MixModel."""
    size = np.array([len(d) for d in docs])
    n, leaf = len(docs), np.concatenate(docs).astype(np.int64)
    place, doc = _places(size), np.repeat(np.arange(n), size)
    order = np.argsort(place // RUN, kind="stable")  # the first run of all documents, then the second
    contexts = [c[order] for c in _contexts(leaf, size)]
    leaf, doc, run = leaf[order], doc[order], (place // RUN)[order]
    token, node, bit = _spread(leaf, model.tree)
    turned, of_doc = node.view(np.uint64) * _K[4], doc[token]
    cells = [_cells(context[token], turned, model.bits) for context in contexts]
    if known.any():
        own = np.where(bit == 1, np.uint32(1 << 16), np.uint32(1)) * known.astype(np.uint32)[of_doc]
        found = [_logits(table[at], own) for table, at in zip(model.cells, cells)]
        x = [_logits(model.nodes[node], own)[0]] + [logit for logit, _ in found]
        gate = _GATES[0](found[0][1]) + _GATES[1](found[1][1])
    else:
        look = model.lookups() if isinstance(model, MixModel) else model
        x = [look.nodes[node]] + [table[at] for table, at in zip(look.cells, cells)]
        gate = look.gates[0][cells[0]] + look.gates[1][cells[1]]
    slot = of_doc * GATES + gate
    here = of_doc * LOCAL + (node & (LOCAL - 1))
    now, target = 2 * here + bit, bit.astype(np.float32)
    local = np.zeros(2 * n * LOCAL, dtype=np.uint16)
    pairs = local.view("<u4")  # 0 in the low bits
    weights = np.repeat(np.array(START_WEIGHTS, dtype=np.float32)[:, None], n * GATES, axis=1)
    ones, all_ = np.tile(SURE / (1 + np.exp(-_CENTRES)), n), np.full(n * STEPS, SURE)
    total = np.zeros(n)
    ends = np.searchsorted(token, np.searchsorted(run, np.arange(int(run[-1]) + 2)))
    for i, j in zip(ends[:-1].tolist(), ends[1:].tolist()):
        b, s, o = target[i:j], slot[i:j], of_doc[i:j]
        part = [v[i:j] for v in x] + [_logits(pairs[here[i:j]], None)[0]]
        logit = weights[0][s] * part[0]
        for w, v in zip(weights[1:], part[1:]):
            logit += w[s] * v
        p = 1 / (1 + np.exp(-logit))
        logit *= np.float32(1 / 0.75)
        logit += np.float32(STEPS / 2)
        at = o * STEPS + np.clip(logit, np.float32(0), np.float32(STEPS - 1)).astype(np.int64)
        refined = np.float32(0.5) * p + (0.5 * ones / all_).astype(np.float32)[at]
        right = np.maximum(np.abs(refined - (1 - b)), np.float32(1e-6))
        total += np.bincount(o, weights=np.log(right), minlength=n)
        error, m = b - p, n * GATES
        share = RATE / (np.bincount(s, minlength=m) + 1)
        for w, v in zip(weights, part):
            w += np.bincount(s, weights=error * v, minlength=m) * share
        np.add.at(local, now[i:j], np.ones(j - i, dtype=np.uint16))
        ones += np.bincount(at, weights=b, minlength=n * STEPS)
        all_ += np.bincount(at, minlength=n * STEPS)
    return total / np.log(10)


def _score(sent):
    def run(batches):
        model = sent.value

        def out():
            rows = pa.Table.from_batches(waits)
            docs = _unpacked(rows.column(7).combine_chunks())
            score = np.zeros(len(docs))
            order = np.argsort([len(d) for d in docs], kind="stable")
            i = 0
            while i < len(order):
                j, tokens = i, 0
                while j < len(order) and (j == i or tokens + len(docs[order[j]]) <= GROUP_TOKENS) and j - i < 256:
                    tokens += len(docs[order[j]])
                    j += 1
                pick = order[i:j]
                score[pick] = log_probabilities([docs[k] for k in pick], np.zeros(len(pick), dtype=bool), model)
                i = j
            score += rows.column(6).to_numpy()
            octets = rows.column(3).to_numpy()
            bits = -score / np.log10(2) / np.maximum(octets, 1)
            yield from pa.table([rows.column(k) for k in (0, 1, 2, 4, 5)] + [pa.array(score), pa.array(bits)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"]).combine_chunks().to_batches()

        waits, size = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                waits.append(part)
                size += int(part.column(2).to_numpy().sum())
                if size > 16 * GROUP_TOKENS:
                    yield from out()
                    waits, size = [], 0
        if waits:
            yield from out()

    return run


def _spelled(words: list[bytes]):
    """Number of the word, and cell (two bytes before, this byte) of each byte of the words and their stops."""
    flat = np.frombuffer(b"".join([w + b" " for w in words]), np.uint8).astype(np.int64)
    size = np.array([len(w) + 1 for w in words])
    place = _places(size)
    one, two = np.zeros(len(flat), dtype=np.int64), np.zeros(len(flat), dtype=np.int64)
    one[1:], two[2:] = flat[:-1], flat[:-2]
    one[place < 1] = 0
    two[place < 2] = 0
    return np.repeat(np.arange(len(words)), size), ((two % BACK) << 16) | (one << 8) | flat


def _count_spelling(batches):
    total = np.zeros(BACK << 16, dtype=np.int64)
    for batch in batches:
        words = raw(batch.column(0))
        for i in range(0, len(words), 20_000):
            np.add.at(total, _spelled(words[i : i + 20_000])[1], 1)
    some = np.flatnonzero(total)
    yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["cell", "n"])


def spelling(counts: np.ndarray) -> np.ndarray:
    """log10 probability of each byte after the two before it."""
    by = counts.reshape(-1, 256) + SPELL_ADDED
    return np.log10(by / by.sum(axis=1, keepdims=True)).astype(np.float32).ravel()


def within_leaf(c: np.ndarray, s: np.ndarray, t: np.ndarray, spelled: np.ndarray) -> np.ndarray:
    """log10 probability of words in their shared leaf: c of its s training tokens, or new (t distinct words are known) and spelled."""
    all_ = np.maximum(s + t, 1)
    return np.where(c > 0, np.log10(np.maximum(c, 1) / all_), np.where(t > 0, np.log10(np.maximum(t, 1) / all_), 0.0) + spelled)


def _place_words(sent):
    """The entries of dictionaries with their words' leaf, count and log10 probability there."""

    def run(batches):
        table = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            c, s, t = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5, 6))
            own = batch.column(7).to_numpy(zero_copy_only=False)
            words, rare = raw(batch.column(2)), np.flatnonzero(~own & (c < 1))
            spelled = np.zeros(len(c))
            for i in range(0, len(rare), 20_000):
                pick = rare[i : i + 20_000]
                word, cell = _spelled([words[k] for k in pick])
                spelled[pick] = np.bincount(word, weights=table[cell], minlength=len(pick))
            now = np.where(own, 0.0, within_leaf(c, s, t, spelled))
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(4), batch.column(3), pa.array(now.astype(np.float32))], names=["chunk", "lid", "leaf", "c", "now"])

    return run


_LEAVES = "doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, base_score double, within double, leaves binary"


def _assemble(total: int, distinct: int):
    """Documents as leaves, with what the dictionary of their chunk says of their tokens; dictionaries come first."""

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        floor, chunk = float(np.log10(total + 0.1 * (distinct + 1))), None
        known, base, leaf, now = (np.zeros(0) for _ in range(4))
        for batch in batches:
            chunks, is_doc = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((chunks[1:] != chunks[:-1]) | (is_doc[1:] != is_doc[:-1])) + 1
            for i, j in zip([0, *edges], [*edges, len(chunks)]):
                if i == j:
                    continue
                part = batch.slice(i, j - i)
                if not is_doc[i]:
                    if chunks[i] != chunk:
                        chunk, (known, base, leaf, now) = chunks[i], (np.zeros(1 << 18, dtype=d) for d in (np.int64, np.float64, np.uint32, np.float64))
                    lid = part.column(6).to_numpy(zero_copy_only=False).astype(np.int64)
                    if lid.max() >= len(known):
                        more = max(len(known), int(lid.max()) + 1 - len(known))
                        known, base, leaf, now = (np.concatenate([a, np.zeros(more, dtype=a.dtype)]) for a in (known, base, leaf, now))
                    leaf[lid], c = part.column(7).to_numpy(zero_copy_only=False), part.column(8).to_numpy(zero_copy_only=False)
                    known[lid], base[lid] = c > 0, np.log10(c + 0.1) - floor
                    now[lid] = part.column(9).to_numpy(zero_copy_only=False)
                    continue
                rows = _unpacked(part.column(5))
                n = np.array([len(r) for r in rows], dtype=np.int64)
                flat, begin = np.concatenate(rows).astype(np.int64), np.cumsum(n) - n
                within = np.add.reduceat(now[flat], begin)
                leaves = leaf[flat]
                data = [pack(leaves[b : b + k].tobytes()) for b, k in zip(begin.tolist(), n.tolist())]
                yield pa.record_batch([part.column(2), part.column(3), pa.array(n), part.column(4), pa.array(np.add.reduceat(known[flat], begin)), pa.array(np.add.reduceat(base[flat], begin)), pa.array(within), pa.array(data, pa.binary())], names=_names(_LEAVES))

    return run


def scored(docs: DataFrame, modulus: int = 10) -> DataFrame:
    """Score every text by a model of the documents whose crc32(doc_id) mod `modulus` is not 0.

    A-Z are lower-cased; tokens are runs of characters that are no ASCII white space, and one end,
    which null and empty texts have alone. Rows that repeat count each; a null id counts as empty
    text for the remainder. An empty table gives no rows; without training documents all words are
    unknown and bits start even. Extra columns are ignored. Ties in word counts, for leaves, go by
    the word.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10), and
    bits_per_byte: all bits of the score over the bytes of the text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (remainder("doc_id", modulus) == 0).alias("held_out"))
    both = staged(docs.mapInArrow(_tokenise, _TOKENS), "lm-tokens")
    # one deal by word counts it and tells every chunk
    of_word = W.partitionBy("word")
    entries = both.where("ids IS NULL").select("chunk", "lid", "word", "n")
    words = staged(entries.select("chunk", "lid", "word", F.sum("n").over(of_word).alias("c"), (F.col("chunk") == F.min("chunk").over(of_word)).alias("first")), "lm-words")
    lexicon = words.where("first").select("word", "c")
    stats = lexicon.agg(F.sum("c").alias("total"), F.count_if(F.col("c") > 0).alias("distinct")).first()
    total, distinct = int(stats["total"] or 0), int(stats["distinct"] or 0)

    frequent = lexicon.where("c > 0").orderBy(F.desc("c"), "word").limit(OWN_LEAVES).collect()
    own = len(frequent)
    # OWN_LEAVES rows at most
    top = F.broadcast(spark.createDataFrame([(r["word"], i) for i, r in enumerate(frequent)], "word string, own int"))
    hashed = F.pmod(F.xxhash64(F.expr("right(word, 2)")), F.lit(SHARED_LEAVES)).cast("int") + own
    leaf = F.coalesce("own", hashed).alias("leaf")
    sums = lexicon.join(top, "word", "left").where("own IS NULL").groupBy(hashed.alias("leaf")).agg(F.sum("c").alias("s"), F.count_if(F.col("c") > 0).alias("t")).collect()  # SHARED_LEAVES rows at most
    counts = np.zeros(own + SHARED_LEAVES, dtype=np.int64)
    counts[:own] = [r["c"] for r in frequent]
    for r in sums:
        counts[r["leaf"]] = r["s"] + r["t"]
    tree = code(counts)

    spelled = np.zeros(BACK << 16)
    for r in lexicon.where("c > 0").select("word").mapInArrow(_count_spelling, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():  # BACK * 2^16 rows at most
        spelled[r["cell"]] = r["n"]
    letters = spark.sparkContext.broadcast(spelling(spelled))
    of_leaf = F.broadcast(spark.createDataFrame([(r["leaf"], r["s"], r["t"]) for r in sums], "leaf int, s long, t long"))
    placed = words.join(top, "word", "left").select("chunk", "lid", "word", "c", leaf, F.col("own").isNotNull().alias("apart")).join(of_leaf, "leaf", "left")
    placed = placed.select("chunk", "lid", "word", "c", "leaf", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"), "apart")
    facts = placed.mapInArrow(_place_words(letters), "chunk long, lid int, leaf int, c long, now float")
    of_entries = facts.select("chunk", F.lit(False).alias("is_doc"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("long").alias("n_bytes"), F.lit(None).cast("binary").alias("ids"), "lid", "leaf", "c", "now")
    of_docs = both.where("ids IS NOT NULL").select("chunk", F.lit(True), "doc_id", "held_out", "n_bytes", "ids", *(F.lit(None).cast(t) for t in ("int", "int", "long", "float")))
    dealt = of_entries.union(of_docs).repartition(tasks(spark), "chunk").sortWithinPartitions("chunk", "is_doc")
    found = staged(dealt.mapInArrow(_assemble(total, distinct), _LEAVES), "lm-leaves")
    discard(both, words)

    cell_bits = min(MOST_CELL_BITS, max(CELL_BITS, (4 * total).bit_length()))
    shape = spark.sparkContext.broadcast(tree)
    train = found.where("NOT held_out").select("leaves")
    parts = 1 + total // COUNT_TOKENS  # each task sends whole tables
    counted = train.coalesce(parts).mapInArrow(_count(shape, cell_bits), "block int, data binary")
    added = counted.repartitionById(HASHED * BLOCKS + 1, F.col("block") + 1).mapInArrow(_add_blocks, "block int, data binary")
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    nodes, cells = np.zeros(len(counts), dtype=np.uint32), np.zeros((HASHED * BLOCKS, (1 << cell_bits) // BLOCKS), dtype=np.uint32)
    for r in added.toLocalIterator():  # tables of at most 2^MOST_CELL_BITS cells
        at = np.frombuffer(unpack(r["data"]), np.uint32)
        if r["block"] < 0:
            nodes[:] = at
        else:
            cells[r["block"]] = at
    model = spark.sparkContext.broadcast(MixModel(tree, nodes, cells.reshape(HASHED, -1)).lookups())
    result = found.mapInArrow(_score(model), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    return result.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")
