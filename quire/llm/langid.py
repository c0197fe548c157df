"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads a text's running bytes, blanks and marks included, in both directions and labels
every position with the languages' probabilities. Long texts are read in spans of SPAN bytes with
OVERLAP more on each side, whose labels the neighbours give; by then the state has forgotten where
it began. A document's probabilities are the means over all its bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import least_by_hash, raw, remainder

#: Documents of each language that the model is fitted on, at most: those with the least hash of the id.
DOCS_PER_LANGUAGE = 400
#: Windows of WINDOW bytes of each of those documents that are trained on, anywhere in it.
WINDOWS, WINDOW = 6, 64
HIDDEN, EPOCHS, BATCH, RATE = 8, 4, 128, 0.02
#: Bytes that a span labels, and bytes that it reads before and after them.
SPAN, OVERLAP = 256, 16
#: Spans that are read side by side, and spans that wait to be sorted by length.
ROWS, WAITING = 1024, 8192

_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "surrogatepass")))


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _init(n_out: int, rng) -> dict[str, np.ndarray]:
    p = {}
    for d in "fb":
        p[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * HIDDEN)).astype(np.float32)
        p[f"h{d}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN)).astype(np.float32)
        p[f"c{d}"] = np.zeros(3 * HIDDEN, dtype=np.float32)
    p["o"] = rng.normal(0, 1 / np.sqrt(2 * HIDDEN), (2 * HIDDEN, n_out)).astype(np.float32)
    p["co"] = np.zeros(n_out, dtype=np.float32)
    return p


def _step(p, d, byte, h):
    """One gated step: reset and update gates, candidate, new state."""
    x, u = p[f"x{d}"][byte] + p[f"c{d}"], h @ p[f"h{d}"]
    r = _sigmoid(x[:, :HIDDEN] + u[:, :HIDDEN])
    z = _sigmoid(x[:, HIDDEN : 2 * HIDDEN] + u[:, HIDDEN : 2 * HIDDEN])
    c = np.tanh(x[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
    return r, z, c, u[:, 2 * HIDDEN :], z * h + (1 - z) * c


def _states(p, d, text: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states of every position; `text` holds runs of one length."""
    n, length = text.shape
    h, out = np.zeros((n, HIDDEN), dtype=np.float32), np.empty((length, n, HIDDEN), dtype=np.float32)
    for t in range(length) if d == "f" else range(length - 1, -1, -1):
        r, z, c, u, new = _step(p, d, text[:, t], h)
        if keep is not None:
            keep.append((t, h, r, z, c, u))
        out[t] = h = new
    return out


def _probabilities(p, text: np.ndarray, keep: dict | None = None) -> np.ndarray:
    both = np.concatenate([_states(p, d, text, None if keep is None else keep.setdefault(d, [])) for d in "fb"], axis=2)
    if keep is not None:
        keep["both"] = both
    s = both @ p["o"] + p["co"]
    s = np.exp(s - s.max(axis=2, keepdims=True))
    return s / s.sum(axis=2, keepdims=True)


def _gradients(p, text: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """Back-propagation through time of the mean cross-entropy over all positions."""
    keep: dict = {}
    q = _probabilities(p, text, keep)
    length, n, k = q.shape
    q[:, np.arange(n), label] -= 1
    q /= n * length
    g = {name: np.zeros_like(v) for name, v in p.items()}
    g["o"] = keep["both"].reshape(-1, 2 * HIDDEN).T @ q.reshape(-1, k)
    g["co"] = q.sum(axis=(0, 1))
    out = q @ p["o"].T
    for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
        dh = np.zeros((n, HIDDEN), dtype=np.float32)
        for t, h, r, z, c, u in reversed(keep[d]):
            dh = dh + out[t][:, part]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * u * r * (1 - r)
            dx = np.concatenate([dr, dz, dc], axis=1)
            du = np.concatenate([dr, dz, dc * r], axis=1)
            np.add.at(g[f"x{d}"], text[:, t], dx)
            g[f"c{d}"] += dx.sum(axis=0)
            g[f"h{d}"] += h.T @ du
            dh = dh * z + du @ p[f"h{d}"].T
    return g


def _by_length(texts: list[bytes]):
    """Arrays of the texts of each length with their numbers."""
    groups: dict[int, list[int]] = {}
    for i, b in enumerate(texts):
        if b:
            groups.setdefault(len(b), []).append(i)
    for length, at in groups.items():
        yield np.array(at), np.frombuffer(b"".join(texts[i] for i in at), np.uint8).reshape(-1, length)


def _read(p, d: int, text: np.ndarray, there: np.ndarray, out: np.ndarray) -> None:
    """As `_states` for spans of several lengths, without what only training needs; d: 0 forward, 1 backward.

    `text` is (length, spans); beyond its end (`there` is 0) a span's state stays 0 on the way back.
    """
    side = "fb"[d]
    # one table and matrix a gate: arrays stay contiguous; reset and update with their sign turned, for exp()
    sign, gates = (-1, -1, 1), [slice(i * HIDDEN, (i + 1) * HIDDEN) for i in range(3)]
    tables = [np.ascontiguousarray(k * (p[f"x{side}"] + p[f"c{side}"])[:, i], dtype=np.float32) for k, i in zip(sign, gates)]
    ws = [np.ascontiguousarray(k * p[f"h{side}"][:, i], dtype=np.float32) for k, i in zip(sign, gates)]
    length, n = text.shape
    h, x, r, z, c = (np.zeros((n, HIDDEN), np.float32) for _ in range(5))
    for t in range(length) if d == 0 else range(length - 1, -1, -1):
        for gate, table, w in ((r, tables[0], ws[0]), (z, tables[1], ws[1])):
            np.matmul(h, w, out=gate)
            gate += np.take(table, text[t], axis=0, out=x, mode="clip")
            np.exp(gate, out=gate)
            gate += 1
        np.matmul(h, ws[2], out=c)
        c /= r
        c += np.take(tables[2], text[t], axis=0, out=x, mode="clip")
        np.tanh(c, out=c)
        h -= c
        h /= z
        h += c
        if d == 1:
            h *= there[t]
        out[t] = h


def _sums(p, spans: list[tuple[bytes, int, int]]) -> np.ndarray:
    """For each span (bytes, first position that counts, number of those) the sums of the languages' probabilities."""
    size = np.array([len(b) for b, _, _ in spans])
    length, n = int(size.max()), len(spans)
    joined = b"".join([b.ljust(length, b"\0") for b, _, _ in spans])
    text = np.ascontiguousarray(np.frombuffer(joined, np.uint8).reshape(n, length).T)
    place = np.arange(length)[:, None]
    there = np.ascontiguousarray(np.broadcast_to((place < size)[:, :, None], (length, n, HIDDEN)), dtype=np.float32)
    s = np.zeros((length * n, len(p["co"])), np.float32)
    out = np.empty((length, n, HIDDEN), np.float32)
    for d, part in ((0, slice(0, HIDDEN)), (1, slice(HIDDEN, None))):
        _read(p, d, text, there, out)
        s += out.reshape(-1, HIDDEN) @ p["o"][part]
    s += p["co"]
    np.exp(s, out=s)
    s = s.reshape(length, n, -1)
    first, number = (np.array([x[i] for x in spans]) for i in (1, 2))
    counts = (place >= first) & (place < first + number)
    s *= (counts / s.sum(axis=2))[:, :, None]
    return s.sum(axis=0, dtype=np.float64)


def fit(texts: list[bytes], label: list[int], n_out: int, seed: int = 5) -> dict[str, np.ndarray]:
    """Adam over batches of runs of one length."""
    rng = np.random.default_rng(seed)
    p, labels = _init(n_out, rng), np.array(label)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    groups = list(_by_length(texts))
    total = EPOCHS * sum(-(-len(at) // BATCH) for at, _ in groups)
    for _ in range(EPOCHS):
        batches = [(at[o], text[o]) for at, text in groups for o in np.array_split(rng.permutation(len(at)), -(-len(at) // BATCH))]
        for k in rng.permutation(len(batches)):
            at, text = batches[k]
            step += 1
            rate = RATE * (1 - 0.9 * step / total) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for name, g in _gradients(p, text, labels[at]).items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g * g
                p[name] -= (rate * m[name] / (np.sqrt(v[name]) + 1e-8)).astype(np.float32)
    return p


@dataclass
class LanguageModel:
    languages: list[str]
    parameters: dict[str, np.ndarray]

    def label(self, texts: list[bytes]) -> np.ndarray:
        """The languages' mean probabilities over all bytes of each text; zeros for an empty one.

        Spans are read in the order of their length and begin afresh at each text, so a text's
        result depends on that text alone.
        """
        out, total = np.zeros((len(texts), len(self.languages))), np.array([max(1, len(t)) for t in texts])
        owner: list[int] = []
        spans: list[tuple[bytes, int, int]] = []

        def flush():
            order = sorted(range(len(spans)), key=lambda i: len(spans[i][0]))
            for k in range(0, len(order), ROWS):
                pick = order[k : k + ROWS]
                np.add.at(out, [owner[i] for i in pick], _sums(self.parameters, [spans[i] for i in pick]))
            owner.clear()
            spans.clear()

        for i, text in enumerate(texts):
            for j in range(0, len(text), SPAN):
                begin = max(0, j - OVERLAP)
                owner.append(i)
                spans.append((text[begin : j + SPAN + OVERLAP], j - begin, min(SPAN, len(text) - j)))
                if len(spans) == WAITING:
                    flush()
        if spans:
            flush()
        return out / total[:, None]


def _train(languages: list[str]):
    def run(batches):
        rng, texts, label = np.random.default_rng(3), [], []
        number = {lang: i for i, lang in enumerate(languages)}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
                if len(text) <= WINDOW:
                    found = [text] if text else []
                else:
                    found = [text[i : i + WINDOW] for i in rng.integers(0, len(text) - WINDOW + 1, WINDOWS).tolist()]
                texts += found
                label += [number[lang]] * len(found)
        p = fit(texts, label, len(languages))
        yield pa.record_batch([pa.array(list(p)), pa.array([",".join(map(str, x.shape)) for x in p.values()]), pa.array([x.astype("<f4").tobytes() for x in p.values()], pa.binary())], names=["name", "shape", "data"])

    return run


def train(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> LanguageModel:
    """Fit on documents with a language whose crc32(doc_id) mod 5 is not 0.

    At most `docs_per_language` documents of each language, by least hash of the id, are read by
    the one task that trains, on WINDOWS windows of WINDOW bytes of each, which begin anywhere in
    it. Without such documents the model knows no language.
    """
    known = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", 5) != 0))
    names = known.groupBy("lang").count().select("lang").orderBy("lang")
    languages = [r.lang for r in names.collect()]  # one row per language
    if not languages:
        return LanguageModel([], {})
    pick = least_by_hash(known.select("doc_id", "lang").distinct(), "lang", docs_per_language)
    # docs_per_language ids for each language: the bound that makes this side fit for broadcast
    found = known.join(F.broadcast(pick), ["doc_id", "lang"]).select("lang", "text", F.xxhash64("doc_id").alias("_h"))
    one = found.repartition(1).sortWithinPartitions("_h", "text").select("lang", "text")
    rows = one.mapInArrow(_train(languages), "name string, shape string, data binary").collect()
    return LanguageModel(languages, {r["name"]: np.frombuffer(r["data"], "<f4").reshape([int(i) for i in r["shape"].split(",")]) for r in rows})


_TYPE = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])


def predict(spark: SparkSession, model: LanguageModel, text: Column | str = "text") -> Column:
    """A struct column: lang_pred and score (its share of the probability over all bytes).

    Null texts, texts without a letter, and all texts if the model knows no language: `und`, 0.
    Ties go to the first language by name.
    """
    sent = spark.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        found, values = sent.value, raw(texts)
        lang, score = ["und"] * len(values), np.zeros(len(values))
        some = [i for i, t in enumerate(values) if has_letter(t)] if found.languages else []
        if some:
            means = found.label([values[i] for i in some])
            for i, best, row in zip(some, means.argmax(axis=1), means):
                lang[i] = found.languages[best]
                score[i] = min(1.0, row[best])
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], fields=list(_TYPE))

    return F.arrow_udf(run, "struct<lang_pred: string, score: double>")(F.col(text) if isinstance(text, str) else text)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every document, repeated rows included."""
    model = train(docs)
    found = docs.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), predict(docs.sparkSession, model, F.col("text").cast("string")).alias("_p"))
    return found.select("doc_id", "held_out", "_p.lang_pred", "_p.score")
