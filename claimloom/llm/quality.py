"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words, all of them. Each passage is
encoded from counts of byte classes, of pairs of them, and of properties of its
words. Gated attention, learned from labels of whole documents, weighs the
encoded passages; the weighted sum is scored. Fitting is done in numpy, on at
most `sample` labelled documents (SAMPLE by default), the first by a hash of
doc_id, and on all of their passages: the driver gets passage features only and
keeps them in a file, of which a step of the fit reads one batch of documents.

Defined cases: a null text is empty; an empty text is one passage without words;
labels that are null or lack a document are not used; of several labels of a
document the largest counts, of several texts one; if only one label is left every
score is its value; repeated rows score alike; texts of any length are encoded
whole; further columns are carried by `drop_poor` and ignored by `score`; an empty
table gives no rows.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.common import BLANK, as_bytes, crc_mod, doc_word_hashes, free_name, held_names, sliced, table
from claimloom.llm.toxicity import labelled

SAMPLE = 8_000
PASSAGE = 100
PREDICT = 0.3
HIDDEN, GATE = 24, 16
PAIRS = 128


def _classes() -> np.ndarray:
    """A class (0-63) for each byte: letters by case-free letter, the rest by kind."""
    out = np.zeros(256, dtype=np.int64)
    for b in range(256):
        c = chr(b)
        if b < 128 and c.isalpha():
            out[b] = 1 + ord(c.lower()) - 97
        elif c in "0123456789":
            out[b] = 27
        elif b == 10:
            out[b] = 28
        elif BLANK[b]:
            out[b] = 29
        elif b < 32 or b == 127:
            out[b] = 30
        elif b < 128:
            out[b] = 31 + b % 17
        else:
            out[b] = 48 + b % 16
    return out


CLASSES = _classes()
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
N_FEATURES = 64 + PAIRS + 8


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the number of passages of each text."""
    feats, counts = [], []
    for text, h in zip(texts, doc_word_hashes(texts), strict=True):
        n = max(1, -(-len(h) // PASSAGE))
        counts.append(n)
        out = np.zeros((n, N_FEATURES), dtype=np.float32)
        feats.append(out)
        if not len(h):
            continue
        codes = np.frombuffer(text, dtype=np.uint8)
        blank = BLANK[codes]
        first = ~blank
        first[1:] &= blank[:-1]
        starts = np.flatnonzero(first)
        own = np.zeros(len(codes), dtype=np.int64)
        own[starts[PASSAGE::PASSAGE]] = 1
        own = np.cumsum(own)
        kind = CLASSES[codes]
        size = np.bincount(own, minlength=n).astype(np.float32)[:, None]
        out[:, :64] = np.bincount(own * 64 + kind, minlength=n * 64).reshape(n, 64) / size
        pair = (kind[:-1] * 64 + kind[1:]) * 2654435761 % (1 << 32) >> 25
        out[:, 64 : 64 + PAIRS] = np.bincount(own[1:] * PAIRS + pair, minlength=n * PAIRS).reshape(n, PAIRS) / size
        at = np.arange(len(h)) // PASSAGE
        words = np.bincount(at, minlength=n).astype(np.float32)
        mean = lambda x: np.bincount(at, weights=x, minlength=n) / words
        ends = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
        length = ends - starts
        order = np.lexsort((h, at))
        again = np.zeros(len(h))
        again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (at[order[1:]] == at[order[:-1]])
        upper = np.add.reduceat(UPPER[codes].astype(np.int64), starts)
        last = codes[ends - 1]
        for k, x in enumerate((np.log1p(length), np.minimum(length, 40) ** 2 / 100.0, again, np.r_[0.0, h[1:] == h[:-1]], (upper > 0) & (upper >= length - 3), upper > 0, ~np.isin(last, np.frombuffer(b".,;:!?", np.uint8)) & (last < 65))):
            out[:, 64 + PAIRS + k] = mean(x)
        out[:, -1] = np.log1p(words) / 5
    return (np.concatenate(feats) if feats else np.zeros((0, N_FEATURES), np.float32)), np.array(counts, dtype=np.int64)


class GatedAttention:
    """score = sigmoid(o . sum_k a_k z_k), a = softmax(w . tanh(V z) * sigmoid(U z))."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: rng.normal(0, a**-0.5, (a, b))
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.p = {"E": draw(N_FEATURES, HIDDEN), "e": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE, 1), "o": draw(HIDDEN, 1), "b": np.zeros(1)}

    def _forward(self, x: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> dict:
        p = self.p
        z = np.tanh(x @ p["E"] + p["e"])
        t, s = np.tanh(z @ p["V"]), 1 / (1 + np.exp(-z @ p["U"]))
        a = (t * s @ p["w"])[:, 0]
        a = np.exp(a - np.maximum.reduceat(a, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        r = np.add.reduceat(a[:, None] * z, starts, axis=0)
        y = 1 / (1 + np.exp(-np.clip((r @ p["o"])[:, 0] + p["b"], -40, 40)))
        return {"z": z, "t": t, "s": s, "a": a, "r": r, "y": y}

    def _gradient(self, x: np.ndarray, starts: np.ndarray, bag: np.ndarray, label: np.ndarray) -> dict:
        p, f = self.p, self._forward(x, starts, bag)
        d = (f["y"] - label)[:, None] / len(label)
        dr = (d @ p["o"].T)[bag]
        da = (dr * f["z"]).sum(axis=1)
        dz = f["a"][:, None] * dr
        da = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[bag])  # through the softmax
        dg = da[:, None] * p["w"].T
        dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
        dz += dt @ p["V"].T + ds @ p["U"].T
        dx = dz * (1 - f["z"] ** 2)
        return {"E": x.T @ dx, "e": dx.sum(0), "V": f["z"].T @ dt, "U": f["z"].T @ ds, "w": (f["t"] * f["s"]).T @ da[:, None], "o": f["r"].T @ d, "b": d.sum(0)}

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x.astype(np.float32) - self.mean) / self.scale, -6, 6)

    def fit(self, x: np.ndarray, counts: np.ndarray, label: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 4e-3, decay: float = 1e-3, seed: int = 7) -> None:
        """x may be a mapped file: no step holds more than the passages of `batch` documents."""
        total = square = 0.0
        for a in range(0, len(x), 1 << 13):
            part = x[a : a + (1 << 13)].astype(np.float64)
            total, square = total + part.sum(axis=0), square + (part**2).sum(axis=0)
        self.mean = total / len(x)
        self.scale = np.sqrt(np.maximum(square / len(x) - self.mean**2, 0)) + 1e-3
        rng, ends = np.random.default_rng(seed), np.cumsum(counts)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(counts))
            for a in range(0, len(order), batch):
                docs = order[a : a + batch]
                rows = self._scaled(np.concatenate([x[ends[i] - counts[i] : ends[i]] for i in docs]))
                starts = np.r_[0, np.cumsum(counts[docs])[:-1]]
                g = self._gradient(rows, starts, np.repeat(np.arange(len(docs)), counts[docs]), label[docs])
                step += 1
                now = rate * (1 - epoch / epochs)
                for k, v in self.p.items():
                    first[k] += 0.1 * (g[k] - first[k])
                    second[k] += 0.001 * (g[k] ** 2 - second[k])
                    v -= now * ((first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8) + decay * v)

    def predict(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(counts):
            return np.zeros(0)
        return self._forward(self._scaled(x), np.r_[0, np.cumsum(counts)[:-1]], np.repeat(np.arange(len(counts)), counts))["y"]


class Constant:
    """Stands in where all labels are alike."""

    def __init__(self, value: float):
        self.value = value

    def predict(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.full(len(counts), self.value)


def _groups(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    a = n = 0
    for b, t in enumerate(texts):
        n += len(t)
        if n >= size:
            yield a, b + 1
            a, n = b + 1, 0
    if a < len(texts):
        yield a, len(texts)


def fit(docs: DataFrame, labels: DataFrame, held: F.Column, sample: int = SAMPLE) -> GatedAttention | Constant:
    held_names(labels, "doc_id", "quality")
    rows = labelled(docs, labels, "quality", held, sample)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = as_bytes(batch["text"])
            for a, b in _groups(texts):
                x, counts = passages(texts[a:b])
                ends = np.cumsum(counts)
                bags = [x[e - c : e].astype(np.float16).tobytes() for e, c in zip(ends, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"][a:b], batch["label"][a:b], pa.array(counts), pa.array(bags, pa.binary())], names=["doc_id", "label", "n", "x"])

    found = rows.mapInArrow(measure, "doc_id long, label int, n long, x binary")
    counts, y = [], []
    with tempfile.TemporaryFile() as file:  # the driver's own
        for r in found.orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():  # `sample` rows
            file.write(r["x"])
            counts.append(r["n"])
            y.append(float(r["label"] > 0))
        if len(set(y)) < 2:
            return Constant(y[0] if y else 0.5)
        file.flush()
        model = GatedAttention()
        model.fit(np.memmap(file, dtype=np.float16, mode="r", shape=(sum(counts), N_FEATURES)), np.array(counts), np.array(y))
    return model


def score(docs: DataFrame, model: GatedAttention | Constant, carry: bool = False) -> DataFrame:
    """doc_id and score of each row; with carry, all columns and score."""
    held_names(docs, "doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    rows = docs if carry else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kept = docs.columns if carry else ["doc_id"]
    name = free_name("score", *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = as_bytes(batch["text"])
            for a, b in _groups(texts):
                p = np.round(sent.value.predict(*passages(texts[a:b])), 9)
                yield pa.RecordBatch.from_arrays([*(batch[c][a:b] for c in kept), pa.array(p, pa.float64())], names=[*kept, name])

    schema = rows.select(*kept).schema.add(name, "double")
    return rows.mapInArrow(run, schema)


def drop_poor(docs: DataFrame, labels: DataFrame, held: F.Column, least: float = PREDICT) -> DataFrame:
    """docs whose score is `least` or more; all columns."""
    scored = score(docs, fit(docs, labels, held), carry=True)
    return scored.filter(F.col(scored.columns[-1]) >= least).select(*docs.columns)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 5) == 0
    model = fit(docs, table(spark, sf_dir, "labels"), held)
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))
