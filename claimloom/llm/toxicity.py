"""Toxicity: a weighted lexicon matched by Aho-Corasick.

Texts are folded first: case, accents, look-alike letters of other scripts, and
digits and signs that stand for letters inside a word. The lexicon is learned
from labelled documents: starts of words (and whole words) whose share of toxic
documents is far above the rest. Exception phrases, learned the same way, are
pairs of words around a lexicon hit that occur in clean documents only; a hit
inside one counts nothing. Weights of the hits, with their number and density by
length, go through a logistic calibration.

The fit uses at most `sample` labelled documents (SAMPLE by default), the first
by a hash of doc_id; its join is broadcast, of that size at most. The lexicon and
the exceptions hold every term that is significant in them, however many.

Defined cases: a null text is empty; an empty text scores what no hit in no
words scores; labels that are null or lack a document are not used; of several
labels of a document the largest counts, of several texts one; if no label is left
every score is 0; repeated rows score alike; texts of any length are matched whole;
an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.common import crc_mod, held_names, stored, table

SAMPLE = 20_000
STEM = range(4, 11)
LEAST_DOCS = 5
#: How many times likelier in toxic documents, and by how many deviations.
LEAST_ODDS, LEAST_Z = 6.0, 5.0
PREDICT = 0.7

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɡ": "g", "ℓ": "l", "ß": "s", "ø": "o", "ł": "l", "đ": "d",
}
# Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}

_DIGITS = str.maketrans(SUBSTITUTES)
_MARK = re.compile(r"[0-9@$!]")
#: Words, from their start, that hold a digit or sign that may stand for a letter.
_MIXED = re.compile(r"(?<!\S)[^\s0-9@$!]*[0-9@$!]\S*")
_LETTER = re.compile(r"[^\W\d_]")
_HIDDEN = dict.fromkeys(map(ord, "\u00ad\u200b\u200c\u200d\u2060\ufeff\ufe0f"))
_WORDS = re.compile(r"[^\W\d_]+")
#: Folded texts start and end with it, and it stands between words.
GAP = " "


class _Plain(dict):
    """For str.translate: a character without marks and hidden parts, as Latin where it looks so."""

    def __missing__(self, code: int) -> str:
        parts = unicodedata.normalize("NFKD", LOOKALIKES.get(chr(code), chr(code)))
        out = "".join(LOOKALIKES.get(c, c) for c in parts if not unicodedata.combining(c))
        if len(self) < 1 << 16:
            self[code] = out
        return out


_PLAIN = _Plain(_HIDDEN)


def _substitute(found: re.Match) -> str:
    word = found[0]
    if not _LETTER.search(word):
        return word
    core = word.rstrip("!")  # closing marks are no letters
    return core.translate(_DIGITS) + word[len(core) :]


def fold(text: str) -> str:
    """GAP-separated words of a text after folding."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_PLAIN)
    if _MARK.search(text):
        text = _MIXED.sub(_substitute, text)
    return GAP + GAP.join(_WORDS.findall(text)) + GAP


def terms(folded: str) -> set[str]:
    """Starts of words, and whole words with a GAP at both ends."""
    out = set()
    for word in set(folded.split()):
        out.update(GAP + word[:n] for n in STEM if n <= len(word))
        if len(word) >= 3:
            out.add(GAP + word + GAP)
    return out


def labelled(docs: DataFrame, labels: DataFrame, label: str, held: DataFrame | F.Column, sample: int) -> DataFrame:
    """(text, label) of at most `sample` labelled rows that aren't held out."""
    rows = labels.filter(~held & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(rows), "doc_id")
    return stored(picked.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")), f"sample-{label}")


def _count(make) -> object:
    """A mapInArrow function: documents with each term, by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: Counter = Counter()
        clean: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(toxic.keys() | clean.keys())
            rows = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], names=["term", "toxic", "clean"])
            toxic.clear()
            clean.clear()
            return rows

        for batch in batches:
            for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist(), strict=True):
                (toxic if label else clean).update(make(fold(text)))
                if len(toxic) + len(clean) > 400_000:
                    yield out()
        yield out()

    return run


def _odds(df: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """Adds the log odds ratio of each term and its deviations from chance."""
    t, c = F.col("toxic"), F.col("clean")
    share = n_toxic / max(1, n_toxic + n_clean)
    weight = F.log((t + 0.5) / (n_toxic + 1.0)) - F.log((c + 0.5) / (n_clean + 1.0))
    z = (t - (t + c) * share) / F.sqrt((t + c) * share * (1 - share) + 1e-9)
    return df.withColumn("weight", weight).withColumn("z", z)


def matcher(lexicon: dict[str, float]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for k, w in lexicon.items():
        automaton.add_word(k, (len(k), w))
    automaton.make_automaton()
    return automaton


def hits(automaton, folded: str) -> list[tuple[int, int, float]]:
    """(start, end, weight), leftmost and longest first, none overlapping."""
    out, free = [], 0
    if not len(automaton):
        return out
    found = sorted((end + 1 - n, -n, w) for end, (n, w) in automaton.iter(folded))
    for start, n, w in found:
        if start >= free:
            out.append((start, start - n, w))
            free = start - n - 1  # words share the gap between them
    return out


def _phrase(folded: str, start: int, end: int) -> list[str]:
    """The hit's word with its left neighbour, and with its right one."""
    stop = folded.index(GAP, start + 1)
    left = folded.rfind(GAP, 0, start) if start else -1
    right = folded.find(GAP, stop + 1)
    out = [folded[left : stop + 1]] if left >= 0 else []
    return out + ([folded[start : right + 1]] if right >= 0 else [])


def live_hits(automaton, exceptions: set[str], folded: str) -> list[float]:
    """The weights of hits outside exception phrases."""
    return [w for a, b, w in hits(automaton, folded) if not (exceptions and exceptions.intersection(_phrase(folded, a, b)))]


def features(own: list[float], folded: str) -> list[float]:
    """What the calibration sees of a text and the weights of its hits."""
    words = folded.count(GAP) - 1
    total = sum(own)
    return [1.0, min(len(own), 5.0), total / (1.0 + words) ** 0.5, float(np.log1p(total)), float(np.log1p(100.0 * len(own) / (words + 10.0)))]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        w = p * (1 - p) + 1e-6
        b += np.linalg.solve((x * w[:, None]).T @ x + ridge * len(x) * np.eye(len(b)) / 100, x.T @ (y - p) - ridge * len(x) * b / 100)
    return b


def fit(docs: DataFrame, labels: DataFrame, held: F.Column, sample: int = SAMPLE) -> dict:
    """Lexicon, exception phrases and calibration."""
    held_names(labels, "doc_id", "toxic")
    rows = labelled(docs, labels, "toxic", held, sample)
    n = {r["label"]: r["n"] for r in rows.groupBy(F.col("label").cast("boolean").cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic:
        return {"lexicon": {}, "exceptions": set(), "weights": np.array([-40.0, 0, 0, 0, 0])}
    sums = [F.sum(x).alias(x) for x in ("toxic", "clean")]
    shape = "term string, toxic long, clean long"
    found = _odds(rows.mapInArrow(_count(terms), shape).groupBy("term").agg(*sums).filter(F.col("toxic") >= LEAST_DOCS), n_toxic, n_clean)
    found = found.filter((F.col("weight") >= float(np.log(LEAST_ODDS))) & (F.col("z") >= LEAST_Z))
    lexicon: dict[str, float] = {}
    # each is in LEAST_DOCS documents of the sample, which bounds their number
    for r in sorted(found.collect(), key=lambda r: (len(r["term"]), r["term"])):
        # a longer start adds nothing where a shorter one is in already
        if not any(r["term"][:k] in lexicon for k in range(4, len(r["term"]))):
            lexicon[r["term"]] = float(r["weight"])

    def around(folded: str) -> set[str]:
        return {p for a, b, _ in hits(around.automaton, folded) for p in _phrase(folded, a, b)}

    def phrases(batches):
        around.automaton = matcher(lexicon)
        yield from _count(around)(batches)

    clean = rows.mapInArrow(phrases, shape).groupBy("term").agg(*sums).filter(f"clean >= {LEAST_DOCS} AND toxic * 20 <= clean")
    exceptions = {r["term"] for r in clean.collect()}

    def measure(batches):
        automaton = matcher(lexicon)
        for batch in batches:
            folded = map(fold, batch["text"].to_pylist())
            x = [features(live_hits(automaton, exceptions, t), t) for t in folded]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    got = rows.mapInArrow(measure, "doc_id long, label int, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    x, y = np.array(got["x"].tolist()), (got["label"].to_numpy() > 0).astype(float)
    return {"lexicon": lexicon, "exceptions": exceptions, "weights": _logistic(x, y)}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score and n_hits of each row."""
    held_names(docs, "doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # what the sample bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        automaton = matcher(own["lexicon"])
        for batch in batches:
            x, n = [], []
            for text in batch["text"].to_pylist():
                folded = fold(text or "")
                weights = live_hits(automaton, own["exceptions"], folded)
                x.append(features(weights, folded))
                n.append(len(weights))
            p = 1 / (1 + np.exp(-np.clip(np.array(x).reshape(-1, 5) @ own["weights"], -40, 40)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.round(p, 9)), pa.array(n, pa.int64())], names=["doc_id", "score", "n_hits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, n_hits long")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 3) == 1
    model = fit(docs, table(spark, sf_dir, "labels"), held)
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"), "n_hits")
