"""BPE encoding and decoding: speculate, verify, repair.

A word's tokens are first guessed by greedy longest match. A guess is right
exactly if every pair of neighbours is compatible, that is, if merging never
joins across their border; those tests run over all new pairs of a batch at
once on arrays. Only words with a pair that fails are merged step by step.

Two tokens a, b are incompatible if some merge (x, y) of rank m has x on the
right edge of a and y on the left edge of b at the time of m: before x's own
parent is made and no later than y's (of equal merges the left one comes first).

Defined cases: a null text is empty; an empty text has no tokens and decodes to
an empty text; special tokens inside a text are encoded as such; any length of
text and word is encoded whole; repeated rows give equal rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.common import held_names, sliced, table

#: Bytes, near enough, of the words (and of the chunks) of one generation that a task remembers.
REMEMBERED = 3 << 24
NEVER = np.iinfo(np.int64).max
END = "</w>"


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def byte_letters() -> list[str]:
    """The printable letter of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Recent:
    """The ids of strings, of two generations: the older one goes as a whole."""

    def __init__(self) -> None:
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.size = 0

    def put(self, key: str, ids: tuple[int, ...]) -> None:
        self.new[key] = ids
        self.size += 200 + len(key) + 8 * len(ids)

    def unknown(self, keys: set[str]) -> list[str]:
        """Keys of neither generation; those of the older one come over."""
        out = []
        for k in keys - self.new.keys():
            ids = self.old.get(k)
            if ids is None:
                out.append(k)
            else:
                self.put(k, ids)
        return out

    def turn(self) -> None:
        if self.size > REMEMBERED:
            self.old, self.new, self.size = self.new, {}, 0


class Codec:
    """Reads a tokenizer file with word ends; lower case, white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = [x["type"] for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        plain = all(not model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or not plain or steps != ["NFC", "Replace", "Lowercase"] or cuts != ["Split", "ByteLevel"] or spec["decoder"] or spec["post_processor"]:
            raise ValueError(f"{path}: not a tokenizer of the kind that this codec follows")
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.tokens = [""] * self.size
        for text, k in [*self.vocab.items(), *self.special.items()]:
            self.tokens[k] = text
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(pattern)
        self.splits = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.letters = byte_letters()
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.rank = {(a, b): r for r, (a, b) in enumerate(pairs)}
        left = np.array([self.vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], dtype=np.int64)
        self._tables(left, right, made)
        # a token that merging wouldn't make from its own letters is no guess
        self.guess = {t: k for t, k in self.vocab.items() if len(t.removesuffix(END)) == 1 or self._alone(k)}
        #: The longest guess for each start of three letters.
        self.reach: dict[str, int] = {}
        for t in self.guess:
            if (n := len(t.removesuffix(END))) >= 3:
                self.reach[t[:3]] = max(n, self.reach.get(t[:3], 0))
        self.numbers = [str(k) for k in range(self.size)]
        self.chunks, self.known = Recent(), Recent()

    def _tables(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> None:
        keys = left * self.size + right
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        born = np.full(self.size, -1, dtype=np.int64)
        born[made] = np.arange(len(made))
        self.parts = {int(k): (int(a), int(b)) for k, a, b in zip(made, left, right, strict=True)}

        def edge(child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Nodes on one edge from the top down, and when each is covered."""
            down = np.full(self.size, -1, dtype=np.int64)
            down[made] = child
            node, until = [np.arange(self.size)], [np.full(self.size, NEVER)]
            while (now := np.where(node[-1] >= 0, down[node[-1]], -1)).max() >= 0:
                until.append(np.where(now >= 0, born[node[-1]], -1))
                node.append(now)
            return np.array(node), np.array(until)

        self.right_edge, self.left_edge = edge(right), edge(left)

    def _merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens, whether no merge (of a rank under before) joins them."""
        ok = np.ones(len(a), dtype=bool)
        limit = np.full(len(a), NEVER) if before is None else before
        (xs, x_until), (ys, y_until) = self.right_edge, self.left_edge
        for i in range(len(xs)):
            x = xs[i][a]
            if not (rows := np.flatnonzero(ok & (x >= 0))).size:
                break
            for j in range(len(ys)):
                sub = rows[(ys[j][b[rows]] >= 0) & ok[rows]]
                if not sub.size:
                    break
                m = self._merge_rank(x[sub], ys[j][b[sub]])
                bad = (m < x_until[i][a[sub]]) & (m <= y_until[j][b[sub]]) & (m < limit[sub])
                ok[sub[bad]] = False
        return ok

    def _alone(self, token: int) -> bool:
        if not hasattr(self, "_whole"):
            made = np.array(list(self.parts), dtype=np.int64)
            a, b = np.array(list(self.parts.values()), dtype=np.int64).T
            born = self._merge_rank(a, b)
            fine = dict(zip(made.tolist(), self.compatible(a, b, born).tolist(), strict=True))
            self._whole: dict[int, bool] = {}
            for k in made[np.argsort(born)].tolist():
                self._whole[k] = fine[k] and all(self._whole.get(p, True) for p in self.parts[k])
        return self._whole[token]

    def _greedy(self, word: str) -> list[int]:
        out, at, size, guess, reach = [], 0, len(word), self.guess, self.reach
        while at < size:
            n = reach.get(word[at : at + 3], 2)
            if at + n >= size:
                if (k := guess.get(word[at:] + END)) is not None:
                    out.append(k)
                    break
                n = size - at - 1
            while (k := guess.get(word[at : at + n])) is None:
                n -= 1
            out.append(k)
            at += n
        return out

    def merge(self, word: str) -> list[int]:
        """Exact merging, lowest rank first, the left one of equal ranks."""
        part = [*word[:-1], word[-1] + END]
        if len(part) <= 24:
            rank = self.rank
            have = [rank.get(x, NEVER) for x in zip(part, part[1:], strict=False)]
            while have and (low := min(have)) < NEVER:
                i = have.index(low)
                part[i : i + 2] = [part[i] + part[i + 1]]
                del have[i]
                if i:
                    have[i - 1] = rank.get((part[i - 1], part[i]), NEVER)
                if i < len(have):
                    have[i] = rank.get((part[i], part[i + 1]), NEVER)
            return [self.vocab[x] for x in part]
        nxt, prev = [*range(1, len(part)), -1], [*range(-1, len(part) - 1)]
        heap = [(r, i, part[i], part[i + 1]) for i in range(len(part) - 1) if (r := self.rank.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if part[i] != a or j < 0 or part[j] != b:
                continue
            part[i], part[j] = a + b, ""
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            for x, y in ((prev[i], i), (i, nxt[i])):
                if x >= 0 and y >= 0 and (r := self.rank.get((part[x], part[y]))) is not None:
                    heapq.heappush(heap, (r, x, part[x], part[y]))
        return [self.vocab[x] for x in part if x]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Tokens of words in byte letters."""
        if not words:
            return []
        guesses = [self._greedy(w) for w in words]
        flat = np.array([k for g in guesses for k in g], dtype=np.int64)
        ends = np.cumsum([len(g) for g in guesses])
        inner = np.ones(max(0, len(flat) - 1), dtype=bool)
        inner[ends[:-1] - 1] = False
        at = np.flatnonzero(inner)
        pairs, back = np.unique(flat[at] * self.size + flat[at + 1], return_inverse=True)
        right = self.compatible(pairs // self.size, pairs % self.size)[back]
        for w in np.unique(np.searchsorted(ends, at[~right], side="right")).tolist():
            guesses[w] = self.merge(words[w])
        return guesses

    def _learn(self, chunks: list[str]) -> None:
        """Remembers chunks: text without white space, normalised."""
        letter = self.letters.__getitem__
        split = {c: [w if w.isascii() and w.isprintable() else "".join(map(letter, w.encode())) for w in self.words.findall(c)] for c in chunks}
        new = self.known.unknown({w for ws in split.values() for w in ws})
        for w, ids in zip(new, self.encode_words(new), strict=True):
            self.known.put(w, tuple(ids))
        known = self.known.new
        for c, ws in split.items():
            self.chunks.put(c, known[ws[0]] if len(ws) == 1 else tuple(k for w in ws for k in known[w]))

    def _pieces(self, text: str) -> list[str]:
        """Normalised chunks of a text, special tokens as chunks of their own."""
        if "<" in text and len(parts := self.splits.split(text)) > 1:
            return [c for k, part in enumerate(parts) for c in ([part] if k % 2 else self._plain(part))]
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # a lone letter has no final form
            text = text.replace("Σ", "σ")
        text = text.lower()
        return [x for x in regex.split(r"\s+", text) if x] if regex.search("[\x1c-\x1f]", text) else text.split()

    def encode(self, texts: list[str]) -> list[list[int]]:
        self.chunks.turn()
        self.known.turn()
        for s, k in self.special.items():
            if s not in self.chunks.new:
                self.chunks.put(s, (k,))
        pieces = [self._pieces(t) for t in texts]
        if new := self.chunks.unknown(set().union(*pieces)):
            self._learn(new)
        ids = self.chunks.new.__getitem__
        return [list(chain.from_iterable(map(ids, cs))) for cs in pieces]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by one space."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _some(texts: list, chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many characters."""
    a = n = 0
    for b, t in enumerate(texts):
        n += len(t)
        if n >= chars:
            yield a, b + 1
            a, n = b + 1, 0
    if a < len(texts):
        yield a, len(texts)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of each row."""
    held_names(docs, "doc_id", "text")
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [x or "" for x in batch["text"].to_pylist()]
            for a, b in _some(texts):
                ids = codec(path).encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch["doc_id"][a:b], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the decoded text of each row of encode()."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = codec(path)
            texts = [own.decode(x or []) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None, ids: bool = False) -> DataFrame:
    """Digests of each row's ids, and of the text that these ids decode to.

    With ids, the ids are a column too (array<int>).
    """
    held_names(docs, "doc_id", "text")
    path = path or default_path()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for batch in sliced(batches):
            texts = [x or "" for x in batch["text"].to_pylist()]
            for a, b in _some(texts):
                got = own.encode(texts[a:b])
                said = [sha(" ".join(map(own.numbers.__getitem__, x))) for x in got]
                back = [sha(own.decode(x)) for x in got]
                more = [pa.array(got, pa.list_(pa.int32()))] * ids
                yield pa.RecordBatch.from_arrays([batch["doc_id"][a:b], pa.array(map(len, got), pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string()), *more], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
