"""Fingerprints, collocations and ranked search against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from claimloom.llm import collocations, fingerprints, ranked_search
from tests.llm.test_queries import SHAPE, patched, rows  # noqa: F401


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SHAPE).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


# ---- fingerprints


def slow_print(data: bytes) -> str:
    """The docstring, one byte at a time."""
    table, step, mask = [int(x) for x in fingerprints._BYTE], 0xD6E8FEB86659FD93, 2**64 - 1

    def mixed(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    zeros = {}
    for i in range(len(data) - 6):
        h = 0
        for c in data[i : i + 7]:
            h = (h * step + table[c]) & mask
        h = mixed(h)
        zeros[i + 7] = 64 if h == 0 else (h & -h).bit_length() - 1
    zeros.pop(len(data), None)
    k = 2
    while sum(z >= k for z in zeros.values()) + 1 > 64:
        k += 1
    out = [str(k)]
    for size in (k, k + 1, k + 2):
        edges = [0, *(e for e, z in sorted(zeros.items()) if z >= size), len(data)]
        out.append("".join(fingerprints.LETTERS[zlib.crc32(data[a:b]) % 64] for a, b in pairwise(edges) if b > a))
    return ":".join(out)


def edit_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def slow_likeness(one, two):
    if one == two:
        return 1.0
    a, b = one.split(":"), two.split(":")
    k = max(int(a[0]), int(b[0]))
    if k - min(int(a[0]), int(b[0])) > 2:
        return 0.0
    a, b = a[1 + k - int(a[0])], b[1 + k - int(b[0])]
    run = max(1, min(4, min(len(a), len(b)) // 4))
    if not a or not b or not any(a[i : i + run] in b for i in range(len(a) - run + 1)):
        return 0.0
    return 1 - edit_distance(a, b) / max(len(a), len(b))


def test_fingerprints(docs, empty):
    table = rows()
    # by descending doc_id, a null one last; the texts under one doc_id are equal here
    order = sorted(((r[0], r[1] or "") for r in table), key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = []
    for (doc, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        changed = (text[: len(text) - half] + following[:half]).encode()
        marks = slow_print(text.encode()), slow_print(changed), slow_print(following.encode())
        want.append((doc, len(text), hashlib.sha256(changed).hexdigest(), *marks[:2], round(slow_likeness(*marks[:2]), 9), round(slow_likeness(marks[0], marks[2]), 9)))
    out = fingerprints.edited_prints(docs)
    near = [F.round(fingerprints.likeness(F.col("fingerprint"), F.col(x)), 9) for x in ("edited_fingerprint", "next_fingerprint")]
    got = [tuple(r) for r in out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert fingerprints.edited_prints(empty).count() == 0
    lone = fingerprints.edited_prints(docs.filter("doc_id = 3")).first()
    assert lone["fingerprint"] == lone["next_fingerprint"]


def test_fingerprint_of_odd_texts():
    rng = random.Random(3)
    say = lambda n: bytes(rng.choices(b"abcdefgh \n", k=n))
    for data in (b"", b"a", b"abcdefg", b"a" * 5000, b"ab" * 4000, "日本語の文字列 ".encode() * 90, say(300), say(20_000)):
        assert fingerprints.fingerprint(data) == slow_print(data)
    long = say(3_000_000)
    one, two = fingerprints.fingerprint(long), fingerprints.fingerprint(long[:1_000_000] + b"!" + long[1_000_000:])
    assert slow_likeness(one, two) > 0.9
    assert max(map(len, one.split(":"))) <= fingerprints.CHUNKS
    assert slow_likeness(one, fingerprints.fingerprint(say(3_000_000))) == 0


def test_likeness_of_columns(spark, docs):
    pairs = [(None, "2:A:B:C"), ("2:::", "2:::"), ("2:::", "2:A:A:A"), ("2:ABCD:AB:A", "5:ABCD:AB:A"), ("2:ABCDEFGHIJKLMNOP:QRST:A", "4:AB:AB:A"), ("2:ABCDEFGHIJKLMNOP:Q:A", "2:ABCDEFGHIJKLMNOX:Q:A")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(fingerprints.likeness(F.col("a"), F.col("b"))).collect()]
    assert got == [None if a is None else slow_likeness(a, b) for a, b in pairs]
    named = fingerprints.with_fingerprint(docs).filter("doc_id = 3").first()
    assert named["fingerprint"] == slow_print(named["text"].encode()) and named["digest"] == "clash"


# ---- collocations


def phrase_rows():
    rng = random.Random(5)
    vocab = ["w1", "w2", "w3", "Über", "x*y", "\x1c"]
    say = lambda n: "".join(rng.choice(vocab) + rng.choice([" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\r\n", "!"]) for _ in range(n))
    texts = [say(rng.randint(1, 300)) for _ in range(100)] + ["New  York City hall", "new york\tcity HALL"] * 40 + ["a b a b a b a b", "", None, " \t ", ".,;:", "one"]
    shape = [("en" if k % 3 else None if k % 2 else "und", t) for k, t in enumerate(texts)] + [("fr", "très bien merci ") for _ in range(29)] + [("de", "zu viel gut") for _ in range(31)]
    return [(k, t, lang, "s", 1, 0.5, "clash") for k, (lang, t) in enumerate(shape)] + [(0, "repeated row here", "en", "s", 1, 0.5, "clash")] * 35


def slow_collocations(table):
    counts, words = {}, Counter()
    for _, text, lang, *_ in table:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, 5):
                counts.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        good = {p: n for p, n in f.items() if len(p) > 1 and n >= 30}
        found = []
        for p, a in good.items():
            if any(len(q) > len(p) and 100 * n >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, n in good.items()):
                continue
            score, j = min((2_000_000 * a // (f[p[:j]] + f[p[j:]]), j) for j in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:j]], f[p[j:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(found)[:2000], 1):
            out.append((lang, i, p.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_collocations(spark, empty, patched):  # noqa: F811
    table = spark.createDataFrame(phrase_rows(), SHAPE).repartition(3)
    want = slow_collocations(phrase_rows())
    assert len(want) > 20 and {x[0] for x in want} == {"en", "und", "de"}
    assert sorted(tuple(r) for r in collocations.collocations(table).select(*COLUMNS).collect()) == want
    assert collocations.collocations(empty).count() == 0
    # chunks, shards and stripes in many parts
    patched(collocations, CHUNK=150, SHARD=9, STRIPE=40)
    assert sorted(tuple(r) for r in collocations.collocations(table).select(*COLUMNS).collect()) == want
    # a stripe's sum is the prefix's count, its largest entry the most frequent extension
    _, levels, sums = collocations.frequent_phrases(table)
    for shorter, longer, own in zip(levels, levels[1:], sums, strict=False):
        n = {r["id"]: r["n"] for r in shorter.collect()}
        most = Counter()
        for r in longer.collect():
            most[r["first"]] = max(most[r["first"]], r["n"])
        assert {r["first"]: (r["total"], r["largest"]) for r in own.collect()} == {k: (v, most[k]) for k, v in n.items()}


def test_score_is_exact_beyond_64_bits(spark):
    n, left, right = 9_000_000_000_000_000_000, 9_100_000_000_000_000_001, 9_200_000_000_000_000_003
    one = spark.createDataFrame([(n, [left, n], [right, n])], "n long, heads array<long>, tails array<long>").select(F.expr(collocations._CUT).alias("c")).first()["c"]
    assert one["score"] == 2_000_000 * n // (left + right)


# ---- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def slow_search(table, queries, k):
    low = lambda t: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(r[0], Counter(low(r[1]))) for r in table]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n, total = len(docs), sum(x[2] for x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in queries:
        asked, scored = Counter(low(text)), []
        for d, c, size in docs:
            m = 100 - 25 + (25 * size * n) // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                scored.append((-s, d is not None, d or 0, d))
        out += [(item, i, x[3], -x[0]) for i, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def search_rows():
    rng = random.Random(7)
    vocab = [f"t{i}" for i in range(40)] + ["Ñandú", "x1", "ÀB"]
    say = lambda n: "".join(rng.choices(vocab, k=1)[0] + rng.choice([" ", "-", "\n", "_", "  "]) for _ in range(n))
    texts = [say(rng.randint(1, 60)) for _ in range(150)] + ["", None, "...", "t1 t2 t3 " * 400, "t1 t2"] + ["t5 t6 same"] * 30
    table = [(k, t, "en", "s", 1, 0.5, "clash") for k, t in enumerate(texts)]
    queries = [(i, say(rng.randint(1, 12))) for i in range(25)] + [(90, None), (91, "unknown words"), (92, "same t5"), (92, "t6"), (None, "T1 t1 ñANDÚ")]
    return [*table, table[3], (None, "t1 t2", "en", "s", 1, 0.5, "clash")], queries


def test_ranked_search(spark, empty, patched):  # noqa: F811
    table, queries = search_rows()
    docs = spark.createDataFrame(table, SHAPE).repartition(3)
    asked = spark.createDataFrame(queries, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    want = slow_search(table, queries, 20)
    run = lambda d, q: sorted((tuple(r) for r in ranked_search.search(ranked_search.build_index(d), q).collect()), key=str)
    assert run(docs, asked) == want
    assert run(empty, asked) == [] == run(docs, asked.limit(0))
    # small blocks, batches of one or two queries, rounds of one place
    patched(ranked_search, BLOCK=100, BATCH=10, ROUND=1)
    assert run(docs, asked) == want


def test_best_positions_stop_early():
    """A document that leads both lists is found without reading them to the end, ties by id included."""
    import numpy as np

    n = 5000
    impact = np.arange(n, 0, -1, dtype=np.int64) * 10
    lists = [(3, ranked_search._List.of(np.arange(n), impact)), (2, ranked_search._List.of(np.arange(n), impact[::-1].copy()))]
    reads = []
    unique = np.unique

    def counted(x, *a, **b):
        reads.append(len(x))
        return unique(x, *a, **b)

    ranked_search.np.unique = counted
    try:
        got = ranked_search.best(lists[:1], 20, np.arange(n))
        assert got == [(i, int(3 * impact[i])) for i in range(20)] and max(reads) <= ranked_search.ROUND
        score = 3 * impact + 2 * impact[::-1]
        want = np.lexsort((np.arange(n), -score))[:20]
        assert ranked_search.best(lists, 20, np.arange(n)) == [(int(i), int(score[i])) for i in want]
        level = [(1, ranked_search._List.of(np.arange(n), np.full(n, 7)))]
        assert [d for d, _ in ranked_search.best(level, 5, np.arange(n)[::-1])] == list(range(n - 1, n - 6, -1))
    finally:
        ranked_search.np.unique = unique
