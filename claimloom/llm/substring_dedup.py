"""Substring dedup by relative Lempel-Ziv parsing.

All documents are the reference. It is cut into blocks at anchors: the smallest
hash of GRAM words within every WINDOW words, so equal windows lie in blocks of
the same anchor. A block indexes its reference by window: where (document,
position) each window of WINDOW words occurs. A document is factored against the
blocks of its anchors, that is, all blocks that can hold a match: each of its
windows that occurs elsewhere gets its source there, the smallest (document,
position) but itself. Parsing is greedy: at a word whose window has a source, the
factor follows that source as far as it goes, over borders of blocks too; other
words are literals. The next factor starts where the last one ends; windows across
such a boundary are looked up like all others, and what any of them covers joins
the duplicate spans.

Equality of windows, at borders of factors and elsewhere, is that of two digests of
their words from two independent families of word hashes, 127 bits in all; of
documents that of 128 bits.

How it runs: (1) tasks report the anchors of documents and Spark keeps those seen
twice; (2) documents with such anchors meet them, and tasks fold the windows of
their own documents and send one entry for each different window to its block;
(3) tasks go through their blocks one after the other and name sources; (4) sources
meet their documents, which are parsed. Anchors of more than SPLIT documents are
split into blocks by window.

Defined cases: a null text has no words; a document of fewer than WINDOW words
keeps all of them; an empty text keeps none and hashes as empty; rows that repeat
doc_id and text are occurrences of their own; documents that are null in doc_id
are told apart by their text; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.common import as_bytes, doc_word_hashes, grams, held_names, mix64, partitions, signed, stored, table

WINDOW, GRAM = 35, 8
SPLIT = 1 << 11
#: Windows that a task folds, or looks up, at a time.
FOLDED = 1 << 20


def _smallest(g: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each n neighbours, by doubling."""
    have, span = g, 1
    while 2 * span <= n:
        have = np.minimum(have[:-span], have[span:])
        span *= 2
    return np.minimum(have[: len(g) - n + 1], have[n - span : n - span + len(g) - n + 1])


def window_anchors(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window, and the hashes of all grams."""
    if len(h) < window:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
    g = grams(h, gram)
    return _smallest(g, window - gram + 1), g


def _uid() -> list[F.Column]:
    """128 bits for doc_id and text."""
    doc_id = F.col("doc_id").cast("long")
    return [F.xxhash64(doc_id, "text").alias("one"), F.xxhash64("text", doc_id, F.lit("two")).alias("two")]


def _keyed(docs: DataFrame) -> DataFrame:
    """one, two (the document's uid), doc_id and the compressed text of each row."""
    held_names(docs, "doc_id", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [squeeze.compress(t) for t in as_bytes(batch["text"])]
            yield pa.RecordBatch.from_arrays([*(batch[x] for x in ("one", "two", "doc_id")), pa.array(packed, pa.binary())], names=["one", "two", "doc_id", "packed"])

    return docs.select(*_uid(), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, "one long, two long, doc_id long, packed binary")


def _unpack(column: pa.Array) -> list[bytes]:
    loosen = zstandard.ZstdDecompressor()
    return [loosen.decompress(x) for x in column.to_pylist()]


def anchors(docs: DataFrame) -> DataFrame:
    """one, two, anchor, and 2 where the document holds it more than once, else 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, times, sizes = [], [], []
            for h in doc_word_hashes(as_bytes(batch["text"])):
                m, g = window_anchors(h)
                own = np.unique(m)
                every, n = np.unique(g, return_counts=True)
                values.append(own)
                times.append(np.minimum(n[np.searchsorted(every, own)], 2))
                sizes.append(len(own))
            if values:
                ids = [pa.array(np.repeat(np.asarray(batch[x]), sizes)) for x in ("one", "two")]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(signed(np.concatenate(values))), pa.array(np.concatenate(times).astype(np.int8))], names=["one", "two", "anchor", "times"])

    return docs.select(*_uid(), "text").mapInArrow(run, "one long, two long, anchor long, times byte")


def window_prints(h: np.ndarray, second: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Two independent digests of each window, from words hashed by two families."""
    return grams(h, window), grams(second, window)


def _groups(high: np.ndarray, low: np.ndarray, *ties: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that brings equal prints together, sorted by ties; where groups start, and their sizes."""
    order = np.lexsort((*ties[::-1], low, high))
    fresh = np.r_[True, (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])]
    starts = np.flatnonzero(fresh)
    return order, starts, np.diff(np.r_[starts, len(order)])


def _sources(order: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each entry the first of its group; for the first the second, or -1."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.repeat(order[starts], sizes)
    many = sizes > 1
    out[order[starts]] = -1
    out[order[starts[many]]] = order[starts[many] + 1]
    return out


def _runs(*steps: tuple[np.ndarray, int]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs in which each array rises by its step."""
    n = len(steps[0][0])
    if not n:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    cut = np.zeros(n - 1, dtype=bool)
    for x, step in steps:
        cut |= x[1:] != x[:-1] + x.dtype.type(step)
    starts = np.r_[0, np.flatnonzero(cut) + 1]
    return starts, np.diff(np.r_[starts, n])


_SENT = "block long, one long, two long, start int, n int, prints binary, s_one long, s_two long, s_start int"
_FOUND = "one long, two long, start int, n int, s_one long, s_two long, s_start int"


def _rows(names: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in names.split(", ")]
    n = max(len(c) for c in columns if c is not None)
    return pa.RecordBatch.from_arrays([pa.nulls(n, kinds[k]) if c is None else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[x for x, _ in fields])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows at known anchors: to each block one entry for a different window.

    prints holds both hashes of n windows; the lowest bit of the second says that
    this task has seen the window twice. Such windows have their source from here:
    rows without prints say that n windows from start occur at the source.
    """
    held: list[tuple[np.ndarray, ...]] = []
    uids: list[tuple[int, int]] = []

    def out() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        high, low, doc, at, block = (np.concatenate(x) for x in zip(*held, strict=True))
        one, two = np.array(uids, dtype=np.int64).T
        held.clear()
        uids.clear()
        order, starts, sizes = _groups(high, low)
        source = _sources(order, starts, sizes)
        twice = np.flatnonzero(source >= 0)
        src = source[twice]
        s, n = _runs((doc[twice], 0), (at[twice], 1), (doc[src], 0), (at[src], 1))
        own, src = twice[s], src[s]
        if len(own):
            yield _rows(_SENT, one[doc[own]], one[doc[own]], two[doc[own]], at[own], n, None, one[doc[src]], two[doc[src]], at[src])
        once = np.sort(order[starts])
        marked = low[once] | (source[once] >= 0).astype(np.uint64)
        high, doc, at, block = high[once], doc[once], at[once], block[once]
        s, n = _runs((doc, 0), (at, 1), (block, 0))
        raw, more = high.tobytes(), marked.tobytes()
        for a in range(0, len(s), 20_000):
            k, m = s[a : a + 20_000], n[a : a + 20_000]
            packed = [raw[8 * i : 8 * (i + j)] + more[8 * i : 8 * (i + j)] for i, j in zip(k.tolist(), m.tolist(), strict=True)]
            yield _rows(_SENT, block[k], one[doc[k]], two[doc[k]], at[k], m, packed, None, None, None)

    size = 0
    for batch in batches:
        columns = (batch[x].to_pylist() for x in ("one", "two", "anchors", "parts"))
        texts = _unpack(batch["packed"])
        for h, second, one, two, known, parts in zip(doc_word_hashes(texts), doc_word_hashes(texts, 2), *columns, strict=True):
            m, _ = window_anchors(h)
            known, parts = np.array(known, dtype=np.int64).view(np.uint64), np.array(parts, dtype=np.uint64)
            order = np.argsort(known)
            known, parts = known[order], parts[order]
            where = np.minimum(np.searchsorted(known, m), len(known) - 1)
            at = np.flatnonzero(known[where] == m)
            if not len(at):
                continue
            high, low = (x[at] for x in window_prints(h, second))
            block = signed(mix64(m[at] + high % parts[where[at]]))
            held.append((high, low & ~np.uint64(1), np.full(len(at), len(uids)), at, block))
            uids.append((one, two))
            size += len(at)
            if size >= FOLDED:
                yield from out()
                size = 0
    yield from out()


def _named(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The sources of windows in some whole blocks."""
    one, two, start, n = (np.asarray(rows[x]) for x in ("one", "two", "start", "n"))
    if not len(n):
        return
    n = n.astype(np.int64)
    raw = np.frombuffer(b"".join(rows["prints"].to_pylist()), dtype=np.uint64)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = np.repeat(2 * (np.cumsum(n) - n), n) + within
    row = np.repeat(np.arange(len(n)), n)
    high, low, at = raw[place], raw[place + n[row]], start[row] + within
    seen = (low & np.uint64(1)).astype(bool)
    order, starts, sizes = _groups(high, low >> np.uint64(1), one[row], two[row], at)
    source = _sources(order, starts, sizes)
    hit = np.flatnonzero((source >= 0) & ~seen)  # those seen twice have a source already
    src = source[hit]
    s, k = _runs((row[hit], 0), (at[hit], 1), (row[src], 0), (at[src], 1))
    for a in range(0, len(s), 100_000):
        own, from_ = hit[s[a : a + 100_000]], src[s[a : a + 100_000]]
        yield _rows(_FOUND, one[row[own]], two[row[own]], at[own], k[a : a + 100_000], one[row[from_]], two[row[from_]], at[from_])


def _lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Goes through a task's entries, sorted by block, a few whole blocks at a time."""
    wait, size = [], 0
    for batch in batches:
        known = batch.filter(batch["s_one"].is_valid())
        if known.num_rows:
            yield known.select([x.split()[0] for x in _FOUND.split(", ")])
        batch = batch.filter(batch["prints"].is_valid())
        if batch.num_rows:
            wait.append(batch)
            size += int(np.asarray(batch["n"]).sum())
        if size >= FOLDED:
            rows = pa.Table.from_batches(wait)
            blocks = np.asarray(rows["block"])
            cut = int(np.searchsorted(blocks, blocks[-1]))
            yield from _named(rows.slice(0, cut))
            rows = rows.slice(cut).combine_chunks()
            wait, size = rows.to_batches(), int(np.asarray(rows["n"]).sum())
    if wait:
        yield from _named(pa.Table.from_batches(wait))


def window_sources(docs: DataFrame, keyed: DataFrame) -> DataFrame:
    """one, two, start, n, s_one, s_two, s_start: n windows from word start on
    occur in document (s_one, s_two) from word s_start on."""
    found = stored(anchors(docs), "anchors")
    known = found.groupBy("anchor").agg(F.sum("times").alias("n")).filter("n > 1")
    known = stored(known.select("anchor", F.ceil(F.col("n") / SPLIT).cast("int").alias("parts")), "known-anchors")
    # a row that repeats another has its anchors twice
    own = found.select("one", "two", "anchor").join(known, "anchor").groupBy("one", "two").agg(F.collect_set(F.struct("anchor", "parts")).alias("a"))
    own = own.select("one", "two", F.col("a.anchor").alias("anchors"), F.col("a.parts").alias("parts"))
    sent = keyed.select("one", "two", "packed").join(own, ["one", "two"]).mapInArrow(_windows, _SENT)
    return sent.repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block").mapInArrow(_lookup, _FOUND)


def _sourced(n_words: int, runs: list[dict]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """For each window its source (an index of the list, -1 for none) and the position there."""
    names: dict[tuple[int, int], int] = {}
    doc, at = np.full(max(0, n_words - WINDOW + 1), -1, dtype=np.int64), np.zeros(max(0, n_words - WINDOW + 1), dtype=np.int64)
    for r in runs:
        span = slice(r["start"], r["start"] + r["n"])
        doc[span] = names.setdefault((r["s_one"], r["s_two"]), len(names))
        at[span] = np.arange(r["s_start"], r["s_start"] + r["n"])
    return doc, at, list(names)


def factors(n_words: int, runs: list[dict]) -> tuple[list[tuple[int, int, tuple[int, int], int]], np.ndarray]:
    """The greedy parse (start, words, source, position there), and which words lie in duplicate spans."""
    doc, at, names = _sourced(n_words, runs)
    has = np.flatnonzero(doc >= 0)
    edge = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(edge, has, 1)
    np.add.at(edge, has + WINDOW, -1)
    ends = np.r_[np.flatnonzero((doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)), len(doc) - 1] if len(doc) else has
    out, i = [], 0
    while (k := int(np.searchsorted(has, i))) < len(has):
        i = int(has[k])
        n = int(ends[np.searchsorted(ends, i)]) - i + WINDOW
        out.append((i, n, names[doc[i]], int(at[i])))
        i += n
    return out, np.cumsum(edge[:-1]) > 0


_FACTOR = pa.struct([("start", pa.int32()), ("n_words", pa.int32()), ("source", pa.string()), ("source_start", pa.int32())])
_SPAN = pa.struct([("start", pa.int32()), ("n_words", pa.int32())])
_PARSED = "doc_id long, uid string, n_words long, factors array<struct<start:int,n_words:int,source:string,source_start:int>>, spans array<struct<start:int,n_words:int>>, kept string"


def _hex(one: int, two: int) -> str:
    return f"{one % 2**64:016x}{two % 2**64:016x}"


def parse(docs: DataFrame) -> DataFrame:
    """doc_id, uid, n_words, factors, duplicate spans and the kept text of each row.

    A factor's source is the uid of a document, and source_start the word there.
    """
    keyed = _keyed(docs)
    runs = window_sources(docs, keyed).groupBy("one", "two").agg(F.collect_list(F.struct("start", "n", "s_one", "s_two", "s_start")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = (batch[x].to_pylist() for x in ("doc_id", "one", "two", "runs"))
            for text, doc_id, one, two, runs in zip(_unpack(batch["packed"]), *columns, strict=True):
                words = text.split()
                found, gone = factors(len(words), runs or [])
                edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                spans = [{"start": int(a), "n_words": int(b - a)} for a, b in edges.reshape(-1, 2)]
                found = [{"start": a, "n_words": n, "source": _hex(*s), "source_start": b} for a, n, s, b in found]
                kept = b" ".join([w for w, out in zip(words, gone.tolist(), strict=True) if not out])
                rows.append((doc_id, _hex(one, two), len(words), found, spans, kept.decode()))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = pa.int64(), pa.string(), pa.int64(), pa.list_(_FACTOR), pa.list_(_SPAN), pa.string()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "uid", "n_words", "factors", "spans", "kept"])

    return keyed.join(runs, ["one", "two"], "left").mapInArrow(run, _PARSED)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["n_words"])
    return parsed.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS g FROM d, unnest(range(1, len(w) - 33)) AS u(i)),
two AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
hit AS (SELECT r, list(i) AS hits FROM g JOIN two USING (g) GROUP BY r),
cov AS (SELECT DISTINCT r, j FROM (SELECT r, unnest(range(x, x + 35)) AS j FROM (SELECT r, unnest(hits) AS x FROM hit))),
gone AS (SELECT r, list(j) AS js, count(*) AS n FROM cov GROUP BY r),
word AS (SELECT d.r, u.i, d.w[u.i] AS x FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN cov ON word.r = cov.r AND word.i = cov.j GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""
