"""Ranked lexical search with the Best Position Algorithm.

`build_index` cuts documents into blocks of about BLOCK postings. A block is one row:
its terms, and for each term the documents that hold it and how often, as packed
arrays. Nothing is shuffled for it and no block grows with the corpus.

`search` runs a batch of queries over all blocks. In a block each term has an impact
list, sorted by falling impact, and direct access to a document's entry. The lists of
a query are read in parallel, in rounds that get longer; each document met is looked
up in all its lists. A list's best position is the end of the run of its places, from
the first on, that have been seen by either kind of access. No unseen document can
score more than the sum of the impacts at the best positions, so a block stops once
its kth score is strictly above that sum (a tie could still win by its doc_id). The
best of all blocks are ranked per query.

Counts of documents, terms and their lengths cover the whole index. Queries reach the
tasks in batches of BATCH terms at most (a longer query is a batch of its own), so
what is sent is bounded however many queries there are.

Defined cases: a null or empty text, or one without terms, has no postings and isn't
counted; a query without known terms has no results; each row of queries is a query,
also where item_id repeats or is null; repeated documents are ranked each; a null
doc_id comes before others among equal scores; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.llm.common import as_bytes, held_names, sliced, stored, table

#: Postings of a block, terms of a batch of queries, places of a list that the first round reads.
BLOCK, BATCH, ROUND = 1 << 20, 1 << 17, 64

# letters and digits of ASCII and all other characters are kept, only A-Z changed
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_INDEX = "doc_ids array<long>, n_terms binary, terms binary, starts binary, docs binary, times binary, n_docs long, all_terms long"


def terms_of(text: str | None) -> list[str]:
    """The terms of one text."""
    return [x.decode() for x in (text or "").encode().translate(_FOLD).split()]


def _lines(blob: bytes) -> pa.Array:
    return pc.split_pattern(pa.array([blob], pa.large_binary()).cast(pa.large_string()), "\n").flatten() if blob else pa.array([], pa.large_string())


def _block(ids: list, n: np.ndarray, codes: np.ndarray, docs: np.ndarray, terms: pa.Array) -> tuple:
    """A row of the index from (code of a term, number of a document) for each occurrence."""
    used, codes = np.unique(codes, return_inverse=True)
    pairs, times = np.unique(codes.astype(np.int64) * len(ids) + docs, return_counts=True)
    starts = np.searchsorted(pairs, np.arange(len(used) + 1) * len(ids))
    blob = b"\n".join(x.encode() for x in terms.take(pa.array(used)).to_pylist())
    return ids, n.astype(np.int64).tobytes(), blob, starts.astype(np.int64).tobytes(), (pairs % len(ids)).astype(np.int32).tobytes(), times.astype(np.int32).tobytes(), int((n > 0).sum()), int(n.sum())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole documents, some BLOCK terms with repeats at a time."""

    def out() -> pa.RecordBatch:
        words = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        n, flat = np.asarray(pc.list_value_length(words)).astype(np.int64), words.flatten()
        coded = flat.dictionary_encode()
        codes, docs = np.asarray(coded.indices), np.repeat(np.arange(len(n)), n)
        real = np.asarray(pc.binary_length(flat)) > 0  # blanks at an end leave an empty one
        codes, docs = codes[real], docs[real]
        row = _block(list(ids), np.bincount(docs, minlength=len(ids)), codes, docs, coded.dictionary)
        ids.clear(), texts.clear()
        kinds = pa.list_(pa.int64()), *[pa.binary()] * 5, pa.int64(), pa.int64()
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in _INDEX.split(", ")])

    ids, texts, size = [], [], 0
    for batch in sliced(batches):
        for doc, text in zip(batch["doc_id"].to_pylist(), as_bytes(batch["text"]), strict=True):
            ids.append(doc)
            texts.append(text.translate(_FOLD))
            size += len(text)
            if size >= 6 * BLOCK:
                yield out()
                size = 0
    if ids:
        yield out()


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of doc_id and text: one row for each block of documents."""
    held_names(docs, "doc_id", "text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(_blocks, _INDEX), "index")


@dataclass
class _List:
    """An impact list: documents by number with impact and place, and impacts by place."""

    docs: np.ndarray
    impact: np.ndarray
    place: np.ndarray
    by_place: np.ndarray
    falling: np.ndarray

    @classmethod
    def of(cls, docs: np.ndarray, impact: np.ndarray) -> _List:
        order = np.lexsort((docs, -impact))
        place = np.empty(len(docs), dtype=np.int64)
        place[order] = np.arange(len(docs))
        return cls(docs, impact, place, docs[order], impact[order])


def best(lists: list[tuple[int, _List]], k: int, ids: np.ndarray) -> list[tuple[int, int]]:
    """The k best (document, score) of weighted impact lists, equal scores by ids.

    Fewer than k where the lists hold fewer documents; scores are above 0.
    """
    depth, longest = ROUND, max((len(x.docs) for _, x in lists), default=0)
    if not longest:
        return []
    while True:
        seen = np.unique(np.concatenate([x.by_place[:depth] for _, x in lists]))
        score, bound = np.zeros(len(seen), dtype=np.int64), 0
        for weight, x in lists:
            at = np.minimum(np.searchsorted(x.docs, seen), len(x.docs) - 1)
            held = x.docs[at] == seen
            score[held] += weight * x.impact[at[held]]
            places = np.sort(x.place[at[held]])
            run = int(np.argmin(np.r_[places == np.arange(len(places)), False]))
            # run is 1 at least, since the first round reads every list's first place
            bound += weight * int(x.falling[run - 1]) if run < len(x.docs) else 0
        order = np.lexsort((ids[seen], -score))[:k]
        full = len(order) == k and score[order[-1]] > bound
        if full or depth >= longest:
            return [(int(seen[i]), int(score[i])) for i in order if score[i] > 0]
        depth *= 2


def _starts(row: dict) -> np.ndarray:
    return np.frombuffer(row["starts"], dtype=np.int64)


def _frequencies(index: DataFrame, terms: list[str]) -> dict[int, int]:
    """In how many documents each of a batch's terms (by its place in the list) occurs."""
    wanted = pa.array(terms, pa.large_string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            at = pc.index_in(wanted, value_set=_lines(batch["terms"][0].as_py())).fill_null(-1).to_numpy(zero_copy_only=False)
            own = np.flatnonzero(at >= 0)
            n = np.diff(np.frombuffer(batch["starts"][0].as_py(), dtype=np.int64))[at[own]]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(n, pa.int64())], names=["term", "df"])

    # BATCH rows at most, or the terms of one query
    found = index.select("terms", "starts").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {x["term"]: x["df"] for x in found.collect()}


def _search_batch(index: DataFrame, queries: list[tuple[int, int | None, Counter]], n: int, total: int, k: int) -> DataFrame:
    terms = sorted({x for _, _, counts in queries for x in counts})
    df = _frequencies(index, terms)
    number = {x: i for i, x in enumerate(terms) if i in df}
    weight = {i: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for i, d in df.items()}
    wanted = pa.array(terms, pa.large_string())
    asked = [(turn, item, [(number[x], weight[number[x]] * times) for x, times in counts.items() if x in number and weight[number[x]]]) for turn, item, counts in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            row = batch.to_pylist()[0]
            ids, starts = row["doc_ids"], _starts(row)
            length = np.frombuffer(row["n_terms"], dtype=np.int64)
            m = 100 - 25 + (25 * length * n) // total
            docs, times = np.frombuffer(row["docs"], dtype=np.int32), np.frombuffer(row["times"], dtype=np.int32).astype(np.int64)
            at = pc.index_in(wanted, value_set=_lines(row["terms"])).fill_null(-1).to_numpy(zero_copy_only=False)
            held: dict[int, _List] = {}
            order = np.argsort(np.argsort(np.array([-(2**63) if x is None else x for x in ids], dtype=np.int64), kind="stable"))
            out = []
            for turn, item, parts in asked:
                lists = []
                for term, w in parts:
                    if at[term] < 0:
                        continue
                    if term not in held:
                        span = slice(starts[at[term]], starts[at[term] + 1])
                        held[term] = _List.of(docs[span], (1_000_000_000 * times[span]) // (1000 * times[span] + 12 * m[docs[span]]))
                    lists.append((w, held[term]))
                out += [(turn, item, ids[d], s) for d, s in best(lists, k, order)]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["turn", "item_id", "doc_id", "score"])

    return index.mapInArrow(run, "turn long, item_id long, doc_id long, score long")


def search(index: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each row (item_id, text) of queries."""
    held_names(queries, "item_id", "text")
    spark = index.sparkSession
    n, total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("all_terms"), F.lit(0))).first()
    found = spark.createDataFrame([], "turn long, item_id long, doc_id long, score long")

    def batches() -> Iterator[list]:
        held, size = [], 0
        for turn, row in enumerate(queries.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator()):
            counts = Counter(terms_of(row["text"]))
            if held and size + len(counts) > BATCH:
                yield held
                held, size = [], 0
            held.append((turn, row["item_id"], counts))
            size += len(counts)
        if held:
            yield held

    if n:
        for batch in batches():
            found = found.union(stored(_search_batch(index, batch, n, total, k), "found", 1))
    rank = F.row_number().over(Window.partitionBy("turn").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (
  SELECT item_id, term, count(*) AS qf FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
size AS (SELECT doc_id, len(w)::BIGINT AS n FROM t WHERE len(w) > 0),
total AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM size),
p AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS term FROM t) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, total GROUP BY term),
s AS (
  SELECT item_id, doc_id, sum(qf * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nd) // l))))::BIGINT AS score
  FROM q JOIN weight USING (term) JOIN p USING (term) JOIN size USING (doc_id), total GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""
