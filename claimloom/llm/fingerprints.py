"""Document fingerprints by context-triggered piecewise hashing.

A hash rolls over WINDOW bytes of the UTF-8 text. Where its lowest k bits are 0 a
chunk of block size 2^k ends, so boundaries move with the text around them, and
those of a block size are among those of the next smaller one. A text's own block
size is the smallest that cuts it into CHUNKS chunks at most. A fingerprint is

    k:signature:signature:signature

with a letter for each chunk at block sizes 2^k, 2^(k+1) and 2^(k+2). Every byte of
the text is in a chunk of each, however long the text is.

Two fingerprints compare at the finest block size that both hold, so texts whose
lengths differ up to some four times do: likeness is 1 - edit distance / longer
signature. Signatures without a common run of letters (a quarter of the shorter one,
four at most) are strangers, likeness 0. Comparing is all columns, no Python.

Defined cases: a null text counts as empty; an empty text's signatures are empty
and equal each other only; equal texts have equal fingerprints; a null doc_id
comes after all others; among rows of one doc_id the order is that of the text's
hash, then of the text; without documents there are no rows; a lone document is its
own next one; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.common import grams, held_names, partitions, sliced, stored, table

#: Bytes that the hash rolls over, most chunks of a text, bits of the smallest block size, block sizes of a fingerprint.
WINDOW, CHUNKS, LEAST, SIZES = 7, 64, 2, 3
#: Bytes that are hashed at once.
PIECE = 1 << 20
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_BYTE = np.random.default_rng(0xC7F).integers(1, 2**63, 256, dtype=np.uint64)


def _boundaries(data: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks of block size 2^k end, and the largest block size (bits) that ends there."""
    codes = np.frombuffer(data, dtype=np.uint8)
    ends, bits = [], []
    for a in range(0, max(len(codes) - WINDOW + 1, 0), PIECE):
        rolled = grams(_BYTE[codes[a : a + PIECE + WINDOW - 1]], WINDOW)
        at = np.flatnonzero((rolled & np.uint64((1 << k) - 1)) == 0)
        low = rolled[at] & (~rolled[at] + np.uint64(1))
        ends.append(at + (a + WINDOW))
        bits.append(np.where(low == 0, 64, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64)))
    if not ends:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(ends), np.concatenate(bits)


def fingerprint(data: bytes) -> str:
    """The fingerprint of a text's bytes."""
    # block sizes that are hopelessly small for the length aren't looked at first
    start = max(LEAST, (len(data) // CHUNKS).bit_length() - 3)
    while True:
        ends, bits = _boundaries(data, start)
        if start == LEAST or np.count_nonzero(ends < len(data)) >= CHUNKS:
            break
        start = max(LEAST, start - 4)
    k = start
    while np.count_nonzero((bits >= k) & (ends < len(data))) >= CHUNKS:
        k += 1
    view, out = memoryview(data), []
    for size in range(k, k + SIZES):
        edges = [0, *ends[bits >= size].tolist(), len(data)]
        out.append("".join(LETTERS[zlib.crc32(view[a:b]) & 63] for a, b in zip(edges, edges[1:], strict=False) if a < b))
    return ":".join((str(k), *out))


def likeness(one: Column, two: Column) -> Column:
    """0 to 1 for two columns of fingerprints; null where one is null."""

    def cut(x: Column) -> Column:
        return F.split(x, ":")

    def signature(x: Column, bits: Column) -> Column:
        # past the sizes that x holds there is none
        return F.coalesce(F.try_element_at(cut(x), (bits - cut(x)[0].cast("int") + 2).cast("int")), F.lit(""))

    bits = F.greatest(cut(one)[0].cast("int"), cut(two)[0].cast("int"))
    a, b = signature(one, bits), signature(two, bits)
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    run = F.greatest(F.lit(1), F.least(F.lit(4), (short / 4).cast("int")))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(a) - run + 1))
    common = (short > 0) & F.exists(starts, lambda i: F.contains(b, F.substring(a, i, run)))
    score = 1 - F.levenshtein(a, b) / F.greatest(long, F.lit(1))
    return F.when(one == two, 1.0).when(one.isNotNull() & two.isNotNull(), F.when(common, score).otherwise(0.0))


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """df with the fingerprints of a text column; a null text counts as empty."""
    held_names(df, text)

    @F.pandas_udf("string")
    def of(texts):
        return texts.map(lambda x: fingerprint((x or "").encode()))

    return df.withColumn(out, of(F.coalesce(F.col(text), F.lit(""))))


def edited(text: str, following: str) -> str:
    """text whose last half (rounded down) is the start of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"
_EDGE = "part int, text string, first_text string, first_print string"
_OUT_NAMES = [x.split()[0] for x in _OUT.split(", ")]
_OUT_TYPES = [pa.int64(), pa.int64(), *[pa.string()] * 4]


def _result(doc, text: str, mark: str, following: str, next_mark: str) -> tuple:
    changed = edited(text, following).encode()
    return doc, len(text), hashlib.sha256(changed).hexdigest(), mark, fingerprint(changed), next_mark


def _of_rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their next one; the last row comes out with the first one's text, for the partition before."""
    names, types = [*_OUT_NAMES, "part", "text", "first_text", "first_print"], [*_OUT_TYPES, pa.int32(), *[pa.string()] * 3]
    first = held = None
    for batch in sliced(batches):
        rows = []
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            now = doc, text, fingerprint(text.encode())
            if held:
                rows.append((*_result(*held, now[1], now[2]), None, None, None, None))
            first, held = first or now, now
        yield _of_rows(rows, names, types)
    if held:
        yield _of_rows([(held[0], None, None, held[2], None, None, TaskContext.get().partitionId(), held[1], first[1], first[2])], names, types)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 10):
        rows = zip(*(batch[x].to_pylist() for x in ("doc_id", "text", "fingerprint", "next_text", "next_print")), strict=True)
        yield _of_rows([_result(*x) for x in rows], _OUT_NAMES, _OUT_TYPES)


def edited_prints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document, of its edited text and of the next document, by descending doc_id.

    Texts move once, to ranges of doc_id; a range's last row meets the next range's
    first one in a second, small step: one row for each partition.
    """
    held_names(docs, "doc_id", "text")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("turn", F.xxhash64("text"))
    order = F.col("doc_id").desc_nulls_last(), F.col("turn")
    ranged = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "text")
    done = stored(ranged.mapInArrow(_neighbours, f"{_OUT}, {_EDGE}"), "prints")
    edges = done.filter("part IS NOT NULL")
    parts = sorted(x["part"] for x in edges.select("part").collect())  # one number for each partition
    pairs = spark.createDataFrame([(a, b) for a, b in zip(parts, parts[1:] + parts[:1], strict=True)], "part int, next_part int")
    heads = edges.select(F.col("part").alias("next_part"), F.col("first_text").alias("next_text"), F.col("first_print").alias("next_print"))
    last = edges.select("part", "doc_id", "text", "fingerprint").join(pairs, "part").join(heads, "next_part")
    last = last.select("doc_id", "text", "fingerprint", "next_text", "next_print").mapInArrow(_edges, _OUT)
    return done.filter("part IS NULL").select(*_OUT_NAMES).unionByName(last)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = edited_prints(table(spark, sf_dir, "documents"))
    near = [likeness(F.col("fingerprint"), F.col(x)) for x in ("edited_fingerprint", "next_fingerprint")]
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near[0].alias("near_edited"), near[1].alias("near_next"))
