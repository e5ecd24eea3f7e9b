"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words: space and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True

STEP = np.uint64(0x9E3779B97F4A7C15)
GRAM = np.uint64(0xD6E8FEB86659FD93)
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes hashed at once; longer inputs are cut between words.
PIECE = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a local master gets a temporary one; a cluster has to name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/claimloom/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme that Spark would take, for readers other than Spark."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return out.replace("file:/", "file:///", 1) if out.startswith("file:/") and not out.startswith("file://") else out


def stored(df: DataFrame, name: str, batch_rows: int = 1000) -> DataFrame:
    """df written as Parquet to the shared folder and read again.

    Cuts the lineage: a lost executor costs no more than its own reads. Python
    tasks get batch_rows rows at a time, so that wide rows need little memory;
    the session's own setting is back after the write.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, batch_rows)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(BATCH, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders of the shared folder."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of stored() that nothing reads any more."""
    for x in tables:
        remove(x.sparkSession, x.stored_at)


def free_name(name: str, *taken: str) -> str:
    """name, with underscores before it where a column (case aside) has it."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on uint64 after which all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of words that are mixed in lanes of 8; longer words have a keyed BLAKE2b digest.
LANED = 32
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _hash_piece(codes: np.ndarray, seed: int) -> np.ndarray:
    blank = BLANK[codes]
    edge = np.diff(np.r_[True, blank, True].astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    size = ends - starts
    out = mix64(size.astype(np.uint64) + np.uint64(seed) * STEP)
    lanes = np.lib.stride_tricks.sliding_window_view(np.r_[codes, np.zeros(8, dtype=np.uint8)], 8)
    for at in range(0, LANED, 8):
        own = np.flatnonzero(size > at)
        if not len(own):
            break
        lane = np.ascontiguousarray(lanes[starts[own] + at]).view("<u8")[:, 0] & _LOW[np.minimum(size[own] - at, 8)]
        out[own] = mix64(out[own] ^ lane)
    for i in np.flatnonzero(size > LANED).tolist():
        word = codes[starts[i] : ends[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=seed.to_bytes(8)).digest())
    return out


def word_hashes(text: bytes, seed: int = 1) -> np.ndarray:
    """One uint64 for each word of text, equal for equal words; another family for another seed.

    Different words of one length up to 8 bytes never share a hash. Other words do
    with a chance of 2^-64 for each pair, and independently so for each seed.
    """
    codes = np.frombuffer(text, dtype=np.uint8)
    if len(codes) <= PIECE:
        return _hash_piece(codes, seed)
    out, at = [], 0
    while at < len(codes):
        end = min(at + PIECE, len(codes))
        if end < len(codes):
            rest = BLANK[codes[end:]]
            end += int(rest.argmax()) if rest.any() else len(rest)
        out.append(_hash_piece(codes[at:end], seed))
        at = end
    return np.concatenate(out)


def doc_word_hashes(texts: list[bytes], seed: int = 1) -> Iterator[np.ndarray]:
    """word_hashes of each text, worked out for many short texts at once."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < PIECE):
            size += len(texts[end]) + 1
            end += 1
        part = texts[at:end]
        if len(part) == 1:
            yield word_hashes(part[0], seed)
        else:
            buffer = b"\n".join(part)
            codes = np.frombuffer(buffer, dtype=np.uint8)
            blank = BLANK[codes]
            first = ~blank
            first[1:] &= blank[:-1]
            hashes = _hash_piece(codes, seed)
            ends = np.cumsum([len(x) + 1 for x in part])
            cut = np.searchsorted(np.flatnonzero(first), ends)
            begin = 0
            for stop in cut:
                yield hashes[begin:stop]
                begin = stop
        at = end


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A uint64 for each run of n neighbours in h, by doubling."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    power, have, out, done, rest = GRAM, h, None, 0, n
    size = len(h) - n + 1
    while rest:
        if rest & 1:
            part = have[done : done + size]
            out = part.copy() if out is None else out * power + part
            done += len(h) - len(have) + 1
        rest >>= 1
        if rest:
            span = len(h) - len(have) + 1
            have = have[:-span] * power + have[span:]
            power = np.uint64(int(power) ** 2 % 2**64)
    return mix64(out)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    """The same rows, so few at a time that Python copies of their texts stay small."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def crc_mod(column: str, n: int):
    """crc32 of the column's text modulo n; null like an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def held_names(df: DataFrame, *names: str) -> None:
    """Fail early, and by name, where a needed column is missing."""
    missing = [x for x in names if x not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
