"""Token counts of documents in flat, unindexed token files.

A token file is binary and nothing but token ids (two bytes each, low byte first):
each document's tokens, then one end-of-document id. It is read in blocks of fixed
size that know nothing of documents. Every block finds its separators with one
vectorised comparison and reports a summary: tokens before the first separator,
lengths between separators, tokens after the last. A prefix scan over the blocks
of a file, in two levels so that no task holds a whole file, turns summaries into
the number of documents and the open tokens before each block, which completes the
first document of every block.

Tasks write the files to, and read ranges of them from, the folder that driver and
executors share, through pyarrow's file systems (local, HDFS, S3, ...). A file is
named by its attempt, and only the files that a finished task reports count, so a
lost executor leaves at most a file that nobody reads.

Defined cases: an empty or null text is a document of 0 tokens; a document may
span any number of blocks; tokens after the last separator of a file are an
unfinished document and aren't counted; an empty table has no files and gives no
rows; a null doc_id stays null; repeated rows are counted each.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.llm.common import held_names, new_path, partitions, qualified, remove, stored, table

BLOCK_TOKENS = 1 << 19
GROUP = 1024
#: No document's id: the public byte-level vocabulary leaves it free.
END = 50_256


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@lru_cache(maxsize=2)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_flat(docs: DataFrame, folder: str, path: str | None = None) -> DataFrame:
    """Writes one token file for each task; file, first, ids, n_bytes.

    ids are the doc_ids of the file's documents from ordinal `first` on, a side
    table that scanning doesn't see; the last row of a file has its size.
    """
    held_names(docs, "doc_id", "text")
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, root = _opened(folder)
        file, first, size, sink = f"{uuid.uuid4().hex}.bin", 0, 0, None

        def row(ids: list, n: int | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([n], pa.int64())], names=["file", "first", "ids", "n_bytes"])

        try:
            for batch in batches:
                texts, ids = [x or "" for x in batch["text"].to_pylist()], batch["doc_id"].to_pylist()
                for a in range(0, len(texts), 256):
                    sink = sink or own.open_output_stream(f"{root}/{file}")
                    for text in texts[a : a + 256]:
                        size += sink.write(np.array([*encoding(path).encode_ordinary(text), END], dtype="<u2").tobytes())
                    yield row(ids[a : a + 256], None)
                    first += len(ids[a : a + 256])
        finally:
            if sink:
                sink.close()
        if sink:
            yield row([], size)

    own, root = _opened(folder)
    own.create_dir(root, recursive=True)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "file string, first long, ids array<long>, n_bytes long")


def scan(files: DataFrame, folder: str, end: int = END, block: int = BLOCK_TOKENS) -> DataFrame:
    """file, ordinal (of the document in its file) and n_tokens, from files (file, n_bytes)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, root = _opened(folder)
        for batch in batches:
            head, tail, inner = [], [], []
            for file, k, size in zip(*(batch[x].to_pylist() for x in ("file", "block", "n_bytes")), strict=True):
                with own.open_input_file(f"{root}/{file}") as f:
                    tokens = np.frombuffer(f.read_at(min(2 * block, size - 2 * block * k), 2 * block * k), dtype="<u2")
                at = np.flatnonzero(tokens == end)
                head.append(int(at[0]) if len(at) else None)
                tail.append(len(tokens) - int(at[-1]) - 1 if len(at) else len(tokens))
                inner.append(np.diff(at) - 1 if len(at) else [])
            yield pa.RecordBatch.from_arrays([batch["file"], batch["block"], pa.array(head, pa.int64()), pa.array(tail, pa.int64()), pa.array(inner, pa.list_(pa.int64()))], names=["file", "block", "head", "tail", "inner"])

    last = F.floor((F.col("n_bytes") - 1) / (2 * block)).cast("long")
    blocks = files.filter("n_bytes > 0").select("file", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    blocks = blocks.repartition(partitions(files.sparkSession), "file", "block")
    found = stored(blocks.mapInArrow(find, "file string, block long, head long, tail long, inner array<long>"), "separators", 64)
    found = found.withColumn("part", F.floor(F.col("block") / GROUP)).withColumn("ends", F.when(F.col("head").isNull(), 0).otherwise(1 + F.size("inner")).cast("long"))
    # open tokens: tails are summed since the last block that has a separator
    last = F.max(F.when(F.col("head").isNotNull(), F.col("block")))
    parts = found.groupBy("file", "part").agg(F.sum("ends").alias("p_ends"), last.alias("p_last"))
    since = found.join(parts.select("file", "part", "p_last"), ["file", "part"]).filter("p_last IS NULL OR block >= p_last").groupBy("file", "part").agg(F.sum("tail").alias("p_open"))
    parts = parts.join(since, ["file", "part"])

    def before(keys: list[str], order: str):
        return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    whole = before(["file"], "part")
    # a part's open tokens reach back over parts without separators
    parts = parts.withColumn("p_before", F.coalesce(F.sum("p_ends").over(whole), F.lit(0))).withColumn("p_sum", F.coalesce(F.sum("p_open").over(whole), F.lit(0)))
    start = F.max(F.when(F.col("p_last").isNotNull(), F.col("p_sum"))).over(whole)
    parts = parts.select("file", "part", "p_before", (F.col("p_sum") - F.coalesce(start, F.lit(0))).alias("p_carry"))

    within = before(["file", "part"], "block")
    rows = found.withColumn("b_ends", F.coalesce(F.sum("ends").over(within), F.lit(0))).withColumn("b_sum", F.coalesce(F.sum("tail").over(within), F.lit(0)))
    rows = rows.withColumn("b_start", F.max(F.when(F.col("head").isNotNull(), F.col("b_sum"))).over(within))
    rows = rows.join(parts, ["file", "part"]).filter("head IS NOT NULL")
    carry = F.when(F.col("b_start").isNotNull(), F.col("b_sum") - F.col("b_start")).otherwise(F.col("b_sum") + F.col("p_carry"))
    lengths = F.concat(F.array(F.col("head") + carry), F.col("inner"))
    rows = rows.select("file", (F.col("p_before") + F.col("b_ends")).alias("first"), F.posexplode(lengths).alias("k", "n_tokens"))
    return rows.select("file", (F.col("first") + F.col("k")).alias("ordinal"), "n_tokens")


def token_counts(docs: DataFrame, path: str | None = None, block: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id and n_tokens of each row, scanned out of flat token files."""
    spark = docs.sparkSession
    folder = qualified(spark, new_path(spark, "token-files"))
    written = stored(write_flat(docs, folder, path), "written")
    names = written.select("file", "first", F.posexplode("ids").alias("k", "doc_id"))
    counts = scan(written.filter("n_bytes IS NOT NULL").select("file", "n_bytes"), folder, block=block)
    remove(spark, folder)  # what the scan found is stored
    # one row a document on both sides: never to be broadcast, however small the ids' file looks
    return names.select("file", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id").hint("merge").join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
