"""Quality rules: base rules and n-gram perplexity.

The language model is an interpolated modified Kneser-Ney model of order DEPTH over
whole bytes, 0 standing before a text. Nothing is folded or hashed: a gram is its
own key, and the model grows with the grams that the corpus holds.

1. Documents are dealt to chunks of about CHUNK bytes. The distinct grams of a
   chunk and their counts are packed as sorted arrays, one for each shard of grams.
2. Shards add up the counts. Continuation counts, totals of contexts and lower
   orders come from them by grouped aggregation and joins.
3. A shard holds its grams and log probabilities as sorted arrays and answers the
   chunks' arrays; a chunk gets its answers back and scores its texts. The chunks
   are a bucketed table, so answers move and texts don't. No task and no driver
   holds the model.

A document is part of what the model is fitted on, so each gram is scored as if one
occurrence of it weren't there: what occurs once counts as unseen.

A document passes if its log perplexity is within the band of its language:
quartiles of the documents of that language that pass the base rules, widened by
WIDE times their distance on both sides.

Defined cases: a null or empty text has no words and fails the base rules; a null
language is a language of its own; without documents there are no rows; repeated
rows are judged alike, and count as often as they occur.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.common import as_bytes, doc_word_hashes, dropped, grams, held_names, new_path, partitions, remove, stored, table

#: Bytes of a gram of the operator's model.
DEPTH = 5
#: Bytes of text that share their grams, and bytes of text for each shard of the model.
CHUNK, SHARD = 1 << 23, 1 << 24
#: Chosen on labelled rows; the README has what other factors reject.
WIDE = 2.0
MIN_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\v\f\r"


def _discounts_of(c: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2 and 3 or more, from how many grams occur once to four times."""
    c = [max(1, x) for x in c]
    y = c[0] / (c[0] + 2 * c[1])
    d = [0.0] + [k - (k + 1) * y * c[k] / c[k - 1] for k in (1, 2, 3)]
    return np.clip(np.array(d), [0, 0.05, 0.05, 0.05], [0, 0.95, 1.9, 2.85])


def byte_grams(text: bytes) -> np.ndarray:
    """The gram that ends at each byte."""
    codes = np.concatenate([np.zeros(DEPTH - 1, dtype=np.int64), np.frombuffer(text, dtype=np.uint8).astype(np.int64)])
    out = np.zeros(len(text), dtype=np.int64)
    for k in range(DEPTH):
        out = (out << 8) | codes[k : k + len(text)]
    return out


def in_chunks(docs: DataFrame) -> DataFrame:
    """docs with the number of a chunk of about CHUNK bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            own = []
            for text in as_bytes(batch["text"]):
                if size > CHUNK:
                    chunk, size = chunk + 1, 0
                size += len(text)
                own.append(chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], names=["doc_id", "lang", "text", "chunk"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, lang string, text string, chunk long")


def packed_grams(chunks: DataFrame, shards: int) -> DataFrame:
    """shard, chunk, and the sorted distinct grams and their counts as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)

        def out(chunk: int, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            shard = keys % shards
            order = np.argsort(shard, kind="stable")
            ends = np.searchsorted(shard[order], np.arange(shards + 1))
            found = [(s, order[a:b]) for s, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
            packed = [pa.array([squeeze.compress(f(x[at]).tobytes()) for _, at in found], pa.binary()) for f, x in ((_steps, keys), (np.asarray, n))]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int64()), pa.array([chunk] * len(found), pa.int64()), *packed], names=["shard", "chunk", "grams", "counts"])

        now, held = None, []
        for batch in batches:
            for chunk, text in zip(batch["chunk"].to_pylist(), as_bytes(batch["text"]), strict=True):
                if chunk != now and held:
                    yield from out(now, held)
                    held = []
                now = chunk
                if text:
                    held.append(byte_grams(text))
        if held:
            yield from out(now, held)

    return chunks.select("chunk", "text").mapInArrow(run, "shard long, chunk long, grams binary, counts binary")


def _steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences, which pack well."""
    return np.diff(keys, prepend=0)


def _loose(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    loosen = zstandard.ZstdDecompressor()
    return [np.frombuffer(loosen.decompress(x), dtype=kind) for x in column.to_pylist()]


def count_grams(packed: DataFrame) -> DataFrame:
    """gram, n over all documents."""

    def add(rows: pa.Table) -> pa.Table:
        keys = np.concatenate([np.cumsum(x) for x in _loose(rows["grams"], np.int64)])
        out, at = np.unique(keys, return_inverse=True)
        n = np.bincount(at.ravel(), weights=np.concatenate(_loose(rows["counts"], np.int64)))
        return pa.table({"gram": out, "n": n.astype(np.int64)})

    return packed.select("shard", "grams", "counts").groupBy("shard").applyInArrow(add, "gram long, n long")


def _interpolated(level: DataFrame, lower: DataFrame | None, order: int) -> DataFrame:
    """gram, p, and p_less: p if the gram occurred once less."""
    found = {r["n"]: r["k"] for r in level.filter("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()}
    d = [float(x) for x in _discounts_of([found.get(k, 0) for k in range(1, 5)])]
    cut = lambda n: F.when(n >= 3, d[3]).when(n == 2, d[2]).when(n == 1, d[1]).otherwise(0.0)
    n = F.col("n")
    level = level.withColumn("context", F.shiftright("gram", 8))
    totals = level.groupBy("context").agg(F.sum("n").alias("total"), F.sum(cut(n)).alias("rest"))
    level = level.join(totals, "context")
    if lower is None:
        level = level.withColumn("low", F.lit(1 / 256)).withColumn("low_less", F.lit(1 / 256))
    else:
        lower = lower.select(F.col("gram").alias("end"), F.col("p").alias("low"), F.col("p_less").alias("low_less"))
        level = level.withColumn("end", F.col("gram").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))).join(lower, "end")
    p = (n - cut(n) + F.col("rest") * F.col("low")) / F.col("total")
    # the lower order loses a context only where the gram itself goes
    low = F.when(n == 1, F.col("low_less")).otherwise(F.col("low"))
    rest = F.col("rest") - cut(n) + cut(n - 1)
    less = F.when(F.col("total") > 1, (n - 1 - cut(n - 1) + rest * low) / (F.col("total") - 1)).otherwise(low)
    return level.select("gram", p.alias("p"), less.alias("p_less"))


def fit(counts: DataFrame) -> DataFrame:
    """gram, log_p: each gram scored as if it occurred once less."""
    levels = [counts]
    for order in range(DEPTH - 1, 0, -1):
        # lower orders count in how many contexts a gram occurs
        end = levels[0].select(F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1)).alias("gram"))
        levels.insert(0, stored(end.groupBy("gram").agg(F.count("*").alias("n")), f"grams-{order}"))
    lower = None
    for order, level in enumerate(levels, 1):
        lower = stored(_interpolated(level, lower, order), f"model-{order}")
    return lower.select("gram", F.log("p_less").alias("log_p"))


def answers(packed: DataFrame, model: DataFrame, shards: int) -> DataFrame:
    """chunk, its grams, and their log probabilities as arrays."""

    def look_up(shard: pa.Table, rows: pa.Table) -> pa.Table:
        keys, log_p = shard["gram"].to_numpy(), shard["log_p"].to_numpy().astype(np.float32)
        order = np.argsort(keys)
        keys, log_p = keys[order], log_p[order]
        logs = [log_p[np.searchsorted(keys, np.cumsum(x))].tobytes() for x in _loose(rows["grams"], np.int64)]
        return pa.table({"chunk": rows["chunk"], "grams": rows["grams"], "logs": pa.array(logs, pa.binary())})

    model = model.withColumn("shard", F.expr(f"pmod(gram, {shards}L)"))
    asked = packed.select("shard", "chunk", "grams").groupBy("shard")
    return model.groupBy("shard").cogroup(asked).applyInArrow(look_up, "chunk long, grams binary, logs binary")


def base_counts(text: str, h: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = len(text) - sum(map(text.count, _BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line.strip(_BLANKS):
            again += line in seen
            seen.add(line)
    repeated = 0
    if len(h) >= 3:
        _, at, n = np.unique(grams(h, 3), return_inverse=True, return_counts=True)
        many = n[at.ravel()] > 1
        cover = np.zeros(len(h), dtype=bool)
        for k in range(3):
            cover[k : k + len(many)] |= many
        repeated = int(cover.sum())
    return len(h), chars, symbols, again, repeated


_MEASURES = "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"


def bucketed(chunks: DataFrame, n: int) -> tuple[DataFrame, str, str]:
    """chunks in a table of n buckets by chunk, its name and its folder.

    Answers then come to the texts: grouping by chunk shuffles no text.
    """
    spark = chunks.sparkSession
    name, path = f"chunks_{uuid.uuid4().hex}", new_path(spark, "chunks")
    chunks.write.bucketBy(n, "chunk").option("compression", "zstd").option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name), name, path


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts and log_perplexity of each row."""
    held_names(docs, "doc_id", "text", "lang")
    spark = docs.sparkSession
    # shards grow in number with the corpus, so one holds as many grams at any size
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(partitions(spark), -(-size // SHARD)) | 1
    chunks, name, path = bucketed(in_chunks(docs), partitions(spark))
    try:
        return _measured(chunks, shards)
    finally:
        spark.sql(f"DROP TABLE {name}")
        remove(spark, path)


def _measured(chunks: DataFrame, shards: int) -> DataFrame:
    packed = stored(packed_grams(chunks, shards), "packed-grams")
    model = stored(fit(stored(count_grams(packed), f"grams-{DEPTH}")), "model")

    def score(rows: pa.Table, found: pa.Table) -> pa.Table:
        keys = np.concatenate([np.empty(0, np.int64), *map(np.cumsum, _loose(found["grams"], np.int64))])
        log_p = np.concatenate([np.empty(0, np.float32), *(np.frombuffer(x, np.float32) for x in found["logs"].to_pylist())])
        order = np.argsort(keys)
        keys, log_p = keys[order], log_p[order]
        raw = as_bytes(rows["text"])
        logs = [float(-log_p[np.searchsorted(keys, byte_grams(t))].mean(dtype=np.float64)) if t else 0.0 for t in raw]
        counts = [base_counts(t.decode(), h) for t, h in zip(raw, doc_word_hashes(raw), strict=True)]
        columns = list(zip(*counts, strict=True)) or [[]] * len(_MEASURES)
        return pa.Table.from_arrays([rows["doc_id"], rows["lang"], *(pa.array(c, pa.int64()) for c in columns), pa.array(logs, pa.float64())], names=["doc_id", "lang", *_MEASURES, "log_perplexity"])

    shape = "doc_id long, lang string, " + ", ".join(f"{x} long" for x in _MEASURES) + ", log_perplexity double"
    out = stored(chunks.groupBy("chunk").cogroup(answers(packed, model, shards).groupBy("chunk")).applyInArrow(score, shape), "rules")
    dropped(packed, model)
    return out


def judge(docs: DataFrame, wide: float = WIDE) -> DataFrame:
    """The base counts, base_failed, log_perplexity, its band, and kept."""
    rows = measure(docs)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    # exact quartiles of rounded values, counted first: reruns agree, and a language of any size sends few rows
    valued = rows.filter(~F.col("base_failed")).groupBy(F.col("lang").alias("_lang"), F.round("log_perplexity", 3).alias("v")).agg(F.count("*").alias("n"))
    bands = valued.groupBy("_lang").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.75)), F.col("n")).alias("q"))
    low, high = F.col("q")[0], F.col("q")[1]
    slack = F.lit(wide) * F.greatest(high - low, F.lit(0.01))
    bands = stored(bands.select("_lang", (low - slack).alias("band_low"), (high + slack).alias("band_high")), "bands")
    rows = rows.join(bands, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("band_low"), F.col("band_high")), F.lit(False))
    return rows.withColumn("kept", ~F.col("base_failed") & inside)


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *_MEASURES, "base_failed", "kept", F.round("log_perplexity", 6).alias("log_perplexity"))
