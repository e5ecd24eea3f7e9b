"""Phrase collocations mined with stripes.

Frequent phrases grow word by word, each language by itself. A phrase of k words that
occurs LEAST times has a prefix and a suffix of k - 1 words that do, so level k only
looks at places where frequent phrases of k - 1 words start at two neighbouring
words. All counts are exact.

1. Tasks cut texts into chunks of about CHUNK bytes of one language. A chunk is one
   row: its text as numbers of its own list of different words, -1 between pieces.
2. A chunk sends its stripes: for each prefix an associative counter of next words,
   here named by the frequent suffix (prefix without its first word + next word),
   with an entry -1 for all other ends, so that a stripe's sum is the prefix's count.
   For the empty prefix the stripe is the chunk's word counts.
3. Stripes of a prefix are merged elementwise. One merged stripe gives the extensions
   (entries of LEAST and more), the prefix's total and its largest extension, which
   decides whether the prefix is subsumed to the right. The stripe of a prefix with
   more than STRIPE occurrences is cut by next word into as many parts as that takes,
   and stripes are dealt to shards of about SHARD entries, so no task holds more than
   a shard whatever the corpus or the prefix.
4. The merging task names each frequent phrase and answers each chunk with the names
   of its own entries. The chunk rewrites its numbers, which are shorter every level.

Scores and subsumption are columns over the frequent phrases.

Defined cases: a null text counts as empty; a null language is `und`; a language
without phrases of LEAST occurrences has no rows; repeated rows count as often as
they occur; a long text is cut between pieces, and only a single piece can make a
chunk longer; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.llm.common import as_bytes, dropped, held_names, mix64, partitions, signed, sliced, stored, table, word_hashes

#: Words of the longest phrase, occurrences of a candidate, percent of a phrase's occurrences that subsume it, rows of a language.
LONGEST, LEAST, SUBSUMED, KEPT = 4, 30, 80, 2000
#: Bytes of a chunk, entries of a shard, occurrences of a part of a stripe.
CHUNK, SHARD, STRIPE = 1 << 23, 1 << 20, 1 << 20

_BREAKS = b",;:!?\n\x0b\x0c\r"
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x2E if c in _BREAKS else 0x20 if c == 9 else c for c in range(256))
_PART = np.uint64(0x9E6C63D0876A68DF)


def _rows(shape: str, **columns) -> pa.RecordBatch:
    """A batch of the columns that shape (a schema in SQL) names."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    names = [x.split() for x in shape.split(", ")]
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[t]) if n in columns else pa.nulls(size, kinds[t]) for n, t in names], names=[n for n, _ in names])


def _dense(tokens: np.ndarray) -> np.ndarray:
    """tokens with one -1 where there were several."""
    gap = tokens < 0
    return tokens[~(gap & np.r_[True, gap[:-1]])] if len(tokens) else tokens


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards (a power of two) by the top bits, so that what is sorted by hash is sorted by shard."""
    return (hashes >> np.uint64(65 - shards.bit_length())).astype(np.int64) if shards > 1 else np.zeros(len(hashes), dtype=np.int64)


def _spans(starts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Where parts that begin at starts begin and end, none without starts."""
    return list(zip(starts.tolist(), np.r_[starts, size][1:].tolist(), strict=True))


def _lines(blobs: list[bytes]) -> pa.Array:
    joined = b"\n".join(x for x in blobs if x)
    return pc.split_pattern(pa.array([joined], pa.large_binary()).cast(pa.large_string()), "\n").flatten() if joined else pa.array([], pa.large_string())


# ---- level 1: words

_WORDS = "chunk long, lang string, n_words long, n_entries long, tokens binary, words binary, counts binary"


def _pieces(data: bytes) -> Iterator[bytes]:
    """A folded text in parts of CHUNK bytes, cut at its breaks."""
    while len(data) > CHUNK:
        cut = data.rfind(b".", 0, CHUNK)
        cut = cut if cut >= 0 else data.find(b".", CHUNK)
        if cut < 0:
            break
        yield data[: cut + 1]
        data = data[cut + 1 :]
    yield data


def _word_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, made = TaskContext.get().partitionId() << 32, 0
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def out(lang: str) -> pa.RecordBatch:
        nonlocal made
        # a break can't be in a word, so it stands for itself
        data = b".".join((*held.pop(lang), b"")).replace(b".", b" . ")
        sizes.pop(lang)
        words = pc.ascii_split_whitespace(pa.array([data], pa.large_binary()).cast(pa.large_string())).flatten()
        del data
        coded = words.filter(pc.not_equal(words, "")).dictionary_encode()
        names, codes = coded.dictionary, np.asarray(coded.indices)
        del words, coded
        real = np.flatnonzero(~np.asarray(pc.equal(names, "."))) if len(names) else np.empty(0, dtype=np.int64)
        hashes = word_hashes(b"\n".join(x.encode() for x in names.take(pa.array(real)).to_pylist()))
        order = np.argsort(hashes, kind="stable")
        real = real[order]
        number = np.full(len(names), -1, dtype=np.int32)
        number[real] = np.arange(len(real))
        tokens = number[codes]
        counts = np.bincount(tokens[tokens >= 0], minlength=len(real)).astype(np.int32)
        blob = b"\n".join(x.encode() for x in names.take(pa.array(real)).to_pylist())
        made += 1
        return _rows(_WORDS, chunk=[task + made], lang=[lang], n_words=[int(counts.sum())], n_entries=[len(real)], tokens=[_dense(tokens).tobytes()], words=[blob], counts=[counts.tobytes()])

    for batch in sliced(batches):
        for lang, text in zip(batch["lang"].to_pylist(), as_bytes(batch["text"]), strict=True):
            for part in _pieces(text.translate(_FOLD)):
                held.setdefault(lang, []).append(part)
                sizes[lang] = sizes.get(lang, 0) + len(part)
                if sizes[lang] >= CHUNK:
                    yield out(lang)
            if sum(sizes.values()) >= 3 * CHUNK or len(sizes) > 1000:
                for x in list(held):
                    yield out(x)
    for x in list(held):
        yield out(x)


_DEALT_WORDS = "lang string, shard long, chunk long, start int, words binary, counts binary"


def _deal_words(shards: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            row = batch.to_pylist()[0]
            blob, counts = row["words"], np.frombuffer(row["counts"], dtype=np.int32)
            shard = _shard(word_hashes(blob), shards)
            own, first = np.unique(shard, return_index=True)
            ends = np.r_[np.flatnonzero(np.frombuffer(blob, dtype=np.uint8) == 10), len(blob)]
            begins = np.r_[0, ends[:-1] + 1]
            cut = _spans(first, len(shard))
            yield _rows(
                _DEALT_WORDS, lang=[row["lang"]] * len(own), shard=own, chunk=[row["chunk"]] * len(own), start=first.astype(np.int32),
                words=[blob[begins[a] : ends[b - 1]] for a, b in cut], counts=[counts[a:b].tobytes() for a, b in cut],
            )

    return deal


#: Rows of a merge: a phrase (id, first, second or word), a prefix's sum (first), or an answer to a chunk.
_MERGED = "kind string, id long, lang string, word string, first long, second long, n long, largest long, chunk long, at binary, ids binary, parts binary"


def _answers(chunk: np.ndarray, at: np.ndarray, ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """For each chunk its entries that are frequent, their names, and the parts of their own stripes."""
    order = np.lexsort((at, chunk))
    chunk, at, ids, n = chunk[order], at[order], ids[order], n[order]
    own, first = np.unique(chunk, return_index=True)
    parts = (-(-n // STRIPE)).astype(np.int32)
    cut = _spans(first, len(chunk))
    return _rows(
        _MERGED, kind=["answer"] * len(own), chunk=own, at=[at[a:b].astype(np.int32).tobytes() for a, b in cut],
        ids=[ids[a:b].astype(np.int64).tobytes() for a, b in cut], parts=[parts[a:b].tobytes() for a, b in cut],
    )


def _by_shard(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The rows of each shard, which follow each other."""
    wait: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        key = list(zip(*(batch[x].to_pylist() for x in keys), strict=True))
        a = 0
        for b in range(1, len(key) + 1):
            if b == len(key) or key[b] != key[a]:
                if wait and key[a] != now:
                    yield pa.Table.from_batches(wait)
                    wait = []
                now = key[a]
                wait.append(batch.slice(a, b - a))
                a = b
    if wait:
        yield pa.Table.from_batches(wait)


def _merge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name = TaskContext.get().partitionId() << 40
    for rows in _by_shard(batches, "lang", "shard"):
        counts = [np.frombuffer(x, dtype=np.int32) for x in rows["counts"].to_pylist()]
        coded = _lines(rows["words"].to_pylist()).dictionary_encode()
        codes, sizes = np.asarray(coded.indices), np.array([len(x) for x in counts])
        n = np.zeros(len(coded.dictionary), dtype=np.int64)
        np.add.at(n, codes, np.concatenate(counts))
        frequent = np.flatnonzero(n >= LEAST)
        if not len(frequent):
            continue
        ids = np.full(len(n), -1, dtype=np.int64)
        ids[frequent] = np.arange(name, name + len(frequent))
        name += len(frequent)
        lang = rows["lang"][0].as_py()
        yield _rows(_MERGED, kind=["phrase"] * len(frequent), id=ids[frequent], lang=[lang] * len(frequent), word=coded.dictionary.take(pa.array(frequent)).cast(pa.string()), n=n[frequent])
        own = np.flatnonzero(ids[codes] >= 0)
        at = np.repeat(np.asarray(rows["start"]), sizes) + np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        yield _answers(np.repeat(np.asarray(rows["chunk"]), sizes)[own], at[own], ids[codes[own]], n[codes[own]])


# ---- levels above: stripes of prefixes

#: A chunk's tokens, or the stripes that it sends to a shard: prefixes, how many entries each has, and the entries.
_LEVEL = "chunk long, tokens binary, shard long, start int, firsts binary, sizes binary, seconds binary, counts binary"


def _stripes(chunk: int, tokens: np.ndarray, ids: np.ndarray, parts: np.ndarray, shards: int) -> pa.RecordBatch:
    """A chunk's stripes from the names (-1: none) of its entries; its tokens are then entries of those."""
    name = np.r_[ids, -1][tokens]  # token -1 takes the last
    left, right = name[:-1], name[1:]
    at = np.flatnonzero(left >= 0)
    used, first = np.unique(left[at], return_inverse=True)
    others, second = np.unique(right[at], return_inverse=True)
    entry, inverse, counts = np.unique(first * max(len(others), 1) + second, return_inverse=True, return_counts=True)
    first, second = entry // max(len(others), 1), others[entry % max(len(others), 1)]
    named = np.flatnonzero(ids >= 0)
    named = named[np.argsort(ids[named])]
    many = parts[named[np.searchsorted(ids[named], used)]].astype(np.uint64)[first]
    part = np.where(second >= 0, mix64(second.astype(np.uint64)) % many, np.uint64(0))
    first = used[first]
    hashes = mix64(first.view(np.uint64) + mix64(part) * _PART)
    order = np.lexsort((second, part, first, hashes))
    number = np.empty(len(order), dtype=np.int32)
    number[order] = np.arange(len(order))
    now = np.full(len(tokens), -1, dtype=np.int32)
    real = right[at] >= 0
    now[at[real]] = number[inverse[real]]
    first, part, second, counts, shard = first[order], part[order], second[order], counts[order].astype(np.int32), _shard(hashes[order], shards)
    own, start = np.unique(shard, return_index=True)
    cut = _spans(start, len(order))
    head = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (part[1:] != part[:-1])]) if len(first) else np.empty(0, dtype=np.int64)
    size = np.diff(np.r_[head, len(order)]).astype(np.int32)
    low, high = np.searchsorted(head, start), np.searchsorted(head, [b for _, b in cut])
    span = list(zip(low.tolist(), high.tolist(), strict=True))
    return _rows(
        _LEVEL, chunk=[chunk] * (1 + len(own)), tokens=[_dense(now).tobytes(), *[None] * len(own)], shard=[None, *own.tolist()], start=[None, *start.tolist()],
        firsts=[None, *(first[head[a:b]].tobytes() for a, b in span)], sizes=[None, *(size[a:b].tobytes() for a, b in span)],
        seconds=[None, *(second[a:b].tobytes() for a, b in cut)], counts=[None, *(counts[a:b].tobytes() for a, b in cut)],
    )


def _next_level(shards: int):
    """Chunks, each followed by its answers, as chunks and stripes of the next level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, tokens, ids, parts = None, None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["tokens"] is not None:
                    if chunk is not None:
                        yield _stripes(chunk, tokens, ids, parts, shards)
                    chunk, tokens = row["chunk"], np.frombuffer(row["tokens"], dtype=np.int32)
                    size = int(tokens.max(initial=-1)) + 1
                    ids, parts = np.full(size, -1, dtype=np.int64), np.ones(size, dtype=np.int32)
                else:
                    at = np.frombuffer(row["at"], dtype=np.int32)
                    ids[at], parts[at] = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["parts"], dtype=np.int32)
        if chunk is not None:
            yield _stripes(chunk, tokens, ids, parts, shards)

    return run


def _merge_stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name = TaskContext.get().partitionId() << 40
    for rows in _by_shard(batches, "shard"):
        size, second, counts = (np.concatenate([np.frombuffer(x, dtype=t) for x in rows[c].to_pylist()]) for c, t in (("sizes", np.int32), ("seconds", np.int64), ("counts", np.int32)))
        first = np.repeat(np.concatenate([np.frombuffer(x, dtype=np.int64) for x in rows["firsts"].to_pylist()]), size)
        length = np.array([len(x) // 8 for x in rows["seconds"].to_pylist()])
        prefixes, p = np.unique(first, return_inverse=True)
        others, q = np.unique(second, return_inverse=True)
        entry, inverse = np.unique(p * len(others) + q, return_inverse=True)
        n = np.zeros(len(entry), dtype=np.int64)
        np.add.at(n, inverse, counts)
        p, second = entry // len(others), others[entry % len(others)]
        total, largest = np.zeros(len(prefixes), dtype=np.int64), np.zeros(len(prefixes), dtype=np.int64)
        np.add.at(total, p, n)
        frequent = np.flatnonzero((n >= LEAST) & (second >= 0))
        np.maximum.at(largest, p[frequent], n[frequent])
        yield _rows(_MERGED, kind=["prefix"] * len(prefixes), first=prefixes, n=total, largest=largest)
        if not len(frequent):
            continue
        ids = np.full(len(n), -1, dtype=np.int64)
        ids[frequent] = np.arange(name, name + len(frequent))
        name += len(frequent)
        yield _rows(_MERGED, kind=["phrase"] * len(frequent), id=ids[frequent], first=prefixes[p[frequent]], second=second[frequent], n=n[frequent])
        own = np.flatnonzero(ids[inverse] >= 0)
        at = np.repeat(np.asarray(rows["start"]), length) + np.arange(len(inverse)) - np.repeat(np.cumsum(length) - length, length)
        yield _answers(np.repeat(np.asarray(rows["chunk"]), length)[own], at[own], ids[inverse[own]], n[inverse[own]])


def _power(n: int) -> int:
    return 1 << max(0, int(n) - 1).bit_length()


def _grown(phrases: DataFrame, shorter: DataFrame) -> DataFrame:
    """Phrases (id, first, second, n) with their words and the counts of their parts, from those of one word less."""
    left = shorter.select(F.col("id").alias("first"), "lang", F.col("phrase").alias("start"), "heads")
    right = shorter.select(F.col("id").alias("second"), "last", "tails")
    out = phrases.join(left, "first").join(right, "second")
    return out.select("id", "first", "second", "lang", F.concat_ws(" ", "start", "last").alias("phrase"), "last", F.array_append("heads", F.col("n")).alias("heads"), F.array_append("tails", F.col("n")).alias("tails"), "n")


def frequent_phrases(docs: DataFrame) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """Words of each language (lang, n), and for each length the frequent phrases and the sums of their stripes.

    Phrases: id, first and second (ids of prefix and suffix), lang, phrase, n, and
    the counts of their starts (heads) and ends (tails) by length. Sums: first, total
    and largest extension, from the stripes of those phrases.
    """
    held_names(docs, "lang", "text")
    spark = docs.sparkSession
    tasks = partitions(spark)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    chunks = stored(rows.mapInArrow(_word_chunks, _WORDS), "word-chunks")
    totals = stored(chunks.groupBy("lang").agg(F.sum("n_words").alias("n")), "lang-words")
    shards = _power(max(tasks, -(-(chunks.agg(F.sum("n_entries")).first()[0] or 0) // SHARD)))
    dealt = chunks.select("chunk", "lang", "words", "counts").mapInArrow(_deal_words(shards), _DEALT_WORDS)
    merged = stored(dealt.repartition(tasks, "lang", "shard").sortWithinPartitions("lang", "shard").mapInArrow(_merge_words, _MERGED), "words", 64)
    words = merged.filter("kind = 'phrase'").select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("n").alias("heads"), F.array("n").alias("tails"), "n")
    levels, sums = [words], []
    for _ in range(2, LONGEST + 1):
        held = merged.filter("kind = 'phrase'").agg(F.sum("n")).first()[0] or 0
        shards = _power(max(tasks, -(-held // SHARD)))
        answers = merged.filter("kind = 'answer'").select("chunk", F.lit(None).cast("binary").alias("tokens"), "at", "ids", "parts")
        tokens = chunks.filter("tokens IS NOT NULL").select("chunk", "tokens", *(F.lit(None).cast("binary").alias(x) for x in ("at", "ids", "parts")))
        both = tokens.union(answers).repartition(tasks, "chunk").sortWithinPartitions("chunk", F.col("tokens").isNull())
        after = stored(both.mapInArrow(_next_level(shards), _LEVEL), "stripes", 64)
        dropped(chunks)
        chunks = after
        stripes = chunks.filter("shard IS NOT NULL").drop("tokens")
        merged = stored(stripes.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(_merge_stripes, _MERGED), "merged", 64)
        # the parts of a stripe add up
        sums.append(merged.filter("kind = 'prefix'").groupBy("first").agg(F.sum("n").alias("total"), F.max("largest").alias("largest")))
        levels.append(stored(_grown(merged.filter("kind = 'phrase'").select("id", "first", "second", "n"), levels[-1]), "phrases"))
    dropped(chunks)
    return totals, levels, sums


#: The lowest-scoring cut after j words, exact beyond 64 bits; ties go to the smallest j.
_CUT = """array_min(transform(sequence(1, size(heads) - 1), j -> struct(
  CAST((CAST(n AS DECIMAL(20, 0)) * 2000000) div (CAST(heads[j - 1] AS DECIMAL(20, 0)) + tails[size(heads) - j - 1]) AS BIGINT) AS score,
  j AS cut, heads[j - 1] AS l, tails[size(heads) - j - 1] AS r)))"""


def collocations(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two words and more."""
    totals, levels, sums = frequent_phrases(docs)
    out = None
    for k in range(1, LONGEST):
        found = levels[k]
        if k + 1 < LONGEST:
            # a longer phrase that subsumes one by two words has a part that does so by one
            before = levels[k + 1].groupBy("second").agg(F.max("n").alias("before"))
            found = found.join(sums[k].select(F.col("first").alias("id"), F.col("largest").alias("after")), "id", "left")
            found = found.join(before.select(F.col("second").alias("id"), "before"), "id", "left")
            found = found.filter(100 * F.greatest(F.coalesce("before", F.lit(0)), F.coalesce("after", F.lit(0))) < SUBSUMED * F.col("n"))
        found = found.select("lang", "phrase", F.col("n").alias("a"), F.expr(_CUT).alias("cut"))
        out = found if out is None else out.union(found)
    out = out.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    # Spark cuts each task's rows to KEPT a language before they move
    best = out.withColumn("rank", rank).filter(F.col("rank") <= KEPT)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
w AS (SELECT d, lang, generate_subscripts(pieces, 1) AS p, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS ws FROM p),
i AS (SELECT d, lang, p, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
t AS (
  SELECT lang, w AS w1, lead(w, 1) OVER piece AS w2, lead(w, 2) OVER piece AS w3, lead(w, 3) OVER piece AS w4
  FROM i WINDOW piece AS (PARTITION BY d, p ORDER BY i)),
g AS (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, 1 AS k, w1 AS phrase FROM t
    UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM t WHERE w2 IS NOT NULL
    UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM t WHERE w3 IS NOT NULL
    UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM t WHERE w4 IS NOT NULL)
  GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
f AS MATERIALIZED (SELECT * FROM g WHERE f >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cut AS (SELECT lang, k, phrase, a, j, array_to_string(ws[1:j], ' ') AS x, array_to_string(ws[j + 1:k], ' ') AS y FROM c, unnest(range(1, k)) AS u(j)),
scored AS (
  SELECT cut.lang, cut.phrase, a, j, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.x JOIN f y ON y.lang = cut.lang AND y.phrase = cut.y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
sub AS (
  SELECT DISTINCT s.lang, s.phrase FROM c s JOIN c t
  ON s.lang = t.lang AND t.k > s.k AND 100 * t.a >= 80 * s.a AND contains(' ' || t.phrase || ' ', ' ' || s.phrase || ' '))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best ANTI JOIN sub USING (lang, phrase) JOIN n USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
