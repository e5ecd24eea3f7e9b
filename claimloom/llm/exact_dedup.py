"""Exact deduplication over a cuckoo-filter index of live digests.

Each document becomes a SHA-256 digest in the JVM. Tasks first fold the digests
of their own rows, so that a text with any number of copies sends one entry for
each task and a third of all rows under one text is no hot group. The entries
are dealt by digest to index shards of bounded size. A shard is a cuckoo filter (16-bit
fingerprints, four slots a bucket) whose slots point at stored digests: a
fingerprint hit is verified against the stored digest, a miss is inserted, and
an overflow doubles the filter and rebuilds it from the stored digests. SHA-256
stands for the text's content: no two texts with one digest are known.

Defined cases: a null text counts as empty; empty texts equal each other; rows
that repeat a doc_id and its text are copies, of which one stays; a null doc_id
is smaller than any other; an empty table gives no rows; further columns are
carried by `drop_copies` and ignored by `copy_groups`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.llm.common import free_name, held_names, mix64, partitions, stored, table

SLOTS = 4
KICKS = 200
#: Entries that a task folds before it sends them on, and entries of a shard.
FOLDED, SHARD = 1 << 18, 1 << 20
#: A group of more than a HOT-th of all rows is broadcast, not shuffled.
HOT = 1024
LOWEST = np.iinfo(np.int64).min


class CuckooIndex:
    """Digests (rows of four uint64) with insertion, lookup and deletion."""

    def __init__(self, buckets: int = 1 << 10):
        self.keys = np.empty((0, 4), dtype=np.uint64)
        self.live = np.empty(0, dtype=bool)
        self.used = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = np.uint64(buckets - 1)
        self.prints = np.zeros((buckets, SLOTS), dtype=np.uint16)
        self.entry = np.zeros((buckets, SLOTS), dtype=np.int64)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint (never 0) and both buckets of each digest."""
        mark = (keys[:, 1] & np.uint64(0xFFFF)) | np.uint64(keys.shape[0] == 0)
        mark = np.where(mark == 0, np.uint64(1), mark)
        one = mix64(keys[:, 0]) & self.mask
        return mark.astype(np.uint16), one, one ^ (mix64(mark) & self.mask)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each digest, -1 where it isn't in the index."""
        mark, one, two = self._places(keys)
        found = np.full(len(keys), -1, dtype=np.int64)
        for bucket in (one, two):
            for slot in range(SLOTS):
                hit = np.flatnonzero(self.prints[bucket, slot] == mark)
                at = self.entry[bucket[hit], slot]
                same = (self.keys[at] == keys[hit]).all(axis=1)
                found[hit[same]] = at[same]
        return found

    def insert(self, keys: np.ndarray) -> np.ndarray:
        """Entries of digests that are distinct and not in the index yet."""
        first = self.used
        while first + len(keys) > len(self.keys):
            room = max(1 << 10, len(self.keys))
            self.keys = np.concatenate([self.keys, np.zeros((room, 4), dtype=np.uint64)])
            self.live = np.concatenate([self.live, np.zeros(room, dtype=bool)])
        new = np.arange(first, first + len(keys))
        self.keys[new], self.live[new] = keys, True
        self.used += len(keys)
        if self.used > 0.85 * self.prints.size or not self._place(new):
            self._resize()
        return new

    def _resize(self) -> None:
        """Twice the buckets, filled from the stored live digests."""
        buckets = len(self.prints)
        while True:
            buckets *= 2
            self._clear(buckets)
            entries = np.flatnonzero(self.live[: self.used])
            if len(entries) <= 0.85 * self.prints.size and self._place(entries):
                return

    def _place(self, entries: np.ndarray) -> bool:
        mark, one, two = self._places(self.keys[entries])
        wait = np.arange(len(entries))
        for bucket in (one, two, one, two):
            free = self.prints[bucket[wait]] == 0
            has = np.flatnonzero(free.any(axis=1))
            if not len(has):
                continue
            # of those that want one bucket, the first goes in
            _, head = np.unique(bucket[wait[has]], return_index=True)
            row = has[head]
            slot = free[row].argmax(axis=1)
            own = wait[row]
            self.prints[bucket[own], slot] = mark[own]
            self.entry[bucket[own], slot] = entries[own]
            wait = np.delete(wait, row)
        return all(self._kick(int(entries[i]), mark[i], int(one[i])) for i in wait)

    def _kick(self, entry: int, mark: np.uint16, bucket: int) -> bool:
        for turn in range(KICKS):
            for _ in range(2):
                free = np.flatnonzero(self.prints[bucket] == 0)
                if len(free):
                    self.prints[bucket, free[0]], self.entry[bucket, free[0]] = mark, entry
                    return True
                bucket ^= int(mix64(np.array([mark], dtype=np.uint64))[0] & self.mask)
            slot = turn % SLOTS
            out = self.prints[bucket, slot], int(self.entry[bucket, slot])
            self.prints[bucket, slot], self.entry[bucket, slot] = mark, entry
            mark, entry = out
            bucket ^= int(mix64(np.array([mark], dtype=np.uint64))[0] & self.mask)
        return False

    def delete(self, keys: np.ndarray) -> np.ndarray:
        """Takes digests out; tells which of them were in the index."""
        mark, one, two = self._places(keys)
        found = self.find(keys)
        for i in np.flatnonzero(found >= 0):
            for bucket in (one[i], two[i]):
                slot = np.flatnonzero((self.prints[bucket] == mark[i]) & (self.entry[bucket] == found[i]))
                if len(slot):
                    self.prints[bucket, slot[0]] = 0
                    break
            self.live[found[i]] = False
        return found >= 0


def _digests(column) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype=">u8").astype(np.uint64).reshape(-1, 4)


def _later(doc, row: int, old: tuple) -> bool:
    """Whether (doc, row) is larger; a null doc_id is smaller than any other."""
    return (doc is not None, doc or 0, row) > (old[0] is not None, old[0] or 0, old[1])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One (digest, largest doc_id and row, rows) for each digest of a task, near enough."""
    held: dict[bytes, tuple] = {}

    def out() -> pa.RecordBatch:
        rows = [(k, *v) for k, v in held.items()]
        held.clear()
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=_NAMES)

    for batch in batches:
        for digest, doc, row, n in zip(*(batch[x].to_pylist() for x in _NAMES), strict=True):
            old = held.get(digest)
            if old is None:
                held[digest] = doc, row, n
            else:
                held[digest] = (doc, row, n + old[2]) if _later(doc, row, old) else (*old[:2], n + old[2])
        if len(held) >= FOLDED:
            yield out()
    yield out()


class _Shard:
    """A cuckoo index, and for each of its entries what stays and how many rows there are."""

    def __init__(self) -> None:
        self.index = CuckooIndex()
        self.keep, self.row, self.size = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, batch: pa.RecordBatch) -> None:
        keys, inverse = np.unique(_digests(batch["digest"]), axis=0, return_inverse=True)
        at = self.index.find(keys)
        if (new := np.flatnonzero(at < 0)).size:
            at[new] = self.index.insert(keys[new])
            more = self.index.used - len(self.keep)
            self.keep, self.row = (np.concatenate([x, np.full(more, LOWEST)]) for x in (self.keep, self.row))
            self.size = np.concatenate([self.size, np.zeros(more, dtype=np.int64)])
        at = at[inverse.ravel()]
        doc, row = np.asarray(batch["keep_id"].fill_null(LOWEST)), np.asarray(batch["keep_row"])
        np.add.at(self.size, at, np.asarray(batch["group_size"]))
        order = np.lexsort((row, doc, at))
        last = order[np.r_[at[order][1:] != at[order][:-1], True]]
        at, doc, row = at[last], doc[last], row[last]
        wins = (doc > self.keep[at]) | ((doc == self.keep[at]) & (row > self.row[at]))
        self.keep[at[wins]], self.row[at[wins]] = doc[wins], row[wins]

    def rows(self) -> Iterator[pa.RecordBatch]:
        for a in range(0, self.index.used, 10_000):
            b = min(a + 10_000, self.index.used)
            raw = self.index.keys[a:b].astype(">u8").tobytes()
            ids = self.keep[a:b]
            yield pa.RecordBatch.from_arrays([pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary()), pa.array(ids, mask=ids == LOWEST), pa.array(self.row[a:b]), pa.array(self.size[a:b])], names=_NAMES)


def _index_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds entries, sorted by shard, by digest: one cuckoo index at a time."""
    now, shard = None, _Shard()
    for batch in batches:
        ids = np.asarray(batch["shard"])
        edges = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if ids[a] != now:
                yield from shard.rows()
                now, shard = ids[a], _Shard()
            shard.add(batch.slice(a, b - a))
    yield from shard.rows()


_NAMES = ["digest", "keep_id", "keep_row", "group_size"]
_ENTRY = "digest binary, keep_id long, keep_row long, group_size long"


def text_digest() -> F.Column:
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def live_groups(digests: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_row, group_size) from rows of (doc_id, row, digest).

    Digests are dealt to shards of about SHARD entries each, however many there
    are; a task goes through its shards one by one.
    """
    spark = digests.sparkSession
    rows = digests.select("digest", F.col("doc_id").cast("long").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"))
    folded = stored(rows.mapInArrow(_fold, _ENTRY), "folded")
    shards = max(partitions(spark), -(-folded.count() // SHARD))
    dealt = folded.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))
    dealt = dealt.repartition(min(shards, 20 * partitions(spark)), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(_index_shards, _ENTRY)


def update_index(index: DataFrame, inserted: DataFrame, deleted: DataFrame) -> DataFrame:
    """The live digests after a batch of insertions, then deletions.

    index, inserted and deleted have a column digest (32 bytes). A digest that
    is inserted twice is live once; deleting one that isn't live does nothing.
    """

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuckoo = CuckooIndex()
        gone = []
        for batch in batches:
            keys, kind = _digests(batch["digest"]), np.asarray(batch["kind"])
            gone.append(keys[kind == 1])
            keys = np.unique(keys[kind == 0], axis=0)
            cuckoo.insert(keys[cuckoo.find(keys) < 0])
        for keys in gone:
            cuckoo.delete(np.unique(keys, axis=0))
        left = cuckoo.keys[: cuckoo.used][cuckoo.live[: cuckoo.used]]
        raw = left.astype(">u8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary())], names=["digest"])

    marked = index.select("digest", F.lit(0).alias("kind")).union(inserted.select("digest", F.lit(0))).union(deleted.select("digest", F.lit(1)))
    return marked.distinct().repartition(partitions(index.sparkSession), "digest").mapInArrow(shard, "digest binary")


def _with_groups(rows: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """Each row (digest, ...) with its group.

    A group of a HOT-th of all n rows and more would meet in one task; of such
    there are HOT at most, so they're broadcast, and only the others are shuffled.
    """
    hot = F.col("group_size") * HOT >= n
    many = F.broadcast(groups.filter(hot).select(F.col("digest").alias("hot_digest"), F.col("keep_id").alias("hot_id"), F.col("keep_row").alias("hot_row"), F.col("group_size").alias("hot_size")))  # HOT rows at most
    rows = rows.join(many, F.col("digest") == F.col("hot_digest"), "left")
    own = rows.filter("hot_digest IS NOT NULL").select("doc_id", "row", "digest", F.col("hot_id").alias("keep_id"), F.col("hot_row").alias("keep_row"), F.col("hot_size").alias("group_size"))
    rest = rows.filter("hot_digest IS NULL").select("doc_id", "row", "digest").join(groups.filter(~hot), "digest")
    return own.unionByName(rest)


def copy_groups(docs: DataFrame) -> DataFrame:
    """Each row's group of equal texts, and whether the row stays."""
    held_names(docs, "doc_id", "text")
    # the row's number is written, so it's the same wherever it is read; it breaks ties
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_digest().alias("digest")), "digests")
    out = _with_groups(rows, stored(live_groups(rows), "groups"), rows.count())
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("keep_row"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the copies of a text that has a larger doc_id; all columns.

    Of rows that repeat doc_id and text one stays, any of them. Copies go by their
    digests first, so only what no other row outranks is sorted out by row.
    """
    digest, keep, turn = (free_name(x, *docs.columns) for x in ("_digest", "_keep", "_turn"))
    low = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    digests = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_digest().alias("digest"))
    groups = live_groups(stored(digests, "digests")).select(F.col("digest").alias(digest), F.coalesce("keep_id", F.lit(-(2**63))).alias(keep))
    rows = docs.withColumn(digest, text_digest()).withColumn(keep, low).join(groups, [digest, keep])
    return rows.withColumn(turn, F.row_number().over(Window.partitionBy(digest, keep).orderBy(F.lit(1)))).filter(F.col(turn) == 1).select(*docs.columns)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_groups(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
