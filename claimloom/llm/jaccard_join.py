"""N-gram Jaccard join: a grouped prefix join with connected components.

A document's set is its distinct shingles of WORDS words. Shingles have one global
order, rare ones first. Two sets can only reach the threshold if their prefixes
(the first n - ceil(0.8 n) + 1 shingles) share one.

1. Documents with one prefix and size make a group, and groups are indexed by the
   shingles of their prefix; shingles that one group alone holds go.
2. The groups of a shingle's list are paired with the list's leader, and group
   pairs that fail the size and position filters go.
3. Group pairs are expanded: members (different sets; documents with equal sets
   are one member throughout) are verified on whole sets against a member of the
   leader, and within a group against its first member. Linked ones are one class
   from then on.
4. What is still open are pairs of one list in different classes. They are paired
   as groups of a class by bands of size within reach of each other (`_meetings`),
   expanded and verified likewise; long bands are dealt to several tasks. So every link between different texts that joins two
   classes is found, and a list of n near copies costs n verifications.

The order comes from counts of all shingles of all documents, hashed to SLOTS
counters: a fixed size, broadcast as one byte each. A counter's excess over the
median tells frequent shingles at any load. The order decides how much work is
left, never what is found.

Defined cases: a null text is empty; a document without words has an empty set
and links with nothing; with fewer than WORDS words its set is the one sequence;
documents with equal sets are linked; a row that repeats a doc_id is classed by
its own text; rows without doc_id take no part in the classes and have null for
theirs; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.common import as_bytes, doc_word_hashes, dropped, free_name, grams, held_names, mix64, partitions, signed, stored, table
from claimloom.llm.components import components

WORDS = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
SLOT_BITS = 22
SLOTS = 1 << SLOT_BITS
PART = 1 << 14
#: Lists beyond about so many groups are dealt to several tasks.
LIST = 1 << 16
#: The sieve of wanted documents has about 8 bits for each, and these at least and at most.
SIEVE, SIEVE_MOST = 1 << 25, 1 << 28
#: Entries of a list that meet in one task while pairs are formed.
SALT = 1 << 12
#: Postings that a task looks at at a time.
BUNCH = 1 << 20
#: Pairs of sets that a task verifies at a time.
PAIRS = 100
#: Seeds of a set's two digests; the first is its node.
ONE, TWO = 0x1F83D9AB, 0x5BE0CD19


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's distinct shingles."""
    for h in doc_word_hashes([t.lower() for t in texts]):  # bytes: only A-Z
        if len(h):
            g = grams(h, min(WORDS, len(h)))
            yield np.unique(g if len(h) >= WORDS else mix64(g + np.uint64(len(h))))
        else:
            yield h


def _slots(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def shingle_ranks(docs: DataFrame) -> np.ndarray:
    """One byte for each slot: about 4 log2 of how many more shingles than usual hash to it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, dtype=np.uint32)
        for batch in batches:
            for s in shingle_sets(as_bytes(batch["text"])):
                at, n = np.unique(_slots(s), return_counts=True)
                total[at] += n.astype(np.uint32)
        squeeze = zstandard.ZstdCompressor(level=1)
        parts = [squeeze.compress(total[a : a + PART].tobytes()) for a in range(0, SLOTS, PART)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["part", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        loosen = zstandard.ZstdDecompressor()
        total = np.zeros(PART, dtype=np.uint64)
        for x in pdf["counts"]:
            total += np.frombuffer(loosen.decompress(x), dtype=np.uint32)
        more = np.maximum(total.astype(np.float64) - np.median(total), 0)
        ranks = np.minimum(4 * np.log2(more + 1.0), 255).astype(np.uint8)
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "ranks": [ranks.tobytes()]})

    counted = docs.select("text").mapInArrow(count, "part int, counts binary")
    out = np.zeros(SLOTS, dtype=np.uint8)
    for r in stored(counted.groupBy("part").applyInPandas(add, "part int, ranks binary"), "ranks").collect():  # SLOTS bytes in all
        out[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(r["ranks"], dtype=np.uint8)
    return out


def _prefix_size(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def prefixes(docs: DataFrame, ranks) -> DataFrame:
    """doc_id, a hash of the text, n, group, two set digests, and the prefix in the global order.

    Of the copies in a task one has the prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = ranks.value, set()
        for batch in batches:
            rows = []
            for s in shingle_sets(as_bytes(batch["text"])):
                if not len(s):
                    rows.append((0, None, None, None, None))
                    continue
                one, two = _digest(s, ONE), _digest(s, TWO)
                r, p = rank[_slots(s)], _prefix_size(len(s))
                if p < len(s):
                    low = np.flatnonzero(r <= np.partition(r, p - 1)[p - 1])
                    first = s[low[np.lexsort((s[low], r[low]))[:p]]]
                else:
                    first = s[np.lexsort((s, r))]
                group = mix64(first * np.arange(1, 2 * len(first), 2, dtype=np.uint64) + np.uint64(len(s))).sum(dtype=np.uint64).astype(np.int64)
                known = (one, two) in seen
                seen.add((one, two))
                rows.append((len(s), int(group), one, two, None if known else first.tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["mark"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "mark", "n", "group", "one", "two", "prefix"])

    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, "doc_id long, mark long, n int, group long, one long, two long, prefix binary")


def _postings(ranks):
    """Rows of _DEALT for each shingle of a prefix: postings of one shingle and part are dealt to one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        hot = int(4 * np.log2(LIST))
        for batch in batches:
            groups, sizes = np.asarray(batch["group"]), np.asarray(batch["n"])
            new = [i for i, g in enumerate(groups.tolist()) if not (g in seen or seen.add(g))]
            raw = [batch["prefix"][i].as_py() for i in new]
            if not raw:
                continue
            length = np.array([len(x) // 8 for x in raw])
            shingle = np.frombuffer(b"".join(raw), dtype=np.uint64)
            group, n = np.repeat(groups[new], length), np.repeat(sizes[new], length)
            at = np.arange(len(shingle)) - np.repeat(np.cumsum(length) - length, length)
            rank = ranks.value[_slots(shingle)]
            parts = np.where(rank > hot, 2.0 ** ((rank - hot) / 4.0) + 1, 1).astype(np.uint64)
            part = np.where(parts > 1, mix64(group.view(np.uint64)) % parts + np.uint64(1), 0)  # 0: not split
            for a in range(0, len(shingle), 200_000):
                cut = slice(a, a + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(signed(shingle[cut])), pa.array(group[cut]), pa.array(part[cut].astype(np.int32)), pa.array(n[cut]), pa.array(at[cut].astype(np.int32))], names=["shingle", "group", "part", "n", "at"])

    return run


_POSTING = "shingle long, group long, n int, at int"
#: What is shuffled: no more than a posting and its part, as hashes don't compress.
_DEALT = "shingle long, group long, part int, n int, at int"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by shingle and part, those whose shingle another group holds too."""

    def some(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        shingle, group = np.asarray(rows["shingle"]), np.asarray(rows["group"])
        order = np.lexsort((group, shingle))
        s, g = shingle[order], group[order]
        fresh = np.r_[True, (s[1:] != s[:-1]) | (g[1:] != g[:-1])]
        order, s = order[fresh], s[fresh]
        _, back, n = np.unique(s, return_inverse=True, return_counts=True)
        keep = order[(n[back.ravel()] > 1) | (np.asarray(rows["part"])[order] > 0)]
        yield from rows.select(["shingle", "group", "n", "at"]).take(pa.array(np.sort(keep))).combine_chunks().to_batches(100_000)

    wait, size, enough = [], 0, BUNCH
    for batch in batches:
        wait.append(batch)
        size += batch.num_rows
        if size >= enough:  # whole parts only
            rows = pa.Table.from_batches(wait)
            shingle, part = np.asarray(rows["shingle"]), np.asarray(rows["part"])
            first = int(np.searchsorted(shingle, shingle[-1]))
            cut = first + int(np.searchsorted(part[first:], part[-1]))
            yield from some(rows.slice(0, cut))
            rows = rows.slice(cut).combine_chunks()
            wait, size = rows.to_batches(), rows.num_rows
            enough = max(BUNCH, 2 * size)  # a part longer than that is copied a few times only
    if wait:
        yield from some(pa.Table.from_batches(wait))


def _may_link(x: str, y: str):
    """Size and position filters for the first shingle that two sets share."""
    left = F.least(F.col(f"{x}_n") - F.col(f"{x}_at"), F.col(f"{y}_n") - F.col(f"{y}_at"))
    return (100 + PERCENT) * left >= PERCENT * (F.col(f"{x}_n") + F.col(f"{y}_n"))


def _band(n):
    """The size band of a set: each holds sizes up to a twentieth apart."""
    return F.floor(F.log(n.cast("double")) * 20).cast("int")


def _meetings(ranked: DataFrame, put) -> DataFrame:
    """Entries (group, root, n, at) of one shingle that sizes and positions let link: u is the smaller, v in another class or not.

    By the filters an entry reaches sets of up to 2.25 (n - at) - n shingles. Of two
    sets the smaller, u, has to reach the larger, so only entries that reach their own
    size ask, each the size bands from its own to its reach; entries of its own kind and
    others answer in the one band of their size, if they reach u. Where a shingle is late
    in all prefixes, as frequent ones are, nobody asks and a list of any length costs
    nothing more. A band of over SALT answers is dealt to several tasks. Of the lowest
    class in a list no two entries meet.
    """
    n, at = F.col("n"), F.col("at")
    reach = F.floor(((100 + PERCENT) * (n - at) - PERCENT * n) / PERCENT).cast("int")
    mixed = ranked.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    entries = put(ranked.withColumn("reach", reach).join(mixed.select("shingle", "low"), "shingle"), "open-lists", 10_000)
    asks = F.explode(F.sequence(_band(n), _band(F.col("reach"))))
    asking = entries.filter("reach >= n").withColumn("band", asks)
    # what some entry asks for, and the smallest that asks
    asked = asking.groupBy("shingle", "band").agg(F.min("n").alias("least"))
    answers = entries.withColumn("band", _band(n)).join(asked, ["shingle", "band"]).filter("reach >= least")
    answers = put(answers.drop("least"), "answers", 10_000)
    deals = answers.groupBy("shingle", "band").agg(F.ceil(F.count("*") / SALT).cast("int").alias("parts"))
    deals = put(deals, "deals", 10_000)
    salt = F.pmod(F.xxhash64("group", "root"), F.col("parts")).cast("int")
    v = answers.join(deals, ["shingle", "band"]).withColumn("salt", salt)
    u = asking.join(deals, ["shingle", "band"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = lambda df, x: df.select("shingle", "band", "salt", *(F.col(c).alias(f"{x}_{c}") for c in ("group", "root", "n", "at", "reach")), (F.col("root") == F.col("low")).alias(f"{x}_low"))
    # two joins, so that no pair of the lowest class is formed: others ask all, the lowest class asks others
    met = side(u.filter("root <> low"), "u").join(side(v, "v"), ["shingle", "band", "salt"])
    met = met.union(side(u.filter("root = low"), "u").join(side(v.filter("root <> low"), "v"), ["shingle", "band", "salt"]))
    return met.filter("v_n >= u_n AND v_n <= u_reach AND u_n <= v_reach")


def _named(df: DataFrame, x: str, *columns: str) -> DataFrame:
    return df.select("shingle", *(F.col(c).alias(f"{x}_{c}") for c in columns))


def _digest(s: np.ndarray, k: int) -> int:
    return int(mix64(s ^ np.uint64(k)).sum(dtype=np.uint64).astype(np.int64))


def _sieve(ids: DataFrame, size: int) -> np.ndarray:
    """A bit for each hash of a doc_id, size bits in all."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << 16, dtype=bool)
        bits[pdf["bit"].to_numpy()] = True
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "bits": [np.packbits(bits).tobytes()]})

    at = F.pmod(F.xxhash64("doc_id"), F.lit(size))
    found = ids.select(F.floor(at / (1 << 16)).cast("int").alias("part"), (at % (1 << 16)).cast("int").alias("bit")).distinct()
    out = np.zeros(size // 8, dtype=np.uint8)
    for r in stored(found.groupBy("part").applyInPandas(fill, "part int, bits binary"), "sieve").collect():
        out[r["part"] << 13 : (r["part"] + 1) << 13] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


class _Scratch:
    """Tables of one run, each dropped as soon as nothing reads it any more."""

    def __init__(self) -> None:
        self.held: list[DataFrame] = []

    def put(self, df: DataFrame, name: str, batch_rows: int = 1000) -> DataFrame:
        self.held.append(stored(df, name, batch_rows))
        return self.held[-1]

    def drop(self, *done: DataFrame) -> None:
        dropped(*done)
        self.held = [x for x in self.held if all(x is not y for y in done)]


def _sets(docs: DataFrame, wanted: DataFrame, scratch: _Scratch) -> DataFrame:
    """node, set (its sorted hashes) of the wanted (doc_id, node), stored.

    Texts that a sieve shows to be unwanted aren't shuffled; the join drops the
    rest. The sieve grows with the wanted documents up to SIEVE_MOST bits (32 MB):
    with far more of them it passes all texts, and the join alone decides.
    """
    size = min(max(SIEVE, 1 << (8 * wanted.count()).bit_length()), SIEVE_MOST)
    sieve = docs.sparkSession.sparkContext.broadcast(_sieve(wanted, size))  # SIEVE_MOST bits at most

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            at = np.asarray(batch["bit"])
            batch = batch.filter(pa.array((sieve.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([squeeze.compress(t) for t in as_bytes(batch["text"])], pa.binary())], names=["doc_id", "packed"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loosen = zstandard.ZstdDecompressor()
        for batch in batches:
            own = shingle_sets([loosen.decompress(x) for x in batch["packed"].to_pylist()])
            rows = [(k, s.tobytes()) for k, s in zip(batch["node"].to_pylist(), own, strict=True) if _digest(s, ONE) == k]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.binary())], names=["node", "set"])

    known = docs.filter("doc_id IS NOT NULL").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(size)).alias("bit"), "text")
    texts = known.mapInArrow(pack, "doc_id long, packed binary").join(wanted, "doc_id")
    # stored in between: no stage then keeps two Python workers for a task
    texts = scratch.put(texts, "wanted-texts")
    sets = scratch.put(texts.mapInArrow(unpack, "node long, set binary"), "sets")
    scratch.drop(texts)
    return sets


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (u, v), those whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch["u_set"], batch["v_set"], strict=True):
                x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (a, b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    v = sets.select(F.col("node").alias("v"), F.col("set").alias("v_set"))
    u = sets.select(F.col("node").alias("u"), F.col("set").alias("u_set"))
    return pairs.join(v, "v").join(u, "u").select("u", "v", "u_set", "v_set").mapInArrow(run, "u long, v long")


def _classed(docs: DataFrame) -> DataFrame:
    """doc_id, mark, one, n, component_id of each row, and the lead: the set that stands for its class."""
    held_names(docs, "doc_id", "text")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranks = spark.sparkContext.broadcast(shingle_ranks(docs))  # SLOTS bytes
    rows = stored(prefixes(docs, ranks), "prefixes")

    scratch = _Scratch()
    put, drop = scratch.put, scratch.drop

    # members: one document for each different set
    members = rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("group", "n", F.col("one").alias("node"), "two").agg(F.min("doc_id").alias("doc_id"))
    members = put(members, "members")
    dealt = rows.filter("prefix IS NOT NULL").select("group", "n", "prefix").mapInArrow(_postings(ranks), _DEALT)
    lists = put(dealt.repartition(partitions(spark), "shingle", "part").sortWithinPartitions("shingle", "part").mapInArrow(_shared, _POSTING), "lists", 10_000)

    # pairs of groups: each group of a list with the list's leader
    heads = put(members.groupBy("group").agg(F.min("node").alias("head"), F.first("n").alias("n"), F.count("*").alias("k")), "heads")
    leaders = lists.groupBy("shingle").agg(F.min(F.struct("at", "n", "group")).alias("l"), F.count("*").alias("k")).filter("k > 1")
    leaders = leaders.select("shingle", F.col("l.group").alias("u_group"), F.col("l.n").alias("u_n"), F.col("l.at").alias("u_at"))
    leaders = put(leaders.join(heads.select(F.col("group").alias("u_group"), F.col("head").alias("u")), "u_group"), "leaders")
    paired = _named(lists, "v", "group", "n", "at").join(leaders, "shingle").filter("u_group <> v_group").filter(_may_link("u", "v"))
    paired = put(paired.select("u", F.col("v_group").alias("group")).distinct(), "group-pairs")
    drop(leaders)

    # expanded to members, and verified
    several = members.join(heads.filter("k > 1").select("group", F.col("head").alias("u")), "group").filter("node <> u")
    star = paired.join(members.select("group", "node"), "group").select("u", F.col("node").alias("v")).union(several.select("u", F.col("node").alias("v")))
    star = put(star.distinct(), "star")
    drop(paired)
    wanted = put(star.select("u").union(star.select("v")).distinct().select(F.col("u").alias("node")), "wanted")
    ids = members.select("doc_id", "node")
    wanted_ids = put(ids.join(wanted, "node"), "wanted-ids")
    sets = _sets(docs, wanted_ids, scratch)
    drop(wanted_ids)
    links = put(_verified(star, sets), "links", PAIRS)
    roots = put(components(links), "roots")

    # what is still open: pairs of one list in different classes, as groups of a class first
    classed = put(members.join(roots, "node", "left").select("group", "node", F.coalesce("root", "node").alias("root")), "classed")
    own = heads.filter("k > 1").select(F.xxhash64("group").alias("shingle"), "group", "n", F.lit(0).alias("at"))
    ranked = put(lists.union(own).join(classed.select("group", "root").distinct(), "group"), "classed-lists")
    drop(lists, heads)
    opened = _meetings(ranked, put).filter("u_root <> v_root").filter(_may_link("u", "v"))
    opened = put(opened.select("u_group", "u_root", "v_group", "v_root").distinct(), "open-groups")
    drop(ranked)
    side = lambda x: classed.select(F.col("group").alias(f"{x}_group"), F.col("root").alias(f"{x}_root"), F.col("node").alias(x))
    opened = opened.join(side("u"), ["u_group", "u_root"]).join(side("v"), ["v_group", "v_root"])
    opened = opened.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    done = star.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    opened = put(opened.join(done, ["u", "v"], "left_anti"), "open")
    if not opened.isEmpty():
        more = opened.select("u").union(opened.select("v")).distinct().select(F.col("u").alias("node"))
        more = put(more.join(wanted, "node", "left_anti").join(ids, "node"), "more")
        if not more.isEmpty():
            sets = sets.union(_sets(docs, more, scratch))
        links = links.union(put(_verified(opened, sets), "more-links", PAIRS))
        roots = put(components(links), "roots")

    known = members.join(roots, "node", "left").select("node", "two", "n", "doc_id", F.coalesce("root", "node").alias("root"))
    known = put(known, "classes")
    first = F.min(F.struct("doc_id", "node"))
    least = put(known.groupBy("root").agg(first["doc_id"].alias("component_id"), first["node"].alias("lead")), "least")
    known = stored(known.join(least, "root").select(F.col("node").alias("one"), "two", "n", "component_id", "lead"), "known")
    drop(*scratch.held)
    out = rows.select("doc_id", "mark", "n", "one", "two").join(known, ["one", "two", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "mark", "one", F.col("n").cast("long").alias("n"), component.alias("component_id"), "lead")


def link_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    return _classed(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest doc_id; all columns.

    Rows go by doc_id and text: a row that repeats a doc_id with another text has
    a class of its own. Equal rows stay or go together.
    """
    rows = stored(_classed(docs).filter("doc_id IS NOT NULL AND lead IS NOT NULL").select("doc_id", "mark", "one", ((F.col("component_id") == F.col("doc_id")) & (F.col("lead") == F.col("one"))).alias("stays")).distinct(), "rows")
    # texts of one doc_id with equal sets: one of them stays
    stay = rows.filter("stays").groupBy("doc_id", "one").agg(F.min("mark").alias("mark")).select("doc_id", "mark")
    gone = stored(rows.select("doc_id", "mark").join(stay, ["doc_id", "mark"], "left_anti").distinct(), "near-copies")
    own_id, own_mark = (free_name(x, *docs.columns) for x in ("_id", "_mark"))
    same = (F.col("doc_id").cast("long") == F.col(own_id)) & (F.xxhash64("text") == F.col(own_mark))
    return docs.join(gone.select(F.col("doc_id").alias(own_id), F.col("mark").alias(own_mark)), same, "left_anti").select(*docs.columns)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_classes(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (
  SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(2, len(w) - 3))) AS u(i) WHERE len(w) > 0 GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
c(doc_id, root) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c.root) AS component_id
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""
