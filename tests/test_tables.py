"""Stored tables: what a change rewrites, what a failure leaves, what a repeated batch does."""

import tempfile

import pytest
from pyspark.sql import functions as F

from claimloom.sources.tables import ClaimStore

SHAPE = "claim_id string, seq long, verdict string"


@pytest.fixture
def store(spark):
    return ClaimStore(spark, "file://" + tempfile.mkdtemp(prefix="spark-"), buckets=4)


def frame(spark, rows):
    return spark.createDataFrame(rows, SHAPE)


def rows(store, name="reports"):
    return sorted((tuple(r) for r in store.read(name).collect()), key=str)


def many(n, verdict="old", seq=0):
    return [(f"C{k}", seq, verdict) for k in range(n)]


def test_upsert_rewrites_touched_buckets_only(spark, store):
    store.upsert("reports", frame(spark, many(40)), ["claim_id"], ["seq"])
    before = store.manifest()["tables"]["reports"]["folders"]
    assert len(before) == 4
    store.upsert("reports", frame(spark, [("C7", 1, "new"), ("C7", 2, "newest"), ("C7", -1, "stale")]), ["claim_id"], ["seq"])
    after = store.manifest()["tables"]["reports"]["folders"]
    assert sum(before[b] != after[b] for b in before) == 1
    want = {**{c: (c, s, v) for c, s, v in many(40)}, "C7": ("C7", 2, "newest")}
    assert rows(store) == sorted(want.values(), key=str)
    # an older row doesn't win, and without an order the incoming one does
    store.upsert("reports", frame(spark, [("C7", 1, "late")]), ["claim_id"], ["seq"])
    assert ("C7", 2, "newest") in rows(store)
    store.upsert("reports", frame(spark, [("C7", 0, "forced")]), ["claim_id"])
    assert ("C7", 0, "forced") in rows(store) and len(rows(store)) == 40
    store.upsert("reports", frame(spark, []), ["claim_id"])
    assert len(rows(store)) == 40


def test_a_failure_half_way_leaves_the_old_state(spark, store):
    store.upsert("reports", frame(spark, many(10)), ["claim_id"], ["seq"])
    store.append("log", frame(spark, many(10)), ["claim_id", "seq"])
    before = store.manifest()
    broken = frame(spark, [("C1", 1, "x")]).withColumn("verdict", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.upsert("reports", broken, ["claim_id"], ["seq"])
    # files are written, the commit isn't
    commit = store._commit
    store._commit = lambda manifest: (_ for _ in ()).throw(OSError("gone"))
    with pytest.raises(OSError, match="gone"):
        store.delete(frame(spark, [("C1", 0, "")]))
    store._commit = commit
    assert store.manifest() == before and rows(store) == many(10) == rows(store, "log")
    # the second of two writers fails
    stale = store.manifest()
    store.append("log", frame(spark, [("D", 0, "d")]), ["claim_id", "seq"])
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit(stale)
    assert store.vacuum() > 0
    assert rows(store) == many(10) and len(rows(store, "log")) == 11


def test_append_once(spark, store):
    store.append("log", frame(spark, many(6)), ["claim_id", "seq"], "w", 0)
    version = store.manifest()["version"]
    store.append("log", frame(spark, many(6)), ["claim_id", "seq"], "w", 0)  # the same batch again
    assert store.manifest()["version"] == version
    store.append("log", frame(spark, [*many(6), ("C1", 5, "more"), ("C1", 5, "more"), (None, 1, "n")]), ["claim_id", "seq"], "w", 1)
    store.append("log", frame(spark, [(None, 1, "n")]), ["claim_id", "seq"])  # without a writer, by keys
    assert rows(store, "log") == sorted([*many(6), ("C1", 5, "more"), (None, 1, "n")], key=str)


def test_delete_takes_all_tables_in_one_commit(spark, store):
    for name in ("log", "snapshots", "reports"):
        store.append(name, frame(spark, many(20)), ["claim_id", "seq"])
    version = store.manifest()["version"]
    before = store.manifest()["tables"]
    store.delete(frame(spark, [("C3", 0, ""), ("C3", 1, ""), (None, 0, ""), ("none", 0, "")]))
    assert store.manifest()["version"] == version + 1
    for name in ("log", "snapshots", "reports"):
        assert rows(store, name) == sorted((r for r in many(20) if r[0] != "C3"), key=str)
        after = store.manifest()["tables"][name]["folders"]
        assert sum(before[name]["folders"][b] != after.get(b) for b in before[name]["folders"]) <= 2
    # the version before can still be read
    assert sum(1 for _ in store._rows(store.manifest(version), "log").collect()) == 20


def test_sink_stores_a_batch_once(spark, store):
    put = store.sink("log", ["claim_id", "seq"], "stream")
    for _ in range(2):
        put(frame(spark, many(3)), 0)
    put(frame(spark, many(5, seq=1)), 1)
    assert rows(store, "log") == sorted(many(3) + many(5, seq=1), key=str)
    count = store.sink("counts", ["claim_id"], "stream", update=True)
    count(frame(spark, many(3)), 0)
    count(frame(spark, [("C1", 9, "now")]), 1)
    count(frame(spark, [("C1", 1, "old again")]), 0)
    assert rows(store, "counts") == [("C0", 0, "old"), ("C1", 9, "now"), ("C2", 0, "old")]


def test_many_appends_leave_few_folders(spark, tmp_path):
    store = ClaimStore(spark, f"{tmp_path}/store", 2)
    for n in range(11):
        store.append("log", spark.createDataFrame([("A", n), ("A", max(n - 1, 0)), ("B", n)], "claim_id string, id int"), ["claim_id", "id"], writer="w", batch=n)
    assert max(map(len, store.manifest()["tables"]["log"]["folders"].values())) <= 8
    assert sorted(map(tuple, store.read("log").collect())) == [(c, n) for c in "AB" for n in range(11)]
    before = store.manifest()
    store.append("log", spark.createDataFrame([("A", 99)], "claim_id string, id int"), ["claim_id", "id"], writer="w", batch=10)
    assert store.manifest() == before
