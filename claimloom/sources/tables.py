"""Stored tables of claims: appends, keyed merges and deletes that rewrite little and commit at once.

A store is a folder. Its tables lie in buckets of their first key (of claims: claim_id),
each bucket in folders of Parquet files. A manifest, one numbered file for each version of the store, lists the
folders of every table; the highest number is the present. A change writes new folders
beside the old ones and then its manifest, so readers see all of a change or nothing,
and what fails half-way leaves folders that no manifest names (`vacuum` deletes them).
Only buckets that a change touches are read or written again.

One writer changes a store at a time: of two that start from one version, the second
to commit fails and may be run again.
"""

from __future__ import annotations

import json
import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_BUCKET = "_claim_bucket"
#: A bucket with so many folders is laid into one by the next append that touches it.
_FOLDERS = 8


class ClaimStore:
    """Tables under one folder. A table is made by its first change; keys[0] deals it to buckets."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---- manifests

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _versions(self) -> list[int]:
        folder = self._path("manifests")
        if not self._fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)]
        return sorted(int(x[:-5]) for x in names if x.endswith(".json") and not x.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """{"version": n, "tables": {name: {"schema", "by", "buckets", "folders", "done"}}}."""
        if version is None:
            version = max(self._versions(), default=0)
        if not version:
            return {"version": 0, "tables": {}}
        stream = self._fs.open(self._path(f"manifests/{version:010d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """Makes manifest the next version; fails if another writer has made one."""
        manifest = manifest | {"version": manifest["version"] + 1}
        target, beside = self._path(f"manifests/{manifest['version']:010d}.json"), self._path(f"manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(beside, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if self._fs.exists(target) or not self._fs.rename(beside, target):
            self._fs.delete(beside, False)
            raise RuntimeError(f"version {manifest['version']} was written by another writer")

    # ---- reading

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The present rows of a table, or of some of its buckets."""
        return self._rows(self.manifest(), name, buckets)

    def _rows(self, manifest: dict, name: str, buckets: list[int] | None = None) -> DataFrame:
        entry = manifest["tables"][name]
        schema = StructType.fromJson(entry["schema"])
        folders = self.folders(manifest, name, buckets)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{x}" for x in folders))

    def folders(self, manifest: dict, name: str, buckets: list[int] | None = None) -> list[str]:
        of = manifest["tables"][name]["folders"]
        return [f for b in (of if buckets is None else map(str, buckets)) for f in of.get(str(b), [])]

    # ---- changes

    def _entry(self, manifest: dict, name: str, df: DataFrame, by: str) -> dict:
        return manifest["tables"].setdefault(name, {"schema": df.schema.jsonValue(), "by": by, "buckets": self.buckets, "folders": {}, "done": {}})

    def _bucketed(self, df: DataFrame, entry: dict) -> DataFrame:
        return df.withColumn(_BUCKET, F.pmod(F.xxhash64(entry["by"]), F.lit(entry["buckets"])).cast("int"))

    def _touched(self, df: DataFrame) -> list[int]:
        return sorted(r[0] for r in df.select(_BUCKET).distinct().collect())  # one number for each bucket

    def _write(self, df: DataFrame, version: int) -> dict[int, str]:
        """Writes rows that have their bucket; the folder of each bucket that has any."""
        top = f"data/{version:010d}-{uuid.uuid4().hex}"
        df.repartition(F.col(_BUCKET)).write.partitionBy(_BUCKET).parquet(f"{self.root}/{top}")
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(top))]
        return {int(x.split("=")[1]): f"{top}/{x}" for x in names if x.startswith(_BUCKET)}

    def append(self, name: str, df: DataFrame, keys: list[str], writer: str | None = None, batch: int | None = None, repeats: bool = False) -> None:
        """Adds the rows whose keys the table doesn't hold yet, one for each key.

        A batch that `writer` has stored already changes nothing, whatever rows come
        with it; without a writer the keys alone keep a repeated delivery out. With
        `repeats` a new batch is stored whole, equal keys and rows too. What many
        appends have left in pieces is read as few files: crowded buckets are rewritten.
        """
        if repeats and writer is None:
            raise ValueError("only a writer's batches tell a repeated delivery from repeated rows")
        manifest = self.manifest()
        entry = self._entry(manifest, name, df, keys[0])
        if writer is not None and entry["done"].get(writer, -1) >= batch:
            return
        df = df.select(*(f["name"] for f in entry["schema"]["fields"]))
        rows = self._bucketed(df if repeats else df.dropDuplicates(keys), entry)
        touched = self._touched(rows)
        if not repeats:
            held = self._rows(manifest, name, touched).select(keys)
            same = [F.col(f"n.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys]
            rows = rows.alias("n").join(held.alias("h"), same, "left_anti")
        crowded = [b for b in touched if len(entry["folders"].get(str(b), [])) >= _FOLDERS]
        if crowded:
            rows = rows.unionByName(self._bucketed(self._rows(manifest, name, crowded), entry))
        for bucket, folder in self._write(rows, manifest["version"] + 1).items():
            kept = [] if bucket in crowded else entry["folders"].get(str(bucket), [])
            entry["folders"][str(bucket)] = [*kept, folder]
        if writer is not None:
            entry["done"][writer] = batch
        self._commit(manifest)

    def _replace(self, manifest: dict, name: str, touched: list[int], rows: DataFrame) -> None:
        written = self._write(rows, manifest["version"] + 1)
        for bucket in touched:
            manifest["tables"][name]["folders"].pop(str(bucket), None)
            if bucket in written:
                manifest["tables"][name]["folders"][str(bucket)] = [written[bucket]]

    def upsert(self, name: str, df: DataFrame, keys: list[str], order: list[str] | None = None, writer: str | None = None, batch: int | None = None) -> None:
        """For each key the row that is largest by order; without an order the incoming one."""
        manifest = self.manifest()
        entry = self._entry(manifest, name, df, keys[0])
        if writer is not None and entry["done"].get(writer, -1) >= batch:
            return
        columns = [f["name"] for f in entry["schema"]["fields"]]
        incoming = self._bucketed(df.select(*columns), entry)
        touched = self._touched(incoming)
        both = self._bucketed(self._rows(manifest, name, touched), entry).withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
        newest = Window.partitionBy(*keys).orderBy(*(F.desc_nulls_last(x) for x in [*(order or []), "_new"]))
        kept = both.withColumn("_nth", F.row_number().over(newest)).filter("_nth = 1").drop("_nth", "_new")
        self._replace(manifest, name, touched, kept)
        if writer is not None:
            entry["done"][writer] = batch
        self._commit(manifest)

    def delete(self, ids: DataFrame, tables: list[str] | None = None) -> None:
        """Takes the claims in ids out of all tables in buckets of claim_id (or those named) in one commit."""
        manifest = self.manifest()
        gone = ids.select("claim_id").filter("claim_id IS NOT NULL").distinct()
        for name in tables or [t for t, entry in manifest["tables"].items() if entry["by"] == "claim_id"]:
            entry = manifest["tables"][name]
            touched = self._touched(self._bucketed(gone, entry))
            left = self._rows(manifest, name, touched).join(gone, "claim_id", "left_anti")
            self._replace(manifest, name, touched, self._bucketed(left, entry))
        self._commit(manifest)

    def sink(self, name: str, keys: list[str], writer: str, update: bool = False, repeats: bool = False):
        """A function for foreachBatch: stores each batch of a stream once."""
        put = self.upsert if update else partial(self.append, repeats=repeats)

        def store(batch: DataFrame, number: int) -> None:
            # read in full once, also if it is stored already: the stream's state is that of whole batches
            batch = batch.persist()
            try:
                batch.count()
                put(name, batch, keys, writer=writer, batch=number)
            finally:
                batch.unpersist()

        return store

    def vacuum(self, keep: int = 1) -> int:
        """Deletes folders that none of the last `keep` versions names; tells how many."""
        used = {f.split("/")[1] for v in self._versions()[-keep:] for m in [self.manifest(v)] for t in m["tables"] for f in self.folders(m, t)}
        old = [x.getPath() for x in self._fs.listStatus(self._path("data"))] if self._fs.exists(self._path("data")) else []
        old = [x for x in old if x.getName() not in used]
        for x in old:
            self._fs.delete(x, True)
        return len(old)
