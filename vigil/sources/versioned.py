"""Tables of the latest row a key, replaced bucket by bucket.

A version is a small manifest that names, for each bucket of keys, the folder
of its rows.  A merge writes new folders for the buckets that its rows touch,
then one manifest; readers follow the newest manifest, so a writer that dies in
between leaves the old version readable and some folders nobody names.  A
manifest also holds the last batch of each source, so a batch that is tried
again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Files:
    """The few file operations on the cluster's own file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder)))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def put(self, name: str, text: str) -> None:
        """Write a file that appears whole or not at all; it must be new."""
        part = f"{name}.{uuid.uuid4().hex}"
        out = self.fs.create(self.path(part), False)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        if self.exists(name) or not self.fs.rename(self.path(part), self.path(name)):
            self.delete(part)
            raise RuntimeError(f"{name} was written by another job")

    def get(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()


class VersionedTable:
    """A table of one row a key under ``root``, in ``buckets`` buckets of the
    keys' hash (fixed when the table is made; a manifest has one line a
    bucket)."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], buckets: int = 64) -> None:
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), list(keys), buckets
        self.files = Files(spark, root)

    def manifest(self) -> dict:
        """The newest version."""
        names = [n for n in self.files.names(f"{self.root}/manifests") if n.endswith(".json")]
        if not names:
            return {"version": 0, "folders": {}, "batches": {}, "schema": None}
        return json.loads(self.files.get(f"{self.root}/manifests/{names[-1]}"))

    def _rows(self, manifest: dict, buckets: Sequence[str]) -> DataFrame | None:
        folders = [manifest["folders"][b] for b in buckets if b in manifest["folders"]]
        if not folders:
            return None
        return self.spark.read.schema(T.StructType.fromJson(manifest["schema"])).parquet(*folders)

    def read(self) -> DataFrame:
        """The rows of the newest version; a table never written to is an error."""
        now = self.manifest()
        if now["schema"] is None:
            raise FileNotFoundError(self.root)
        rows = self._rows(now, list(now["folders"]))
        return rows if rows is not None else self.spark.createDataFrame([], T.StructType.fromJson(now["schema"]))

    def merge(self, batch: DataFrame, ts: str, tie: str | None = None, batch_id: int | None = None, source: str = "") -> bool:
        """Put the batch's rows in: of each key the row with the latest ``ts``
        (then ``tie``) stays.  Only buckets with keys of the batch are read and
        written.  A ``batch_id`` not above the last one of its source was put in
        before: nothing happens, and the result is false."""
        from vigil.operators.featurestore import latest_per_key, materialize_incremental
        now = self.manifest()
        if batch_id is not None and batch_id <= now["batches"].get(source, -1):
            return False
        bucket = F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.buckets)).cast("int")
        latest = latest_per_key(batch, self.keys, ts, tie).select(*batch.columns).persist()
        try:
            touched = [str(r[0]) for r in latest.select(bucket.alias("bucket")).distinct().collect()]  # at most `buckets` rows
            old = self._rows(now, touched)
            merged = latest if old is None else materialize_incremental(old, latest, self.keys, ts, tie).select(*batch.columns)
            version = now["version"] + 1
            home = f"{self.root}/data/v{version:08d}-{uuid.uuid4().hex[:8]}"
            if touched:
                merged.withColumn("bucket_", bucket).repartition("bucket_").write.partitionBy("bucket_").parquet(home)
        finally:
            latest.unpersist()
        batches = now["batches"] | ({source: batch_id} if batch_id is not None else {})
        new = {"version": version, "batches": batches, "schema": batch.schema.jsonValue(),
               "folders": now["folders"] | {b: f"{home}/bucket_={b}" for b in touched}}
        self.files.put(f"{self.root}/manifests/{version:012d}.json", json.dumps(new))
        return True

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the newest ``keep`` manifests, and the data folders
        that none of them names (leftovers of failed merges too; no merge may
        run meanwhile)."""
        names = [n for n in self.files.names(f"{self.root}/manifests") if n.endswith(".json")]
        held: set[str] = set()
        for n in names[-keep:]:
            held |= set(json.loads(self.files.get(f"{self.root}/manifests/{n}"))["folders"].values())
        for n in names[:-keep]:
            self.files.delete(f"{self.root}/manifests/{n}")
        for version in self.files.names(f"{self.root}/data"):
            for part in self.files.names(f"{self.root}/data/{version}"):
                if part.startswith("bucket_=") and f"{self.root}/data/{version}/{part}" not in held:
                    self.files.delete(f"{self.root}/data/{version}/{part}")
            if not any(n.startswith("bucket_=") for n in self.files.names(f"{self.root}/data/{version}")):
                self.files.delete(f"{self.root}/data/{version}")


def append_batch(df: DataFrame, path: str, batch_id: str | int, partition_cols: Sequence[str] = ()) -> None:
    """Append a batch under a folder of its own (``batch_id=…``): writing the
    same batch again replaces its own files and adds nothing."""
    df.write.mode("overwrite").partitionBy(*partition_cols).parquet(f"{path.rstrip('/')}/batch_id={batch_id}")
