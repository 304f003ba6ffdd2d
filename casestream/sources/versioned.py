"""A keyed table that changes by whole commits: rows lie in buckets by a hash of their key,
and a commit writes anew only the buckets that hold changed keys.

    path/data/<commit>/bucket=<b>/…   Parquet files, never changed once written
    path/manifest/<version>.json      which folder holds each bucket; the version is what readers see

Data is written first and the manifest last, under its final name by a rename that fails if the name is taken:
a commit that stopped half-way leaves folders that no manifest names, and of two writers
from one version the later one gets `Conflict` and works on the new version. (Stores whose rename isn't atomic
need one writer at a time.) A manifest also holds, for each job that writes, the last run that it has in it, so a
run that comes again changes nothing. The driver holds one manifest, which is as long as there are buckets."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another commit took the version."""


class Folder:
    """A folder in whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._there = self._path(path)
        self._fs = self._there.getFileSystem(spark._jsc.hadoopConfiguration())

    def _of(self, name: str):
        return self._path(self._there, name) if name else self._there

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._of(name))

    def names(self, name: str = "") -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._of(name))] if self.exists(name) else []

    def delete(self, name: str = "") -> bool:
        return self._fs.delete(self._of(name), True)

    def complete(self, name: str = "") -> bool:
        """Whether a Spark write to it has ended."""
        return self.exists(f"{name}/_SUCCESS" if name else "_SUCCESS")

    def publish(self, name: str, text: str) -> bool:
        """Write a small file under a new name; false if the name is taken."""
        waiting = self._of(f"_{uuid.uuid4().hex}")
        out = self._fs.create(waiting, False)
        try:
            out.writeBytes(text)  # JSON is ASCII
        finally:
            out.close()
        done = not self._fs.exists(self._of(name)) and self._fs.rename(waiting, self._of(name))
        if not done:
            self._fs.delete(waiting, False)
        return done


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @cached_property
    def _manifests(self) -> Folder:
        return Folder(self.spark, f"{self.path}/manifest")

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: list[str], buckets: int = 64) -> VersionedTable:
        """Version 0. Keys may be null and repeated; all rows of a key are in one bucket."""
        made = cls(rows.sparkSession, path)
        first = {"version": 0, "keys": keys, "buckets": buckets, "schema": rows.schema.json(), "applied": {}}
        made._publish(first | {"parts": made._write(rows, keys, buckets)})
        return made

    # -- reading -----------------------------------------------------------

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._manifests.names() if n.endswith(".json") and not n.startswith("_"))

    def manifest(self, version: int | None = None) -> dict:
        there = self.versions()
        if not there:
            raise FileNotFoundError(f"no version of a table in {self.path}")
        version = there[-1] if version is None else version
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{version}.json", wholetext=True).first()[0])

    def applied(self, job: str) -> int:
        """The last run of a job that the newest version has in it; -1 for none."""
        return self.manifest()["applied"].get(job, -1)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows as of a version, by default the newest."""
        found = self.manifest(version)
        return self._rows(found, found["parts"].values())

    def _rows(self, manifest: dict, parts) -> DataFrame:
        schema, folders = StructType.fromJson(json.loads(manifest["schema"])), [f"{self.path}/{p}" for p in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    # -- writing -----------------------------------------------------------

    @staticmethod
    def _bucket(keys: list[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, keys: list[str], buckets: int) -> dict[str, str]:
        commit = f"data/{uuid.uuid4().hex}"
        placed = rows.withColumn("bucket", self._bucket(keys, buckets))
        placed.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{commit}")
        return {n.partition("=")[2]: f"{commit}/{n}" for n in Folder(self.spark, f"{self.path}/{commit}").names() if n.startswith("bucket=")}

    def _publish(self, manifest: dict) -> None:
        if not self._manifests.publish(f"{manifest['version']}.json", json.dumps(manifest)):
            raise Conflict(f"version {manifest['version']} of {self.path} is there")

    def update(self, changes: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], job: str | None = None, run: int | None = None, tries: int = 5) -> bool:
        """Commit `change(rows, changes)`: `changes` has the key columns, `rows` are those of the buckets that its keys
        are in, and all of what comes back, in the table's columns, replaces them. False if that run of the job
        is in the table already. After a conflict it starts over from the new version."""
        for attempt in range(tries):
            old = self.manifest()
            if job is not None and old["applied"].get(job, -1) >= run:
                return False
            keys, buckets = old["keys"], old["buckets"]
            touched = [str(r[0]) for r in changes.select(self._bucket(keys, buckets)).distinct().collect()]  # as many as buckets
            new = old | {"version": old["version"] + 1, "parts": {b: p for b, p in old["parts"].items() if b not in touched}}
            if touched:
                rows = self._rows(old, [old["parts"][b] for b in touched if b in old["parts"]])
                columns = StructType.fromJson(json.loads(old["schema"])).names
                new["parts"] |= self._write(change(rows, changes).select(*columns), keys, buckets)
            if job is not None:
                new["applied"] = old["applied"] | {job: run}
            try:
                self._publish(new)
            except Conflict:
                if attempt == tries - 1:
                    raise
                continue
            return True
        return False

    def upsert(self, rows: DataFrame, job: str | None = None, run: int | None = None) -> bool:
        """Rows replace those of their keys; new keys are added."""
        keys = self.manifest()["keys"]
        return self.update(rows, lambda old, new: _without(old, new, keys).unionByName(new), job, run)

    def delete(self, gone: DataFrame, job: str | None = None, run: int | None = None) -> bool:
        """The rows of the given keys go."""
        keys = self.manifest()["keys"]
        return self.update(gone, lambda old, new: _without(old, new, keys), job, run)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete the versions before the last `keep`, and every folder that none of these names: their names. Only
        where no reader of an older version and no writer is at work."""
        kept = self.versions()[-keep:]
        named = {p.split("/")[1] for v in kept for p in self.manifest(v)["parts"].values()}
        data = Folder(self.spark, f"{self.path}/data")
        gone = [n for n in data.names() if n not in named]
        for name in gone:
            data.delete(name)
        for v in self.versions():
            if v not in kept:
                self._manifests.delete(f"{v}.json")
        return gone


def _without(rows: DataFrame, keys_of: DataFrame, keys: list[str]) -> DataFrame:
    gone = keys_of.select(*[F.col(k).alias(f"__gone_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"__gone_{k}")) for k in keys]
    return rows.join(gone, same, "left_anti")
