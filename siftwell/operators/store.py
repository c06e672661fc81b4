"""Writing: keyed merges over plain files, appends, deletes and schema growth, each swapped in as one version.

A table is a folder of bucketed files and numbered manifests. A merge rewrites the buckets that it touches and publishes the next
manifest last, so a failed or repeated job leaves readers where they were.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], keep: Sequence[str] = ("id", "created_at"), order: Sequence[str] = ("updated_at",)) -> DataFrame:
    """Rows of both, one a key: the last change wins, but a key that was there keeps its `keep` columns.

    One aggregation over both sides; keys with a null are never equal to each other and stay as they are.
    """
    columns = current.columns
    both = current.select(*columns, F.lit(0).alias("_new")).unionByName(changes.select(*columns, F.lit(1).alias("_new")))
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    rest = [c for c in columns if c not in keys]
    place = F.struct("_new", *order)
    merged = both.where(complete).groupBy(*keys).agg(F.max_by(F.struct(*rest), place).alias("x"), F.min_by(F.struct(*keep), place).alias("k"))
    merged = merged.select(*(F.col(f"k.{c}").alias(c) if c in keep else F.col(c) if c in keys else F.col(f"x.{c}").alias(c) for c in columns))
    return merged.unionByName(both.where(~complete).select(*columns))


def replace_keyed(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of both, those of `changes` in place of equal keys."""
    return current.join(changes.select(key), key, "left_anti").unionByName(changes)


def update_by_id(current: DataFrame, changes: DataFrame, column: str) -> DataFrame:
    """The column set to that of `changes` (id, column) where there is one; raises if a changed id is missing."""
    if not changes.join(current.select("id"), "id", "left_anti").isEmpty():
        raise KeyError("an id to be changed is missing")
    new = changes.select("id", F.col(column).alias("_to"), F.lit(True).alias("_set"))
    return current.join(new, "id", "left").withColumn(column, F.when(F.col("_set"), F.col("_to")).otherwise(F.col(column))).drop("_to", "_set").select(*current.columns)


def delete_where(current: DataFrame, condition: Column) -> DataFrame:
    """The rows for which the condition isn't true."""
    return current.where(~F.coalesce(condition, F.lit(False)))


def with_columns(current: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Columns {name: (type, default)} added where missing, their nulls filled."""
    for name, (kind, default) in columns.items():
        value = F.lit(default).cast(kind)
        current = current.withColumn(name, F.coalesce(F.col(name), value) if name in current.columns else value)
    return current


def referencing(rows: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """The rows whose key a parent has."""
    return rows.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_semi")


class Table:
    """A versioned table in a folder that all executors share, dealt to buckets by the hash of its keys.

    A version is a small manifest that names the folders of each bucket. A merge reads and rewrites only the buckets that its changes
    touch, an append adds folders, and both create the next manifest in one step at the end, so readers never see half a change. A mark
    tells what was merged, so that the same batch merged again, even by another process, changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = ("id",), buckets: int = 16) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The current version; 0 if there is none."""
        if not self._fs.exists(self._path(self.path)):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return max((int(n[9:]) for n in names if n.startswith("_manifest") and n[9:].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{"folders": {bucket: [folder, ...]}, "marks": [...]} of a version."""
        version = self.version() if version is None else version
        if not version:
            return {"folders": {}, "marks": []}
        stream = self._fs.open(self._path(f"{self.path}/_manifest{version}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, version: int, manifest: dict) -> int:
        out = self._fs.create(self._path(f"{self.path}/_new{version}"), True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(self._path(f"{self.path}/_new{version}"), self._path(f"{self.path}/_manifest{version}")):
            raise RuntimeError(f"version {version} was written by another process")
        return version

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _written(self, rows: DataFrame, version: int) -> dict[str, list[str]]:
        """Writes rows below the folder of a version; {bucket: [folder]}."""
        bucketed = rows.withColumn("_bucket", self._bucket())
        bucketed.hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/v{version}")
        folders = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/v{version}"))]
        return {n[8:]: [f"v{version}/{n}"] for n in folders if n.startswith("_bucket=")}

    def _read(self, folders: Sequence[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(*(f"{self.path}/{f}" for f in folders))

    def read(self, version: int | None = None) -> DataFrame:
        return self._read([f for held in self.manifest(version)["folders"].values() for f in held])

    def write(self, rows: DataFrame) -> int:
        """A version that holds just these rows."""
        n = self.version() + 1
        return self._publish(n, {"folders": self._written(rows, n), "marks": self.manifest(n - 1)["marks"]})

    def merge(self, changes: DataFrame, mark: str | None = None, **how) -> int:
        """Upserts changes by the table's keys; buckets without a change stay as they are. A mark that was merged before changes nothing."""
        n = self.version()
        before = self.manifest(n)
        if mark is not None and mark in before["marks"]:
            return n
        touched = [str(r["b"]) for r in changes.select(self._bucket().alias("b")).distinct().collect()]  # at most `buckets`
        held = [f for b in touched for f in before["folders"].get(b, [])]
        rows = upsert(self._read(held) if held else changes.limit(0), changes, self.keys, **how)
        return self._publish(n + 1, {"folders": before["folders"] | self._written(rows, n + 1), "marks": before["marks"] + ([mark] if mark is not None else [])})

    def append(self, rows: DataFrame) -> int:
        """A version with more rows, without reading those that are there; columns that differ are merged on reading."""
        n = self.version()
        before, added = self.manifest(n), self._written(rows, n + 1)
        return self._publish(n + 1, {"folders": before["folders"] | {b: before["folders"].get(b, []) + f for b, f in added.items()}, "marks": before["marks"]})
