"""The tables of a store as versions: a manifest names the folder of each table.

Folders are written once and never changed, so a change writes only the tables it
touches; the new manifest takes over the folders of the others. A manifest is created
exclusively under the next version's number: of two writers that began from the same
version one gets it, the other a ``Conflict`` and begins again. All paths go through
Hadoop's file system, so a store can lie in any folder that the executors share.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has published this version."""


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.at = jvm.org.apache.hadoop.fs.Path
        self.fs = self.at(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> tuple[int, dict[str, str]]:
        """The last version and its folders; one that is still being written does not count."""
        if not self.fs.exists(self.at(self.root)):
            return 0, {}
        names = [s.getPath().getName() for s in self.fs.listStatus(self.at(self.root))]
        for version in sorted((int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json") and n[9:-5].isdigit()), reverse=True):
            rows = self.spark.read.text(f"{self.root}/manifest-{version}.json", wholetext=True).collect()
            try:
                return version, json.loads(rows[0][0])
            except (IndexError, ValueError):
                continue
        return 0, {}

    def read(self, folder: str | None, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}") if folder else self.spark.createDataFrame([], schema)

    def write(self, name: str, rows: DataFrame, partition_by: tuple[str, ...] = ()) -> str:
        folder = f"{name}-{uuid.uuid4().hex}"
        rows.write.partitionBy(*partition_by).parquet(f"{self.root}/{folder}")
        return folder

    def publish(self, version: int, manifest: dict[str, str]) -> None:
        path = self.at(f"{self.root}/manifest-{version}.json")
        try:
            out = self.fs.create(path, False)
        except Exception as e:
            if self.fs.exists(path):
                raise Conflict(f"version {version} is taken") from e
            raise
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that none of the last ``keep`` versions names; returns how many."""
        last, _ = self.manifest()
        live: set[str] = set()
        for version in range(max(1, last - keep + 1), last + 1):
            rows = self.spark.read.text(f"{self.root}/manifest-{version}.json", wholetext=True).collect()
            live |= set(json.loads(rows[0][0]).values())
        gone = [s.getPath() for s in self.fs.listStatus(self.at(self.root)) if s.isDirectory() and s.getPath().getName() not in live]
        for path in gone:
            self.fs.delete(path, True)
        return len(gone)
