"""A keyed table in numbered snapshots: readers see one whole state, writers replace rows by key.

A snapshot is a manifest that names a base folder and the deltas written since. An upsert writes its rows
as a delta and then claims the next manifest; once there are ``max_deltas`` of them, base and deltas are
merged to a new base. Folders are never changed, and a manifest appears whole or not at all, so a reader has
the old state or the new one, and what a broken writer leaves behind is named by nobody. Of two writers
one gets the next number; the other adds its delta to the state it then finds.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlog.sources.files import Files


class SnapshotTable:
    """Rows of ``schema``, one per ``key``: the greatest by ``order``, and among equals (or without an order) the last written.

    Without an order the rows of one upsert have different keys. A null key is a key. ``keep`` states can be read;
    those before are removed.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, key: str, order: str | None = None, max_deltas: int = 8, keep: int = 2
    ):
        self.spark, self.path, self.schema, self.key, self.order = spark, path, schema, key, order
        self.max_deltas, self.keep, self.files = max_deltas, keep, Files(spark)

    def versions(self) -> list[int]:
        return [int(n) for n in self.files.names(f"{self.path}/_manifests") if n.isdigit()]

    def _manifest(self, version: int | None = None) -> dict:
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "base": None, "deltas": []}
        return json.loads(self.files.read(f"{self.path}/_manifests/{version:012d}"))

    def read(self, version: int | None = None) -> DataFrame:
        """The newest state, or that of a version that is still kept."""
        return self._state(self._manifest(version))

    def _state(self, manifest: dict) -> DataFrame:
        folders = [f for f in (manifest["base"], *manifest["deltas"]) if f]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        rows = None
        for number, folder in enumerate(folders):
            part = self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}").withColumn("_written", F.lit(number))
            rows = part if rows is None else rows.unionAll(part)
        newest = F.struct(*([self.order] if self.order else []), "_written")
        names = self.schema.names
        return rows.groupBy(F.col(self.key).alias("_key")).agg(F.max_by(F.struct(*names), newest).alias("_row")).select("_row.*")

    def _write(self, rows: DataFrame, kind: str) -> str:
        folder = f"{kind}-{uuid.uuid4().hex}"
        # dealt by key: few rows become one file, many are spread
        rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).repartition(self.key).write.parquet(f"{self.path}/{folder}")
        return folder

    def upsert(self, rows: DataFrame) -> int:
        """Replace or add the rows' keys; returns the version that holds them."""
        delta = self._write(rows, "delta")
        while True:
            now = self._manifest()
            if self._commit(now["version"] + 1, now["base"], [*now["deltas"], delta]):
                break
        if len(now["deltas"]) + 1 >= self.max_deltas:
            self.compact()
        self._remove_old()
        return now["version"] + 1

    def compact(self) -> int:
        """Merge base and deltas to a new base; deltas that others add meanwhile stay deltas."""
        seen = self._manifest()
        base = self._write(self._state(seen), "base")
        while True:
            now = self._manifest()
            if now["base"] != seen["base"]:  # another writer has merged
                self.files.delete(f"{self.path}/{base}")
                return now["version"]
            later = [d for d in now["deltas"] if d not in seen["deltas"]]
            if self._commit(now["version"] + 1, base, later):
                return now["version"] + 1

    def _commit(self, version: int, base: str | None, deltas: list[str]) -> bool:
        text = json.dumps({"version": version, "base": base, "deltas": deltas})
        return self.files.claim(f"{self.path}/_manifests/{version:012d}", text)

    def _remove_old(self) -> None:
        """Remove states before the last ``keep`` with the folders that no kept state names."""
        versions = self.versions()
        kept, old = versions[-self.keep :], versions[: -self.keep]
        named = lambda m: {f for f in (m["base"], *m["deltas"]) if f}
        used = set().union(*(named(self._manifest(v)) for v in kept)) if kept else set()
        for version in old:
            for folder in named(self._manifest(version)) - used:
                self.files.delete(f"{self.path}/{folder}")
            self.files.delete(f"{self.path}/_manifests/{version:012d}")
