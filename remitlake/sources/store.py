"""A keyed store on files: an append-only log of versions, with manifests that are committed one by one.

A write puts its rows into a folder of its own name and then renames its manifest to that of the next
version, which fails if another writer was first; it then takes the version after. A reader sees the
manifests only, so folders of unfinished writes do not count, whether a task, an executor or the driver was lost. The last set or remove of a (batch, key)
holds, unless its batch was cleared later. :meth:`compact` writes the state as a new base; older
versions stay readable. A rename must not replace a file, as on HDFS; on a local disk, for tests, the
look for the target and the rename are two steps.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "batch string, key string, value string, op string, seq long"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _manifests(self) -> list[dict]:
        """The committed versions in order; they carry folder names, not rows."""
        folder = self._at("manifests")
        if not self._fs.exists(folder):
            return []
        out = []
        for status in self._fs.listStatus(folder):
            if status.getPath().getName().endswith(".json"):
                stream = self._fs.open(status.getPath())
                out.append(json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8") or "{}"))
                stream.close()
        return sorted((m for m in out if m), key=lambda m: m["version"])

    def version(self) -> int:
        found = self._manifests()
        return found[-1]["version"] if found else 0

    def _commit(self, folder: str, base: bool, of: int | None = None) -> int:
        """``of``: the version that a base holds the state of; it is given up if another write came since."""
        while True:
            version = self.version() + 1
            if of is not None and version != of + 1:
                return 0
            # written aside and renamed, so that a manifest is whole or absent; a rename does not replace
            aside, target = self._at(f"manifests/{folder}.tmp"), self._at(f"manifests/{version:012d}.json")
            stream = self._fs.create(aside, True)
            stream.write(bytearray(json.dumps({"version": version, "folder": folder, "base": base}).encode()))
            stream.close()
            if not self._fs.exists(target) and self._fs.rename(aside, target):
                return version
            self._fs.delete(aside, False)

    def _append(self, rows: DataFrame, base: bool = False, of: int | None = None) -> int:
        folder = uuid.uuid4().hex
        rows.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in ROW.split(", ")]).write.parquet(f"{self.path}/data/{folder}")
        return self._commit(folder, base, of)

    def upsert(self, rows: DataFrame) -> int:
        """Sets (batch, key, value); of rows with one key in one write the highest ``seq`` holds."""
        return self._append(rows.withColumn("op", F.lit("set")))

    def remove(self, rows: DataFrame) -> int:
        """Removes (batch, key)."""
        return self._append(rows.withColumns({"op": F.lit("remove"), "value": F.lit(None), "seq": F.lit(0)}))

    def clear(self, batches: DataFrame) -> int:
        """Removes all keys of (batch)."""
        return self._append(batches.withColumns({"op": F.lit("clear"), "key": F.lit(None), "value": F.lit(None), "seq": F.lit(0)}))

    def history(self, upto: int | None = None) -> DataFrame:
        """The rows that make up the state of version ``upto``, with their version; from the last base on."""
        found = [m for m in self._manifests() if upto is None or m["version"] <= upto]
        first = max((k for k, m in enumerate(found) if m["base"]), default=0)
        out = self.spark.createDataFrame([], f"{ROW}, version long")
        for m in found[first:]:
            out = out.unionByName(self.spark.read.schema(ROW).parquet(f"{self.path}/data/{m['folder']}").withColumn("version", F.lit(m["version"]).cast("long")))
        return out

    def load(self, upto: int | None = None) -> DataFrame:
        """(batch, key, value) of the latest version, or as of ``upto``."""
        rows = self.history(upto)
        last = rows.where("op <> 'clear'").groupBy("batch", "key").agg(F.max(F.struct("version", "seq", "op", "value")).alias("x"))
        cleared = rows.where("op = 'clear'").groupBy("batch").agg(F.max("version").alias("__cleared"))
        kept = last.join(cleared, "batch", "left").where(F.coalesce(F.col("x.version") > F.col("__cleared"), F.lit(True)) & (F.col("x.op") == "set"))
        return kept.select("batch", "key", "x.value")

    def compact(self) -> int:
        """Writes the state as a base; 0 if another write was committed meanwhile."""
        now = self.version()
        return self._append(self.load(now).withColumns({"op": F.lit("set"), "seq": F.lit(0)}), True, now)
