"""A key-value store in sorted runs on shared storage, with levels that are compacted as they fill."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kv

SCHEMA = "key STRING, value BINARY, seq BIGINT, op STRING"
_RETIRED = "_RETIRED"


class KeyValueStore:
    """Runs under path/level=<n>/<run>. Each batch of changes is a run of level 0; a level with more than level_factor ** level
    runs is merged into one run of the next. A write is durable when it returns; rows need a `seq` that orders changes.
    Values are bytes; texts are stored in UTF-8.

    Merges keep deletions, `compact` drops them. A merged run is written in full before the runs it replaces are retired, and
    holding a version twice changes no result, so a failure between the two loses nothing. Retired runs are no part of the
    store, but their files stay until the next merge, for readers that hold them in a lazy plan.
    """

    def __init__(self, spark: SparkSession, path: str, level_factor: int = 10):
        self.spark, self.path, self.level_factor = spark, path.rstrip("/"), level_factor
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _runs(self, retired: bool = False) -> dict[int, list[str]]:
        found: dict[int, list[str]] = {}
        if self._fs.exists(self._path(self.path)):
            for level in self._fs.listStatus(self._path(self.path)):
                n = int(level.getPath().getName().partition("=")[2])
                runs = [r.getPath() for r in self._fs.listStatus(level.getPath())]
                found[n] = sorted(r.toString() for r in runs if self._fs.exists(self._path(r, "_SUCCESS")) and retired == self._fs.exists(self._path(r, _RETIRED)))
        return found

    def log(self) -> DataFrame:
        """(key, value, seq, op, level) of all runs; empty for a new store."""
        parts = [self.spark.read.schema(SCHEMA).parquet(*runs).withColumn("level", F.lit(n).cast("bigint")) for n, runs in sorted(self._runs().items()) if runs]
        if not parts:
            return self.spark.createDataFrame([], SCHEMA + ", level BIGINT")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _write(self, rows: DataFrame, level: int) -> None:
        kv.write_run(rows.select("key", F.col("value").cast("binary").alias("value"), "seq", "op"), f"{self.path}/level={level}/{uuid.uuid4().hex}", "errorifexists")

    def put(self, rows: DataFrame) -> None:
        """Upserts (key, value, seq)."""
        self._write(rows.withColumn("op", F.lit("U")), 0)
        self._merge_full_levels()

    def delete(self, rows: DataFrame) -> None:
        """Deletes the keys of (key, seq)."""
        self._write(rows.select("key", F.lit(None).cast("binary").alias("value"), "seq", F.lit("D").alias("op")), 0)
        self._merge_full_levels()

    def _merge_full_levels(self) -> None:
        level = 0
        while len(runs := self._runs().get(level, [])) > self.level_factor**level:
            self._write(kv.newest(self.spark.read.schema(SCHEMA).parquet(*runs)), level + 1)
            self._retire(runs)
            level += 1

    def _retire(self, runs: Sequence[str]) -> None:
        """Takes runs out of the store; the files of those retired before go now."""
        for r in (r for of in self._runs(retired=True).values() for r in of):
            self._fs.delete(self._path(r), True)
        for r in runs:
            self._fs.create(self._path(f"{r}/{_RETIRED}"), True).close()

    def compact(self) -> None:
        """Everything into one run of the lowest level in use, deletions dropped."""
        runs = self._runs()
        old = [r for of in runs.values() for r in of]
        if old:
            self._write(kv.latest(self.log()).withColumn("op", F.lit("U")), max(runs))
            self._retire(old)

    def get(self, key: str) -> DataFrame:
        return kv.get(self.log(), key)

    def multi_get(self, keys: Sequence[str] | DataFrame) -> DataFrame:
        return kv.multi_get(self.log(), keys)

    def range(self, start: str, end: str) -> DataFrame:
        return kv.key_range(self.log(), start, end)

    def scan(self) -> DataFrame:
        return kv.scan(self.log())

    def report_stats(self) -> DataFrame:
        """(level, n_runs, n_bytes, n_entries, n_keys, n_deletes) of each level that has a run."""
        files = [(n, len(runs), sum(self._fs.getContentSummary(self._path(r)).getLength() for r in runs)) for n, runs in self._runs().items() if runs]
        return self.spark.createDataFrame(files, "level long, n_runs int, n_bytes long").join(kv.stats(self.log()), "level")

    def cleanup(self) -> None:
        """Removes all runs."""
        self._fs.delete(self._path(self.path), True)
