"""A versioned key-value store over an append-only log (key, value, seq, op), op 'U' for put and 'D' for delete."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import sort_key, sort_key_literal


def newest(log: DataFrame) -> DataFrame:
    """(key, value, seq, op): the version of largest seq of each key, deletions included. Equal seq: a deletion holds, then the larger value. NULL keys are left out."""
    rank = F.struct("seq", (F.col("op") == "D").alias("gone"), "value")
    best = log.where(F.col("key").isNotNull()).groupBy("key").agg(F.max(rank).alias("v"))
    return best.select("key", "v.value", "v.seq", F.when(F.col("v.gone"), "D").otherwise("U").alias("op"))


def latest(log: DataFrame) -> DataFrame:
    """(key, value, seq) of the living keys: what a full compaction keeps."""
    return newest(log).where("op <> 'D'").select("key", "value", "seq")


def get(log: DataFrame, key: str) -> DataFrame:
    """(key, value) of one key, nothing if it is missing or deleted; the comparison reaches the scan."""
    return latest(log.where(F.col("key") == key)).select("key", "value")


def multi_get(log: DataFrame, keys: Sequence[str] | DataFrame) -> DataFrame:
    """(key, value) of many keys: a list goes into the scan's filter, a table (key) is semi-joined before versions are compared."""
    rows = log.join(keys.select("key"), "key", "left_semi") if isinstance(keys, DataFrame) else log.where(F.col("key").isin(list(keys)) if keys else F.lit(False))
    return latest(rows).select("key", "value")


def key_range(log: DataFrame, start: str, end: str) -> DataFrame:
    """(key, value) from start to end, both included, in key order."""
    k = sort_key(F.col("key"))
    rows = log.where((k >= sort_key_literal(start)) & (k <= sort_key_literal(end)))
    return latest(rows).select("key", "value").orderBy(sort_key(F.col("key")), "key")


def scan(log: DataFrame) -> DataFrame:
    """(key, value) of all living keys in key order, numeric keys first."""
    return latest(log).select("key", "value").orderBy(sort_key(F.col("key")), "key")


def stats(log: DataFrame, level: str = "level") -> DataFrame:
    """(level, n_entries, n_keys, n_deletes) of each level, versions and deletions included in n_entries."""
    return log.groupBy(level).agg(F.count(F.lit(1)).alias("n_entries"), F.count_distinct("key").alias("n_keys"), F.count_if(F.col("op") == "D").alias("n_deletes"))


def write_run(rows: DataFrame, path: str, mode: str = "append") -> None:
    """A sorted run: range-partitioned and sorted by key order, with a Bloom filter on the key, so lookups skip files and row groups."""
    k = sort_key(F.col("key"))
    ordered = rows.repartitionByRange(k).sortWithinPartitions(k, "key")
    ordered.write.mode(mode).option("parquet.bloom.filter.enabled#key", "true").parquet(path)


def compact(log: DataFrame, path: str, full: bool = True) -> None:
    """Newest version of each key into one sorted run at a new path; a full compaction drops deleted keys, others must keep the deletions."""
    rows = latest(log).withColumn("op", F.lit("U")) if full else newest(log)
    write_run(rows, path, "overwrite")
