"""Access to a folder of Parquet tables."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder (a single file or a directory of parts); lazily, so filters and columns reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and intermediate tables: the session's spark.checkpoint.dir.

    Where it is unset, a local master (tests) gets a folder of its own; on a cluster that is an error, for executors
    don't see each other's disks.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def spread(rows: DataFrame) -> DataFrame:
    """Rows over at least as many partitions as there are cores, for work that is heavy for its input's size.

    Only an input of fewer splits, which is small, is shuffled; a large one stays as it is read.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
