"""Index maintenance by Structured Streaming: each micro-batch appends rows, nothing is rewritten."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.analysis import Analyzer, token_table


def _run(source: DataFrame, rows_of: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    query = rows_of(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def ingest_postings(spark: SparkSession, folder: str, schema: str, analyzer: Analyzer, out: str, checkpoint: str, pattern: str = "*") -> DataFrame:
    """Indexes all documents that are new in the folder and returns the table (term, doc_id) of everything so far.

    The file sink writes each batch exactly once, whatever fails between; distinct at reading is the merge of batches.
    """
    source = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    _run(source, lambda d: token_table(d, analyzer).select("term", "doc_id"), out, checkpoint)
    return spark.read.schema("term STRING, doc_id BIGINT").parquet(out).distinct()


def ingest_log(spark: SparkSession, folder: str, schema: str, rows_of: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, pattern: str = "*") -> DataFrame:
    """Appends key-value changes (key, value, seq, op) that `rows_of` makes of new input to the log, and returns the log."""
    source = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    _run(source, rows_of, out, checkpoint)
    return spark.read.schema("key STRING, value STRING, seq BIGINT, op STRING").parquet(out)
