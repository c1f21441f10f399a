"""The current state of an append-only posting log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import normal_term

_TF_SPAN = 1 << 32  # one tf (32 bits) fits below each seq in the packed order key
_TF_SHIFT = 1 << 31


def _packed(seq: Column, tf: Column) -> Column:
    """seq and tf as one decimal that orders by seq, then tf. A decimal's aggregation buffer can be changed in place, so the maximum stays a hash aggregate; a struct's would need a sort."""
    return F.coalesce(seq, F.lit(-(1 << 63))).cast("decimal(20,0)") * F.lit(_TF_SPAN).cast("decimal(10,0)") + (tf.cast("long") + _TF_SHIFT).cast("decimal(10,0)")


def clean_postings(log: DataFrame) -> DataFrame:
    """Usable rows of the log: (term, doc_id, tf, seq) with the term in normal form. Rows with a NULL or blank term, NULL tf or NULL doc_id are no postings."""
    return log.select(normal_term(F.col("term")).alias("term"), "doc_id", "tf", "seq").where("term IS NOT NULL AND tf IS NOT NULL AND doc_id IS NOT NULL")


def latest_tf(clean: DataFrame, *keys: str) -> DataFrame:
    """(keys, tf): of each key the tf of its largest seq, kept if positive."""
    newest = clean.groupBy(*keys).agg(F.max(_packed(F.col("seq"), F.col("tf"))).alias("_newest"))
    tf = (F.pmod(F.col("_newest"), F.lit(_TF_SPAN).cast("decimal(10,0)")).cast("long") - _TF_SHIFT).cast("int")
    return newest.select(*keys, tf.alias("tf")).where("tf > 0")


def current_postings(log: DataFrame) -> DataFrame:
    """(term, doc_id, tf): of each term and record the row with the largest seq, kept if its tf is positive.

    One shuffle on (term, doc_id): a term that holds a third of the log still spreads over all tasks. Rows of equal seq
    that differ in tf: the larger tf holds. A NULL seq counts as older than any other. Other columns are ignored; an
    empty log gives an empty result.
    """
    return latest_tf(clean_postings(log), "term", "doc_id")


def record_count(records: DataFrame) -> Column:
    """Number of distinct doc_id of a table as a scalar subquery: one row in the plan, nothing collected."""
    return records.agg(F.count_distinct("doc_id").alias("n")).scalar()
