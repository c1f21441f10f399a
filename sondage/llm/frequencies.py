"""Problem 1: how often every distinct term occurs, and in how many records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def term_frequencies(counts: DataFrame, n_records: Column, rare_below: int = 3, common_above: float = 0.25) -> DataFrame:
    """(term, occurrences, records, mark) from per-record term counts (term, tf; one row for each term and record).

    Counts combine by hash in each task before the one shuffle on the term. mark is 'rare' for a term of fewer than
    `rare_below` records, 'common' for one of more than the share `common_above` of `n_records`, else NULL; 'rare' goes
    first where both hold. Every term comes out. NULL terms and counts are left out; no rows in, no rows out.
    """
    sums = counts.where("term IS NOT NULL AND tf IS NOT NULL").groupBy("term").agg(F.sum(F.col("tf").cast("long")).alias("occurrences"), F.count(F.lit(1)).alias("records"))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(common_above) * n_records, "common")
    return sums.select("term", "occurrences", "records", mark.alias("mark"))


def text_term_frequencies(texts: DataFrame, tokens: Column, n_records: Column, rare_below: int = 3, common_above: float = 0.25) -> DataFrame:
    """The same from texts with one row for each record: `tokens` is an array column, NULL and empty arrays give nothing.

    A record's tokens are sorted inside the row, so the first of each run stands for the record; a single shuffle follows,
    that of the partial sums.
    """
    ordered = texts.select(F.array_sort(tokens).alias("t")).where(F.size("t") > 0)
    flagged = F.transform("t", lambda x, i: F.struct(x.alias("term"), ((i == 0) | (F.get("t", i - 1) != x)).alias("first")))
    each = ordered.select(F.explode(flagged).alias("x")).select("x.term", "x.first")
    sums = each.where("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("occurrences"), F.count_if("first").alias("records"))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(common_above) * n_records, "common")
    return sums.select("term", "occurrences", "records", mark.alias("mark"))
