"""Problem 4 on the posting log: champion lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import term_weight
from ..operators.postings import clean_postings, latest_tf
from .topn import subgroup, subgroups_for, top_n_per_group


def champion_lists(log: DataFrame, size: int = 8, subgroups: int | Column | None = None) -> DataFrame:
    """(term, doc_id, tf, rank): the `size` heaviest current postings of every term, equal weights in order of doc_id.

    Within a term the weight (1 + ln tf) * idf orders as 1 + ln tf does, for idf is one positive number, so no
    statistics of the collection are needed. The log is partitioned once, by term and subgroup of the record: in it the
    newest row of each posting is found and the subgroups are ranked, without another shuffle; survivors alone move again.
    The number of subgroups follows from the log's size unless given. Terms with fewer postings come out whole; an empty log
    gives an empty result.
    """
    subgroups = subgroups_for(log) if subgroups is None else subgroups
    salted = clean_postings(log).withColumn("_subgroup", subgroup(F.col("doc_id"), subgroups)).repartition(F.col("term"), F.col("_subgroup"))
    current = latest_tf(salted, "term", "_subgroup", "doc_id")
    return top_n_per_group(current, "term", term_weight(F.col("tf")), "doc_id", size, subgroups, salted="_subgroup")
