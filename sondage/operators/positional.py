"""Positions of terms and exact phrases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def positional_postings(tokens: DataFrame) -> DataFrame:
    """(term, doc_id, positions, tf), positions in order."""
    return tokens.groupBy("term", "doc_id").agg(F.array_sort(F.collect_list("pos")).alias("positions"), F.count(F.lit(1)).cast("int").alias("tf"))


def tokens_of(postings: DataFrame) -> DataFrame:
    """(doc_id, pos, term) from (term, doc_id, positions): a comparison of terms still reaches the scan. Repeated positions count once."""
    return postings.select("doc_id", "term", F.explode(F.array_distinct("positions")).alias("pos")).select("doc_id", "pos", "term")


def get_positions(tokens: DataFrame, term: str, doc_id: int | None = None) -> DataFrame:
    """(doc_id, pos) of a term, of one record or of all."""
    hits = tokens.where(F.col("term") == term)
    return (hits if doc_id is None else hits.where(F.col("doc_id") == doc_id)).select("doc_id", "pos")


def phrase_positions(tokens: DataFrame, phrase: Sequence[str]) -> DataFrame:
    """(doc_id, start) of every occurrence of the terms in a row, overlapping ones included; none for an empty phrase.

    A term at offset o of the phrase and position p of a record votes for start p - o; a start with as many votes as
    the phrase has terms is a hit. Only rows of the phrase's terms leave the scan; one shuffle, by record and start.
    """
    terms = list(phrase)
    offsets: dict[str, list[int]] = {}
    for o, t in enumerate(terms):
        offsets.setdefault(t, []).append(o)
    hits = tokens.where(F.col("term").isin(list(offsets)) if terms else F.lit(False))
    votes = F.lit(None).cast("array<int>")
    for t, at in offsets.items():
        votes = F.when(F.col("term") == t, F.array(*[F.lit(o) for o in at])).otherwise(votes)
    starts = hits.select("doc_id", "pos", F.explode(votes).alias("o")).select("doc_id", (F.col("pos") - F.col("o")).alias("start")).where("start >= 0")
    return starts.groupBy("doc_id", "start").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(terms)).select("doc_id", "start")


def phrase_batch(tokens: DataFrame, phrases: Sequence[tuple[int, Sequence[str]]]) -> DataFrame:
    """(query_id, doc_id, start) for a batch of phrases given on the driver: the same votes, the batch joined by term."""
    rows = [(int(q), t, o, len(p)) for q, p in phrases for o, t in enumerate(p)]
    batch = tokens.sparkSession.createDataFrame(rows, "query_id long, term string, o int, size int")
    votes = tokens.join(batch, "term").select("query_id", "size", "doc_id", (F.col("pos") - F.col("o")).alias("start")).where("start >= 0")
    return votes.groupBy("query_id", "size", "doc_id", "start").agg(F.count(F.lit(1)).alias("n")).where("n = size").select("query_id", "doc_id", "start")


def search_phrase(tokens: DataFrame, phrase: Sequence[str]) -> DataFrame:
    """(doc_id) that have the phrase."""
    return phrase_positions(tokens, phrase).select("doc_id").distinct()


def count_phrase(tokens: DataFrame, phrase: Sequence[str]) -> DataFrame:
    """(doc_id, cnt): occurrences of the phrase, overlapping ones included."""
    return phrase_positions(tokens, phrase).groupBy("doc_id").agg(F.count(F.lit(1)).alias("cnt"))
