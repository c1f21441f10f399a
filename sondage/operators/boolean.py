"""Boolean retrieval over (term, doc_id) postings, with validity dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import Analyzer, token_table
from ..plans.expressions import compile_expression


def boolean_postings(docs: DataFrame, analyzer: Analyzer) -> DataFrame:
    """Distinct (term, doc_id)."""
    return token_table(docs, analyzer).select("term", "doc_id").distinct()


def merge_postings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of two posting sets without repetition."""
    return old.select("term", "doc_id").unionByName(new.select("term", "doc_id")).distinct()


def query_term(postings: DataFrame, term: str) -> DataFrame:
    """(doc_id) of one term; the comparison reaches the scan."""
    return postings.where(F.col("term") == term).select("doc_id").distinct()


def query_and(postings: DataFrame, *terms: str) -> DataFrame:
    """(doc_id) with all terms; none without terms. Equal terms count once."""
    wanted = sorted({t for t in terms if t})
    hits = postings.where(F.col("term").isin(wanted) if wanted else F.lit(False))
    return hits.groupBy("doc_id").agg(*[F.max(F.col("term") == t).alias(f"_{i}") for i, t in enumerate(wanted)] or [F.count(F.lit(1)).alias("_0")]).where(
        " AND ".join(f"_{i}" for i in range(len(wanted))) or "false"
    ).select("doc_id")


def query_or(postings: DataFrame, *terms: str) -> DataFrame:
    """(doc_id) with any of the terms; none without terms."""
    wanted = sorted(set(terms))
    return postings.where(F.col("term").isin(wanted) if wanted else F.lit(False)).select("doc_id").distinct()


def query_and_not(postings: DataFrame, term: str, other: str) -> DataFrame:
    """(doc_id) with `term` but not `other`: one aggregate over the rows of both."""
    flags = postings.where(F.col("term").isin(term, other)).groupBy("doc_id").agg(F.max(F.col("term") == term).alias("a"), F.max(F.col("term") == other).alias("b"))
    return flags.where("a AND NOT b").select("doc_id")


def query_tree(docs: DataFrame, postings: DataFrame, expression, analyzer: Analyzer, start=None, end=None, mode: str = "valid") -> DataFrame:
    """(doc_id) of the records for which the nested expression holds and, with start or end, the date filter too.

    The tree is compiled into one predicate over a flag for each distinct term and the record's dates. The flags take one
    shuffle, whatever the number of terms; records are outer-joined only if a record without any of the terms can be a hit.
    Malformed trees and dates raise ValueError here, not at run time. docs: (doc_id, start_date, end_date).
    """
    compiled = compile_expression(expression, analyzer, start, end, mode)
    records = docs.select("doc_id", *[c for c in ("start_date", "end_date") if c in docs.columns]).dropDuplicates(["doc_id"])
    if not compiled.terms:
        return records.where(compiled.predicate).select("doc_id")
    flags = (
        postings.where(F.col("term").isin(list(compiled.terms)))
        .groupBy("doc_id")
        .agg(*[F.max(F.col("term") == t).alias(name) for t, name in compiled.terms.items()])
    )
    joined = records.join(flags, "doc_id", "left" if compiled.holds_without_terms else "inner")
    return joined.fillna(False, list(compiled.terms.values())).where(compiled.predicate).select("doc_id")
