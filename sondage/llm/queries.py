"""Queries of this folder's operators over a folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.postings import current_postings, record_count
from ..sources.tables import table
from .champions import champion_lists
from .distinctive import distinctive_terms, dominant_terms, weighted_terms
from .encodings import QUOTED, repair_texts
from .frequencies import term_frequencies
from .leakage import find_leaks
from .neighbours import nearest_vectors
from .packing import coverage, pack_texts, split_items


def _frequencies(spark: SparkSession, d: str) -> DataFrame:
    return term_frequencies(current_postings(table(spark, d, "postings")), record_count(table(spark, d, "dated_docs")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _frequencies(spark, d).where("mark IS NOT NULL").select("term", "mark")


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    return _frequencies(spark, d)


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    return weighted_terms(table(spark, d, "postings"), record_count(table(spark, d, "dated_docs")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return dominant_terms(_weighted(spark, d))


def p3_distinctive(spark: SparkSession, d: str) -> DataFrame:
    number = [F.round(c, 6).alias(c) for c in ("weight", "norm", "log_odds", "z")]
    return distinctive_terms(_weighted(spark, d)).select("doc_id", "term", "tf", "df", *number)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return champion_lists(table(spark, d, "postings")).select("term", "doc_id")


def p4_champions(spark: SparkSession, d: str) -> DataFrame:
    return champion_lists(table(spark, d, "postings"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    near = nearest_vectors(table(spark, d, "points"), "point_id", "coords", 16, 5, max_distance=1.0)
    pair = F.least("item", "neighbour").alias("point_id_a"), F.greatest("item", "neighbour").alias("point_id_b")
    return near.select(*pair).distinct()


def _neighbours(spark: SparkSession, d: str, **more) -> DataFrame:
    near = nearest_vectors(table(spark, d, "points"), "point_id", "coords", 16, 5, **more)
    return near.select(F.col("item").alias("point_id"), "neighbour", "rank", F.round("distance", 6).alias("distance"))


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d)


def p5_probed(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d, max_probes=24)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return split_items(pack_texts(table(spark, d, "documents"), "doc_id")).select(F.col("item").alias("doc_id"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_texts(table(spark, d, "documents"), "doc_id").select("container", F.col("item").alias("doc_id"), "token_from", "token_to")


def p6_coverage(spark: SparkSession, d: str) -> DataFrame:
    return coverage(pack_texts(table(spark, d, "documents"), "doc_id")).withColumnRenamed("item", "doc_id")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    layout = pack_texts(table(spark, d, "documents"), "doc_id")
    return layout.groupBy("role").agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.col("token_to") - F.col("token_from")).alias("tokens"), F.count_distinct("container").alias("containers"))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    found = find_leaks(table(spark, d, "documents"), "doc_id", table(spark, d, "eval_items"), "item_id")
    return found.select(F.col("item").alias("doc_id"), F.col("eval_item").alias("item_id"), "words")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id")


def p7_verbatim(spark: SparkSession, d: str) -> DataFrame:
    """Those leaks that hold the whole passage letter by letter."""
    texts = table(spark, d, "documents").select("doc_id", "text")
    passages = table(spark, d, "eval_items").select("item_id", "passage")
    return p7_leaks(spark, d).join(texts, "doc_id").join(passages, "item_id").where(F.contains("text", "passage")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return repair_texts(table(spark, d, "documents"), "doc_id").select(F.col("item").alias("doc_id"))


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return repair_texts(table(spark, d, "documents"), "doc_id").select(F.col("item").alias("doc_id"), "status", "chains", "restored")


def p8_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Those affected that have a replacement character outside quotation marks."""
    words = F.split("text", "[ \\n\\r\\t]+")
    marked = table(spark, d, "documents").where(F.contains(F.col("text"), F.lit("\ufffd"))).where(F.exists(words, lambda w: F.contains(w, F.lit("\ufffd")) & ~w.rlike(QUOTED)))
    return p8_found(spark, d).join(marked.select("doc_id"), "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_terms, p3_found, p3_distinctive, p4_found, p4_champions, p5_found, p5_neighbours, p5_probed, p6_found, p6_containers, p6_coverage, p6_fill, p7_found, p7_leaks, p7_verbatim, p8_found, p8_restored, p8_replaced)}
