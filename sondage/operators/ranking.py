"""TF-IDF ranking: statistics, exact and tiered top-k, for single queries and batches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.analysis import Analyzer, token_table
from ..functions.terms import smoothed_idf, term_weight
from ..sources.store import load_table, save_table
from .hotkeys import join_key_stats
from .limits import first_per_group, numbered_heads


#: How many records of each term a stored index keeps in order of weight.
RANKED_DEPTH = 1024


@dataclass(frozen=True)
class RankedIndex:
    """The tables of a ranked index: lazy, or read back from where they were saved.

    stats (term, df, idf); weights (term, doc_id, tf, df, idf, w[, rn]); norms (doc_id, length, norm[, vector]). Saved
    tables have `rn`, the place of a record among the RANKED_DEPTH heaviest of its term, and `vector`, the weights of
    a record by term: inexact search reads the heads of its terms and the vectors of its candidates alone.
    """

    stats: DataFrame
    weights: DataFrame
    norms: DataFrame
    ids: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, analyzer: Analyzer) -> RankedIndex:
        return cls.of_counts(docs, term_counts(docs, analyzer))

    @classmethod
    def of_counts(cls, docs: DataFrame, counts: DataFrame) -> RankedIndex:
        n = document_count(docs)
        weights = term_weights(counts, n)
        return cls(term_stats(counts, n), weights, doc_stats(docs, weights), docs.select("doc_id").distinct())

    @property
    def saved(self) -> bool:
        return "rn" in self.weights.columns and "vector" in self.norms.columns

    def save(self, path: str) -> None:
        """Writes the three tables: by term and place, by term, and by record. What is computed once is read back for the rest."""
        ranked = numbered_heads(self.weights, "term", _heaviest(), F.col("doc_id"), RANKED_DEPTH, "rn")
        save_table(ranked, path, "weights", sort=(F.col("term"), F.col("rn").asc_nulls_last(), F.col("doc_id")))
        weights = load_table(self.weights.sparkSession, path, "weights")
        save_table(weights.groupBy("term", "df", "idf").count(), path, "terms")
        vector = F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("vector")
        save_table(self.ids.join(weights.groupBy("doc_id").agg(*_sums(), vector), "doc_id", "left").fillna(0, ["length", "norm"]), path, "vectors")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RankedIndex:
        stats, weights, norms = (load_table(spark, path, t) for t in ("terms", "weights", "vectors"))
        return cls(stats, weights, norms, norms.select("doc_id"))

    def of_terms(self, terms: Sequence[str]) -> RankedIndex:
        """The same with the rows of these terms only; the comparison reaches the scan of saved tables."""
        wanted = F.col("term").isin(list(terms)) if terms else F.lit(False)
        return RankedIndex(self.stats.where(wanted), self.weights.where(wanted), self.norms, self.ids)


def term_counts(docs: DataFrame, analyzer: Analyzer) -> DataFrame:
    """(term, doc_id, tf)."""
    return token_table(docs, analyzer).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def document_count(docs: DataFrame) -> Column:
    """Number of records, those without terms included, as a scalar subquery."""
    return docs.agg(F.count_distinct("doc_id").alias("n")).scalar()


def term_stats(counts: DataFrame, n_docs: Column) -> DataFrame:
    """(term, df, idf): records with the term; ln((N+1)/(df+1)) + 1."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", smoothed_idf(n_docs, F.col("df")))


def term_weights(counts: DataFrame, n_docs: Column) -> DataFrame:
    """(term, doc_id, tf, df, idf, w) with w = (1 + ln tf) * idf. Statistics of hot terms come by broadcast, others by shuffle."""
    joined = join_key_stats(counts.where("tf > 0"), term_stats(counts.where("tf > 0"), n_docs), "term", "df")
    return joined.select("term", "doc_id", "tf", "df", "idf", (term_weight(F.col("tf")) * F.col("idf")).alias("w"))


def _sums() -> list[Column]:
    return [F.sum("tf").alias("length"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")]


def doc_stats(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """(doc_id, length, norm): number of terms, and root of the sum of squared weights; 0 for records without terms."""
    sums = weights.groupBy("doc_id").agg(*_sums())
    return docs.select("doc_id").distinct().join(sums, "doc_id", "left").fillna(0, ["length", "norm"])


def query_table(like: DataFrame, queries: Sequence[tuple[int, str]], analyzer: Analyzer) -> DataFrame:
    """(query_id, term, tp, qtf) for a batch of queries given on the driver: each distinct term with its first place and number of uses."""
    rows = []
    for q, text in queries:
        terms = analyzer.of_query(text)
        rows += [(int(q), t, terms.index(t), terms.count(t)) for t in dict.fromkeys(terms)]
    return like.sparkSession.createDataFrame(rows, "query_id long, term string, tp int, qtf int")


def queries_of_table(queries: DataFrame, analyzer: Analyzer) -> DataFrame:
    """The same from a table (query_id, query)."""
    terms = queries.select("query_id", F.posexplode(analyzer.terms(F.col("query"))).alias("tp", "term"))
    return terms.groupBy("query_id", "term").agg(F.min("tp").alias("tp"), F.count(F.lit(1)).cast("int").alias("qtf"))


def score(queries: DataFrame, weights: DataFrame, norms: DataFrame | None = None, stats: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, dot[, cosine]) of the records with at least one known query term.

    dot is the product of query and record weights. With `norms` (doc_id, norm) and `stats` (term, idf) cosine is dot divided by
    both norms, and records of norm 0 are left out. Unknown terms are dropped, from the query's norm too. `candidates`
    (query_id, doc_id) restricts the records.
    """
    asked = queries.select("query_id", "term", "qtf")
    hits = asked.join(weights.select("term", "doc_id", "idf", "w"), "term").withColumn("wq", term_weight(F.col("qtf")) * F.col("idf"))
    if candidates is not None:
        hits = hits.join(candidates, ["query_id", "doc_id"], "left_semi")
    dots = hits.groupBy("query_id", "doc_id").agg(F.sum(F.col("wq") * F.col("w")).alias("dot"))
    if norms is None:
        return dots
    known = asked.join(stats.select("term", "idf"), "term").withColumn("wq", term_weight(F.col("qtf")) * F.col("idf"))
    by_query = known.groupBy("query_id").agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("qnorm"))
    scored = dots.join(norms.select("doc_id", "norm").where("norm > 0"), "doc_id").join(by_query, "query_id")
    return scored.select("query_id", "doc_id", "dot", (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("cosine"))


def top_k(scored: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best of each query by score rounded to `digits`, then doc_id. k of 0 gives nothing; a negative k is an error.

    In two stages, so that the hits of one query aren't sorted in one task, whatever k is.
    """
    if k < 0:
        raise ValueError(f"k must not be negative: {k}")
    rounded = scored.select("query_id", "doc_id", F.round("score", digits).alias("score"))
    return first_per_group(rounded, "query_id", [F.col("score").desc(), F.col("doc_id")], F.col("doc_id"), k, "rank")


def top_k_of_each(scored: DataFrame, ks: DataFrame, digits: int = 9) -> DataFrame:
    """The same with a k for each query, from ks (query_id, top_k), one row for each query. NULL counts as 0.

    The largest k limits the rows, then each query's own. A job over `ks` alone runs for it.
    """
    most = ks.agg(F.max("top_k")).first()[0] or 0
    best = top_k(scored, max(most, 0), digits)
    return best.join(ks.select("query_id", "top_k"), "query_id").where("rank <= top_k").drop("top_k")


def _heaviest() -> list[Column]:
    return [F.round("w", 12).desc(), F.col("doc_id")]


def tiers(weights: DataFrame, champions: int = 8, tier: int = 8) -> DataFrame:
    """(term, doc_id, w, rn, tier): 'hot' for the `champions` heaviest records of a term, 'warm' for the next `tier`, 'cold' for the rest (rn NULL).

    Order: weight descending, doc_id. A hot term is ranked in salted parts, and what isn't among the first of its part is
    cold where it lies.
    """
    placed = numbered_heads(weights.select("term", "doc_id", "w"), "term", _heaviest(), F.col("doc_id"), champions + tier, "rn")
    return placed.withColumn("tier", F.when(F.col("rn") <= champions, "hot").when(F.col("rn").isNotNull(), "warm").otherwise("cold"))


def ranked_postings(weights: DataFrame, most: int) -> DataFrame:
    """(term, doc_id, w, rn): the first `most` records of each term by weight rounded to 12 digits, then doc_id. Saved places are read, not computed, as far as they go."""
    if "rn" in weights.columns and most <= RANKED_DEPTH:
        return weights.where(F.col("rn") <= most).select("term", "doc_id", "w", "rn")
    return first_per_group(weights.select("term", "doc_id", "w"), "term", _heaviest(), F.col("doc_id"), most, "rn")


def inexact_candidates(queries: DataFrame, weights: DataFrame, k: int, champions: int = 8, tier: int = 8) -> DataFrame:
    """(query_id, doc_id): all hot records of the query's terms; if fewer than k, the warm ones too; if still fewer, cold ones in
    order of term and rank until max(3k, champions + tier) are reached.

    Decided by counts within the plan, without a trip to the driver. No more of a term's ranking is needed than the first
    champions + tier + 2 * max(3k, champions + tier) records.
    """
    target = max(3 * k, champions + tier)
    terms = queries.select("query_id", "term", "tp")
    wanted = weights if "rn" in weights.columns else weights.join(terms.select("term").distinct(), "term", "left_semi")
    ranked = ranked_postings(wanted, champions + tier + 2 * target)
    step = F.when(F.col("rn") <= champions, 0).when(F.col("rn") <= champions + tier, 1).otherwise(2)
    each = terms.join(ranked, "term").groupBy("query_id", "doc_id").agg(F.min(step).alias("step"), F.min(F.struct("tp", "rn")).alias("place"))
    by_query = W.partitionBy("query_id")
    counted = each.withColumn("hot", F.count_if(F.col("step") == 0).over(by_query)).withColumn("near", F.count_if(F.col("step") <= 1).over(by_query))
    order = F.row_number().over(by_query.orderBy(F.col("step") > 1, "place", "doc_id"))
    chosen = F.when(F.col("hot") >= k, F.col("step") == 0).when(F.col("near") >= k, F.col("step") <= 1).otherwise((F.col("step") <= 1) | (F.col("_order") <= target))
    return counted.withColumn("_order", order).where(chosen).select("query_id", "doc_id")


def score_vectors(queries: DataFrame, vectors: DataFrame, stats: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, doc_id, dot, cosine) of the candidates (query_id, doc_id), from the records' saved vectors.

    `candidates` is collected: its size is bounded by the query's terms and k, not by the data. So their ids reach the scan of
    the vectors, which are in order of doc_id.
    """
    spark = vectors.sparkSession
    pairs = [(r["query_id"], r["doc_id"]) for r in candidates.collect()]
    chosen = spark.createDataFrame(pairs, "query_id long, doc_id long")
    rows = vectors.where(F.col("doc_id").isin(sorted({d for _, d in pairs})) if pairs else F.lit(False)).select("doc_id", "norm", F.explode("vector").alias("term", "w"))
    known = queries.select("query_id", "term", "qtf").join(F.broadcast(stats.select("term", "idf")), "term").withColumn("wq", term_weight(F.col("qtf")) * F.col("idf"))
    by_query = known.groupBy("query_id").agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("qnorm"))
    hits = rows.join(F.broadcast(chosen), "doc_id").join(F.broadcast(known), ["query_id", "term"])
    dots = hits.groupBy("query_id", "doc_id", "norm").agg(F.sum(F.col("wq") * F.col("w")).alias("dot"))
    return dots.where("norm > 0").join(F.broadcast(by_query), "query_id").select("query_id", "doc_id", "dot", (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("cosine"))


def search(index: RankedIndex, queries: DataFrame, k: int, model: str | None = "vector", inexact: bool = False, champions: int = 8, tier: int = 8) -> DataFrame:
    """Ranked search of a batch of queries. model 'tfidf' scores by dot product, anything else by cosine; `inexact` scores only
    tiered candidates, over saved tables without reading their terms' postings."""
    measure = "dot" if model == "tfidf" else "cosine"
    chosen = inexact_candidates(queries, index.weights, k, champions, tier) if inexact else None
    if inexact and index.saved:
        scored = score_vectors(queries, index.norms, index.stats, chosen)
    elif measure == "dot":
        scored = score(queries, index.weights, candidates=chosen)
    else:
        scored = score(queries, index.weights, index.norms, index.stats, chosen)
    return top_k(scored.withColumnRenamed(measure, "score"), k)
