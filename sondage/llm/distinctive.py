"""Problem 3: how distinctive each term is of its record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import smoothed_idf, term_weight
from ..operators.hotkeys import heavy_keys, join_key_stats
from ..operators.postings import clean_postings, latest_tf

#: Parts over which the rows of a hot term are spread.
HOT_PARTS = 1024


def weighted_terms(log: DataFrame, n_records: Column, hot_share: float = 0.001) -> DataFrame:
    """(term, doc_id, tf, df, term_tokens, weight) of the current postings of a log (term, doc_id, tf, seq).

    weight = (1 + ln tf) * (ln((N+1)/(df+1)) + 1). The log is shuffled once, by term and part: terms of at least `hot_share`
    of its rows, 1/hot_share of them at most, have HOT_PARTS parts, the others one. In that partitioning newest rows are found
    and the terms' statistics come back: those of hot terms by broadcast, those of the others by (term, part), so beside
    the log only partial counts move.
    """
    clean = clean_postings(log)
    hot = heavy_keys(clean, "term", hot_share).select("term")
    flagged = clean.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "term", "left")
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64("doc_id"), F.lit(HOT_PARTS)).cast("int") + 1).otherwise(0)
    current = latest_tf(flagged.withColumn("_part", part).drop("_hot").repartition(F.col("term"), F.col("_part")), "term", "_part", "doc_id")
    by_term = current.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.col("tf").cast("long")).alias("term_tokens"))
    stats = F.struct("df", "term_tokens")
    of_hot = by_term.join(F.broadcast(hot), "term", "left_semi").select("term", stats.alias("_hot"))
    # 0, but no literal: the optimizer would take one out of the join's keys, and hot terms would meet in one task
    zero = F.pmod("df", F.lit(1)).cast("int").alias("_part")
    of_cold = by_term.join(F.broadcast(hot), "term", "left_anti").select("term", zero, stats.alias("_cold"))
    joined = current.join(F.broadcast(of_hot), "term", "left").join(of_cold, ["term", "_part"], "left").withColumn("_s", F.coalesce("_hot", "_cold"))
    weight = term_weight(F.col("tf")) * smoothed_idf(n_records, F.col("_s.df"))
    return joined.select("term", "doc_id", "tf", F.col("_s.df").alias("df"), F.col("_s.term_tokens").alias("term_tokens"), weight.alias("weight"))


def distinctive_terms(weighted: DataFrame, prior_size: float = 1000.0, hot_share: float = 0.001) -> DataFrame:
    """Log-odds ratio of record versus rest with an informative Dirichlet prior, as z-scores, beside tf-idf weights.

    weighted: rows of `weighted_terms`. Out comes one row for each of them with
    doc_id, term, tf, df, terms (of the record), weight, norm, log_odds, z. With y the count of the term in the record, r
    its count elsewhere, n and m the tokens of the record and elsewhere, and a = prior_size * (y + r) / (n + m) the
    prior of the term from the collection, a0 = prior_size:
        log_odds = ln((y + a) / (n + a0 - y - a)) - ln((r + a) / (m + a0 - r - a)), z = log_odds / sqrt(1/(y + a) + 1/(r + a)).
    NULL where a record or the rest has the term only, in a collection of a single term. norm = root of the sum of squared
    weights of the record. An empty table gives an empty result.

    Sums of records are algebraic and combine before their shuffle; they come back by `join_key_stats`: those of hot
    records (at most 1/hot_share) by broadcast, the rest by shuffle.
    """
    by_record = weighted.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("terms"), F.sum(F.col("tf").cast("long")).alias("_n"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")
    )
    rows = join_key_stats(weighted, by_record, "doc_id", "terms", hot_share)
    total = by_record.agg(F.sum("_n").alias("n")).scalar()
    y, n, r, m = F.col("tf").cast("double"), F.col("_n").cast("double"), (F.col("term_tokens") - F.col("tf")).cast("double"), (total - F.col("_n")).cast("double")
    # of + a0 - hits - a with a0 - a taken from whole numbers, so that it is 0 for a single term only, however large the counts
    a, others = F.lit(prior_size) * F.col("term_tokens") / total, F.lit(prior_size) * (total - F.col("term_tokens")) / total

    def odds(hits: Column, of: Column) -> Column:
        rest = of - hits + others
        return F.when(rest > 0, F.log((hits + a) / rest))

    log_odds = odds(y, n) - odds(r, m)
    z = F.col("log_odds") / F.sqrt(1 / (y + a) + 1 / (r + a))
    return rows.withColumn("log_odds", log_odds).withColumn("z", z).select("doc_id", "term", "tf", "df", "terms", "weight", "norm", "log_odds", "z")


def dominant_terms(weighted: DataFrame, share: float = 0.9, min_terms: int = 4) -> DataFrame:
    """(doc_id, term) of `weighted_terms` rows whose weight is at least `share` of the record's norm, in records of at least `min_terms` terms.

    The rows are those of `distinctive_terms`: each term of each record is scored, log-odds and z included, then chosen by weight.
    z chooses none, for the share isn't a function of it: a term that few records repeat very often can dominate one record and
    yet be rarer there than elsewhere. But what comes out has been scored. That loses no row: z is NULL only in a collection of
    a single term, where a record has that one term. With a share above the root of 1/2 no two terms of a record can have it;
    smaller shares are an error.
    """
    if share <= 0.5**0.5:
        raise ValueError(f"share must exceed the root of 1/2, not {share}")
    scored = F.col("z").isNotNull() | (F.col("terms") == 1)
    found = distinctive_terms(weighted).where(scored & (F.col("terms") >= min_terms) & (F.col("weight") >= F.lit(share) * F.col("norm")))
    return found.select("doc_id", "term")
