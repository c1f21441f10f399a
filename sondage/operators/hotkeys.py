"""Per-key results when a few keys hold most rows.

Everything here rests on two facts. Algebraic aggregates combine in bounded hash tables on the map side, so only one
partial state for each key and task is shuffled, however many rows a key has. And at most 1/share keys can hold at least
that share of all rows each, so the hot keys are a small table whatever the size of the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_aggregate(rows: DataFrame, key: str, aggregates: Sequence[Column]) -> DataFrame:
    """One row for each non-NULL key with the given algebraic aggregates (count, sum, min, max, avg, ...).

    Plan: partial hash aggregate in each task, exchange of the partial states on the key, final hash aggregate. A key
    with a third of all rows arrives as one state from each task. Rows with a NULL key are left out; an empty table gives
    an empty result. Aggregates that need all rows of a key at once (lists, exact distinct counts) don't belong here:
    count distinct values with `distinct_per_key`.
    """
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*aggregates)


def distinct_per_key(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Number of distinct non-NULL values of each key, hot keys included: duplicates go first, by (key, value), which spreads a hot key over all tasks; counts then combine as in `keyed_aggregate`."""
    pairs = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, value).distinct()
    return keyed_aggregate(pairs, key, [F.count(F.lit(1)).alias(name)])


def heavy_keys(rows: DataFrame, key: str, share: float) -> DataFrame:
    """(key, n_rows) of the non-NULL keys that hold at least `share` of all rows, rows with a NULL key counting towards the total. At most 1/share rows come out."""
    if not 0 < share <= 1:
        raise ValueError(f"share must lie in (0, 1], not {share}")
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return keyed_aggregate(rows.select(key), key, [F.count(F.lit(1)).alias("n_rows")]).where(F.col("n_rows") >= F.lit(share) * total)


def join_key_stats(rows: DataFrame, stats: DataFrame, key: str, n_rows: str, share: float = 0.001) -> DataFrame:
    """Inner join of rows with a table of one row for each key, of which column `n_rows` has the number of rows of the key.

    Keys with at least `share` of all rows get their statistics by broadcast, at most 1/share of them (1,000 by default); the others by
    a shuffle in which no key has more than that share, for rows of hot keys are spread over it by a salt that matches
    nothing. So no task gets a hot key, nothing unbounded is broadcast, and `rows` is computed once. Columns of `rows` that
    `stats` has too, other than the key, give way to those of `stats`. NULL keys find nothing.
    """
    rows = rows.drop(*[c for c in stats.columns if c != key and c in rows.columns])
    cut = F.lit(share) * stats.agg(F.coalesce(F.sum(n_rows), F.lit(0)).alias("n")).scalar()
    carried = F.struct(*[F.col(c) for c in stats.columns if c != key])
    hot = stats.where(F.col(n_rows) >= cut).select(key, carried.alias("_hot"))
    # 0, but no literal: the optimizer would take one out of the join's keys, and hot keys would meet in one task
    zero = F.pmod(F.col(n_rows), F.lit(1)).cast("int").alias("_salt")
    cold = stats.where(F.col(n_rows) < cut).select(key, carried.alias("_cold"), zero)
    spread = F.pmod(F.xxhash64(*[F.col(c) for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]), F.lit(1024)).cast("int") + 1
    flagged = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(F.col("_hot").isNotNull(), spread).otherwise(0))
    joined = flagged.join(cold, [key, "_salt"], "left").withColumn("_found", F.coalesce("_hot", "_cold")).where(F.col("_found").isNotNull())
    return joined.select(*rows.columns, *[F.col(f"_found.{c}").alias(c) for c in stats.columns if c != key])
