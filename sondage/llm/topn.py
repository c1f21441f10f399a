"""Problem 4: the top N items of every group, hot groups included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Rows of one subgroup at most, were all rows of one group, and the least number of subgroups.
SUBGROUP_ROWS, LEAST_SUBGROUPS = 5_000_000, 32


def subgroups_for(rows: DataFrame) -> Column:
    """So many subgroups that one of a group with all of these rows has about SUBGROUP_ROWS: a scalar subquery. `rows` should be cheap to count, as a stored table is."""
    return rows.agg(F.greatest(F.lit(LEAST_SUBGROUPS), F.ceil(F.count(F.lit(1)) / SUBGROUP_ROWS)).alias("n")).scalar()


def subgroup(item: Column, subgroups: int | Column) -> Column:
    """The subgroup of an item within its group, from a hash of its identifier."""
    return F.pmod(F.xxhash64(item), subgroups if isinstance(subgroups, Column) else F.lit(subgroups)).cast("int")


def top_n_per_group(rows: DataFrame, group: str, score: Column, item: str, n: int, subgroups: int | Column = LEAST_SUBGROUPS, salted: str | None = None) -> DataFrame:
    """The n rows of highest score of every group, equal scores in order of `item`, with column `rank` from 1.

    Two stages: each group is hashed by item into subgroups, of each of which n survive; survivors, at most
    n * subgroups of a group, are ranked by score and item. A group of a third of all rows is thus ranked in `subgroups` tasks;
    their number is to fit the largest group (`subgroups_for` takes it from the size of a table).
    `salted` names a column that already has the subgroup of each row, if rows are partitioned by it. Rows with a NULL
    group are left out; NULL scores come last; rows equal in score and item in any order, all counting. Groups
    smaller than n come out whole; n below 1 is an error. All columns of `rows` are kept, whatever their names, but for an older `rank`.
    """
    if n < 1:
        raise ValueError(f"n must be at least 1, not {n}")
    kept = F.struct(*[F.col(c) for c in rows.columns if c not in ("rank", salted)])
    salt = F.col(salted) if salted else subgroup(F.col(item), subgroups)
    scored = rows.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), salt.alias("s"), score.alias("v"), F.col(item).alias("i"), kept.alias("r"))
    order = [F.col("v").desc_nulls_last(), F.col("i").asc_nulls_last()]
    survivors = scored.withColumn("k", F.row_number().over(W.partitionBy("g", "s").orderBy(*order))).where(F.col("k") <= n)
    ranked = survivors.withColumn("k", F.row_number().over(W.partitionBy("g").orderBy(*order))).where(F.col("k") <= n)
    return ranked.select("r.*", F.col("k").alias("rank"))
