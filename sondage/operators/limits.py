"""The first rows of every group, however large a group is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_group(rows: DataFrame, group: str, order: Sequence[Column], spread: Column, n: int, name: str, subgroups: int = 32) -> DataFrame:
    """The first n rows of each group in the given order, numbered from 1 in column `name`.

    Rows of a group are hashed by `spread` to subgroups, of each of which the first n survive; survivors, n * subgroups of
    a group at most, are numbered. So a group of a third of all rows is sorted in `subgroups` tasks, also for an n
    above the number up to which Spark limits a window before its shuffle.
    """
    salted = rows.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(subgroups)).cast("int"))
    survivors = salted.withColumn(name, F.row_number().over(W.partitionBy(group, "_part").orderBy(*order))).where(F.col(name) <= n)
    return survivors.drop("_part").withColumn(name, F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col(name) <= n)


def numbered_heads(rows: DataFrame, group: str, order: Sequence[Column], spread: Column, n: int, name: str, subgroups: int = 32) -> DataFrame:
    """All rows, the first n of each group numbered from 1 in column `name`, the others with NULL.

    Rows that aren't among the first n of their subgroup come out as they lie; only the survivors move a second time.
    """
    salted = rows.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(subgroups)).cast("int"))
    placed = salted.withColumn(name, F.row_number().over(W.partitionBy(group, "_part").orderBy(*order))).drop("_part")
    heads = placed.where(F.col(name) <= n).withColumn(name, F.row_number().over(W.partitionBy(group).orderBy(*order)))
    none = F.lit(None).cast("int")
    rest = placed.where(F.col(name) > n).withColumn(name, none)
    return rest.unionByName(heads.withColumn(name, F.when(F.col(name) <= n, F.col(name)).otherwise(none)))
