"""Exact nearest neighbours for a table of query points: points in leaves of a k-d tree, leaves pruned by their bounding boxes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpoint_dir

#: Points to which the splits are fitted, at most (a hash sample; all points are indexed), and leaves, at most.
FIT_SAMPLE, MOST_LEAVES = 20_000, 4096
#: Points of a leaf, and queries that visit it, which one task compares at a time; more are shared by several tasks.
LEAF_POINTS, LEAF_QUERIES = 50_000, 20_000


@dataclass(frozen=True)
class Splits:
    """Median splits of a complete tree, the axis being the depth modulo the dimensions: thresholds in the order root, its children, theirs, ..."""

    dims: int
    depth: int
    thresholds: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, depth: int) -> Splits:
        thresholds = np.full((1 << depth) - 1, np.inf)
        rows = {0: np.arange(len(x))}
        for node in range(len(thresholds)):
            own = rows.pop(node)
            axis = ((node + 1).bit_length() - 1) % max(1, x.shape[1])
            if not len(own):
                rows[2 * node + 1] = rows[2 * node + 2] = own
                continue
            order = own[np.lexsort((own, x[own, axis]))]
            thresholds[node] = x[order[(len(order) - 1) // 2], axis]
            low = x[own, axis] <= thresholds[node]
            rows[2 * node + 1], rows[2 * node + 2] = own[low], own[~low]
        return cls(x.shape[1], depth, thresholds)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for level in range(self.depth):
            node = 2 * node + 1 + (x[:, level % self.dims] > self.thresholds[node])
        return (node - len(self.thresholds)).astype(np.int32)


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, dims))


def usable(rows: DataFrame, item: str, dims: int) -> DataFrame:
    """(item, coords) as doubles. NULL coordinates and NULL elements are no points; another dimension fails the job."""
    typed = rows.where(F.col("coords").isNotNull()).select(item, F.transform("coords", lambda x: x.cast("double")).alias("coords")).where(F.forall("coords", lambda x: x.isNotNull()))
    wrong = F.raise_error(F.lit(f"a point has another dimension than {dims}")).cast("array<double>")
    return typed.withColumn("coords", F.when(F.size("coords") == dims, F.col("coords")).otherwise(wrong))


def fit_splits(points: DataFrame, dims: int) -> Splits:
    """Splits for about LEAF_POINTS / 10 points in a leaf, from a bounded sample of the points."""
    n = points.count()
    depth = min(max(0, int(np.ceil(np.log2(max(1, 10 * n / LEAF_POINTS))))), MOST_LEAVES.bit_length() - 1)
    sample = points.select("coords").orderBy(F.xxhash64("coords")).limit(FIT_SAMPLE).toPandas() if depth else pd.DataFrame({"coords": []})
    return Splits.fit(_matrix(sample["coords"], dims), depth)


def with_leaf(rows: DataFrame, splits: Splits, item: str) -> DataFrame:
    """(item, coords, leaf)."""

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(leaf=splits.leaf(_matrix(f["coords"], splits.dims)))

    return rows.mapInPandas(assign, f"{item} long, coords array<double>, leaf int")


def _best(query: np.ndarray, ids: np.ndarray, x: np.ndarray, q: np.ndarray) -> pd.DataFrame:
    """Of each query the nearest point, ties by smaller id: sums are exact in the order of the dimensions."""
    out = []
    for at in range(0, len(q), max(1, 4_000_000 // max(1, len(x)))):
        part = q[at : at + max(1, 4_000_000 // max(1, len(x)))]
        rough = np.maximum((part * part).sum(1)[:, None] - 2 * part @ x.T + (x * x).sum(1), 0)
        near = rough <= (rough.min(axis=1) + 1e-9 * (1 + (part * part).sum(1) + (x * x).sum(1).max()))[:, None]
        r, c = np.nonzero(near)
        exact = np.zeros(len(r))
        for j in range(x.shape[1]):
            exact += (part[r, j] - x[c, j]) ** 2
        order = np.lexsort((ids[c], exact, r))
        first = order[np.concatenate([[True], r[order][1:] != r[order][:-1]])]
        out.append(pd.DataFrame({"query_id": query[at + r[first]], "square": exact[first], "point_id": ids[c[first]], "coords": pd.Series(list(x[c[first]]), dtype=object)}))
    if not out:
        out = [pd.DataFrame({"query_id": query[:0], "square": np.zeros(0), "point_id": ids[:0], "coords": pd.Series([], dtype=object)})]
    return pd.concat(out)


def nearest_table(points: DataFrame, queries: DataFrame, dims: int) -> DataFrame:
    """(query_id, point_id, coords, distance): of each query point the nearest point, ties by smaller id; queries without any point don't come out.

    points: (point_id, coords), queries: (query_id, coords), both tables of any size; query_id is unique. Equal points count as the one of
    smallest id, so copies don't fill a leaf. Each query looks into its own leaf, then only into leaves whose bounding
    box comes as near as what it found there. Points of a large leaf, and queries of a much visited one, are shared by
    several tasks. Splits and boxes, at most MOST_LEAVES of them, go through the driver, points and queries don't.
    """
    checkpoint_dir(points.sparkSession)
    distinct = usable(points, "point_id", dims).where("point_id IS NOT NULL").groupBy("coords").agg(F.min("point_id").alias("point_id")).select("point_id", "coords").checkpoint()
    splits = fit_splits(distinct, dims)
    placed = with_leaf(distinct, splits, "point_id")
    corner = lambda f: F.array(*[f(F.get("coords", F.lit(j))) for j in range(dims)])
    boxes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), corner(F.min).alias("low"), corner(F.max).alias("high")).toPandas().sort_values("leaf")
    low, high, leaf_of_box = _matrix(boxes["low"], dims), _matrix(boxes["high"], dims), boxes["leaf"].to_numpy(np.int32)
    parts = {int(k): int(-(-n // LEAF_POINTS)) for k, n in zip(boxes["leaf"], boxes["n"])}
    asked = with_leaf(usable(queries, "query_id", dims), splits, "query_id")

    def visits(frames: Iterator[pd.DataFrame], found: bool) -> Iterator[pd.DataFrame]:
        for f in frames:
            q = _matrix(f["coords"], dims)
            for at in range(0, len(f), 500):
                some = q[at : at + 500]
                away = np.zeros((len(some), len(low)))
                for j in range(dims):
                    away += np.maximum(0, np.maximum(low[:, j] - some[:, j : j + 1], some[:, j : j + 1] - high[:, j])) ** 2
                if found:
                    radius = f["square"].to_numpy()[at : at + 500]
                    r, c = np.nonzero((away <= (radius * (1 + 1e-9) + 1e-12)[:, None]) & (leaf_of_box != f["leaf"].to_numpy()[at : at + 500, None]))
                else:  # the own leaf, or the nearest one where it holds no point
                    r, c = np.arange(len(some) if len(low) else 0), away.argmin(axis=1) if len(low) else np.zeros(0, int)
                yield pd.DataFrame({"query_id": f["query_id"].to_numpy()[at + r], "coords": pd.Series(list(some[r]), dtype=object), "leaf": leaf_of_box[c]})

    def compare(data: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if data.empty:
            ask = ask.iloc[:0]
        return _best(ask["query_id"].to_numpy(), data["point_id"].to_numpy(), _matrix(data["coords"], dims), _matrix(ask["coords"], dims))

    def answered(visit: DataFrame) -> DataFrame:
        share = visit.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / LEAF_QUERIES).cast("int").alias("queries"))  # one row for each leaf
        sizes = visit.sparkSession.createDataFrame(list(parts.items()) or [(-1, 1)], "leaf int, points int")
        plan = F.broadcast(share.join(sizes, "leaf"))
        held = placed.join(plan, "leaf").withColumn("part", F.pmod(F.xxhash64("point_id"), "points")).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("queries") - 1)))
        asks = visit.join(plan, "leaf").withColumn("share", F.pmod(F.xxhash64("query_id"), "queries").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("points").cast("long") - 1)))
        keys = ("leaf", "part", "share")
        return held.select(*keys, "point_id", "coords").groupBy(*keys).cogroup(asks.select(*keys, "query_id", "coords").groupBy(*keys)).applyInPandas(compare, "query_id long, square double, point_id long, coords array<double>")

    least = F.min(F.struct("square", "point_id", "coords")).alias("b")
    first = asked.mapInPandas(lambda fs: visits(fs, False), "query_id long, coords array<double>, leaf int").checkpoint()
    if len(leaf_of_box) <= 1:  # nowhere else to look
        return answered(first).groupBy("query_id").agg(least).select("query_id", "b.point_id", "b.coords", F.sqrt("b.square").alias("distance"))
    near = answered(first).groupBy("query_id").agg(least).select("query_id", "b.square", F.col("b.point_id").alias("point_id"), F.col("b.coords").alias("at")).checkpoint()
    more = first.join(near, "query_id").mapInPandas(lambda fs: visits(fs, True), "query_id long, coords array<double>, leaf int")
    every = near.select("query_id", "square", "point_id", F.col("at").alias("coords")).unionByName(answered(more))
    return every.groupBy("query_id").agg(least).select("query_id", "b.point_id", "b.coords", F.sqrt("b.square").alias("distance"))
