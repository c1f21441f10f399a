"""Exact nearest neighbour of query points."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kdtree import nearest_table, usable

#: Query points that are compared with the points in one pass; larger batches become a table.
QUERY_BLOCK = 4096


def nearest_neighbor(points: DataFrame, query: Sequence[float]) -> DataFrame:
    """(point_id, coords, distance) of the nearest point, ties by smaller id; nothing for an empty table.

    Points of another dimension are a ValueError as in `nearest_batch`. NULL coordinates and NULL elements are no points.
    """
    found = nearest_batch(points, [(0, query)])
    return found.select("point_id", "coords", "distance")


def nearest_batch(points: DataFrame, queries: Sequence[tuple[int, Sequence[float]]]) -> DataFrame:
    """(query_id, point_id, coords, distance) for a batch of query points given on the driver.

    A small batch is compared with the points where they lie: each task gives one row for each query, the best by distance and
    id, and the best of these is taken by a small aggregate. More than QUERY_BLOCK queries become a table, for
    `kdtree.nearest_table`. Rows of another dimension than the queries fail.
    """
    dims = {len(q) for _, q in queries}
    if len(dims) > 1:
        raise ValueError(f"queries of different dimensions: {sorted(dims)}")
    size = dims.pop() if dims else 0
    if len(queries) > QUERY_BLOCK:
        asked = points.sparkSession.createDataFrame([(int(q), [float(x) for x in p]) for q, p in queries], "query_id long, coords array<double>")
        return nearest_table(points, asked, size)
    rows = usable(points, "point_id", size)
    out = _nearest_block(rows, np.array([q for q, _ in queries], np.int64), np.array([p for _, p in queries], np.float64).reshape(len(queries), size))
    best = out.groupBy("query_id").agg(F.min(F.struct("square", "point_id", "coords")).alias("b"))
    return best.select("query_id", "b.point_id", "b.coords", F.sqrt("b.square").alias("distance"))


def _nearest_block(rows: DataFrame, ids: np.ndarray, q: np.ndarray) -> DataFrame:
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = np.full(len(ids), np.inf)
        keys, coords = np.zeros(len(ids), np.int64), np.zeros_like(q)
        for f in frames:
            for start in range(0, len(f) if len(ids) else 0, 1000):
                part = f.iloc[start : start + 1000]
                x, k = np.stack(part["coords"].to_numpy()), part["point_id"].to_numpy()
                rough = np.maximum((q * q).sum(1)[:, None] - 2 * q @ x.T + (x * x).sum(1), 0)
                low = rough.min(axis=1)
                r, c = np.nonzero(rough <= (low + 1e-9 * (1 + (q * q).sum(1) + (x * x).sum(1).max()))[:, None])
                exact = np.zeros(len(r))
                for j in range(q.shape[1]):  # in the order of the dimensions, as a plain sum
                    exact += (q[r, j] - x[c, j]) ** 2
                order = np.lexsort((k[c], exact, r))
                r, c, exact = r[order], c[order], exact[order]
                first = np.concatenate([[True], r[1:] != r[:-1]])
                r, c, exact = r[first], c[first], exact[first]
                better = (exact < best[r]) | ((exact == best[r]) & (k[c] < keys[r]))
                best[r[better]], keys[r[better]], coords[r[better]] = exact[better], k[c[better]], x[c[better]]
        seen = np.isfinite(best)
        yield pd.DataFrame({"query_id": ids[seen], "square": best[seen], "point_id": keys[seen], "coords": pd.Series(list(coords[seen]), dtype=object)})

    return rows.mapInPandas(search, "query_id long, square double, point_id long, coords array<double>")
