"""Problem 5: the k most similar vectors of every vector, by one-bit codes in cells of centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.hotkeys import join_key_stats
from ..sources.tables import checkpoint_dir
from .onebit import Codes, nearest_in_cell, rotation
from .topn import top_n_per_group

#: Distinct vectors to which the centroids are fitted, at most: a hash sample; all vectors are indexed all the same. It also is
#: the largest number of first centroids, which beyond 10^8 vectors makes cells larger than the root of their number.
FIT_SAMPLE = 20_000
#: Vectors of a cell, and queries that visit it, which one task compares; a cell of more is shared by several tasks on either side.
CELL_VECTORS, CELL_QUERIES = 20_000, 20_000
#: Times that cells far over the average get centroids of their own, at most.
REFINEMENTS = 8


def valid_vectors(rows: DataFrame, item: str, coords: str, dims: int) -> DataFrame:
    """(item, coords): one row for each item with `dims` finite elements. Of an item's differing rows the least array holds; -0.0 counts as 0.0. Other rows and columns are left out."""
    finite = F.forall(coords, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    plain = F.transform(coords, lambda x: x.cast("double") + F.lit(0.0))
    usable = rows.where(F.col(item).isNotNull() & (F.size(coords) == dims)).where(finite)
    return usable.select(F.col(item).alias("item"), plain.alias("coords")).groupBy("item").agg(F.min("coords").alias("coords"))


def _stack(column: pd.Series, dims: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, dims))


def _square_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1), 0)


def _fit(sample: np.ndarray, cells: int, rounds: int = 4) -> np.ndarray:
    centroids = sample[: max(1, min(cells, len(sample)))].copy()
    for _ in range(rounds):
        nearest = np.concatenate([_square_distances(sample[i : i + 2000], centroids).argmin(axis=1) for i in range(0, len(sample), 2000)])
        n = np.bincount(nearest, minlength=len(centroids))
        for j in range(sample.shape[1]):
            total = np.bincount(nearest, sample[:, j], len(centroids))
            centroids[:, j] = np.where(n > 0, total / np.maximum(n, 1), centroids[:, j])
    return centroids


def _assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 4000):
                part = f.iloc[at : at + 4000]
                x = _stack(part["coords"], centroids.shape[1])
                cell = _square_distances(x, centroids).argmin(axis=1)
                yield part.assign(cell=cell.astype(np.int32), reach=np.sqrt(((x - centroids[cell]) ** 2).sum(axis=1)))

    return vectors.mapInPandas(nearest, "class long, n long, coords array<double>, ids array<long>, cell int, reach double")


def refined(vectors: DataFrame, dims: int, cells: int) -> tuple[DataFrame, np.ndarray, pd.DataFrame]:
    """The vectors with their cells, the centroids, and each cell's size and reach. Cells far over the average get centroids of their own vectors, as long as that makes the largest smaller."""
    fit = vectors.select("class", "coords").orderBy(F.xxhash64("class"), "class").limit(FIT_SAMPLE).toPandas()
    centroids = _fit(_stack(fit["coords"], dims), cells) if len(fit) else np.zeros((1, dims))
    largest = np.inf
    for turn in range(REFINEMENTS + 1):
        indexed = _assign(vectors, centroids).checkpoint()
        shape = indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("reach")).toPandas()
        mean = shape["n"].sum() / len(centroids)
        large = shape[shape["n"] > max(2000, 8 * mean)]
        if large.empty or turn == REFINEMENTS or large["n"].max() > 0.9 * largest:
            break
        largest = large["n"].max()
        more = int(min(FIT_SAMPLE, large["n"].sum() // max(500, mean)))
        wanted = indexed.where(F.col("cell").isin(large["cell"].tolist())).orderBy(F.xxhash64("class", F.lit(turn)), "class").select("coords").limit(more)
        centroids = np.concatenate([centroids, _stack(wanted.toPandas()["coords"], dims)])
    return indexed, centroids, shape


def _expanded(rows: np.ndarray, cols: np.ndarray, square: np.ndarray, ids: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The items behind distinct vectors: of each row the k first by distance, then item. Rows come grouped."""
    n = np.array([len(x) for x in ids])[cols] if len(cols) else np.zeros(0, int)
    rows, distance = np.repeat(rows, n), np.sqrt(np.repeat(square, n))
    items = np.concatenate([ids[c] for c in cols]) if len(cols) else np.zeros(0, np.int64)
    order = np.lexsort((items, distance, rows))
    rows, distance, items = rows[order], distance[order], items[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[kept], items[kept], distance[kept]


def nearest_vectors(
    rows: DataFrame,
    item: str,
    coords: str,
    dims: int,
    k: int,
    max_distance: float | None = None,
    max_probes: int | None = None,
    epsilon: float | None = None,
    cells_per_root: float = 2.0,
) -> DataFrame:
    """(item, neighbour, rank, distance): of every valid vector the k nearest others by Euclidean distance, ties by smaller id.

    With `max_distance`, only neighbours within it. The result is exact unless `max_probes` limits the number of foreign
    cells that a vector looks into, nearest first, or `epsilon` asks for the probabilistic bound of the codes.

    1. Equal vectors become one, with its k + 1 smallest ids and its number of copies, so copies make no pairs.
    2. About cells_per_root * sqrt(n) centroids are fitted to FIT_SAMPLE vectors; every vector goes to its nearest centroid.
       As long as it helps, cells far over the average get further centroids from their own vectors.
    3. In its own cell each vector finds k neighbours, which bound its search radius. A cell beyond is visited only if the
       plane between the two centroids and the reach of that cell let one of its vectors lie within the radius.
    4. Both steps estimate distances from one-bit codes and measure exactly only what the error bound leaves open.
    Cells of many vectors, such as near-equal ones, and cells visited by many are split by hashes on both sides, so that no
    task gets more than CELL_VECTORS of one and CELL_QUERIES of the other. Jobs for the centroids run first, over one
    checkpoint of the vectors and one of their cells. Items without `dims` finite elements are no vectors; an
    empty table gives an empty result.
    """
    spark = rows.sparkSession
    checkpoint_dir(spark)
    turn_by = rotation(dims)
    valid = valid_vectors(rows, item, coords, dims)
    first = top_n_per_group(valid, "coords", F.lit(0), "item", k + 1).groupBy("coords").agg(F.array_sort(F.collect_list("item")).alias("ids"))
    sizes = valid.groupBy("coords").agg(F.count(F.lit(1)).alias("n"))
    vectors = sizes.join(first, "coords").select(F.get("ids", F.lit(0)).alias("class"), "n", "coords", "ids").checkpoint()
    indexed, centroids, shape = refined(vectors, dims, round(cells_per_root * vectors.count() ** 0.5))
    reach = np.full(len(centroids), -1.0)
    reach[shape["cell"].to_numpy(int)] = shape["reach"]
    limit = np.inf if max_distance is None else max_distance**2 * (1 + 1e-12)

    def probes(x: np.ndarray, own: int, radius: np.ndarray) -> list[np.ndarray]:
        """The other cells that can have a vector within the radius."""
        from_centre = np.sqrt(_square_distances(x, centroids))
        apart = np.sqrt(((centroids - centroids[own]) ** 2).sum(axis=1))
        apart[apart == 0] = np.nan  # no plane between equal centroids
        plane = np.nan_to_num((from_centre**2 - from_centre[:, own : own + 1] ** 2) / (2 * apart))
        least = np.maximum(plane, from_centre - reach)
        near = least <= (radius + 1e-6)[:, None]
        near[:, own], near[:, reach < 0] = False, False
        found = [np.nonzero(line)[0] for line in near]
        if max_probes is not None:
            found = [c if len(c) <= max_probes else c[np.argsort(from_centre[i][c], kind="stable")[:max_probes]] for i, c in enumerate(found)]
        return [c.astype(np.int32) for c in found]

    def looked(f: pd.DataFrame, x: np.ndarray, cell: int, items: list[np.ndarray], distances: list[np.ndarray]) -> pd.DataFrame:
        """What each vector of a cell has found there, and the cells that it has to look into beside."""
        radius = np.array([d[k - 1] if len(d) >= k else np.sqrt(limit) for d in distances])
        out = f[["class", "coords"]].copy()
        out["radius"] = radius
        out["probes"] = [c for at in range(0, len(x), 1000) for c in probes(x[at : at + 1000], cell, radius[at : at + 1000])]
        out["items"], out["distances"] = items, distances
        return out

    def own_cell(f: pd.DataFrame) -> pd.DataFrame:
        x, keys, cell = _stack(f["coords"], dims), f["class"].to_numpy(), int(f["cell"].iloc[0])
        ids = [np.asarray(i, np.int64) for i in f["ids"]]
        parts = list(nearest_in_cell(Codes(x, centroids[cell], turn_by), x, keys, x, keys, np.full(len(x), limit), k, epsilon))
        rows, items, distance = _expanded(*(np.concatenate(p) for p in zip(*parts)), ids, k)
        ends = np.cumsum(np.bincount(rows, minlength=len(x)))[:-1]
        return looked(f, x, cell, np.split(items, ends), np.split(distance, ends))

    def in_part(data: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if data.empty or ask.empty:
            return pd.DataFrame({"class": np.zeros(0, np.int64), "neighbour": np.zeros(0, np.int64), "distance": np.zeros(0)})
        x, keys, q, own = _stack(data["coords"], dims), data["class"].to_numpy(), _stack(ask["coords"], dims), ask["class"].to_numpy()
        ids = [np.asarray(i, np.int64) for i in data["ids"]]
        codes = Codes(x, centroids[int(data["cell"].iloc[0])], turn_by)
        square = ask["radius"].to_numpy() ** 2 * (1 + 1e-9)
        parts = list(nearest_in_cell(codes, x, keys, q, own, square, k, epsilon))
        rows, items, distance = _expanded(*(np.concatenate(p) for p in zip(*parts)), ids, k)
        return pd.DataFrame({"class": own[rows], "neighbour": items, "distance": distance})

    cell_parts = [(int(c), int(-(-size // CELL_VECTORS))) for c, size in zip(shape["cell"], shape["n"])] or [(-1, 1)]

    def answered(visits: DataFrame) -> DataFrame:
        """(class, neighbour, distance) from visits (class, coords, radius, cell): each cell in parts by vector and shares by visitor."""
        shares = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL_QUERIES).cast("int").alias("shares"))  # a row for each cell: bounded by the centroids
        plan = F.broadcast(shares.join(spark.createDataFrame(cell_parts, "cell int, parts int"), "cell"))
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        by_class = lambda c: F.pmod(F.xxhash64("class"), F.col(c)).cast("int")
        asked = visits.join(plan, "cell").withColumn("share", by_class("shares")).withColumn("part", every("parts")).drop("shares", "parts")
        held = indexed.select(*[F.col(c).alias(c) for c in ("class", "coords", "ids", "cell")]).join(plan, "cell").withColumn("part", by_class("parts")).withColumn("share", every("shares")).drop("shares", "parts")
        keys = ("cell", "part", "share")
        return held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(in_part, "class long, neighbour long, distance double")

    shape_of_started = "class long, coords array<double>, radius double, probes array<int>, items array<long>, distances array<double>"
    hot = [c for c, parts in cell_parts if parts > 1]
    started = (indexed.where(~F.col("cell").isin(hot)) if hot else indexed).groupBy("cell").applyInPandas(own_cell, shape_of_started)
    if hot:
        crowd = indexed.where(F.col("cell").isin(hot)).select(*[F.col(c).alias(c) for c in ("class", "coords", "cell")])
        best = F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))), 1, k)
        near = answered(crowd.withColumn("radius", F.lit(float(np.sqrt(limit))))).groupBy("class").agg(best.alias("b"))
        both = crowd.join(near, "class", "left").select("class", "coords", "cell", F.coalesce(F.col("b.neighbour"), F.array()).alias("items"), F.coalesce(F.col("b.distance"), F.array()).alias("distances"))

        def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for cell, g in f.groupby("cell"):
                    yield looked(g, _stack(g["coords"], dims), int(cell), list(g["items"]), list(g["distances"]))

        started = started.unionByName(both.mapInPandas(look, shape_of_started))
    started = started.checkpoint()
    beyond = answered(started.select("class", "coords", "radius", F.explode("probes").alias("cell")))
    pair = F.struct(F.col("distance"), F.col("neighbour"))
    zipped = F.transform(F.arrays_zip("distances", "items"), lambda z: F.struct(z["distances"].alias("distance"), z["items"].alias("neighbour")))
    lists = started.select("class", zipped.alias("found")).unionByName(beyond.groupBy("class").agg(F.collect_list(pair).alias("found")))
    merged = lists.groupBy("class").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))
    copies = F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("distance"), i.alias("neighbour")))
    by_vector = indexed.select("class", "n", "coords", "ids").join(merged, "class").select("coords", "n", F.concat(copies, "found").alias("found"))
    members = join_key_stats(valid, by_vector, "coords", "n")
    kept = F.slice(F.filter("found", lambda s: s["neighbour"] != F.col("item")), 1, k)
    out = members.select("item", F.posexplode(kept).alias("rank", "s")).select("item", "s.neighbour", (F.col("rank") + 1).alias("rank"), "s.distance")
    return out if max_distance is None else out.where(F.col("distance") <= max_distance)
