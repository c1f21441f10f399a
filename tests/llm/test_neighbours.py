import numpy as np
import pytest

from sondage.llm import neighbours
from sondage.llm.neighbours import nearest_vectors
from sondage.llm.onebit import Codes, rotation


def brute(ids, x, k, most=np.inf):
    out = {}
    for i, p in zip(ids, x):
        d = np.sqrt(((x - p) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i and d[j] <= most][:k]
        out[i] = [ids[j] for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("item", "rank").collect():
        out.setdefault(r["item"], []).append(r["neighbour"])
    return out


def clustered(n, dims, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims)) * 10
    return np.round(centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dims)) * rng.choice([0.1, 2.0], (n, 1)), 4)


@pytest.mark.parametrize("dims", [8, 10, 16])
def test_the_bound_is_never_over_the_distance(dims):
    x, q = clustered(300, dims), clustered(50, dims, 1)
    guess, least = Codes(x, x.mean(axis=0), rotation(dims)).estimate(q)
    exact = ((q[:, None] - x) ** 2).sum(axis=2)
    assert (least <= exact + 1e-6).all()
    assert np.corrcoef(guess.ravel(), exact.ravel())[0, 1] > 0.85


def test_rotation_is_orthogonal():
    r = rotation(10)
    assert r.shape == (16, 16) and np.allclose(r @ r.T, np.eye(16))


@pytest.mark.parametrize("most", [None, 1.0])
def test_exact_against_brute_force(spark, most):
    x = clustered(700, 6)
    x[100:200] = x[0]  # copies
    x[300:303] = x[5]
    ids = np.arange(700) * 3 + 1
    df = spark.createDataFrame([(int(i), [float(v) for v in p], 1) for i, p in zip(ids, x)], "id long, v array<double>, item int")
    got = found(nearest_vectors(df, "id", "v", 6, 5, max_distance=most))
    want = {i: n for i, n in brute(ids, x, 5, most or np.inf).items() if n}
    assert got == want


def test_a_crowd_of_near_equal_vectors(spark, monkeypatch):
    """Cells are refined, and what stays over the bound is split on both sides: no group exceeds it, and the result stays exact."""
    monkeypatch.setattr(neighbours, "CELL_VECTORS", 300)
    monkeypatch.setattr(neighbours, "CELL_QUERIES", 250)
    split = neighbours.nearest_in_cell

    def watched(codes, x, keys, queries, own, *more):
        assert len(x) <= 400 and len(queries) <= 400, (len(x), len(queries))
        return split(codes, x, keys, queries, own, *more)

    rng = np.random.default_rng(8)
    x = np.concatenate([np.round(1000 + 1e-6 * rng.normal(size=(1500, 4)), 12), rng.normal(size=(300, 4))])
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), [float(v) for v in p]) for i, p in zip(ids, x)], "id long, v array<double>")
    monkeypatch.setattr(neighbours, "nearest_in_cell", watched)
    got = found(nearest_vectors(df, "id", "v", 4, 3, cells_per_root=0.05))
    assert got == brute(ids, x, 3)


def test_refinement_bounds_the_cells(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([1 + 1e-3 * rng.normal(size=(50_000, 4)), 100 * rng.normal(size=(500, 4))])
    df = spark.createDataFrame([(i, 1, p, [i]) for i, p in enumerate(x.tolist())], "class long, n long, coords array<double>, ids array<long>")
    sizes = [r["count"] for r in neighbours.refined(df, 4, 50)[0].groupBy("cell").count().collect()]
    assert sum(sizes) == len(x) and max(sizes) <= neighbours.CELL_VECTORS


def test_few_probes_keep_recall(spark):
    x, ids = clustered(1500, 16, 3), np.arange(1500)
    df = spark.createDataFrame([(int(i), [float(v) for v in p]) for i, p in zip(ids, x)], "id long, v array<double>")
    want = brute(ids, x, 5)
    for more in ({"max_probes": 12}, {"max_probes": 12, "epsilon": 1.9}):
        got = found(nearest_vectors(df, "id", "v", 16, 5, **more))
        assert np.mean([len(set(got[i]) & set(want[i])) / 5 for i in ids.tolist()]) >= 0.9


def test_dirty_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [-0.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [1.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 0.0]), (None, [0.0, 0.0]), (3, None)]
    df = spark.createDataFrame(data, "id long, v array<double>")
    got = [tuple(r) for r in nearest_vectors(df, "id", "v", 2, 2).orderBy("item", "rank").collect()]
    assert got == [(1, 2, 1, 0.0), (1, 3, 2, 1.0), (2, 1, 1, 0.0), (2, 3, 2, 1.0), (3, 1, 1, 1.0), (3, 2, 2, 1.0)]


@pytest.mark.parametrize("data", [[], [(1, [0.0, 1.0])]])
def test_nothing_to_find(spark, data):
    assert nearest_vectors(spark.createDataFrame(data, "id long, v array<double>"), "id", "v", 2, 3).count() == 0
