import random

import numpy as np
import pytest

from sondage.operators import spatial, substring


def points(spark, coords):
    return spark.createDataFrame([(i, c) for i, c in enumerate(coords)], "point_id long, coords array<double>")


def one(df):
    got = df.collect()
    return (got[0]["point_id"], got[0]["coords"], got[0]["distance"]) if got else None


# points and patterns of known results (fixed values)
def test_nearest_examples(spark):
    p = points(spark, [(2.0, 3.0), (5.0, 4.0), (9.0, 6.0), (4.0, 7.0), (8.0, 1.0), (7.0, 2.0)])
    assert one(spatial.nearest_neighbor(p, (9, 2))) == (4, [8.0, 1.0], pytest.approx(2**0.5))
    assert one(spatial.nearest_neighbor(points(spark, [(1.0, 1.0), (1.0, 1.0), (2.0, 2.0)]), (1, 1))) == (0, [1.0, 1.0], 0.0)
    assert one(spatial.nearest_neighbor(points(spark, []), (1, 2, 3))) is None
    assert one(spatial.nearest_neighbor(points(spark, [None, (1.0, None), (3.0, 4.0)]), (0, 0))) == (2, [3.0, 4.0], 5.0)


def test_other_dimensions_fail(spark):
    with pytest.raises(Exception, match="dimension"):
        spatial.nearest_neighbor(points(spark, [(1.0, 2.0, 3.0)]), (1, 2)).collect()
    with pytest.raises(ValueError):
        spatial.nearest_batch(points(spark, [(1.0, 2.0)]), [(0, (1, 2)), (1, (1,))])


def test_random_points_equal_a_scan(spark):
    rng = np.random.default_rng(4)
    x, q = rng.integers(0, 6, (250, 4)).astype(float), rng.integers(0, 6, (60, 4)).astype(float)
    got = {r["query_id"]: (r["point_id"], r["distance"]) for r in spatial.nearest_batch(points(spark, x.tolist()).repartition(3), list(enumerate(q.tolist()))).collect()}
    for i, p in enumerate(q):
        d = ((x - p) ** 2).sum(1)
        assert got[i] == (int(d.argmin()), pytest.approx(float(d.min()) ** 0.5))


def texts(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "text_id long, text string")


def naive(t, p):
    return [i for i in range(len(t) - len(p) + 1) if t[i : i + len(p)] == p] if p else list(range(len(t)))


@pytest.mark.parametrize("pattern", ["aaa", "aaaaaa", "b", "", "ana", "a", "\\E", ".", "é😀", "ab"])
def test_locate_and_count(spark, pattern):
    items = ["aaaaaa", "", "banana", "abracadabra", "x\\Ey\\E", "a.b.", "é😀é😀a", None, "abababab"]
    got = {}
    for r in substring.locate(texts(spark, items), pattern).collect():
        got.setdefault(r["text_id"], []).append(r["pos"])
    assert {k: sorted(v) for k, v in got.items()} == {i: naive(t, pattern) for i, t in enumerate(items) if t and naive(t, pattern)}
    counts = {r["text_id"]: r["cnt"] for r in substring.count(texts(spark, items), pattern).collect()}
    assert counts == {i: len(naive(t, pattern)) for i, t in enumerate(items) if t is not None}


def test_bad_patterns(spark):
    for bad, error in ((5, TypeError), ("a\0", ValueError)):
        with pytest.raises(error):
            substring.locate(texts(spark, ["a"]), bad)


def suffixes(t):
    return sorted(range(len(t) + 1), key=lambda i: (t + "\0")[i:])


@pytest.mark.parametrize("long_text", [2000, 0])
def test_suffix_array(spark, long_text):
    rng = random.Random(9)
    items = ["banana", "", "".join(rng.choice("abc ") for _ in range(90)), "aaaa"]
    rows = substring.suffix_array(texts(spark, items), long_text).collect()
    for i, t in enumerate(items):
        own = sorted((r["rank"], r["pos"], r["bwt"]) for r in rows if r["text_id"] == i)
        assert [p for _, p, _ in own] == suffixes(t)
        assert [b for *_, b in own] == [(t + "\0")[p - 1] for _, p, _ in own]


def test_tables_of_the_transform(spark):
    sa = substring.suffix_array(texts(spark, ["banana"])).cache()
    assert {r["symbol"]: r["first"] for r in substring.c_array(sa).collect()} == {"\0": 0, "a": 1, "b": 4, "n": 5}
    assert {r["rank"]: r["occ"] for r in substring.occurrences(sa, "a", 2).collect()} == {0: 1, 2: 1, 4: 1, 6: 3}
    sa.unpersist()


def test_checkpoints_send_no_table_to_the_driver(spark):
    rng = random.Random(11)
    items = ["banana", "", "aaaaaaaaaaa", *("".join(rng.choice("abcdeé") for _ in range(rng.randrange(60))) for _ in range(20))]
    sa = substring.suffix_array(texts(spark, items))
    bwt = {i: "".join((t + "\0")[p - 1] for p in suffixes(t)) for i, t in enumerate(items)}
    for step in (1, 4, 100, 10**10):
        at = [(i, b, t) for i, t in bwt.items() for b in range(0, len(t), step)]
        every, given, own = substring.occ_checkpoints(sa, step), substring.occ_checkpoints(sa, step, ["a", "z"]), substring.occurrences(sa, "a", step)
        assert sorted(map(tuple, every.collect())) == sorted((i, b, c, t[:b].count(c)) for i, b, t in at for c in set(t))
        assert sorted(map(tuple, given.collect())) == sorted((i, b, c, t[:b].count(c)) for i, b, t in at for c in "az")
        assert sorted(map(tuple, own.collect())) == sorted((i, b, t[: b + 1].count("a")) for i, b, t in at)
        for df in (every, given, own):  # rows multiply after the scan, so a planner that goes by the scan's size would broadcast them
            assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
