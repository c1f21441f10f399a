import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.llm.packing import TOKEN, Bm25, coverage, pack_shard, pack_texts, split_items


def test_bm25_finds_the_related():
    docs = [np.array(x, np.int32) for x in ([1, 2, 3], [1, 2, 9], [7, 8, 9], [])]
    s = Bm25(docs)
    assert s.scores(0)[1] > s.scores(0)[2] == 0 and s.scores(3).sum() == 0


def test_containers_hold_every_piece_once():
    rng = np.random.default_rng(2)
    pieces = [rng.integers(0, 300, rng.integers(0, 60)).astype(np.int32) for _ in range(400)]
    containers = [[i for i, _ in c] for c in pack_shard(pieces, 64)]
    assert sorted(i for c in containers for i in c) == list(range(400))
    used = [sum(len(pieces[i]) for i in c) for c in containers]
    assert max(used) <= 64 and sum(used) / (64 * len(used)) > 0.97


def test_neighbours_share_a_container():
    rng = np.random.default_rng(3)
    pieces = [(rng.integers(0, 40, 10) + 1000 * (i % 8)).astype(np.int32) for i in range(320)]
    containers = pack_shard(pieces, 40)
    assert np.mean([len({i % 8 for i, _ in c}) for c in containers]) < 1.5
    assert {c[0][1] for c in containers} == {"seed"} and np.mean([r == "neighbour" for c in containers for _, r in c[1:]]) > 0.9


@pytest.mark.parametrize("neighbours", [1, 3, 64])
def test_no_neighbour_that_fits_is_passed_over(neighbours):
    rng = np.random.default_rng(4)
    pieces = [rng.integers(0, 500, rng.integers(1, 12)).astype(np.int32) for _ in range(300)]
    terms, used = [set(p.tolist()) for p in pieces], set()
    for inside in pack_shard(pieces, 64, neighbours):
        room, seed = 64, terms[inside[0][0]]
        for i, role in inside:
            if role == "filler":  # whatever still fits shares no term with the seed
                assert not any(seed & terms[j] for j in range(300) if j not in used and len(pieces[j]) <= room)
            used.add(i)
            room -= len(pieces[i])
    assert len(used) == 300


def test_layout(spark):
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(1, 30))) for _ in range(200)] + [None, "", "?!", "x " * 41, "y " * 20, "y " * 20, "z " * 1000]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "id long, text string, shard string")
    rows = pack_texts(df, "id", capacity=20, shard_texts=50).collect()
    got, load = {}, {}
    for r in rows:
        got.setdefault(r["item"], []).append((r["token_from"], r["token_to"]))
        load[r["container"]] = load.get(r["container"], 0) + r["token_to"] - r["token_from"]
    assert max(load.values()) <= 20
    for i, t in enumerate(texts):
        n = len(re.findall(TOKEN, t or ""))
        spans = sorted(got[i])
        assert len(spans) == max(1, -(-n // 20)) and spans[0][0] == 0 and spans[-1][1] == n
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    split = {r["item"] for r in split_items(pack_texts(df, "id", capacity=20, shard_texts=50)).collect()}
    assert split == {i for i, t in enumerate(texts) if len(re.findall(TOKEN, t or "")) > 20}


def test_a_third_of_rows_without_item(spark):
    df = spark.createDataFrame([(None, "a b c")] * 3000 + [(7, "d")] * 3000 + [(i, "e f") for i in range(100, 3100)], "id long, text string")
    layout = pack_texts(df, "id", capacity=12, shard_texts=300)
    sizes = [r["count"] for r in layout.groupBy(F.shiftright("container", 32)).count().collect()]
    assert sum(sizes) == 9000 and max(sizes) < 600
    got = coverage(pack_texts(df.where("id >= 100"), "id", capacity=12))
    assert got.where("whole AND fits AND n_tokens = 2 AND pieces = 1").count() == 3000


def test_repeated_and_missing_items(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "id long, text string")
    rows = pack_texts(df, "id", capacity=4).collect()
    assert sorted((r["item"] or 0, r["token_to"]) for r in rows) == [(0, 1), (1, 2), (1, 2)]
    assert pack_texts(df.limit(0), "id").count() == 0
    with pytest.raises(ValueError):
        pack_texts(df, "id", capacity=0)
