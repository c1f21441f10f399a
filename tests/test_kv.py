import random

from sondage.functions.keys import sort_key
from sondage.operators import kv

LOG = "key string, value string, seq long, op string"


def log_of(spark, changes):
    return spark.createDataFrame([(k, v, i, "D" if v is None else "U") for i, (k, v) in enumerate(changes)], LOG)


def pairs(df):
    return [(r["key"], r["value"]) for r in df.collect()]


def test_get_update_delete(spark):
    log = log_of(spark, [("a", "1"), ("b", "2"), ("a", "3"), ("b", None), (None, "x"), ("c", "\0")])
    assert pairs(kv.get(log, "a")) == [("a", "3")] and pairs(kv.get(log, "b")) == pairs(kv.get(log, "x")) == []
    assert pairs(kv.get(log, "c")) == [("c", "\0")]
    assert sorted(pairs(kv.multi_get(log, ["a", "b", "x"]))) == [("a", "3")] and pairs(kv.multi_get(log, [])) == []
    asked = spark.createDataFrame([("a", 1), ("a", 2), ("z", 3)], "key string, value int")
    assert pairs(kv.multi_get(log, asked)) == [("a", "3")]


def test_order_and_ranges(spark):
    log = log_of(spark, [(k, k) for k in ("k10", "k2", "k100", "user:5", "doc_abc", "z", "k0", "k00007", "k7")])
    assert [k for k, _ in pairs(kv.scan(log))] == ["k0", "k2", "k00007", "k7", "k10", "k100", "doc_abc", "user:5", "z"]
    assert [k for k, _ in pairs(kv.key_range(log, "k1", "z"))] == ["k2", "k00007", "k7", "k10", "k100", "doc_abc", "user:5", "z"]
    assert [k for k, _ in pairs(kv.key_range(log, "k2", "k10"))] == ["k2", "k00007", "k7", "k10"]
    assert pairs(kv.key_range(log, "z", "k1")) == []


def test_random_changes_equal_a_dict(spark):
    rng, model, changes = random.Random(5), {}, []
    for _ in range(600):
        k = f"k{rng.randint(0, 60)}"
        v = None if rng.random() < 0.2 else str(rng.random())
        changes.append((k, v))
        model.pop(k, None) if v is None else model.__setitem__(k, v)
    log = log_of(spark, changes)
    assert dict(pairs(kv.latest(log))) == model
    want = sorted((int(k[1:]), v) for k, v in model.items() if 10 <= int(k[1:]) <= 30)
    assert [(int(k[1:]), v) for k, v in pairs(kv.key_range(log, "k10", "k30"))] == want


def test_compaction_and_stats(spark, tmp_path, rows):
    log = log_of(spark, [("a", "1"), ("b", "2"), ("a", None), ("k5", "5")])
    kv.compact(log, str(tmp_path / "full"))
    kv.compact(log, str(tmp_path / "part"), full=False)
    assert sorted(r["key"] for r in spark.read.parquet(str(tmp_path / "full")).collect()) == ["b", "k5"]
    part = spark.read.parquet(str(tmp_path / "part"))
    assert sorted((r["key"], r["op"]) for r in part.collect()) == [("a", "D"), ("b", "U"), ("k5", "U")]
    assert rows(kv.latest(part)) == rows(kv.latest(log))
    levels = log.selectExpr("*", "CAST(seq >= 2 AS INT) AS level")
    assert rows(kv.stats(levels)) == [(0, 2, 2, 0), (1, 2, 2, 1)]


def test_empty_log(spark):
    empty = spark.createDataFrame([], LOG)
    assert pairs(kv.scan(empty)) == [] and kv.latest(empty).count() == 0
    assert empty.select(sort_key(empty["key"])).count() == 0
