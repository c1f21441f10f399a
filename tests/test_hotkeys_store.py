from pyspark.sql import functions as F

from sondage.functions.analysis import BOOLEAN
from sondage.operators.hotkeys import distinct_per_key, heavy_keys, join_key_stats, keyed_aggregate
from sondage.operators.postings import current_postings
from sondage.sources.store import load_table, read_results_csv, save_table, write_results_csv
from sondage.streaming.ingest import ingest_log, ingest_postings


def skewed(spark):
    return spark.createDataFrame([("hot", i, i % 7) for i in range(300)] + [(f"k{i}", i, 1) for i in range(100)] + [(None, 1, 1)] * 50, "key string, v int, n_rows int")


def test_keyed_aggregates_under_skew(spark):
    got = {r["key"]: (r["n"], r["s"]) for r in keyed_aggregate(skewed(spark), "key", [F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")]).collect()}
    assert got["hot"] == (300, sum(range(300))) and len(got) == 101
    assert {r["key"]: r["d"] for r in distinct_per_key(skewed(spark), "key", "n_rows", "d").collect()}["hot"] == 7


def test_only_partial_states_are_shuffled(spark):
    plan = keyed_aggregate(skewed(spark), "key", [F.count(F.lit(1)).alias("n")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "SortAggregate" not in plan


def test_heavy_keys_count_all_rows(spark, rows):
    assert rows(heavy_keys(skewed(spark), "key", 0.5)) == [("hot", 300)]
    assert rows(heavy_keys(skewed(spark), "key", 0.7)) == []
    assert rows(heavy_keys(skewed(spark).limit(0), "key", 0.5)) == []


def test_join_with_hot_and_cold_keys(spark):
    stats = keyed_aggregate(skewed(spark), "key", [F.count(F.lit(1)).alias("n_rows")])
    got = join_key_stats(skewed(spark), stats, "key", "n_rows", 0.1)
    assert got.count() == 400 and got.where("key = 'hot' AND n_rows = 300").count() == 300
    assert join_key_stats(skewed(spark).limit(0), stats.limit(0), "key", "n_rows").count() == 0


def test_hot_keys_are_spread_in_the_plan(spark):
    stats = keyed_aggregate(skewed(spark), "key", [F.count(F.lit(1)).alias("n_rows")])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = join_key_stats(skewed(spark), stats, "key", "n_rows", 0.1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = next(line for line in plan.splitlines() if "SortMergeJoin" in line)
    assert join.count("_salt") == 2, join


def test_current_postings(spark, rows):
    log = [("Index", 1, 2, 1, "x"), (" index\t", 1, 5, 3, "x"), ("index", 1, 4, 2, "x"), ("index", 2, 3, 1, "x"), ("INDEX", 2, 0, 9, "x"), (None, 1, 1, 1, "x"), (" \t", 1, 1, 1, "x"), ("a", 1, None, 9, "x"), ("a", 1, 7, 1, "x"), ("b", 3, 1, 5, "x"), ("b", 3, 2, 5, "x"), ("b", 3, 1, None, "x"), ("c", None, 1, 1, "x"), ("d", 4, -1, 1, "x"), ("e", 5, 2**31 - 1, 2**62, "x"), ("f", 6, 3, -5, "x")]
    df = spark.createDataFrame(log, "term string, doc_id long, tf int, seq long, _newest string")
    assert rows(current_postings(df)) == [("a", 1, 7), ("b", 3, 2), ("e", 5, 2**31 - 1), ("f", 6, 3), ("index", 1, 5)]
    assert rows(current_postings(df.limit(0))) == []


def test_store_and_csv(spark, tmp_path, rows):
    df = spark.createDataFrame([("b", 2, 1), ("a", 1, 3)], "term string, doc_id long, tf int")
    save_table(df, str(tmp_path), "postings")
    assert rows(load_table(spark, str(tmp_path), "postings")) == [("a", 1, 3), ("b", 2, 1)]
    write_results_csv(df, str(tmp_path / "csv"))
    assert rows(read_results_csv(spark, str(tmp_path / "csv"), "term string, doc_id long, tf int")) == rows(df)


def test_streams_add_only_what_is_new(spark, tmp_path, rows):
    folder, schema = str(tmp_path / "in"), "doc_id long, text string"
    spark.createDataFrame([(1, "cat dog cat"), (2, None)], schema).write.parquet(folder)
    go = lambda: ingest_postings(spark, folder, schema, BOOLEAN, str(tmp_path / "out"), str(tmp_path / "state"))
    assert rows(go()) == [("cat", 1), ("dog", 1)]
    spark.createDataFrame([(3, "dog")], schema).write.mode("append").parquet(folder)
    assert rows(go()) == rows(go()) == [("cat", 1), ("dog", 1), ("dog", 3)]
    log = ingest_log(spark, folder, schema, lambda d: d.selectExpr("concat('k', doc_id) AS key", "text AS value", "doc_id AS seq", "'U' AS op"), str(tmp_path / "log"), str(tmp_path / "logstate"))
    assert log.count() == 3
