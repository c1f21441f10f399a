import datetime as dt

from sondage.api import BooleanIndex, DatedIndex, PointIndex, PositionalIndex, RankedSearch, TextIndex
from sondage.sources.kvstore import KeyValueStore

DAY = dt.date.fromisoformat


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_boolean_index_grows_and_persists(spark, tmp_path):
    index = BooleanIndex(docs(spark, ["python tutorial", "python advanced", "java tutorial"]))
    assert ids(index.query_and_not("python", "tutorial")) == [1]
    index = index.add_documents(docs(spark, ["tutorials"], 3))
    assert ids(index.query_or("Tutorial")) == [0, 2, 3] and index.get_document_count().first()[0] == 4
    index.save(str(tmp_path))
    again = BooleanIndex.load(spark, str(tmp_path))
    assert ids(again.query_and("python", "tutorial")) == [0] and again.get_term_frequency("tutorial").first()["df"] == 3
    assert again.get_document(2).first()["text"] == "java tutorial" and again.get_document(9).count() == 0


def test_dated_index(spark):
    rows = [(0, "cat dog", DAY("2023-01-01"), None), (1, "dog elephant", DAY("2023-02-01"), None), (2, "cat elephant", DAY("2023-03-01"), None)]
    index = DatedIndex(spark.createDataFrame(rows, "doc_id long, text string, start_date date, end_date date"))
    assert ids(index.query_and_date(["cat"], "2023-01-01", "2023-01-31")) == [0]
    assert ids(index.query_and_date(None, "2023-02-01", "2023-02-28", "appeared")) == [1]
    assert ids(index.query_boolean(("NOT", "cat"))) == [1]


def test_phrases_ranking_points_texts(spark, tmp_path):
    index = PositionalIndex(docs(spark, ["New York city", "york new"]))
    assert ids(index.search_phrase("new york")) == ids(index.search_phrase(["New", "", "york"])) == [0]
    assert index.get_positions("York", 0).first()["pos"] == 1 and ids(index.query_and("new", "york")) == [0, 1]
    ranked = RankedSearch(docs(spark, ["python ranking", "python ranking search engine", "java ranking"]))
    assert [r["doc_id"] for r in ranked.search_vector("python ranking").collect()][:2] == [0, 1]
    assert ranked.search_inexact_top_k("java", 1).first()["doc_id"] == 2
    PointIndex(spark.createDataFrame([(0, [1.0]), (1, [3.0])], "point_id long, coords array<double>")).save(str(tmp_path))
    assert PointIndex.load(spark, str(tmp_path)).nearest_neighbor([2.5]).first()["point_id"] == 1
    assert TextIndex(spark.createDataFrame([(0, "banana")], "text_id long, text string")).count("ana").first()["cnt"] == 2


def test_levels_of_the_store(spark, tmp_path):
    store = KeyValueStore(spark, str(tmp_path / "kv"), level_factor=2)
    assert store.scan().count() == 0
    rows = lambda *r: spark.createDataFrame(r, "key string, value string, seq long")
    for i in range(5):
        store.put(rows((f"k{i}", f"v{i}", i), ("k9", f"n{i}", i)))
    store.delete(rows(("k3", None, 10)).select("key", "seq"))
    again = KeyValueStore(spark, str(tmp_path / "kv"), level_factor=2)
    assert [(r["key"], r["value"]) for r in again.scan().collect()] == [("k0", b"v0"), ("k1", b"v1"), ("k2", b"v2"), ("k4", b"v4"), ("k9", b"n4")]
    assert again.get("k3").count() == 0 and again.get("k9").first()["value"] == b"n4"
    assert [r["key"] for r in again.range("k1", "k4").collect()] == ["k1", "k2", "k4"]
    levels = {r["level"] for r in again.report_stats().collect()}
    assert max(levels) >= 1 and sum(r["n_deletes"] for r in again.report_stats().collect()) == 1
    assert all(r["n_bytes"] > 0 and r["n_runs"] > 0 for r in again.report_stats().collect())
    held = again.scan()  # its files outlive the merge
    again.compact()
    assert held.count() == 5 and [r["n_runs"] for r in again.report_stats().collect()] == [1]
    assert sum(r["n_deletes"] for r in again.report_stats().collect()) == 0 and again.multi_get(["k1", "k3"]).count() == 1
    again.cleanup()
    assert again.scan().count() == 0
