import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sondage.llm import topn
from sondage.llm.champions import champion_lists
from sondage.llm.distinctive import distinctive_terms, dominant_terms, weighted_terms
from sondage.llm.frequencies import term_frequencies, text_term_frequencies
from sondage.llm.topn import top_n_per_group


def test_frequencies_with_bounds_nulls_and_extra_columns(spark):
    rows = [("a", d, 2, "x") for d in range(6)] + [("b", 0, 1, "x"), ("b", 1, None, "x"), (None, 3, 1, "x"), ("c", 0, 1, "x"), ("c", 1, 1, "x"), ("c", 2, 5, "x")]
    df = spark.createDataFrame(rows, "term string, doc_id long, tf int, records string")
    got = {r["term"]: tuple(r)[1:] for r in term_frequencies(df, F.lit(12)).collect()}
    assert got == {"a": (12, 6, "common"), "b": (1, 1, "rare"), "c": (7, 3, None)}
    assert term_frequencies(df.limit(0), F.lit(12)).count() == 0
    assert {r["mark"] for r in term_frequencies(df, F.lit(12), rare_below=1, common_above=1.0).collect()} == {None}


def test_frequencies_of_texts(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "b c"), (4, "b c")], "doc_id long, text string")
    got = {r["term"]: (r["occurrences"], r["records"]) for r in text_term_frequencies(df, F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)), F.lit(5)).collect()}
    assert got == {"a": (2, 1), "b": (3, 3), "c": (2, 2)}


def by_hand(rows, n_records, prior=1000.0):
    df, total, record = Counter(t for t, *_ in rows), Counter(), Counter()
    for t, d, n in rows:
        total[t] += n
        record[d] += n
    everything = sum(total.values())
    w = {(t, d): (1 + math.log(n)) * (math.log((n_records + 1) / (df[t] + 1)) + 1) for t, d, n in rows}
    norm = defaultdict(float)
    for (_, d), x in w.items():
        norm[d] += x * x
    out = {}
    for t, d, y in rows:
        n, r = record[d], total[t] - y
        m, a = everything - n, prior * total[t] / everything
        delta = math.log((y + a) / (n + prior - y - a)) - math.log((r + a) / (m + prior - r - a))
        out[d, t] = (w[t, d], math.sqrt(norm[d]), delta, delta / math.sqrt(1 / (y + a) + 1 / (r + a)))
    return out


@pytest.mark.parametrize("share", [0.001, 0.3, 1.0])
def test_distinctive_terms_equal_the_formula(spark, share):
    rows = [("the", d, 1 + d % 3) for d in range(60)] + [(f"t{d % 11}", d, 1 + d % 5) for d in range(60)] + [("own", 5, 9), ("x", 7, 1), ("y", 7, 1)]
    df = log_of(spark, rows)
    got = {(r["doc_id"], r["term"]): (r["weight"], r["norm"], r["log_odds"], r["z"]) for r in distinctive_terms(weighted_terms(df, F.lit(60), share), hot_share=share).collect()}
    want = by_hand(rows, 60)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


def log_of(spark, rows):
    """The rows, older versions of some, and what is no posting."""
    old = [(f" {t.upper()}\t", d, n + 7, 0, "x") for t, d, n in rows[::3]]
    none = [(None, 1, 1, 1, "x"), (" ", 1, 1, 1, "x"), ("gone", 1, 5, 1, "x"), ("gone", 1, 0, 2, "x"), ("z", 1, None, 9, "x"), ("z", None, 1, 9, "x")]
    return spark.createDataFrame([(*r, 1, "x") for r in rows] + old + none, "term string, doc_id long, tf int, seq long, _hot string")


@pytest.mark.parametrize("share", [0.001, 0.2])
def test_dominant_terms(spark, rows, share):
    data = [("big", 1, 40), ("a", 1, 1), ("b", 1, 1), ("c", 1, 1), ("big", 2, 40), ("a", 2, 1)] + [(t, d, 1) for d in range(3, 20) for t in "abc"]
    weighted = weighted_terms(log_of(spark, data), F.lit(20), share)
    assert rows(dominant_terms(weighted)) == [(1, "big")]
    assert rows(dominant_terms(weighted, min_terms=2)) == [(1, "big"), (2, "big")]
    scored = {(r["doc_id"], r["term"]): r for r in distinctive_terms(weighted).collect()}
    assert len(scored) == len(data)
    assert sorted(k for k, r in scored.items() if r["terms"] >= 4 and r["weight"] >= 0.9 * r["norm"]) == [(1, "big")]
    with pytest.raises(ValueError):
        dominant_terms(weighted, share=0.5)
    empty = weighted_terms(log_of(spark, data).limit(0), F.lit(0))
    assert distinctive_terms(empty).count() == dominant_terms(empty).count() == 0


def test_a_collection_of_one_term(spark):
    df = spark.createDataFrame([("a", 1, 3, 1)], "term string, doc_id long, tf int, seq long")
    r = distinctive_terms(weighted_terms(df, F.lit(1))).first()
    assert r["log_odds"] is None and r["weight"] == pytest.approx(r["norm"])


def test_top_n_ties_nulls_and_any_columns(spark):
    data = [("hot", i, float(i % 10), 9) for i in range(500)] + [("small", 1, 5.0, 9), ("small", 2, 5.0, 9), ("small", 3, None, 9), (None, 1, 1.0, 9)]
    df = spark.createDataFrame(data, "g string, i long, v double, rank int")
    got = defaultdict(list)
    for r in top_n_per_group(df, "g", F.col("v"), "i", 4, subgroups=8).orderBy("g", "rank").collect():
        got[r["g"]].append(r["i"])
    assert got == {"hot": [9, 19, 29, 39], "small": [1, 2, 3]}
    assert top_n_per_group(df.limit(0), "g", F.col("v"), "i", 4).count() == 0
    with pytest.raises(ValueError):
        top_n_per_group(df, "g", F.col("v"), "i", 0)


def test_repeated_rows_all_count(spark):
    df = spark.createDataFrame([("g", 1, 1.0)] * 5, "g string, i long, v double")
    assert top_n_per_group(df, "g", F.col("v"), "i", 3).count() == 3


def test_champion_lists(spark):
    log = [("T", d, 1 + d % 4, d, "x") for d in range(200)] + [(" t ", 3, 0, 900, "x"), ("t", 199, 50, 901, "x"), ("u", 1, 1, 1, "x"), (None, 1, 1, 1, "x"), ("v", 1, None, 1, "x")]
    df = spark.createDataFrame(log, "term string, doc_id long, tf int, seq long, rank string")
    got = [(r["term"], r["doc_id"]) for r in champion_lists(df, 3, subgroups=4).orderBy("term", "rank").collect()]
    assert got == [("t", 199), ("t", 7), ("t", 11), ("u", 1)]
    assert champion_lists(df.limit(0)).count() == 0


def test_subgroups_grow_with_the_log(spark, monkeypatch):
    df = spark.createDataFrame([("t", d, 1 + d % 4, d) for d in range(400)], "term string, doc_id long, tf int, seq long")
    monkeypatch.setattr(topn, "SUBGROUP_ROWS", 4)
    assert spark.range(1).select(topn.subgroups_for(df)).first()[0] == 100 and spark.range(1).select(topn.subgroups_for(df.limit(3))).first()[0] == 32
    assert [r["doc_id"] for r in champion_lists(df, 3).orderBy("rank").collect()] == [3, 7, 11]


def test_dominant_terms_are_scored(spark, rows):
    """log-odds and z are worked out for them, yet lose none: x is rarer in record 0, which it dominates, than elsewhere."""
    data = [(t, d, 1) for d in range(400) for t in "abc"] + [("x", 0, 1), ("x", 1, 100_000), ("x", 2, 100_000)]
    weighted = weighted_terms(log_of(spark, data), F.lit(400))
    found = dominant_terms(weighted)
    assert rows(found) == [(0, "x"), (1, "x"), (2, "x")]
    assert distinctive_terms(weighted).where("doc_id = 0 AND term = 'x'").first()["z"] < -1.96
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "SQRT(((1.0 / " in plan and "1000.0" in plan  # the z-score's error, and the prior


def test_scores_of_huge_collections(spark):
    """A term that holds all but three of 3.2e12 tokens has a score too, where it is all that the rest has."""
    data = [("t", d, 2**31 - 1, 1) for d in range(1500)] + [(t, 1500, 1, 1) for t in "tabc"]
    scored = distinctive_terms(weighted_terms(spark.createDataFrame(data, "term string, doc_id long, tf int, seq long"), F.lit(1501)))
    z = {r["term"]: r["z"] for r in scored.where("doc_id = 1500").collect()}
    n, prior = 1500 * (2**31 - 1) + 4, 1000.0
    a, rest = prior * (n - 3) / n, prior * 3 / n
    log_odds = math.log((1 + a) / (3 + rest)) - math.log((n - 4 + a) / rest)
    assert z["t"] == pytest.approx(log_odds / math.sqrt(1 / (1 + a) + 1 / (n - 4 + a))) and None not in z.values()
