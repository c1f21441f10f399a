import math
import random
from collections import Counter

import pytest

from sondage.functions.analysis import RANKED
from sondage.operators import ranking


class Index:
    def __init__(self, spark, texts):
        self.docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        self.index = ranking.RankedIndex.build(self.docs, RANKED)
        self.index = ranking.RankedIndex(self.index.stats.cache(), self.index.weights.cache(), self.index.norms.cache(), self.index.ids)
        self.weights = self.index.weights

    def search(self, text, k=10, model="vector", **more):
        q = ranking.query_table(self.weights, [(0, text)], RANKED)
        return [(r["doc_id"], r["score"]) for r in ranking.search(self.index, q, k, model, **more).orderBy("rank").collect()]


def by_hand(texts, query, model):
    docs = [Counter(RANKED.of_query(t)) for t in texts]
    df = Counter(t for d in docs for t in d)
    idf = {t: math.log((len(docs) + 1) / (n + 1)) + 1 for t, n in df.items()}
    vec = lambda c: {t: (1 + math.log(n)) * idf[t] for t, n in c.items() if t in idf}
    q = vec(Counter(RANKED.of_query(query)))
    out = []
    for i, d in enumerate(map(vec, docs)):
        if dot := sum(w * d[t] for t, w in q.items() if t in d):
            norm = math.hypot(*d.values()) * math.hypot(*q.values()) if model != "tfidf" else 1
            out.append((i, round(dot / norm, 9)))
    return sorted(out, key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("model", ["tfidf", "vector", None])
def test_equals_the_formula(spark, model):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(15)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(40)] + [None, "the of"]
    index = Index(spark, texts)
    for query in ("w1 w2 w2", "w3", "w5 unknown w6"):
        got = index.search(query, 10, model)
        want = by_hand(texts, query, model)[:10]
        assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-9)


def test_examples(spark):
    index = Index(spark, ["python ranking basics", "python python ranking ranking ranking", "database systems"])
    assert [d for d, _ in index.search("python ranking", model="tfidf")][:2] == [1, 0]
    assert index.search("unknown-term") == index.search("the and") == index.search("unknown-term", inexact=True) == []
    assert index.search("python", 0) == []
    with pytest.raises(ValueError):
        index.search("python", -1)


def test_tiers_and_candidates(spark, rows):
    texts = [" ".join(["alpha"] * n) for n in (5, 4, 3, 2, 1)] + ["beta beta beta"]
    weights = Index(spark, texts).weights
    got = {(r["doc_id"], r["tier"]) for r in ranking.tiers(weights, 2, 2).where("term = 'alpha'").collect()}
    assert got == {(0, "hot"), (1, "hot"), (2, "warm"), (3, "warm"), (4, "cold")}
    q = ranking.query_table(weights, [(0, "alpha")], RANKED)
    for k, want in ((1, {0}), (2, {0, 1}), (4, {0, 1, 2, 3, 4})):
        assert {r["doc_id"] for r in ranking.inexact_candidates(q, weights, k, 1, 1).collect()} == want


def test_empty_collection(spark):
    index = Index(spark, [])
    assert index.search("a1") == []


def test_hot_term_goes_by_broadcast(spark):
    texts = ["hot " + f"w{i}" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = ranking.term_counts(docs, RANKED)
    got = {r["term"]: r["df"] for r in ranking.term_weights(counts, ranking.document_count(docs)).collect()}
    assert got["hot"] == 300 and len(got) == 301
