import random

import pytest

from sondage.functions.analysis import POSITIONAL, token_table
from sondage.operators import positional


def make(spark, texts):
    return token_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), POSITIONAL)


def starts(df):
    out = {}
    for d, s in sorted((r["doc_id"], r["start"]) for r in df.collect()):
        out.setdefault(d, []).append(s)
    return out


@pytest.mark.parametrize(
    "texts, phrase, expected",
    [
        (["new york city is busy", "new big york city", "york new city"], "new york", {0: [0]}),
        (["new york city is busy", "new big york city", "york new city"], "york city", {0: [1], 1: [2]}),
        (["go go go stop", "go stop go"], "go go", {0: [0, 1]}),
        (["alpha beta alpha beta alpha", "alpha alpha beta alpha", "beta alpha beta"], "alpha beta alpha", {0: [0, 2], 1: [1]}),
        (["the cat in the hat", "cat hat"], "cat in the", {0: [1]}),
        (["alpha beta gamma", "beta beta alpha", "delta"], "beta", {0: [1], 1: [0, 1]}),
        (["running fast and runs fast", "runner fast"], "run fast", {0: [0, 3]}),
        (["a b", None, ""], "", {}),
    ],
)
def test_phrases(spark, texts, phrase, expected):
    assert starts(positional.phrase_positions(make(spark, texts), POSITIONAL.of_query(phrase))) == expected


def test_random_phrases_equal_a_scan(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(6)]
    texts = [[rng.choice(words) for _ in range(rng.randint(0, 12))] for _ in range(60)]
    tokens = make(spark, [" ".join(t) for t in texts]).cache()
    phrases = [(q, [rng.choice(words) for _ in range(rng.randint(1, 3))]) for q in range(25)]
    got = sorted(tuple(r) for r in positional.phrase_batch(tokens, phrases).collect())
    want = sorted((q, d, s) for q, p in phrases for d, t in enumerate(texts) for s in range(len(t) - len(p) + 1) if t[s : s + len(p)] == p)
    assert got == want
    tokens.unpersist()


def test_counts_positions_postings(spark, rows):
    tokens = make(spark, ["go go go stop", "go stop go"])
    assert rows(positional.count_phrase(tokens, ["go", "go"])) == [(0, 2)]
    assert rows(positional.search_phrase(tokens, ["stop"])) == [(0,), (1,)]
    assert rows(positional.get_positions(tokens, "go", 1)) == [(1, 0), (1, 2)]
    assert rows(positional.positional_postings(tokens))[0] == ("go", 0, [0, 1, 2], 3)
