import datetime as dt
import random

import pytest

from sondage.functions.analysis import BOOLEAN, DATED
from sondage.functions.dates import parse_day
from sondage.operators import boolean, temporal


def make(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def dated(spark, items):
    d = lambda s: dt.date.fromisoformat(s) if s else None
    return spark.createDataFrame([(i, t, d(a), d(b)) for i, (t, a, b) in enumerate(items)], "doc_id long, text string, start_date date, end_date date")


WORDS = ["harbour", "lantern", "meadow", "orchard", "pebble", "quarry", "ribbon"]
FIRST = dt.date(2031, 5, 1).toordinal()


def random_records(seed, n=60):
    """(text, start, end) with few words and days, so that sets of all sizes come out."""
    rng = random.Random(seed)
    day = lambda: dt.date.fromordinal(FIRST + rng.randint(0, 40)).isoformat()
    return [(" ".join(rng.sample(WORDS, rng.randint(0, 4))), rng.choice([day(), day(), day(), None]), rng.choice([None, day()])) for _ in range(n)]


def having(records, word):
    return {i for i, (t, *_) in enumerate(records) if word in t.split()}


def test_sets_equal_python_sets(spark):
    records = random_records(1)
    post = boolean.boolean_postings(make(spark, [t for t, *_ in records] + [None]), BOOLEAN)
    s = BOOLEAN.term_of_query
    a, b, c = (having(records, w) for w in WORDS[:3])
    terms = [s(w) for w in WORDS[:3]]
    assert set(ids(boolean.query_term(post, terms[0]))) == a
    assert set(ids(boolean.query_and(post, *terms, terms[0]))) == a & b & c
    assert set(ids(boolean.query_or(post, *terms))) == a | b | c
    assert set(ids(boolean.query_and_not(post, terms[0], terms[1]))) == a - b
    assert ids(boolean.query_and(post)) == ids(boolean.query_or(post)) == ids(boolean.query_and(post, terms[0], "nowhere")) == []


def test_words_of_one_stem_and_stop_words(spark):
    post = boolean.boolean_postings(make(spark, ["the painting of a wall", "she paints", "painted by hand", "a pain"]), BOOLEAN)
    for word in ("paint", "Painting", "painted"):
        assert ids(boolean.query_term(post, BOOLEAN.term_of_query(word))) == [0, 1, 2]
    assert ids(boolean.query_term(post, "by")) == ids(boolean.query_term(post, "of")) == []


def test_a_hot_and_a_rare_term(spark):
    post = boolean.boolean_postings(make(spark, [f"here{' seldom' if i % 97 == 0 else ''} own{i}" for i in range(1500)]), BOOLEAN)
    both = boolean.query_and(post, BOOLEAN.term_of_query("here"), BOOLEAN.term_of_query("seldom"))
    assert ids(both) == list(range(0, 1500, 97))


def test_merge_is_a_union(spark):
    post = boolean.boolean_postings(make(spark, ["a1 b1", "b1"]), BOOLEAN)
    assert boolean.merge_postings(post, post).count() == post.count()


def random_tree(rng, depth):
    op = rng.choice(["word", "TERM"] if depth == 0 else ["AND", "OR", "NOT", "AND_NOT", "DATE", "AND_DATE", "word"])
    inner = lambda: random_tree(rng, depth - 1)
    day = lambda: rng.choice([None, dt.date.fromordinal(FIRST + rng.randint(0, 40)).isoformat()])
    if op == "word":
        return rng.choice(WORDS)
    if op == "TERM":
        return ("TERM", rng.choice(WORDS))
    if op in ("AND", "OR"):
        return (op, *[inner() for _ in range(rng.randint(0, 3))])
    if op == "NOT":
        return ("NOT", inner())
    if op == "AND_NOT":
        return ("AND_NOT", inner(), inner())
    filtered = (day(), day(), rng.choice(["valid", "appeared"]))
    return ("DATE", *filtered) if op == "DATE" else ("AND_DATE", inner(), *filtered)


def dates_match(record, start, end, mode):
    _, begins, ends = record
    last = (ends or "9999-12-31") if mode == "valid" else begins
    return begins is not None and (end is None or begins <= end) and (start is None or last >= start)


def evaluated(tree, records):
    every = set(range(len(records)))
    if isinstance(tree, str):
        return having(records, tree)
    op, *args = tree
    if op == "TERM":
        return having(records, args[0])
    if op == "DATE":
        return {i for i in every if dates_match(records[i], *args)}
    if op == "AND_DATE":
        return {i for i in evaluated(args[0], records) if dates_match(records[i], *args[1:])}
    sets = [evaluated(a, records) for a in args]
    if op == "AND":
        return every.intersection(*sets)
    if op == "OR":
        return set().union(*sets)
    return every - sets[0] if op == "NOT" else sets[0] - sets[1]


@pytest.mark.parametrize("seed", range(12))
def test_trees_equal_their_evaluation(spark, seed):
    records = random_records(seed)
    docs, tree = dated(spark, records), random_tree(random.Random(100 + seed), 3)
    assert set(ids(boolean.query_tree(docs, boolean.boolean_postings(docs, DATED), tree, DATED))) == evaluated(tree, records)


@pytest.mark.parametrize("tree, expected", [(("AND",), {0, 1}), (("OR",), set()), ([], set()), ((), set()), (["lantern"], set()), (("AND", "lantern", ("AND",)), {1})])
def test_edges_of_trees(spark, tree, expected):
    docs = dated(spark, TREES[:2])
    assert set(ids(boolean.query_tree(docs, boolean.boolean_postings(docs, DATED), tree, DATED))) == expected


TREES = [("harbour", "2031-05-01", None), ("lantern meadow", "2031-06-10", None), ("harbour lantern", "2031-06-20", None)]


@pytest.mark.parametrize("tree", [("NOT", "a", "b"), ("NOT",), ("AND_NOT", "a"), ("XOR", "a", "b"), ("AND_DATE", "a", "2023-01-01"), ("DATE", "2023-01-01", "bad", "valid"), ("DATE", None, None, "when"), ("OR", "a", ("XOR",))])
def test_bad_trees(spark, tree):
    docs = dated(spark, TREES)
    with pytest.raises(ValueError):
        boolean.query_tree(docs, boolean.boolean_postings(docs, DATED), tree, DATED)


def test_outer_dates(spark):
    docs = dated(spark, TREES)
    post = boolean.boolean_postings(docs, DATED)
    assert ids(boolean.query_tree(docs, post, ("OR", "harbour", "meadow"), DATED, "2031-06-01", "2031-06-15", "appeared")) == [1]


DATES = [("a", "2023-01-01", "2023-01-31"), ("b", "2023-01-15", "2023-02-15"), ("c", "2023-02-01", None)]


@pytest.mark.parametrize("start, end, mode, expected", [("2023-01-20", "2023-02-01", "valid", [0, 1, 2]), ("2023-01-20", "2023-02-01", "appeared", [2]), ("2023-02-01", None, "valid", [1, 2]), (None, None, "anything", [0, 1, 2]), ("2023-02-10", "2023-01-20", "valid", [1]), ("2023-02-10", "2023-01-20", "appeared", [])])
def test_dates(spark, start, end, mode, expected):
    assert ids(temporal.docs_by_date(dated(spark, DATES), start, end, mode)) == expected


def test_bad_dates(spark):
    for bad in ("invalid-date", "", 5):
        with pytest.raises(ValueError):
            parse_day(bad)
    with pytest.raises(ValueError):
        temporal.docs_by_date(dated(spark, DATES), "2023-01-01", mode="when")


def test_windows(spark, rows):
    docs = dated(spark, DATES + [("d", None, None)])
    got = rows(temporal.window_overlaps(docs, [(7, "2023-01-01", "2023-01-14"), (8, None, "2023-02-01"), (9, "2023-03-01", None)]))
    assert got == [(7, 0), (8, 0), (8, 1), (8, 2), (9, 2)]
    assert rows(temporal.window_overlaps(docs, [])) == []


def test_bit_slices_equal_comparison(spark):
    docs = dated(spark, DATES + [("d", None, None), ("e", "0001-01-01", None), ("f", "9999-12-31", None)])
    for day in ("2023-01-15", "0001-01-01", "9999-12-31"):
        assert ids(temporal.sliced_start_before(docs, day)) == ids(docs.where(f"start_date < DATE '{day}'"))
    assert ids(temporal.sliced_start_between(docs, "2023-01-15", "2023-02-01")) == [1, 2]
    assert ids(temporal.sliced_start_between(docs, "2023-02-01", "2023-01-15")) == []
