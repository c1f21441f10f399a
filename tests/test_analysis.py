import pytest

from sondage.functions.analysis import BOOLEAN, DATED, POSITIONAL, RANKED, token_table
from sondage.functions.porter import stem


@pytest.mark.parametrize(
    "word, expected",
    [
        ("running", "run"), ("runs", "run"), ("run", "run"), ("runner", "runner"), ("jogging", "jog"), ("ranking", "rank"), ("programming", "program"), ("tutorial", "tutori"),
        ("advanced", "advanc"), ("database", "databas"), ("databases", "databas"), ("elephant", "eleph"), ("mouse", "mous"), ("quickly", "quickli"), ("engine", "engin"),
        ("compaction", "compact"), ("cosine", "cosin"), ("storage", "storag"), ("cities", "citi"), ("flies", "fli"), ("died", "die"), ("dies", "die"), ("relational", "relat"),
        ("generalization", "gener"), ("sky", "sky"), ("word_25", "word_25"), ("unique_term", "unique_term"), ("proceed", "proceed"), ("hopping", "hop"), ("falling", "fall"),
        ("hoping", "hope"), ("agreed", "agre"), ("happy", "happi"), ("say", "say"), ("as", "as"), ("controll", "control"),
    ],
)
def test_golden_stems(word, expected):
    assert stem(word) == expected


def test_stemming_twice_may_change_a_stem():
    assert stem(stem("databases")) == "databa" and stem(stem("mouse")) == "mou"


@pytest.mark.parametrize(
    "analyzer, text, expected",
    [
        (BOOLEAN, "The cats, RUNNING in word_25!", ["cat", "run", "word_25"]),
        (BOOLEAN, "seg-07", ["seg", "07"]),
        (DATED, "seg-07 is - on", ["seg-07", "-"]),
        (POSITIONAL, "The Ёлка и ИНДЕКС runs - 42", ["the", "ёлка", "и", "индекс", "run", "-", "42"]),
        (RANKED, "The ins и ИНДЕКС", ["индекс"]),
        (RANKED, "", []),
        (RANKED, None, []),
        (RANKED, "!!! @@@", []),
    ],
)
def test_column_and_driver_agree(spark, analyzer, text, expected):
    assert analyzer.of_query(text) == expected
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = df.select(analyzer.terms(df["text"]).alias("t")).first()["t"]
    assert got == expected


def test_token_table_positions_and_extra_columns(spark, rows):
    docs = spark.createDataFrame([(1, "b a", 7, "x"), (2, None, 8, "y"), (1, "b", 9, "z")], "doc_id long, text string, pos int, term string")
    assert rows(token_table(docs, POSITIONAL)) == [(1, 0, "b"), (1, 0, "b"), (1, 1, "a")]


def test_query_terms_are_neither_split_nor_dropped():
    assert BOOLEAN.term_of_query("running fast") != "run" and BOOLEAN.term_of_query("the") == "the"
