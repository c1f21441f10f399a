import random

import numpy as np
import pytest

from sondage.llm import leakage
from sondage.llm.leakage import PassageIndex, find_leaks, folded, longest_case

rng = random.Random(11)
LETTERS = "abcdefghijklmnoprstuvwz"
VOCAB = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 9))) for _ in range(4000)]


def words_of(n):
    return [rng.choice(VOCAB) for _ in range(n)]


PASSAGES = [(i, " ".join(words_of(60))) for i in range(12)]


def inside(*parts):
    return " ".join([*words_of(30), *parts, *words_of(30)])


def cut(item, first, n):
    return PASSAGES[item][1].split()[first : first + n]


def noisy(words):
    text = " ".join(w.upper() if i % 3 else f"<b>{w}</b>," for i, w in enumerate(words))
    return text.replace("A", "Á").replace(" ", "\n", 2).replace(" ", "[3] ", 1)


def replaced(words, *at):
    return [("q" * (len(w) + 2) if i in at else w) for i, w in enumerate(words)]


CASES = [
    (inside(*cut(0, 5, 12)), {(0, 12)}),
    (inside(*cut(1, 0, 60)), {(1, 60)}),
    (inside(*cut(2, 20, 11)), set()),
    (inside(noisy(cut(3, 8, 20))), {(3, 20)}),
    (inside(*replaced(cut(4, 3, 13), 6)), {(4, 13)}),
    (inside(*replaced(cut(5, 3, 12), 6)), set()),
    (inside(*replaced(cut(6, 3, 20), 9, 10)), set()),  # two of ten words in a row
    (inside(*replaced(cut(6, 3, 24), 3, 14)), {(6, 24)}),
    (inside(*replaced(cut(7, 3, 20), 5, 9, 14)), set()),
    (inside(*cut(8, 4, 7), *words_of(1), *cut(8, 11, 7)), set()),  # a word put in
    (inside(*cut(8, 4, 7), "at", "bivomin", *cut(8, 11, 13)), {(8, 13)}),
    (inside(*cut(8, 4, 8), *cut(8, 13, 8)), set()),  # a word left out
    (inside(*cut(8, 4, 7), "two", "words", *cut(8, 12, 7)), set()),  # two words for one
    (inside(*cut(8, 4, 6), "[12]", *cut(8, 10, 6), "<br/>", *cut(8, 16, 3)), {(8, 15)}),
    (inside(*cut(8, 4, 6), f'<a href="{"x" * 900}">', *cut(8, 10, 8)), {(8, 14)}),
    (inside(*[w + "s" if i == 6 else w for i, w in enumerate(cut(8, 4, 14))]), {(8, 14)}),
    (inside("".join(cut(8, 10, 15))), {(8, 15)}),
    (inside(*cut(9, 10, 14), *words_of(3), *cut(10, 1, 13)), {(9, 14), (10, 13)}),
    ("", set()),
    (None, set()),
    (" ".join(words_of(20000) + cut(11, 30, 12) + words_of(20000)), {(11, 12)}),
]


def test_folding():
    one = lambda t: "".join(map(chr, folded([t])[0][0]))
    assert one("Crème-brûlée, [12] <i>ÉTÉ</i>² œuf") == one("creme brulee ete oeuf")
    assert one("Ёлка") == one("елка") and one("frоm") == one("from") and one("a < b, c > d") == one("a b c d")
    assert one("") == one("—…!") == "" and folded([]) == ([], [])
    streams, begins = folded(["œuf à", "", "l’été<br>x <b>y</b>z"])
    assert [b.nonzero()[0].tolist() for b in begins] == [[0, 4], [], [0, 4, 5]] and list(map(len, streams)) == [5, 0, 7]


def test_cases_by_definition():
    flags = lambda s: np.array([c == "1" for c in s])
    case = lambda s, b="": longest_case(flags(s), flags(b.ljust(len(s), "0")), 12)
    assert case("1" * 12) == 12 and case("1" * 11 + "0") == case("1" * 6 + "0" + "1" * 5) == 0
    assert case("1" * 6 + "0" + "1" * 6) == 13
    assert case("0" * 5) == case("") == 0
    assert case("11111111101011111111") == 0 and case("1111" + "0" + "1" * 9 + "0" + "11111") == 20
    assert case("1" * 30, "0" * 10 + "1") == 20 and case("1" * 22, "0" * 11 + "1") == 0


@pytest.mark.parametrize("seed", range(30))
def test_cases_equal_brute_force(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(1, 70))
    found, broken = r.random(n) < r.choice([0.8, 0.9, 0.95]), r.random(n) < 0.02
    best = 0
    for a in range(n):
        for b in range(a, n):
            f = found[a : b + 1]
            gaps = np.flatnonzero(~f)
            if f[0] and f[-1] and f.sum() >= 12 and 10 * len(gaps) <= len(f) and (np.diff(gaps) >= 10).all() and not broken[a + 1 : b + 1].any():
                best = max(best, b - a + 1)
    assert longest_case(found, broken, 12) == best


def test_planted_cases(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(CASES)], "id long, text string, words string")
    items = spark.createDataFrame([*PASSAGES, PASSAGES[0], (99, None), (98, "too short"), (None, "x " * 20)], "q long, passage string")
    got = {}
    for r in find_leaks(docs, "id", items, "q", repair=False).collect():
        got.setdefault(r["item"], set()).add((r["eval_item"], r["words"]))
    assert got == {i: want for i, (_, want) in enumerate(CASES) if want}


def test_damaged_text_is_repaired_first(spark):
    good = "les cloches d’été réveillent là-bas une forêt où dépérit déjà même le vieux chêne près de l’étang gelé où rêvait".split()
    some = [" ".join(np.random.default_rng(i).choice(good, 25)) for i in range(400)]
    bad = " ".join(good).encode().decode("cp1252", "replace").replace("�", "\x9d")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*some, "x " + " ".join(good).encode("utf-8").decode("mac_roman")])], "id long, text string")
    items = spark.createDataFrame([(5, " ".join(good))], "q long, passage string")
    assert [tuple(r) for r in find_leaks(docs, "id", items, "q").where("item = 400").collect()] == [(400, 5, len(good))] and bad


@pytest.mark.parametrize("empty", ["docs", "items"])
def test_empty_tables(spark, empty):
    docs = spark.createDataFrame([] if empty == "docs" else [(1, "a b")], "id long, text string")
    items = spark.createDataFrame([] if empty == "items" else PASSAGES, "q long, passage string")
    assert find_leaks(docs, "id", items, "q", repair=False).count() == 0


def test_index_bounds_are_lossless_for_one_replaced_word():
    index = PassageIndex(PASSAGES, 12, 8)
    for item in range(6):
        for at in (1, 5, 11):
            streams, _ = folded([inside(*replaced(cut(item, 7, 13), at))])
            assert item in {int(i) for _, i, *_ in index.regions(streams, 64)}


def test_all_items_in_one_scan(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(cut(i, 0, 20))) for i in range(12)], "id long, text string")
    items = spark.createDataFrame(PASSAGES, "q long, passage string")
    monkeypatch.setattr(leakage, "ITEMS_AT_ONCE", 5)
    found = find_leaks(docs, "id", items, "q", repair=False)
    assert sorted((r["item"], r["eval_item"]) for r in found.collect()) == [(i, i) for i in range(12)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    monkeypatch.setattr(leakage, "PASSAGES_AT_ONCE", 1500)
    assert find_leaks(docs, "id", items, "q", repair=False).count() == 12


def test_a_very_long_passage(spark):
    passage = " ".join(words_of(30000))
    docs = spark.createDataFrame([(1, " ".join(passage.split()[7000:7400])), (2, passage)], "id long, text string")
    items = spark.createDataFrame([(1, passage)], "q long, passage string")
    assert sorted(tuple(r) for r in find_leaks(docs, "id", items, "q", repair=False).collect()) == [(1, 1, 400), (2, 1, 30000)]


def test_the_margin_of_the_repair_comes_from_all_texts(spark):
    """Twenty of 60,000 texts tell that one word of the wrong Cyrillic letters is damage; hardly one of them is in a sample of 2,000."""
    words = "хранит каждый термин порядку сервис читает повторном запуске фильтр документ строка таблица".split()
    damaged = [w.encode("cp1251").decode("koi8_r") if i in (3, 8) else w for i, w in enumerate(words)]
    texts = [f"the index keeps {words[i % 12]} in its list" for i in range(20)] + [" ".join(damaged), " ".join(words[::-1] * 20)] + ["the index keeps a list"] * 59978
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(4)
    items = spark.createDataFrame([(5, " ".join(words))], "q long, passage string")
    assert [tuple(r) for r in find_leaks(docs, "id", items, "q").collect()] == [(20, 5, 12)]
    assert find_leaks(docs, "id", items, "q", repair=False).count() == 0
