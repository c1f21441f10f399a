from collections import Counter

import numpy as np
import pytest

from sondage.llm.charmodel import CharModel, counts_of, empty_counts
from sondage.llm import encodings
from sondage.llm.encodings import CHAINS, LOST, Repairer, damage, lost_letters, repair_texts, train, undo, undone, validated_margin

ENGLISH = "the café index reads a list of naïve postings which isn’t long — the writer keeps every résumé in “order” and doesn’t merge twice".split()
RUSSIAN = "список вхождений хранит каждый термин по порядку и сервис читает его при повторном запуске если фильтр слишком мал".split()
FRENCH = "la mémoire d’écriture relit une requête exacte après la dernière fusion et dépasse l’été où tout était déjà classé même là".split()


def sentence(words, i, n=16):
    rng = np.random.default_rng(i)
    return " ".join(rng.choice(words, n)) + "."


def corpus():
    return [sentence(w, i) for i in range(150) for w in (ENGLISH, RUSSIAN, FRENCH)]


@pytest.fixture(scope="module")
def repairer():
    counts = empty_counts()
    counts_of(Counter(w for t in corpus() for w in t.split()), counts)
    return Repairer(CharModel(counts), 7.0)


def test_undo_is_the_inverse_of_damage():
    for text in ("café — l’été", "Журнал запуска ёж"):
        for chain in CHAINS[:-1]:
            bad = damage(text, chain)
            if bad is not None and bad != text and chain[2] == "utf-8":
                assert undo(bad, chain) == text
    assert undo("caf&Atilde;&copy;", CHAINS[-1]) == "café"
    assert undo("donâ\x80\x99t", (False, "cp1252", "utf-8")) == "don’t" == undo("donâ€™t", (False, "cp1252", "utf-8"))


CASES = [(RUSSIAN, "cp1251", "utf-8"), (RUSSIAN, "koi8_r", "cp1251"), (RUSSIAN, "cp1251", "koi8_r"), (RUSSIAN, "cp1252", "cp1251"), (RUSSIAN, "cp866", "cp1251"), (FRENCH, "cp1252", "utf-8"), (FRENCH, "mac_roman", "utf-8"), (FRENCH, "mac_roman", "cp1252"), (FRENCH, "cp437", "utf-8"), (ENGLISH, "cp1252", "utf-8")]


@pytest.mark.parametrize("words, read_as, stored_as", CASES)
def test_whole_texts_come_back(repairer, words, read_as, stored_as):
    texts = [sentence(words, 1000 + i) for i in range(10)]
    right = repairer.repair([damage(t, (False, read_as, stored_as)) for t in texts])
    # letters that two encodings of a family share may tie; nearly all words must come back
    same = np.mean([a == b for t, (_, _, r, _) in zip(texts, right) for a, b in zip(t.split(), r.split())])
    assert same > 0.97 and all(chains and not lost for _, chains, _, lost in right)


def test_passages_and_double_damage(repairer):
    good, bad = sentence(RUSSIAN, 1), sentence(RUSSIAN, 2)
    broken = damage(bad, (False, "cp866", "utf-8"))
    assert repairer.repair([f"{good} {broken} {good}"])[0][2] == f"{good} {bad} {good}"
    once = damage("l’été déjà classé", (False, "mac_roman", "utf-8"))
    assert repairer.repair([damage(once, (False, "mac_roman", "utf-8"))])[0][2] == "l’été déjà classé"


def test_sound_texts_stay(repairer):
    for t in [*corpus()[:60], "Some editors show “Ã©” where the author typed “é”.", "┌──┬──┐ 1 │ 2 │ └──┴──┘ (° § ¶ ©)", "The label SÃO-ÁGUA is stored in capitals.", "ХРАНИТ КАЖДЫЙ ТЕРМИН", "", "why?? really????"]:
        assert repairer.repair([t])[0][1:] == ([], t, False)


def test_lost_letters(repairer):
    assert [lost_letters(w) for w in ("caf\ufffd", "????", "(??-???).", "why??", "?", "a", "")] == [1, 4, 5, 0, 0, 0, 0]
    lost = lambda t: repairer.repair([t])[0][1:] == ([], t, True)
    assert lost("a caf\ufffd text") and lost("?????? ???? " + RUSSIAN[0]) and lost("\ufffd alone") and lost(sentence(ENGLISH, 3) + " ?????????")
    for t in ("why?? really???? ¿no??", "it shows “\ufffd” here", "quoi ? comment ? où ??", ""):
        assert not lost(t)
    broken = damage(sentence(RUSSIAN, 7), (False, "cp866", "utf-8"))
    gain, chains, right, gone = repairer.repair([f"{broken} caf\ufffd"])[0]
    assert chains and gone and right == f"{sentence(RUSSIAN, 7)} caf\ufffd" and gain > 7


def test_every_chain_is_undone_as_by_itself():
    for w in ("Ð¼Ð°Ñ€Ñ‚", "йЮЛЕМЭ", "cafÃ©", "plain", "caf&Atilde;&copy;", "┬½x┬╗", ""):
        assert dict(undone(w)) == {j: r for j, c in enumerate(CHAINS) if (r := undo(w, c)) is not None}


def test_runs_across_blocks(repairer, monkeypatch):
    """Blocks are a matter of memory: whatever their size, the same runs come out."""
    bad = damage(sentence(RUSSIAN, 5, 60), (False, "koi8_r", "cp1251"))
    texts = [f"{sentence(FRENCH, 4, 30)} {bad} {sentence(FRENCH, 6, 30)} {bad}", damage(sentence(FRENCH, 9, 200), (False, "mac_roman", "utf-8"))]
    want = repairer.repair(texts)
    for size in (1, 7, 50):
        monkeypatch.setattr(encodings, "_BLOCK", size)
        assert repairer.repair(texts) == want
    words = [w for w in texts[0].split() if not w.isascii()]
    gains = np.array([repairer.gains(set(words))[w] for w in words])
    best = max((gains[a : b + 1, c].sum(), c, a, b) for c in range(LOST + 1) for a in range(len(words)) for b in range(a, len(words)))
    got = repairer.best(words)
    assert got[0] == pytest.approx(best[0], abs=1e-3) and gains[got[2] : got[3] + 1, got[1]].sum() == pytest.approx(best[0], abs=1e-3)


def test_a_long_text_is_taken_whole(repairer):
    bad = damage(sentence(FRENCH, 5), (False, "cp1252", "utf-8"))
    text = " ".join([sentence(FRENCH, 4, 20000), bad, sentence(FRENCH, 6, 20000)])
    assert repairer.repair([text])[0][2] == text.replace(bad, sentence(FRENCH, 5))


def test_table(spark):
    texts = corpus() + [damage(sentence(RUSSIAN, 900), (False, "koi8_r", "cp1251")), damage(sentence(FRENCH, 901), (False, "cp1252", "utf-8")), "a caf� text", None, ""]
    n = len(texts)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "caf�", "x")], "id long, text string, item string")
    model = train(df)
    assert 0.5 <= validated_margin(df, "id", model) <= 16.0
    got = {r["item"]: (r["status"], r["restored"]) for r in repair_texts(df, "id").collect()}
    assert set(got) == {n - 5, n - 4, n - 3}
    assert got[n - 5] == ("restored", sentence(RUSSIAN, 900)) and got[n - 4] == ("restored", sentence(FRENCH, 901)) and got[n - 3][0] == "lost"
    assert repair_texts(df.limit(0), "id").count() == 0


def test_margin_is_validated_on_all_records(spark):
    """All of 21,000 records are scored, and all sound ones damaged, however they lie in partitions."""
    texts = corpus() + ["a list of postings"] * 20548 + ["", damage(sentence(RUSSIAN, 900), (False, "koi8_r", "cp1251"))]
    df = spark.createDataFrame([*enumerate(texts), (None, None)], "id long, text string").repartition(3)
    model, grid = train(df), np.arange(0.5, 8.5, 0.5)
    plain, bad = encodings.gain_counts(df, "id", model, grid)
    at = dict(df.where("id IS NOT NULL").selectExpr("id", "xxhash64(id)").collect())
    wrong = [w for i, t in enumerate(texts) if not t.isascii() and encodings._sound([t], {}) and (w := encodings.damaged_once(t, at[i]))]
    assert plain.sum() == len(texts) and bad.sum() == len(wrong) > 250
    own = Repairer(model, np.inf)
    for counts, some in ((plain, texts), (bad, wrong)):
        gains = np.array([gain for gain, *_ in own.repair(some)])
        assert [int(counts[i + 1 :].sum()) for i in range(len(grid))] == [int((gains > m).sum()) for m in grid]
    assert validated_margin(df, "id", model) == validated_margin(df.repartition(7), "id", model)


def test_each_text_is_damaged_by_chains_that_can_store_it():
    for text in (sentence(RUSSIAN, 1), sentence(FRENCH, 2), "日本 é"):
        can = {w for c in CHAINS[:-1] if (w := damage(text, c)) is not None}
        got = {encodings.damaged_once(text, at) for at in range(-70, 70)}
        assert got - {None} == can - {text} and (None in got) == (text in can)
    assert encodings.damaged_once("plain", 3) is None and encodings.damaged_once("\ud800", 3) is None
