"""Problem 8: text once read in the wrong character encoding, found and restored."""

from __future__ import annotations

import codecs
import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread
from .charmodel import CharModel, counts_of, empty_counts

#: Encodings in which text is wrongly read, and those in which it is really stored.
READ_AS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp866", "koi8_r", "mac_cyrillic", "iso8859_5")
STORED_AS = ("utf-8", "cp1252", "mac_roman", "cp850", "cp1251", "cp866", "koi8_r")
#: (entities are resolved first, read as, stored as)
CHAINS = [(False, r, s) for s in STORED_AS for r in READ_AS if r != s] + [(True, "cp1252", "utf-8")]
#: The chain that can't be undone: letters became replacement characters or question marks. It follows those of CHAINS.
LOST = len(CHAINS)

#: What a word costs that a chain can't decode, so that a chain's passages end there.
_BREAK = -12.0
#: Below this mean log P a character, what a chain gives is no text, however unlikely the word was before.
_LEAST_LIKELY = -5.0
#: What a word counts for at most if a chain turns fewer than _SHORT letters into other letters or another script, or symbols
#: into symbols; and if it turns letters of one script into letters of the same. Either proves little by itself.
_SHORT, _SHORT_GAIN, _SAME_SCRIPT_GAIN = 4, 0.5, 4.0
#: Cyrillic letters that look like Latin ones (fixed values): in a mixed word they are look-alikes rather than damage.
_LOOK_ALIKES = str.maketrans("аеосрхуіјѕАВЕКМНОРСТХ", "aeocpxyijsABEKMHOPCTX")
_ODD = re.compile(r"[\x00-\x08\x0e-\x1f\x80-\xa0\xad─-▟�]")
_CASES = re.compile(r"[a-zß-öø-ÿа-яё][A-ZÀ-ÖØ-ÞА-ЯЁ]")
_MARKS = "«»“”„\"'’‘.,;:!?…()—–*"
_CYRILLIC, _LATIN = re.compile(r"[\u0400-\u04ff]"), re.compile(r"[A-Za-zÀ-ɏ]")
_CACHE_WORDS = 100_000
_BLOCK = 4096
#: log P of one letter more in a word of lost letters, and of there being such a word.
_LOST_LETTER, _LOST_WORD = -0.3, -3.0
_SPACES = re.compile(r"([ \n\r\t]+)")
_ENTITY = re.compile(r"&#?\w+;")
#: A word quoted by itself.
QUOTED = r"^[(\[]*[“«„\"‘‹].*[”»“\"’›][)\].,;:!?…]*$"
_QUOTED = re.compile(QUOTED, re.S)
_ONLY_MARKS = re.compile(r"^[(«“\"]?\?(?:[\-?]*\?)[.,;:!)»”\"…]*$")
_MIXED = re.compile(r"[a-zß-öø-ÿа-яё][A-ZÀ-ÖØ-ÞА-ЯЁ]|[A-Za-zÀ-ÖØ-öø-ÿ][А-Яа-яЁёΑ-ω]|[А-Яа-яЁёΑ-ω][A-Za-zÀ-ÖØ-öø-ÿ]|[\x80-\x9f�─-▟]|\w[^\w\s\-'’.,;:!?…/@()«»“”\"_&]\w")


@lru_cache(maxsize=64)
def _bytes_of(encoding: str) -> dict[int, int]:
    """Code point -> byte; bytes without a character stand for the control character of the same number, which Latin-1 readers show."""
    table = {i: i for i in range(0x80, 0xA0)}
    for i in range(256):
        try:
            table[ord(bytes([i]).decode(encoding))] = i
        except UnicodeDecodeError:
            table.setdefault(i, i)
    return table


@lru_cache(maxsize=64)
def _characters_of(encoding: str) -> str:
    """A character for each byte; U+FFFE, which codecs take for undefined, where there is none."""
    return "".join(bytes([i]).decode(encoding, "replace") for i in range(256)).replace("\ufffd", "\ufffe")


@lru_cache(maxsize=1 << 16)
def _readers(char: str) -> int:
    """The encodings of READ_AS that have the character, as bits."""
    return sum(1 << i for i, r in enumerate(READ_AS) if ord(char) in _bytes_of(r) or char < "\x80")


def _stored(raw: bytes, stored_as: str) -> str | None:
    if stored_as == "utf-8":
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return None
    right = codecs.charmap_decode(raw, "replace", _characters_of(stored_as))[0]
    return None if "\ufffd" in right else right


def undo(word: str, chain: tuple[bool, str, str]) -> str | None:
    """The word as it was before the chain's wrong reading; None if the chain can't have made it, or changes nothing."""
    entities, read_as, stored_as = chain
    if entities:
        if not _ENTITY.search(word):
            return None
        word = html.unescape(word)
    try:
        raw = codecs.charmap_encode(word, "strict", _bytes_of(read_as))[0]
    except UnicodeError:
        return None
    right = _stored(raw, stored_as)
    return None if right == word else right


def undone(word: str) -> Iterator[tuple[int, str]]:
    """Every chain that can have made the word, with what it was before; each encoding is tried once."""
    can = (1 << len(READ_AS)) - 1
    for c in set(word):
        can &= _readers(c)
    raw = {r: codecs.charmap_encode(word, "strict", _bytes_of(r))[0] for i, r in enumerate(READ_AS) if can >> i & 1}
    for j, (entities, read_as, stored_as) in enumerate(CHAINS):
        if entities:
            right = undo(word, CHAINS[j]) if "&" in word else None
        else:
            right = _stored(raw[read_as], stored_as) if read_as in raw else None
        if right is not None and right != word:
            yield j, right


def lost_letters(word: str) -> int:
    """How many letters of a word were lost, 0 if none: replacement characters, or nothing but question marks (two at least, hyphens aside)."""
    return word.count("\ufffd") or (word.count("?") if _ONLY_MARKS.match(word) else 0)


def _encoded(text: str, encoding: str) -> bytes | None:
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        return None


def damage(text: str, chain: tuple[bool, str, str]) -> str | None:
    """The text as the chain's wrong reading shows it, for validation; None where an encoding lacks a character."""
    _, read_as, stored_as = chain
    raw = _encoded(text, stored_as)
    if raw is None:
        return None
    chars = "".join(chr(i) if c == "\ufffe" else c for i, c in enumerate(_characters_of(read_as)))
    return "".join([chars[b] for b in raw])


def damaged_once(text: str, at: int) -> str | None:
    """The text damaged by one of the chains that can store it, the one at place `at` modulo their number; None where that changes nothing."""
    able = [s for s in STORED_AS if _encoded(text, s) is not None]
    chains = [c for c in CHAINS if c[2] in able and not c[0]]
    wrong = damage(text, chains[at % len(chains)]) if chains else None
    return None if wrong == text else wrong


def _worth(word: str, right: str) -> float:
    """The most that a word's change counts for, however much likelier it gets; 0 if what it becomes can't be right.

    A change of length is no such letter for letter change: that valid UTF-8 came out proves more.
    """
    cyrillic, latin = bool(_CYRILLIC.search(right)), bool(_LATIN.search(right))
    if cyrillic and latin and not (_CYRILLIC.search(word) and _LATIN.search(word)):
        return 0.0
    if _ODD.search(right) and not _ODD.search(word) or _CASES.search(right) and not _CASES.search(word):
        return 0.0
    n, bare, bare_right = sum(map(str.isalpha, right)), word.strip(_MARKS), right.strip(_MARKS)
    letters = bare.isalpha() and bare_right.isalpha()
    if n < _SHORT and len(word) == len(right) and (letters or bool(_CYRILLIC.search(word)) != cyrillic or not any(map(str.isalpha, word + right))):
        return _SHORT_GAIN
    if letters and cyrillic and not latin and not re.search("[^а-яёА-ЯЁ]", bare):
        return _SAME_SCRIPT_GAIN
    return np.inf


def _suspect(word: str) -> bool:
    return not word.isascii() or "&" in word and bool(_ENTITY.search(word)) or "??" in word and bool(_ONLY_MARKS.match(word))


def _unsound(words: set[str], known: dict[str, bool]) -> set[str]:
    """Those of the words that are of odd structure or UTF-8 read in another encoding."""
    bad = set()
    for w in words:
        if w.isascii():
            if "?" in w and _ONLY_MARKS.match(w):
                bad.add(w)
            continue
        ok = known.get(w)
        if ok is None:
            if len(known) > _CACHE_WORDS:
                known.clear()
            core = w.strip(_MARKS)
            ok = known[w] = not _MIXED.search(core) and not any(undo(core, (False, r, "utf-8")) for r in READ_AS)
        if not ok:
            bad.add(w)
    return bad


def _sound(texts: list[str], known: dict[str, bool]) -> list[list[str]]:
    """The words of the texts that have no unsound word."""
    split = [t.split() for t in texts if t]
    bad = _unsound({w for words in split for w in words}, known)
    return [words for words in split if bad.isdisjoint(words)]


class Repairer:
    """Scores every chain on every word and restores passages where the likeliest chain gains more than the margin."""

    def __init__(self, model: CharModel, margin: float):
        self.model, self.margin = model, margin
        self._gains: dict[str, np.ndarray] = {}
        self._most: dict[str, float] = {}
        self._rising: dict[str, float] = {}

    def gains(self, words: set[str]) -> dict[str, np.ndarray]:
        """log P after undoing each chain minus log P as it stands, for each word."""
        new = [w for w in words if w not in self._gains]
        if new:
            if len(self._gains) > _CACHE_WORDS:
                self._gains = {w: self._gains[w] for w in words if w in self._gains}
                self._most = {w: self._most[w] for w in self._gains}
                self._rising = {w: m for w, m in self._most.items() if m > 0}
            at, other, lost = [], [], []
            for i, w in enumerate(new):
                if _QUOTED.match(w):  # quoted as it stands: an example, not damage
                    continue
                if letters := lost_letters(w):
                    lost.append((i, letters))
                for j, right in undone(w):
                    if not right.strip() or _SPACES.search(right):
                        continue
                    at.append((i, j))
                    other.append(right)
                    if CHAINS[j][2] == "utf-8" and not right.isascii():
                        # UTF-8 damaged twice is no text after one step: what two steps give counts as well
                        deeper = [x for r in READ_AS if (x := undo(right, (False, r, "utf-8")))]
                        at += [(i, j)] * len(deeper)
                        other += deeper
            scores = self.model.scores(new + other)
            mixed = [i for i, w in enumerate(new) if _CYRILLIC.search(w) and _LATIN.search(w)]
            scores[mixed] = np.maximum(scores[mixed], self.model.scores([new[i].translate(_LOOK_ALIKES) for i in mixed]) - 2)
            table = np.full((len(new), len(CHAINS) + 1), _BREAK, np.float32)
            if at:
                rows, cols = np.array(at).T
                gain = scores[len(new) :] - scores[: len(new)][rows]
                unlikely = scores[len(new) :] < _LEAST_LIKELY * (np.array([len(r) for r in other]) + 1)
                gain[unlikely] = np.minimum(gain[unlikely], 0)
                for x in np.flatnonzero(gain > 0):
                    gain[x] = min(gain[x], _worth(new[rows[x]], other[x]))
                np.maximum.at(table, (rows, cols), gain.astype(np.float32))
            for i, letters in lost:
                # any letters may have stood there: what counts is how unlikely the marks are in clean text
                rise = _LOST_WORD + _LOST_LETTER * letters - scores[i]
                table[i, LOST] = rise if letters >= _SHORT or "\ufffd" in new[i] else min(rise, _SHORT_GAIN)
            most = np.maximum(table.max(axis=1), 0).tolist()
            for i, w in enumerate(new):
                self._gains[w], self._most[w] = table[i], most[i]
                if most[i] > 0:
                    self._rising[w] = most[i]
        return self._gains

    def at_most(self, words: list[str]) -> float:
        """No run of these words gains more."""
        return sum([self._most[w] for w in words])

    def _blocks(self, words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Block by block the first word's number, each chain's total after each word, and the least total before or at it."""
        total, low = np.zeros(LOST + 1), np.zeros(LOST + 1)
        for at in range(0, len(words), _BLOCK):
            after = total + np.cumsum(np.array([self._gains[w] for w in words[at : at + _BLOCK]], np.float64), axis=0)
            least = np.minimum.accumulate(np.vstack([low, after]), axis=0)
            yield at, after, least
            total, low = after[-1], least[-1]

    def parts(self, words: list[str]) -> list[tuple[int, int]]:
        """First and last word of stretches that no run of positive gain crosses: beyond them each chain's best run has come down to nothing."""
        up = np.concatenate([(after > least[1:]).any(axis=1) for _, after, least in self._blocks(words)] or [np.zeros(0, bool)])
        edges = np.flatnonzero(np.diff(np.concatenate([[False], up, [False]]).astype(np.int8)))
        return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))

    def best(self, words: list[str]) -> tuple[float, int, int, int]:
        """Of all chains and runs of suspect words the one of largest total gain: gain, chain, first word, last word."""
        found, start_of = (0.0, 0, 0, 0), np.zeros(LOST + 1, np.int64)
        for at, after, least in self._blocks(words):
            rise = after - least[:-1]
            # the run begins after the last place at which its chain's total was least
            place = np.maximum.accumulate(np.vstack([start_of, np.where(after <= least[1:], at + 1 + np.arange(len(after))[:, None], 0)]), axis=0)
            end, chain = np.unravel_index(rise.argmax(), rise.shape)
            if rise[end, chain] > found[0]:
                found = (float(rise[end, chain]), int(chain), int(place[end, chain]), int(at + end))
            start_of = place[-1]
        return found

    def repair(self, texts: list[str]) -> list[tuple[float, list[str], str, bool]]:
        """Of each text the gain of the best passage, the chains undone, the text restored as far as it can be, and whether letters are lost.

        Rounds go on, for double damage, until nothing is gained any more; a text that comes back to an earlier form stops there.
        """
        found: list[tuple[float, list[str], str, bool]] = [(0.0, [], t, False) for t in texts]
        seen: list[set[str]] = [{t} for t in texts]
        active, first_round = [i for i, t in enumerate(texts) if not t.isascii() or "&" in t or "??" in t], True
        while active:
            words_of = [found[i][2].replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" ") for i in active]
            self.gains({w for w in {w for words in words_of for w in words} if _suspect(w)})
            rising = self._rising
            again = []
            for i, words in zip(active, words_of, strict=True):
                # no run gains more than the words that gain at all
                up = [rising[w] for w in words if w in rising]
                if not up or self.margin < np.inf and sum(up) <= self.margin:
                    continue
                pieces = _SPACES.split(found[i][2])
                spots = [p for p, w in enumerate(pieces) if _suspect(w)]
                words = [pieces[p] for p in spots]
                gain, chains, _, lost = found[i]
                changed = False
                stack = [spots[first : last + 1] for first, last in self.parts(words)]
                while stack:
                    left = stack.pop()
                    words = [pieces[p] for p in left]
                    if self.margin < np.inf and self.at_most(words) <= self.margin:
                        continue
                    rise, chain, first, last = self.best(words)
                    gain = max(gain, rise) if first_round else gain
                    if rise <= self.margin:
                        continue
                    if chain == LOST:
                        lost = True
                    else:
                        for p in left[first : last + 1]:
                            right = undo(pieces[p], CHAINS[chain])
                            pieces[p] = pieces[p] if right is None else right
                        name, changed = ":".join(["html"] * CHAINS[chain][0] + list(CHAINS[chain][1:])), True
                        chains = chains if name in chains else [*chains, name]
                    stack += [part for part in (left[:first], left[last + 1 :]) if part]
                right = "".join(pieces) if changed else found[i][2]
                found[i] = (gain, chains, right, lost)
                if changed and right not in seen[i]:
                    seen[i].add(right)
                    again.append(i)
            active, first_round = again, False
        return found


def _counts(texts: DataFrame, model: CharModel | None, most_gain: float) -> list[np.ndarray]:
    """Counts of all clean records, summed in each task and then over tasks: at most the model's buckets come to the driver."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, known = empty_counts(), {}
        repairer = Repairer(model, np.inf) if model else None
        for f in frames:
            split = _sound(list(f["text"]), known)
            if repairer:
                every = {w for w in {w for words in split for w in words} if _suspect(w)}
                repairer.gains(every)
                suspects = [[w for w in words if w in every] for words in split]
                split = [w for w, s in zip(split, suspects, strict=True) if not s or repairer.at_most(s) <= most_gain or repairer.best(s)[0] <= most_gain]
            counts_of(Counter(w for words in split for w in words), sums)
        for kind, table in enumerate(sums):
            at = np.flatnonzero(table)
            yield pd.DataFrame({"kind": np.full(len(at), kind, np.int32), "bucket": at.astype(np.int32), "n": table[at]})

    rows = texts.select("text").where("text IS NOT NULL").mapInPandas(count, "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toPandas()
    out = empty_counts()
    for kind, table in enumerate(out):
        own = rows[rows["kind"] == kind]
        table[own["bucket"].to_numpy()] = own["n"].to_numpy()
    return out


def train(texts: DataFrame, most_gain: float = 4.5) -> CharModel:
    """A model of clean records, over all of them: first of those of sound structure, then of those of them in which no chain gains more than `most_gain` by the first model."""
    return CharModel(_counts(texts, CharModel(_counts(texts, None, 0)), most_gain))


def gain_counts(texts: DataFrame, item: str, model: CharModel, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many records gain more than none, one, two, ... all of the grid's (rising) margins: of all records as they are, and of all damaged ones.

    Every record of sound structure is damaged by one of the chains that can store it, chosen by a hash of its identifier, and
    counts unless that leaves it as it is (plain ASCII always). Counts are summed in each task and then over tasks, so
    len(grid) + 1 numbers of each kind come to the driver, whatever the number of records.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repairer, known, sums = Repairer(model, np.inf), {}, np.zeros((2, len(grid) + 1), np.int64)
        for f in frames:
            texts = list(f["text"])
            bad = [wrong for t, at in zip(texts, f["at"], strict=True) if not t.isascii() and _sound([t], known) and (wrong := damaged_once(t, at))]
            for kind, some in enumerate((texts, bad)):
                gains = [gain for gain, *_ in repairer.repair(some)]
                sums[kind] += np.bincount(np.searchsorted(grid, gains), minlength=len(grid) + 1)
        kind, above = np.nonzero(sums)
        yield pd.DataFrame({"kind": kind.astype(np.int32), "above": above.astype(np.int32), "n": sums[kind, above]})

    rows = texts.where("text IS NOT NULL").select("text", F.xxhash64(item).alias("at")).mapInPandas(count, "kind int, above int, n long").groupBy("kind", "above").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((2, len(grid) + 1), np.int64)
    for kind, above, n in rows:
        out[kind, above] = n
    return out[0], out[1]


def validated_margin(texts: DataFrame, item: str, model: CharModel, least: float = 0.5, most: float = 8.0, damaged_share: float = 0.02) -> float:
    """The margin of a grid from least to most that separates best records as they are from records damaged by a chain.

    All records are scored as they are, whatever they look like: those that gain between a margin and the grid's last are taken
    as false alarms of that margin, those that gain more as damaged. All records of sound structure are damaged and scored
    (`gain_counts`), and those that gain no more than a margin are missed by it. Errors are weighed as if `damaged_share` of
    all records were damaged. Of the margins whose error is within one standard error of the least, the largest is taken:
    margins above cost few cases, margins below can cost many sound records.
    """
    grid = np.arange(least, most + 0.25, 0.5)
    plain, bad = gain_counts(texts, item, model, grid)
    if not plain.sum() or not bad.sum():
        return float(grid[len(grid) // 2])
    missed = np.cumsum(bad)[:-1] / bad.sum()
    false = (plain[:-1].sum() - np.cumsum(plain)[:-1]) / plain.sum()
    errors = (1 - damaged_share) * false + damaged_share * missed
    at = int(errors.argmin())
    return float(grid[errors <= errors[at] + damaged_share * np.sqrt(missed[at] * (1 - missed[at]) / bad.sum()) + 1e-12].max())


def repair_texts(texts: DataFrame, item: str, margin: float | None = None) -> DataFrame:
    """(item, status, gain, chains, restored) of the records with garbled or lost characters; sound records don't come out.

    texts: `item` (BIGINT) and `text`. Character trigram models are trained on all clean records. Every chain of CHAINS is undone
    on every word that isn't plain ASCII, the result scored by the model, and the run of words that gains most
    accepted if it gains more than the margin (validated on all records unless given). Rounds follow, for double damage.
    One chain more stands for letters lost: its gain is how unlikely the model finds replacement characters, or words of
    question marks, against any word of as many letters; it counts like the others and is accepted by the same margin.
    status: 'restored'; 'partly' if lost characters remain; 'lost' if nothing could be undone. `chains` are those undone,
    as read-as:stored-as. A word quoted by itself is an example and stays. Rows equal in `item` are judged each; NULL and empty
    texts and NULL items don't come out. Other columns are ignored. No shuffle of texts.
    """
    texts = spread(texts.select(F.col(item).alias("item"), "text"))
    model = train(texts)
    margin = validated_margin(texts, "item", model) if margin is None else margin

    def fix(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repairer = Repairer(model, margin)
        for f in frames:
            rows = []
            for key, (gain, chains, right, lost) in zip(f["item"], repairer.repair(list(f["text"])), strict=True):
                if chains or lost:
                    rows.append((key, "restored" if not lost else "partly" if chains else "lost", gain, chains, right))
            yield pd.DataFrame(rows, columns=["item", "status", "gain", "chains", "restored"]).astype({"item": "int64", "gain": "float64"})

    return texts.where("text <> '' AND item IS NOT NULL").mapInPandas(fix, "item long, status string, gain double, chains array<string>, restored string")
