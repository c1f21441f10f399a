"""Problem 7: passages of evaluation items inside a corpus, found by counting shared q-grams in diagonal bands."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread
from .charmodel import CharModel
from .encodings import Repairer, train, validated_margin

#: Evaluation items of one index; a task searches its texts in one index after the other.
ITEMS_AT_ONCE = 2000
#: Characters of passages that are sent to every task (about 25 bytes each in memory); beyond it the corpus is read once more for as many.
PASSAGES_AT_ONCE = 10_000_000
_MARKUP = re.compile(r"</?[A-Za-z!][^<>]*>|\[(?:note )?\d+\]")
#: Tags inside a word's text (fixed values); others part words.
_INLINE = re.compile(r"</?(?:a|b|i|u|em|strong|span|sup|sub|font|code|small|mark)\b[^<>]*>|\[[^\]]*\]", re.I)
_LIGATURES = {"œ": "oe", "Œ": "oe", "æ": "ae", "Æ": "ae", "ß": "ss", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff"}
#: Cyrillic small letters written for Latin ones and the other way round (fixed values).
_LOOK_ALIKES = dict(zip("авекмнорстухіјѕ", "abekmhopctyxijs", strict=True))
_GAP = 0xFFFF
#: Of so many words in a row one at most may be replaced or misspelt.
PER_ERROR = 10


@lru_cache(maxsize=1)
def _fold_table() -> np.ndarray:
    """Code point -> the code point compared, 0 for what is disregarded: no case, no accents, letters and decimal digits only."""
    table = np.zeros(1 << 16, np.uint16)
    for cp in range(1 << 16):
        base = unicodedata.normalize("NFKD", chr(cp))[:1].lower()[:1]
        if base and unicodedata.category(chr(cp))[0] in "LN" and unicodedata.category(chr(cp)) != "No" and ord(base) < _GAP:
            table[cp] = ord(_LOOK_ALIKES.get(base, base))
    return table


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point whether it is white space, and the two letters of a ligature (0 for others)."""
    first, second = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.uint32)
    for c, (x, y) in _LIGATURES.items():
        first[ord(c)], second[ord(c)] = ord(x), ord(y)
    return np.array([chr(cp).isspace() for cp in range(1 << 16)]), first, second


def _unmarked(text: str) -> str:
    """Without entities, markup and note marks."""
    plain = html.unescape(text) if "&" in text else text
    if "<" in plain or "[" in plain:
        plain = _MARKUP.sub(lambda m: "" if _INLINE.fullmatch(m.group()) else " ", plain)
    return plain


def folded(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each text the codes that are compared, everything else left out, and whether a word begins with each; whole texts, of any length."""
    if not texts:
        return [], []
    plain = [_unmarked(t) for t in texts]
    space, first, second = _tables()
    codes = np.minimum(np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32), _GAP)
    text = np.repeat(np.arange(len(plain)), [len(t) for t in plain])
    double = np.flatnonzero(first[codes])
    if len(double):
        rest = second[codes[double]]
        codes, text = codes.copy(), np.insert(text, double + 1, text[double])
        codes[double] = first[codes[double]]
        codes = np.insert(codes, double + 1, rest)
    out = _fold_table()[codes]
    kept = np.flatnonzero(out)
    word, text, out = np.cumsum(space[codes])[kept], text[kept], out[kept]
    begins = np.ones(len(kept), bool)
    begins[1:] = (word[1:] != word[:-1]) | (text[1:] != text[:-1])
    edges = np.searchsorted(text, np.arange(1, len(plain)))
    return np.split(out, edges), np.split(begins, edges)


def _grams(stream: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q codes from each position on."""
    n = len(stream) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(q):
        h = h * np.uint64(0x100000001B3) + stream[i : i + n].astype(np.uint64) + np.uint64(1)
    return h ^ h >> np.uint64(29)


class PassageIndex:
    """The q-grams of all passages, and for each passage how many of them any case must keep."""

    def __init__(self, items: list[tuple[int, str]], words: int, q: int):
        self.words, self.q, self.ids, self.streams, self.starts, self.windows = words, q, [], [], [], []
        bound, span = [], []
        for (item, _), stream, begins in zip(items, *folded([passage for _, passage in items]), strict=True):
            start = np.concatenate([np.flatnonzero(begins), [len(stream)]])
            size = np.diff(start)
            if len(size) < words:
                continue
            shapes = [self._windows(size, start, words + errors, errors) for errors in range((words + 4) // (PER_ERROR - 1) + 1) if words + errors <= len(size)]
            lo, hi, kept = (np.concatenate(x) for x in zip(*shapes, strict=True))
            self.ids.append(item)
            self.streams.append(stream)
            self.starts.append(start)
            self.windows.append((lo, hi, kept))
            bound.append(int(kept.min()))
            span.append(int((hi - lo).max()))
        self.bound, self.span = np.array(bound, np.int64), np.array(span, np.int64)
        grams = [_grams(s, q) for s in self.streams]
        every = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        at = np.concatenate([np.arange(len(g)) for g in grams] + [np.zeros(0, np.int64)])
        order = np.argsort(every, kind="stable")
        self.item, self.at = item[order], at[order]
        self.keys, first = np.unique(every[order], return_index=True)
        self.first = np.concatenate([first, [len(every)]])
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def _windows(self, size: np.ndarray, start: np.ndarray, n: int, errors: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each run of n words the passage positions at which its q-grams begin, and how many of them are left by so many replaced inner words."""
        first = np.arange(len(size) - n + 1)
        lo, hi = start[first], start[first + n]
        inner = np.lib.stride_tricks.sliding_window_view(size, n)[:, 1:-1]
        gone = np.sort(inner, axis=1)[:, inner.shape[1] - errors :].sum(axis=1) if errors else 0
        return lo, hi - self.q + 1, np.maximum(1, hi - lo - gone - (errors + 1) * (self.q - 1))

    def regions(self, streams: list[np.ndarray], band: int) -> np.ndarray:
        """Rows (text, item, lowest and highest diagonal, first and last passage position) of stretches of a passage that keep enough q-grams.

        Diagonals are those of text position less passage position, in bands of width `band` that overlap by half: a case
        whose replaced words shift what follows by up to half a band lies wholly in one of them. A row has the diagonals and
        positions of the band's shared q-grams, so bands that hold the same ones give one row.
        """
        if not len(self.keys):
            return np.zeros((0, 6), np.int64)
        gap = np.full(1, _GAP, np.uint16)
        joined = np.concatenate([x for s in streams for x in (s, gap)])
        start = np.concatenate([[0], np.cumsum([len(s) + 1 for s in streams])])
        grams = _grams(joined, self.q)
        hit = np.flatnonzero(self.sieve[(grams & np.uint64((1 << 22) - 1)).astype(np.int64)])
        key = np.searchsorted(self.keys, grams[hit])
        key[key == len(self.keys)] = 0
        right = self.keys[key] == grams[hit]
        hit, key = hit[right], key[right]
        text = np.searchsorted(start, hit, side="right") - 1
        enough = np.bincount(text, minlength=len(streams)) >= self.bound.min()
        right = enough[text]
        hit, key, text = hit[right], key[right], text[right]
        out = []
        edges = np.searchsorted(text, np.arange(len(streams) + 1))
        fan = np.concatenate([[0], np.cumsum(self.first[key + 1] - self.first[key])])
        at = 0
        while at < len(streams):  # so many texts at a time that the pairs fit in memory
            end = at + 1
            while end < len(streams) and fan[edges[end + 1]] - fan[edges[at]] <= 3_000_000:
                end += 1
            if edges[end] > edges[at]:
                part = slice(edges[at], edges[end])
                out.append(self._regions(hit[part] - start[text[part]], key[part], text[part], band))
            at = end
        return np.concatenate([*out, np.zeros((0, 6), np.int64)])

    def _regions(self, where: np.ndarray, key: np.ndarray, text: np.ndarray, band: int) -> np.ndarray:
        n = self.first[key + 1] - self.first[key]
        entry = np.repeat(self.first[key] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        item, at = self.item[entry], self.at[entry]
        diagonal = np.repeat(where, n) - at
        text = np.repeat(text, n)
        pair = text.astype(np.int64) * len(self.ids) + item
        _, pair_at, count = np.unique(pair, return_inverse=True, return_counts=True)
        keep = count[pair_at] >= self.bound[item]
        pair, item, at, diagonal = pair[keep], item[keep], at[keep], diagonal[keep]
        found: list[tuple[int, ...]] = []
        if not len(pair):
            return np.zeros((0, 6), np.int64)
        for shift in (0, band // 2):
            b = (diagonal + shift) // band
            order = np.lexsort((at, b, pair))
            p, i, a, b, d = pair[order], item[order], at[order], b[order], diagonal[order]
            new = np.ones(len(p), bool)
            new[1:] = (p[1:] != p[:-1]) | (b[1:] != b[:-1]) | (a[1:] != a[:-1])
            p, i, a, b = p[new], i[new], a[new], b[new]
            low, high = np.minimum.reduceat(d, np.flatnonzero(new)), np.maximum.reduceat(d, np.flatnonzero(new))
            last = np.arange(len(p)) + self.bound[i] - 1
            ok = last < len(p)
            f, t = np.flatnonzero(ok), last[ok]
            good = f[(p[t] == p[f]) & (b[t] == b[f]) & (a[t] - a[f] < self.span[i[f]])]
            if not len(good):
                continue
            edge = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (b[1:] != b[:-1]), [True]]))
            for g in np.unique(np.searchsorted(edge, good, side="right") - 1):
                f, t = edge[g], edge[g + 1]
                lo, hi, kept = self.windows[i[f]]
                good = np.flatnonzero(np.searchsorted(a[f:t], hi) - np.searchsorted(a[f:t], lo) >= kept)
                if len(good):
                    found.append((p[f] // len(self.ids), i[f], low[f:t].min(), high[f:t].max(), lo[good[0]], hi[good].max() + self.q - 1))
        return np.unique(np.array(found, np.int64).reshape(-1, 6), axis=0)

    def longest_cases(self, streams: list[np.ndarray], begins: list[np.ndarray], rows: np.ndarray, slack: int = 16) -> np.ndarray:
        """For each region the length of the longest case in it, 0 if there is none: a banded alignment by edit distance, then `longest_case`."""
        out = np.zeros(len(rows), np.int64)
        first, last, width = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for r, (_, item, low, high, lo, hi) in enumerate(rows):
            start = self.starts[item]
            f, t = np.searchsorted(start, lo, side="right") - 1, np.searchsorted(start, hi)
            more = max(2 * self.words, (t - f) // 2)  # words without a shared q-gram at both ends
            first[r], last[r], width[r] = max(0, f - more), min(len(start) - 1, t + more), high - low + 1 + 2 * slack
        sizes = np.array([self.starts[i][t] - self.starts[i][f] for f, t, i in zip(first, last, rows[:, 1], strict=True)], np.int64)
        order, at = np.lexsort((sizes, -(-width // 16))), 0
        while at < len(order):
            end = at + 1
            most, wide = sizes[order[at]], width[order[at]]
            while end < len(order) and end - at < 256:
                most, wide = max(most, sizes[order[end]]), max(wide, width[order[end]])
                if (end + 1 - at) * most * wide > 30_000_000:
                    break
                end += 1
            some = order[at:end]
            for r, places in zip(some, self._align(streams, rows[some], first[some], last[some], int(width[some].max()), slack), strict=True):
                text, item = rows[r][0], rows[r][1]
                passage, starts = self.streams[item], self.starts[item][first[r] : last[r] + 1]
                found = _whole_words(places, starts - starts[0])
                _extend(found, places, passage[starts[0] : starts[-1]], starts - starts[0], streams[text], np.flatnonzero(begins[text]))
                out[r] = longest_case(found, _breaks(found, places, starts - starts[0], begins[text]), self.words)
            at = end
        return out

    def _align(self, streams: list[np.ndarray], rows: np.ndarray, first: np.ndarray, last: np.ndarray, width: int, slack: int) -> list[np.ndarray]:
        """For each region and code of its words first to last the place of the equal code in the text that it is aligned with, -1 without one."""
        froms = [self.starts[i][f] for f, i in zip(first, rows[:, 1], strict=True)]
        passages = [self.streams[i][a : self.starts[i][t]] for a, t, i in zip(froms, last, rows[:, 1], strict=True)]
        m, longest = len(rows), max(len(p) for p in passages)
        s = np.zeros((m, longest), np.uint16)
        t = np.full((m, longest + width), _GAP, np.uint16)
        left = np.array([r[2] - slack + a for r, a in zip(rows, froms, strict=True)])
        for r, lo in enumerate(left):
            s[r, : len(passages[r])] = passages[r]
            part = streams[rows[r][0]][max(lo, 0) : max(lo + longest + width, 0)]
            t[r, max(-lo, 0) : max(-lo, 0) + len(part)] = part[: longest + width - max(-lo, 0)]
        ramp = np.arange(width, dtype=np.int16)
        cost = np.zeros((m, width), np.int16)
        source = np.zeros((longest, m, width), np.uint8 if width <= 256 else np.uint16)
        straight = np.zeros((longest, m, width), bool)
        for i in range(longest):
            across = cost + (t[:, i : i + width] != s[:, i : i + 1])
            down = np.full((m, width), 30000, np.int16)
            down[:, :-1] = cost[:, 1:] + 1
            straight[i] = across <= down
            base = np.minimum(across, down) - ramp
            low = np.minimum.accumulate(base, axis=1)
            source[i] = np.maximum.accumulate(np.where(base == low, ramp, 0), axis=1)
            cost = low + ramp
            cost -= cost.min(axis=1, keepdims=True)  # within a band costs differ by its width at most
        every, where = np.arange(m), np.full((m, longest), -1, np.int64)
        ends = np.array([len(p) for p in passages])
        # a shorter passage ends in an earlier row; rows after its end match nothing and cost each path the same
        at = cost.argmin(axis=1)
        for i in range(longest - 1, -1, -1):
            at = source[i, every, at].astype(np.int64)
            same = straight[i, every, at]
            hit = same & (t[every, np.minimum(i + at, t.shape[1] - 1)] == s[:, i]) & (i < ends)
            where[hit, i] = i + at[hit] + left[hit]
            at = np.where(same, at, at + 1)
        return [w[:n] for w, n in zip(where, ends, strict=True)]


def _whole_words(places: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which of the words stand in the text letter by letter."""
    lost = places < 0
    lost[1:] |= np.diff(places) != 1
    lost[starts[:-1]] = places[starts[:-1]] < 0
    return np.add.reduceat(lost, starts[:-1], dtype=np.int64) == 0


def _extend(found: np.ndarray, places: np.ndarray, passage: np.ndarray, starts: np.ndarray, text: np.ndarray, begins: np.ndarray) -> None:
    """Finds the words that stand next to a found one, or behind one other word, but that an alignment of the same cost has missed."""

    def stands(word: int, at: int) -> bool:
        w = passage[starts[word] : starts[word + 1]]
        if at < 0 or at + len(w) > len(text) or not np.array_equal(text[at : at + len(w)], w):
            return False
        found[word] = True
        places[starts[word] : starts[word + 1]] = np.arange(at, at + len(w))
        return True

    n = len(found)
    for k in np.flatnonzero(found[:-1] & ~found[1:]):
        while k + 1 < n and not found[k + 1]:
            end = places[starts[k + 1] - 1] + 1
            if stands(k + 1, end):
                k += 1
                continue
            after = np.searchsorted(begins, end + 1)
            if k + 2 < n and not found[k + 2] and after < len(begins) and stands(k + 2, begins[after]):
                k += 2
                continue
            break
    for k in np.flatnonzero(found[1:] & ~found[:-1]) + 1:
        while k > 0 and not found[k - 1]:
            start = places[starts[k]]
            if stands(k - 1, start - (starts[k] - starts[k - 1])):
                k -= 1
                continue
            before = np.searchsorted(begins, start) - 1
            if k > 1 and not found[k - 2] and before >= 0 and stands(k - 2, begins[before] - (starts[k - 1] - starts[k - 2])):
                k -= 2
                continue
            break


def _breaks(found: np.ndarray, places: np.ndarray, starts: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Before which of the found words a run ends.

    Between two found words the text must have as many words as the passage has, of other letters: a passage word may be
    replaced, but none inserted or left out. Letters beside a found word that make no word of their own are a misspelling
    of the next one, which then is taken as not found. Where spaces are lost, letters stand for any number of words.
    """
    broken, word, before = np.zeros(len(found), bool), np.cumsum(begins), -1
    for k in np.flatnonzero(found):
        here = places[starts[k]]
        if before >= 0:
            end, missing = places[starts[before + 1] - 1], k - before - 1
            letters, between = here - end - 1, word[here] - word[end] - 1
            if letters < 0 or between > missing or (missing and not letters) or (between < missing and begins[end + 1] and begins[here]):
                broken[k] = True
            elif letters and not missing:
                found[k] = False
                continue
        before = k
    return broken


def longest_case(found: np.ndarray, broken: np.ndarray, words: int) -> int:
    """Length of the longest case, 0 if there is none: a run that begins and ends with a found word, passes no break, has at
    least `words` found words, and lacks at most one word in PER_ERROR, both in all and among any PER_ERROR in a row."""
    found = np.asarray(found, bool)
    n, ends, gaps = len(found), np.flatnonzero(found), np.flatnonzero(~found)
    missing = np.concatenate([[0], np.cumsum(~found)])
    # the first place that a run may not reach: a break, or a missing word too close behind another one of the run
    close = np.flatnonzero(np.diff(gaps) < PER_ERROR)
    first_close = np.append(gaps[close + 1], n)[np.searchsorted(gaps[close], ends)]
    breaks = np.flatnonzero(broken)
    limit = np.minimum(first_close, np.append(breaks, n)[np.searchsorted(breaks, ends, side="right")])
    best = 0
    for first, end in zip(ends, limit, strict=True):
        if end - first <= best:
            continue
        last = ends[np.searchsorted(ends, first + words - 1) : np.searchsorted(ends, end)]
        size, lacks = last - first + 1, missing[last + 1] - missing[first]
        best = max(best, int(size[(lacks * PER_ERROR <= size) & (size - lacks >= words)].max(initial=0)))
    return best


def _leaks(texts: DataFrame, indexes: list[PassageIndex], band: int, repair: tuple[CharModel, float] | None) -> DataFrame:
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repairer = Repairer(*repair) if repair else None
        for whole in frames:
            size = whole["text"].str.len().cumsum().to_numpy()
            for part in np.split(np.arange(len(whole)), np.flatnonzero(np.diff(size // 1_000_000)) + 1):  # about a million characters at a time
                f = whole.iloc[part]
                lines = list(f["text"])
                if repairer:
                    lines = [right for _, _, right, _ in repairer.repair(lines)]
                streams, begins = folded(lines)
                keys, found = f["item"].to_numpy(), []
                for index in indexes:
                    best: dict[tuple[int, int], int] = {}
                    rows = index.regions(streams, band)
                    for (text, i, *_), size_of in zip(rows, index.longest_cases(streams, begins, rows), strict=True):
                        if size_of:
                            best[text, i] = max(int(size_of), best.get((text, i), 0))
                    found += [(keys[t], index.ids[i], n) for (t, i), n in best.items()]
                yield pd.DataFrame(found, columns=["item", "eval_item", "words"]).astype("int64")

    return texts.where("text <> '' AND item IS NOT NULL").mapInPandas(search, "item long, eval_item long, words long")


def find_leaks(texts: DataFrame, item: str, passages: DataFrame, eval_item: str, words: int = 12, q: int = 8, band: int = 64, repair: bool = True) -> DataFrame:
    """(item, eval_item, words): the texts with at least `words` consecutive words of a passage, one word in ten replaced or misspelt at most.

    texts: `item` (BIGINT), `text`; passages: `eval_item` (BIGINT), `passage`. Case, accents, punctuation, spacing, markup, note marks
    and look-alike letters are disregarded, and damage by wrong encodings is undone first (`repair`; its
    model is trained and its margin validated on all the texts).
    `words` of the result is the length of the longest such run, missing words within it included.

    A case is a run of `words` found words or more, consecutive in the passage and in the text: a word may stand for another,
    but one put in or left out ends the run. One word in ten is read strictly: of any ten in a row one may be missing.
    So a case of 12 words has a part of 12 found words with one missing among them at most (for other `words`, (words + 4) // 9).
    By the q-gram lemma each missing word spoils at most its letters and q - 1 grams more. A band of diagonals is kept
    only if it shares as many q-grams with one of these parts of the passage as must be left. What is kept is verified by a
    banded alignment. Only a replacement that shifts what follows by more than half of `band` letters leaves its band.

    The passages' indexes go to every task and each text is folded once, where it lies, and searched in all of them: one scan
    for PASSAGES_AT_ONCE characters of passages, no shuffle of texts. Passages of fewer than `words` words can't be
    contained; NULL and empty texts and passages and NULL ids give nothing. Rows equal in `item` are searched each.
    """
    items = passages.where(F.col(eval_item).isNotNull() & (F.col("passage") != "")).select(F.col(eval_item).cast("long").alias("i"), "passage").distinct()
    texts = spread(texts.select(F.col(item).alias("item"), "text"))
    model = train(texts) if repair else None
    known = (model, validated_margin(texts, "item", model)) if repair else None
    results, indexes, rows, characters = [], [], [], 0
    for row in items.orderBy("i").toLocalIterator():
        rows.append((row["i"], row["passage"]))
        characters += len(row["passage"])
        if len(rows) == ITEMS_AT_ONCE:
            indexes.append(PassageIndex(rows, words, q))
            rows = []
        if characters >= PASSAGES_AT_ONCE:
            results.append(_leaks(texts, [*indexes, PassageIndex(rows, words, q)], band, known))
            indexes, rows, characters = [], [], 0
    if rows or indexes or not results:
        results.append(_leaks(texts, [*indexes, PassageIndex(rows, words, q)], band, known))
    every = results[0]
    for more in results[1:]:
        every = every.unionByName(more)
    return every.groupBy("item", "eval_item").agg(F.max("words").alias("words"))
