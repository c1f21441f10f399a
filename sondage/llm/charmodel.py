"""Character trigram models with Dirichlet smoothing, in tables of fixed size."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping

import numpy as np

#: Buckets of trigrams and bigrams, each twice by different hashes, and of single characters: the whole model has this size
#: whatever it is trained on. The lesser of two counts holds, so that one collision does no harm.
BUCKETS = (1 << 20, 1 << 20, 1 << 18, 1 << 18, 1 << 16)
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_EDGE = "\x02\x02"
_MARKUP = re.compile(r"<[^<>]*>|\[\d+\]|[*_#]")
_DIGITS = str.maketrans("123456789", "000000000")


def plain(word: str) -> str:
    """The form that is scored: without markup, words wholly in capitals in small letters, no-break spaces as word ends."""
    word = _MARKUP.sub("", word)
    if len(word) > 1 and word.isupper():
        word = word.lower()
    return word.replace("\xa0", _EDGE)


def codes_of(words: list[str]) -> np.ndarray:
    """Code points of the (plain) words, each after two edge marks, and two marks more at the end."""
    return np.frombuffer((_EDGE + _EDGE.join(words) + _EDGE).translate(_DIGITS).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _hash(key: np.ndarray, buckets: int, which: int) -> np.ndarray:
    mixed = (key ^ key >> np.uint64(31)) * _FACTORS[which]
    return (mixed >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


def _pairs(b: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    key = b.astype(np.uint64) << np.uint64(21) | c.astype(np.uint64)
    return [_hash(key, BUCKETS[2], w) for w in (0, 1)]


def _buckets(codes: np.ndarray) -> list[np.ndarray]:
    a, b, c = codes[:-2].astype(np.uint64), codes[1:-1], codes[2:]
    key = a << np.uint64(42) | b.astype(np.uint64) << np.uint64(21) | c.astype(np.uint64)
    return [_hash(key, BUCKETS[0], 0), _hash(key, BUCKETS[0], 1), *_pairs(b, c), (c & np.uint32(BUCKETS[4] - 1)).astype(np.int64)]


def counts_of(words: Mapping[str, int], into: list[np.ndarray]) -> None:
    """Adds the counts of words, each with its number of uses, to the tables for trigrams, bigrams and characters."""
    if not words:
        return
    forms = [plain(w) for w in words]
    # after its two edge marks a word's characters, its end and the next mark are its own
    uses = np.repeat(np.fromiter(words.values(), np.int64, len(words)), [len(w) + 2 for w in forms])
    for table, at in zip(into, _buckets(codes_of(forms)), strict=True):
        table += np.bincount(at, uses, len(table)).astype(table.dtype)


def empty_counts() -> list[np.ndarray]:
    return [np.zeros(n, np.int64) for n in BUCKETS]


class CharModel:
    """log P of words, from the counts: each order smoothed by the one below, and with a floor of a part of it."""

    def __init__(self, counts: list[np.ndarray], strength: float = 2.0, floor: float = 0.01):
        self.tables = [c.astype(np.float32) for c in counts]
        total, self.strength, self.floor = float(counts[4].sum()), strength, floor
        # letters of the scripts at hand may be unseen, yet are likelier than unseen symbols
        letters = np.array([c < 0x0530 and unicodedata.category(chr(c))[0] == "L" for c in range(BUCKETS[4])])
        seen = counts[4] + np.where(letters, 1 + 2e-6 * total, 0.05 + 1e-7 * total)
        self.p1 = (seen / seen.sum()).astype(np.float32)

    def _least(self, first: int, at: list[np.ndarray]) -> np.ndarray:
        return np.minimum(self.tables[first][at[0]], self.tables[first + 1][at[1]])

    def log_p(self, codes: np.ndarray) -> np.ndarray:
        """log P of each character from the third on, given the two before it."""
        *hashed, uni = _buckets(codes)
        s, f = self.strength, self.floor
        tri, bi = self._least(0, hashed[:2]), self._least(2, hashed[2:])
        before = self.tables[4][np.concatenate([(codes[1:2] & np.uint32(BUCKETS[4] - 1)).astype(np.int64), uni[:-1]])]
        pair_before = np.concatenate([self._least(2, _pairs(codes[:1], codes[1:2])), bi[:-1]])
        p1 = self.p1[uni]
        p2 = (1 - f) * (bi + s * p1) / (np.maximum(before, bi) + s) + f * p1
        p3 = (1 - f) * (tri + s * p2) / (np.maximum(pair_before, tri) + s) + f * p2
        return np.log(p3)

    def scores(self, words: list[str]) -> np.ndarray:
        """log P of each word with its ends."""
        if not words:
            return np.zeros(0)
        words = [plain(w) for w in words]
        each = self.log_p(codes_of(words))
        # a word's characters and the first mark after it are its own, the second mark is next to certain
        starts = np.concatenate([[0], np.cumsum([len(w) + 2 for w in words])])[:-1]
        return np.add.reduceat(np.concatenate([each, [0.0]]), starts)
