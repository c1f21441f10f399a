"""The Porter stemmer with the usual extensions (irregular forms, ies/ied of four letters, two-letter stems)."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Irregular forms (fixed values).
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
#: Suffixes of steps 2, 3 and 4 with what replaces them (fixed values).
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """'v' for each vowel, 'c' for each consonant; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c", _shape(word)))


def _short(word: str) -> bool:
    """Ends consonant-vowel-consonant other than w, x, y; or is a vowel and a consonant."""
    shape = _shape(word)
    return (shape.endswith("cvc") and word[-1] not in "wxy") or shape == "vc"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plural(w: str) -> str:
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("sses"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) else w
    stem = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s) and "v" in _shape(w[: -len(s)])), None)
    if stem is None:
        return w
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c":
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short(stem) else stem


def _derived(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]):
        return _derived(w[:-2])
    if w.endswith("logi"):
        return w[:-1] if _measure(w[:-3]) else w
    s = _longest(w, STEP2)
    return w[: -len(s)] + STEP2[s] if s and _measure(w[: -len(s)]) else w


def _ending(w: str) -> str:
    s = _longest(w, STEP3)
    w = w[: -len(s)] + STEP3[s] if s and _measure(w[: -len(s)]) else w
    s = _longest(w, STEP4)
    if s:
        cut = w[: -3] if s in ("sion", "tion") else w[: -len(s)]
        w = cut if _measure(cut) > 1 else w
    return w


def _final(w: str) -> str:
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of one word, in small letters."""
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w
    w = _past(_plural(w))
    if w.endswith("y") and len(w) > 2 and _shape(w[:-1])[-1] == "c":
        w = w[:-1] + "i"
    return _final(_ending(_derived(w)))


_STEMMED = re.compile(r"[\x00-\x7f]*[a-z][\x00-\x7f]*")


def stem_ascii(token: str) -> str:
    """Tokens in ASCII with a letter are stemmed, others only lower-cased."""
    small = token.lower()
    return stem(small) if _STEMMED.fullmatch(small) else small


def stems(tokens: Column) -> Column:
    """Stems of an array of tokens. Of each Arrow batch only the distinct tokens are stemmed; the rest is a look-up in Arrow."""

    @F.arrow_udf("array<string>")
    def of(batch: pa.Array) -> pa.Array:
        if pa.types.is_large_list(batch.type):
            batch = batch.cast(pa.list_(pa.string()))
        starts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False))])
        coded = batch.flatten().dictionary_encode()  # without what lies behind NULL lists
        known = pa.array([None if t is None else stem_ascii(t) for t in coded.dictionary.to_pylist()], pa.string())
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), known.take(coded.indices), mask=pc.is_null(batch))

    return of(tokens)
