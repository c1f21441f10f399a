"""The stemmer as a chain of SQL tables, one for each step, so that queries with stems can be told in SQL."""

from __future__ import annotations

from ..functions.porter import IRREGULAR, STEP2, STEP3, STEP4


def _shape(w: str) -> str:
    """V for vowels, C for consonants: y is a vowel after a consonant, which is settled from left to right, one y of a row after the other."""
    out = f"regexp_replace({w}, '[aeiou]', 'V', 'g')"
    for _ in range(3):
        out = rf"regexp_replace(regexp_replace({out}, '(^|V)y', '\1C', 'g'), '([^Vy])y', '\1V', 'g')"
    return f"regexp_replace({out}, '[^V]', 'C', 'g')"


def _measure(w: str) -> str:
    return f"len(regexp_extract_all({_shape(w)}, 'V+C'))"


def _short(w: str) -> str:
    return f"(({_shape(w)} LIKE '%CVC' AND right({w}, 1) NOT IN ('w', 'x', 'y')) OR {_shape(w)} = 'VC')"


def _ends(w: str, *suffixes: str) -> str:
    return "(" + " OR ".join(f"suffix({w}, '{s}')" for s in suffixes) + ")"


def _suffix_of(w: str, suffixes) -> str:
    return "CASE " + " ".join(f"WHEN suffix({w}, '{s}') THEN '{s}'" for s in sorted(suffixes, key=len, reverse=True)) + " ELSE '' END"


def _replaced(s: str, table: dict[str, str]) -> str:
    return f"CASE {s} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + " END"


def stem_tables(vocabulary: str) -> str:
    """Definitions of SQL tables, the last of them `stemmed` (term, stem), over the table `vocabulary` (term), lower-cased terms."""
    irregular = ", ".join(f"('{a}', '{b}')" for a, b in IRREGULAR.items())
    doubled = f"(length(st) > 1 AND right(st, 1) = right(left(st, -1), 1) AND right({_shape('st')}, 1) = 'C')"
    base = "left(w, -length(s))"
    return rf"""
    irregular(term, stem) AS (VALUES {irregular}),
    p0 AS (SELECT DISTINCT term, term AS w FROM {vocabulary} WHERE regexp_full_match(term, '[\x00-\x7F]*[a-z][\x00-\x7F]*') AND length(term) > 2 AND term NOT IN (SELECT term FROM irregular)),
    p1 AS (SELECT term, CASE WHEN suffix(w, 'ies') THEN left(w, CASE WHEN length(w) = 4 THEN -1 ELSE -2 END) WHEN suffix(w, 'sses') THEN left(w, -2)
                             WHEN suffix(w, 's') AND NOT suffix(w, 'ss') THEN left(w, -1) ELSE w END AS w FROM p0),
    p2 AS (SELECT term, w, CASE WHEN {_ends('w', 'ied', 'eed')} THEN NULL WHEN suffix(w, 'ed') AND contains({_shape('left(w, -2)')}, 'V') THEN left(w, -2)
                                WHEN suffix(w, 'ing') AND contains({_shape('left(w, -3)')}, 'V') THEN left(w, -3) END AS st FROM p1),
    p3 AS (SELECT term, CASE WHEN suffix(w, 'ied') THEN left(w, CASE WHEN length(w) = 4 THEN -1 ELSE -2 END) WHEN suffix(w, 'eed') THEN CASE WHEN {_measure('left(w, -3)')} > 0 THEN left(w, -1) ELSE w END
                             WHEN st IS NULL THEN w WHEN {_ends('st', 'at', 'bl', 'iz')} THEN st || 'e' WHEN {doubled} THEN CASE WHEN right(st, 1) IN ('l', 's', 'z') THEN st ELSE left(st, -1) END
                             WHEN {_measure('st')} = 1 AND {_short('st')} THEN st || 'e' ELSE st END AS w FROM p2),
    p4 AS (SELECT term, CASE WHEN suffix(w, 'y') AND length(w) > 2 AND right({_shape('left(w, -1)')}, 1) = 'C' THEN left(w, -1) || 'i' ELSE w END AS w FROM p3),
    p5 AS (SELECT term, CASE WHEN suffix(w, 'alli') AND {_measure('left(w, -4)')} > 0 THEN left(w, -2) ELSE w END AS w FROM p4),
    p6 AS (SELECT term, w, {_suffix_of('w', STEP2)} AS s FROM p5),
    p7 AS (SELECT term, CASE WHEN suffix(w, 'logi') THEN CASE WHEN {_measure('left(w, -3)')} > 0 THEN left(w, -1) ELSE w END
                             WHEN s <> '' AND {_measure(base)} > 0 THEN {base} || {_replaced('s', STEP2)} ELSE w END AS w FROM p6),
    p8 AS (SELECT term, w, {_suffix_of('w', STEP3)} AS s FROM p7),
    p9 AS (SELECT term, CASE WHEN s <> '' AND {_measure(base)} > 0 THEN {base} || {_replaced('s', STEP3)} ELSE w END AS w FROM p8),
    p10 AS (SELECT term, w, {_suffix_of('w', STEP4)} AS s FROM p9),
    p11 AS (SELECT term, w, CASE WHEN s IN ('sion', 'tion') THEN left(w, -3) WHEN s <> '' THEN {base} END AS st FROM p10),
    p12 AS (SELECT term, CASE WHEN st IS NOT NULL AND {_measure('st')} > 1 THEN st ELSE w END AS w FROM p11),
    p13 AS (SELECT term, w, CASE WHEN suffix(w, 'e') THEN left(w, -1) END AS st FROM p12),
    p14 AS (SELECT term, CASE WHEN st IS NOT NULL AND ({_measure('st')} > 1 OR ({_measure('st')} = 1 AND NOT {_short('st')})) THEN st ELSE w END AS w FROM p13),
    p15 AS (SELECT term, CASE WHEN suffix(w, 'll') AND {_measure('left(w, -1)')} > 1 THEN left(w, -1) ELSE w END AS w FROM p14),
    stemmed AS (SELECT v.term, coalesce(i.stem, p15.w, v.term) AS stem FROM (SELECT DISTINCT term FROM {vocabulary}) v LEFT JOIN irregular i ON i.term = v.term LEFT JOIN p15 ON p15.term = v.term)"""
