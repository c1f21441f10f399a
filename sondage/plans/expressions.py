"""Nested Boolean queries, checked and compiled to one column.

Trees are tuples: ("TERM", t) or a bare string; ("AND", e...), ("OR", e...), ("NOT", e), ("AND_NOT", a, b),
("DATE", start, end, mode), ("AND_DATE", e, start, end, mode). AND of nothing is every record, OR of nothing is none;
a leaf that is no tuple (a list, say) or an empty tuple is none.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.analysis import Analyzer
from ..functions.dates import date_filter


@dataclass
class Compiled:
    predicate: Column
    terms: dict[str, str] = field(default_factory=dict)
    #: Whether a record that has none of the terms can satisfy the predicate, dates being favourable.
    holds_without_terms: bool = False


def compile_expression(expression, analyzer: Analyzer, start=None, end=None, mode: str = "valid") -> Compiled:
    terms: dict[str, str] = {}
    predicate, bare = _compile(expression, analyzer, terms)
    outer = date_filter(start, end, mode) if start is not None or end is not None else None
    return Compiled(predicate if outer is None else predicate & outer, terms, bare)


def _compile(e, analyzer: Analyzer, terms: dict[str, str]) -> tuple[Column, bool]:
    """The column of a tree, and its value for a record without terms whose dates all match."""
    if isinstance(e, str):
        e = ("TERM", e)
    if not isinstance(e, tuple) or not e:
        return F.lit(False), False
    op, *args = e
    if op == "TERM":
        if len(args) != 1:
            raise ValueError(f"TERM takes one term, not {len(args)}")
        name = terms.setdefault(analyzer.term_of_query(args[0]), f"_has_{len(terms)}")
        return F.col(name), False
    if op in ("AND", "OR"):
        parts = [_compile(a, analyzer, terms) for a in args]
        if op == "AND":
            return reduce(lambda x, y: x & y, [c for c, _ in parts], F.lit(True)), all(b for _, b in parts)
        return reduce(lambda x, y: x | y, [c for c, _ in parts], F.lit(False)), any(b for _, b in parts)
    if op == "NOT":
        if len(args) != 1:
            raise ValueError(f"NOT takes one expression, not {len(args)}")
        return ~_compile(args[0], analyzer, terms)[0], True
    if op == "AND_NOT":
        if len(args) != 2:
            raise ValueError(f"AND_NOT takes two expressions, not {len(args)}")
        (a, bare), (b, _) = (_compile(x, analyzer, terms) for x in args)
        return a & ~b, bare
    if op == "DATE":
        if len(args) < 3:
            raise ValueError("DATE takes start, end and mode")
        return date_filter(*args[:3]), True
    if op == "AND_DATE":
        if len(args) < 4:
            raise ValueError("AND_DATE takes an expression, start, end and mode")
        c, bare = _compile(args[0], analyzer, terms)
        return c & date_filter(*args[1:4]), bare
    raise ValueError(f"unknown operator {op!r}")
