"""Validity dates: parsing, filters, and the bit-sliced form."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the ordinal of 9999-12-31, and days from 0001-01-01 to 1970-01-01 (fixed values).
ORDINAL_BITS, EPOCH_ORDINAL = 22, 719163


def parse_day(value, name: str = "date") -> dt.date | None:
    """A day from None, a date, a datetime or an ISO string; ValueError for anything else."""
    if value is None:
        return None
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    try:
        return dt.datetime.fromisoformat(value).date()
    except (TypeError, ValueError) as e:
        raise ValueError(f"{name} is no ISO date: {value!r}") from e


def day_literal(day: dt.date) -> Column:
    """A DATE constant; by text, for the year 1 has no four-digit form in strftime."""
    return F.lit(day.isoformat()).cast("date")


def strict_date(text: Column) -> Column:
    """A DATE from text in the form YYYY-MM-DD with an optional time part; NULL for what isn't one."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.substring(text, 1, 10).try_cast("date"))


def dated_records(docs: DataFrame) -> DataFrame:
    """Records with start_date and end_date as DATE. Date columns stay as they are; texts must be ISO dates, the end's may be NULL, and anything else fails the job with the value in its message."""
    kinds = dict(docs.dtypes)
    for name in ("start_date", "end_date"):
        if kinds.get(name) == "string":
            missing = F.col(name).isNull() if name == "end_date" else F.lit(False)
            wrong = F.raise_error(F.concat(F.lit(f"{name} is no ISO date: "), F.coalesce(F.col(name), F.lit("NULL")))).cast("date")
            docs = docs.withColumn(name, F.when(missing, F.lit(None).cast("date")).otherwise(F.coalesce(strict_date(F.col(name)), wrong)))
    return docs


def date_filter(start=None, end=None, mode: str = "valid", start_column: str = "start_date", end_column: str = "end_date") -> Column:
    """'valid': the record's closed interval, open-ended for a NULL end, meets [start, end]; 'appeared': it begins within. A missing bound is no bound; an unknown mode is a ValueError. A NULL start date never matches."""
    if mode not in ("valid", "appeared"):
        raise ValueError(f"unknown date mode {mode!r}")
    lo, hi = parse_day(start, "start_date"), parse_day(end, "end_date")
    begins, ends = F.col(start_column), F.coalesce(F.col(end_column), day_literal(dt.date.max)) if mode == "valid" else F.col(start_column)
    conditions = [begins.isNotNull()] + ([begins <= day_literal(hi)] if hi else []) + ([ends >= day_literal(lo)] if lo else [])
    return reduce(lambda a, b: a & b, conditions)


def ordinal(day: Column) -> Column:
    """Days since 0000-12-31; 9999-12-31 for NULL."""
    return F.unix_date(F.coalesce(day, day_literal(dt.date.max))) + EPOCH_ORDINAL


def bit_slices(day: Column) -> list[Column]:
    """The ordinal's bits, the highest first."""
    return [F.getbit(ordinal(day), F.lit(b)) == 1 for b in reversed(range(ORDINAL_BITS))]


def sliced_less(slices: list[Column], value: int, or_equal: bool = False) -> Column:
    """Whether the sliced number is less than the value: at the first bit that differs it has 0."""
    less, equal = F.lit(False), F.lit(True)
    for s, b in zip(slices, reversed(range(ORDINAL_BITS)), strict=True):
        if value >> b & 1:
            less, equal = less | (equal & ~s), equal & s
        else:
            equal = equal & ~s
    return less | equal if or_equal else less


def sliced_between(slices: list[Column], low: int, high: int) -> Column:
    """Closed range; nothing if it is inverted."""
    return F.lit(False) if low > high else ~sliced_less(slices, low) & sliced_less(slices, high, or_equal=True)
