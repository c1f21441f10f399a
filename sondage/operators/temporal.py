"""Queries by validity dates."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import ORDINAL_BITS, bit_slices, date_filter, day_literal, ordinal, parse_day, sliced_between, sliced_less


def docs_by_date(docs: DataFrame, start=None, end=None, mode: str = "valid") -> DataFrame:
    """(doc_id) by the date filter; without bounds every record, the mode then unchecked."""
    rows = docs if start is None and end is None else docs.where(date_filter(start, end, mode))
    return rows.select("doc_id").distinct()


def window_overlaps(docs: DataFrame, windows: Sequence[tuple[int, object, object]], mode: str = "valid") -> DataFrame:
    """(query_id, doc_id) for a batch of windows (query_id, start, end) given on the driver.

    The batch is a constant array, for some hundred windows: each record is tested against it where it lies and gives a
    row for each window it meets. No join, no shuffle. Many windows are a table, for `window_join`.
    """
    if mode not in ("valid", "appeared"):
        raise ValueError(f"unknown date mode {mode!r}")
    lo, hi = dt.date.min, dt.date.max
    batch = [F.struct(F.lit(int(q)).alias("id"), day_literal(parse_day(s, "start") or lo).alias("lo"), day_literal(parse_day(e, "end") or hi).alias("hi")) for q, s, e in windows]
    if not batch:
        return docs.where("false").select(F.lit(0).cast("long").alias("query_id"), "doc_id")
    ends = F.coalesce("end_date", day_literal(hi)) if mode == "valid" else F.col("start_date")
    met = F.filter(F.array(*batch), lambda w: (F.col("start_date") <= w["hi"]) & (ends >= w["lo"]))
    return docs.select("doc_id", F.explode(met).alias("w")).select(F.col("w.id").cast("long").alias("query_id"), "doc_id")


def _point_nodes(day: Column) -> Column:
    """The dyadic intervals that hold a day, as level and number in one long."""
    return F.transform(F.sequence(F.lit(0), F.lit(ORDINAL_BITS)), lambda level: level.cast("long") * (1 << 23) + F.call_function("shiftright", day, level))


def _cover_nodes(low: Column, high: Column) -> Column:
    """The fewest dyadic intervals that make up the days from low to high; none if they are inverted."""
    end = high + 1

    def of(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1), level)
        first, last = F.call_function("shiftright", low + size - 1, level), F.call_function("shiftright", end, level)
        base = level.cast("long") * (1 << 23)
        left = F.when((first < last) & (F.pmod(first, F.lit(2)) == 1), base + first)
        right = F.when((first < last) & (F.pmod(last, F.lit(2)) == 1), base + last - 1)
        return F.array_compact(F.array(left, right))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(ORDINAL_BITS)), of))


def window_join(docs: DataFrame, windows: DataFrame, mode: str = "valid", salts: int = 16) -> DataFrame:
    """(query_id, doc_id) of every record and window that meet, for a table of windows (query_id, lo, hi) of any size; NULL bounds are open.

    docs: (doc_id, start_date, end_date), ids unique on both sides. Intervals meet if the record begins within the window, or the window
    begins within the record after its first day: never both. Each of these is a day in an interval, and an interval is the
    disjoint union of a few dyadic ones (at most 44), so it is an equi-join on dyadic intervals, with the day's 23. No
    cross join; records of a much hit interval are spread by a salt. Records without a start match nothing.
    """
    if mode not in ("valid", "appeared"):
        raise ValueError(f"unknown date mode {mode!r}")
    first, last = day_literal(dt.date.min), day_literal(dt.date.max)
    w = windows.select(F.col("query_id").cast("long").alias("query_id"), ordinal(F.coalesce("lo", first)).alias("lo"), ordinal(F.coalesce("hi", last)).alias("hi")).where("query_id IS NOT NULL")
    d = docs.where("start_date IS NOT NULL").select("doc_id", ordinal(F.col("start_date")).alias("s"), ordinal(F.col("end_date") if mode == "valid" else F.col("start_date")).alias("e"))
    salted = d.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    spread = w.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    begins = salted.withColumn("node", F.explode(_point_nodes(F.col("s")))).join(spread.withColumn("node", F.explode(_cover_nodes(F.col("lo"), F.col("hi")))), ["node", "salt"])
    out = begins.where("e >= lo").select("query_id", "doc_id")
    if mode == "appeared":
        return out
    within = salted.withColumn("node", F.explode(_cover_nodes(F.col("s") + 1, F.col("e")))).join(spread.withColumn("node", F.explode(_point_nodes(F.col("lo")))), ["node", "salt"])
    return out.unionByName(within.where("s <= hi").select("query_id", "doc_id"))


def sliced_start_before(docs: DataFrame, day) -> DataFrame:
    """(doc_id) that begin before the day, by the bit-sliced comparison."""
    return docs.where(F.col("start_date").isNotNull() & sliced_less(bit_slices(F.col("start_date")), parse_day(day).toordinal())).select("doc_id").distinct()


def sliced_start_between(docs: DataFrame, start, end) -> DataFrame:
    """(doc_id) that begin within the closed range, by the bit-sliced comparison."""
    low, high = parse_day(start).toordinal(), parse_day(end).toordinal()
    return docs.where(F.col("start_date").isNotNull() & sliced_between(bit_slices(F.col("start_date")), low, high)).select("doc_id").distinct()
