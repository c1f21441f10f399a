"""Normal forms of terms and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_term(term: Column) -> Column:
    """Spaces and tabs stripped at both ends, lower-cased; NULL for NULL and for what is blank."""
    stripped = F.lower(F.trim(term, F.lit(" \t")))
    return F.when(stripped != "", stripped)


def term_weight(tf: Column) -> Column:
    """1 + ln(tf); 0 for a count of 0 or less."""
    return F.when(tf > 0, 1 + F.log(tf.cast("double"))).otherwise(F.lit(0.0))


def smoothed_idf(n_records: Column, df: Column) -> Column:
    """ln((N + 1) / (df + 1)) + 1, N at least 1."""
    return F.log((F.greatest(n_records, F.lit(1)) + 1) / (df + 1)) + 1
