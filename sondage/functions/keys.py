"""Sort order of keys: k<digits> by number first, everything else by text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def sort_key(key: Column) -> Column:
    """A struct that orders keys: class, then length and digits of the number without leading zeros, then the text itself."""
    numeric = key.rlike("^k[0-9]+$")
    digits = F.regexp_replace(F.substring(key, 2, 1 << 30), "^0+", "")
    return F.struct(
        F.when(numeric, 0).otherwise(1).alias("kclass"),
        F.when(numeric, F.length(digits)).otherwise(0).alias("klen"),
        F.when(numeric, digits).otherwise(F.lit("")).alias("kdigits"),
        F.when(numeric, F.lit("")).otherwise(key).alias("kstr"),
    )


def sort_key_literal(key: str) -> Column:
    """The same for a bound given on the driver."""
    if re.fullmatch("k[0-9]+", key):
        digits = key[1:].lstrip("0")
        parts = (0, len(digits), digits, "")
    else:
        parts = (1, 0, "", key)
    return F.struct(*[F.lit(p).alias(n) for p, n in zip(parts, ("kclass", "klen", "kdigits", "kstr"), strict=True)])
