"""Index tables on disk, with fixed schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemas of the persisted tables.
SCHEMAS = {
    "docs": "doc_id BIGINT, text STRING, start_date DATE, end_date DATE",
    "postings": "term STRING, doc_id BIGINT, tf BIGINT",
    "positions": "term STRING, doc_id BIGINT, positions ARRAY<INT>, tf INT",
    "weights": "term STRING, doc_id BIGINT, tf BIGINT, df BIGINT, idf DOUBLE, w DOUBLE, rn INT",
    "terms": "term STRING, df BIGINT, idf DOUBLE",
    "vectors": "doc_id BIGINT, length BIGINT, norm DOUBLE, vector MAP<STRING,DOUBLE>",
    "points": "point_id BIGINT, coords ARRAY<DOUBLE>, leaf INT",
}


def save_table(rows: DataFrame, path: str, name: str, mode: str = "overwrite", sort: Sequence[str | Column] = ()) -> None:
    """Writes a table under its schema, in ranges of its sort columns: term tables by term, so that a term's look-up reads few row groups, others by their first column.

    Ranges of several columns split a hot term over files. Columns that `rows` lack are NULL.
    """
    wanted = [f.strip().split(" ", 1) for f in SCHEMAS[name].split(", ")]
    typed = rows.select(*[(rows[c] if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in wanted])
    keys = list(sort) or [c for c in ("term", "doc_id") if c in typed.columns] or [wanted[0][0]]
    typed.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).parquet(f"{path}/{name}")


def load_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Reads a table under its schema; columns that the files lack are NULL."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")


def decoded_postings(blob: Column, positions: bool = False) -> Column:
    """The map doc_id -> tf (or array of positions) of a posting in JSON, as interchange has it.

    Tolerant: what is no JSON object gives an empty map, keys that are no whole numbers and counts that are no positive
    whole numbers are left out; of positions the whole numbers are kept, and lists stay even if empty. NULL gives an empty map.
    """
    raw = F.coalesce(F.from_json(blob, "map<string,string>"), F.create_map().cast("map<string,string>"))
    ids = F.map_filter(raw, lambda k, v: F.trim(k).try_cast("bigint").isNotNull() & v.isNotNull())
    if positions:
        lists = F.map_filter(ids, lambda k, v: F.ltrim(v).startswith("["))
        whole = F.transform_values(lists, lambda k, v: F.transform(F.filter(F.from_json(v, "array<string>"), lambda x: x.rlike(_WHOLE)), lambda x: x.cast("int")))
        return F.transform_keys(whole, lambda k, v: F.trim(k).cast("bigint"))
    counts = F.map_filter(ids, lambda k, v: v.rlike(_WHOLE) & (v.try_cast("bigint") > 0))
    return F.transform_keys(F.transform_values(counts, lambda k, v: v.cast("bigint")), lambda k, v: F.trim(k).cast("bigint"))


_WHOLE = "^-?[0-9]+$"


def write_results_csv(rows: DataFrame, path: str) -> None:
    """Measurements as CSV with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def read_results_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Measurements back, typed; nothing is inferred."""
    return spark.read.schema(schema).option("header", True).csv(path)
