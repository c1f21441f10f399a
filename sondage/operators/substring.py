"""Substrings: every place of a pattern, and the suffix array with its tables, for one text in each row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import checkpoint_dir


def check_pattern(pattern) -> str:
    if not isinstance(pattern, str):
        raise TypeError(f"a pattern is a str, not {type(pattern).__name__}")
    if "\0" in pattern:
        raise ValueError("a pattern has no NUL")
    return pattern


def _quoted(pattern: str) -> str:
    return "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def locate(texts: DataFrame, pattern: str) -> DataFrame:
    """(text_id, pos): sorted 0-based code-point positions of the pattern, overlapping ones included, case-sensitive; every position for the empty pattern.

    text_id is unique. The text is split where the pattern lies ahead, in one pass, and the running length of the pieces is the
    position; only those lengths leave the row. Texts without the pattern go by a filter at the scan.
    """
    check_pattern(pattern)
    if not pattern:
        return texts.where(F.col("text") != "").select("text_id", F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("pos"))
    hits = texts.where(F.contains(F.col("text"), F.lit(pattern)))
    pieces = hits.select("text_id", F.startswith(F.col("text"), F.lit(pattern)).alias("at_start"), F.posexplode(F.transform(F.split("text", f"(?={_quoted(pattern)})"), F.length)).alias("i", "n"))
    before = W.partitionBy("text_id").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    starts = pieces.select("text_id", "i", "at_start", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int").alias("pos"))
    return starts.where("i > 0 OR at_start").select("text_id", "pos")


def count(texts: DataFrame, pattern: str) -> DataFrame:
    """(text_id, cnt) for every text that isn't NULL, 0 included: overlapping occurrences by a look-ahead."""
    check_pattern(pattern)
    n = F.regexp_count("text", F.lit(f"(?={_quoted(pattern)})")) if pattern else F.length("text")
    return texts.where(F.col("text").isNotNull()).select("text_id", n.cast("int").alias("cnt"))


def suffix_array(texts: DataFrame, long_text: int = 2000) -> DataFrame:
    """(text_id, rank, pos, bwt): suffixes of text + NUL in order, with the character before each (NUL for the first).

    Short texts are ranked by the suffix itself; longer ones by prefix doubling over (text_id, pos), which needs
    log2(length) rounds and no suffix as a value; in each, a long text is ranked in ranges over all tasks. Both give the
    same ranks, so `long_text` sets cost alone. A text with a NUL is an error. A job for the longest text runs first.
    """
    clean = texts.where(F.col("text").isNotNull()).select("text_id", F.when(~F.contains(F.col("text"), F.lit("\0")), F.col("text")).otherwise(F.raise_error(F.lit("a text has a NUL"))).alias("text"))
    short = clean.where(F.length("text") <= long_text)
    suffixes = short.select("text_id", "text", F.explode(F.sequence(F.lit(0), F.length("text"))).alias("pos"))
    order = W.partitionBy("text_id").orderBy(F.expr("substring(text, pos + 1)"))
    ranked = suffixes.select("text_id", (F.row_number().over(order) - 1).alias("rank"), "pos", _before(F.col("text"), F.col("pos")).alias("bwt"))
    long = clean.where(F.length("text") > long_text)
    most = long.agg(F.max(F.length("text"))).first()[0]
    return ranked if most is None else ranked.unionByName(_doubled(long, most))


def _before(text: Column, pos: Column) -> Column:
    return F.when(pos > 0, F.substring(text, pos, F.lit(1))).otherwise(F.lit("\0"))


#: Characters by which suffixes are told apart before the first doubling: 3 code points of 21 bits.
_FIRST = 3


def _doubled(texts: DataFrame, longest: int) -> DataFrame:
    checkpoint_dir(texts.sparkSession)
    rows = texts.select("text_id", "text", F.explode(F.sequence(F.lit(0), F.length("text"))).alias("pos"))
    code = lambda i: F.when(F.col("pos") + i < F.length("text"), F.ascii(F.substring("text", F.col("pos") + i + 1, F.lit(1)))).otherwise(F.lit(0)).cast("long")
    key = code(0) * (1 << 42) + code(1) * (1 << 21) + code(2)
    rows = rows.select("text_id", "pos", _before(F.col("text"), F.col("pos")).alias("bwt"), key.alias("k")).checkpoint()
    width = _FIRST
    while True:
        ahead = rows.select("text_id", (F.col("pos") - width).alias("pos"), F.col("k").alias("k2"))
        pairs = rows.join(ahead, ["text_id", "pos"], "left").fillna(-1, ["k2"])
        rows = _dense_ranks(pairs).checkpoint()
        width *= 2
        tied = rows.groupBy("text_id").agg((F.max("k") < F.count(F.lit(1))).alias("tied")).where("tied")
        if width > longest or tied.isEmpty():  # distinct ranks are final
            return rows.select("text_id", (F.col("k") - 1).cast("int").alias("rank"), "pos", "bwt")


def _dense_ranks(pairs: DataFrame) -> DataFrame:
    """(text_id, pos, bwt, k) with the dense rank of (k, k2) within each text as new k, a long text being spread over all tasks.

    Ranges of (text_id, k, k2) hold equal keys together; each range ranks its own, and begins after what the text's earlier
    ranges have counted: a sum over a row for each range and text.
    """
    ranged = pairs.repartitionByRange("text_id", "k", "k2").withColumn("part", F.spark_partition_id()).checkpoint()
    own = ranged.withColumn("own", F.dense_rank().over(W.partitionBy("text_id", "part").orderBy("k", "k2")).cast("long"))
    sizes = own.groupBy("text_id", "part").agg(F.max("own").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("text_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return own.join(sizes.select("text_id", "part", before.alias("before")), ["text_id", "part"]).select("text_id", "pos", "bwt", (F.col("own") + F.col("before")).alias("k"))


def c_array(suffixes: DataFrame) -> DataFrame:
    """(text_id, symbol, first): of each symbol the number of smaller ones."""
    counts = suffixes.groupBy("text_id", F.col("bwt").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("text_id").orderBy("symbol").rowsBetween(W.unboundedPreceding, -1)
    return counts.select("text_id", "symbol", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))


def occurrences(suffixes: DataFrame, symbol: str, step: int = 1) -> DataFrame:
    """(text_id, rank, occ): how often the symbol occurs in the transform up to and including each rank that is a multiple of step (at least 1)."""
    step = max(1, step)
    before = occ_checkpoints(suffixes.withColumn("bwt", F.when(F.col("bwt") == symbol, F.col("bwt"))), step, symbols=[symbol]).select("text_id", "rank", "occ")
    at = suffixes.where(F.col("rank") % step == 0).select("text_id", "rank", (F.col("bwt") == symbol).cast("long").alias("here"))
    return at.join(before.hint("merge"), ["text_id", "rank"], "left").select("text_id", "rank", (F.coalesce("occ", F.lit(0)) + F.col("here")).alias("occ"))


def occ_checkpoints(suffixes: DataFrame, step: int = 32, symbols: Sequence[str] | None = None) -> DataFrame:
    """(text_id, rank, symbol, occ): for each block of `step` ranks how often each symbol of the text occurs before it; all symbols of the text, or those given.

    Ranks count from 0 and the block's first one names it. Blocks are counted first. A symbol's counts in order, and a last row that
    marks the text's last block, each stand for the blocks since the row before, all of which have the same sum. So there is no
    join, whose size a planner would take from the texts' table; rows grow by symbols and blocks. Rows without text_id have no result.
    """
    step = max(1, step)
    rows = suffixes.where(F.col("text_id").isNotNull()).select("text_id", F.floor(F.col("rank") / step).alias("block"), F.col("bwt").alias("symbol"))
    if symbols is None:
        own = rows
        known = rows.groupBy("text_id", "symbol").agg(F.max("block").alias("block"))
        last = known.withColumn("block", F.max("block").over(W.partitionBy("text_id")))  # over a text's symbols, not its ranks
    else:
        own = rows.where(F.col("symbol").isin(*symbols))
        last = rows.groupBy("text_id").agg(F.max("block").alias("block")).withColumn("symbol", F.explode(F.array(*[F.lit(x) for x in symbols])))
    counts = own.groupBy("text_id", "block", "symbol").agg(F.count(F.lit(1)).alias("n"))
    marked = counts.withColumn("end", F.lit(False)).unionByName(last.withColumns({"n": F.lit(0).cast("long"), "end": F.lit(True)}))
    order = W.partitionBy("text_id", "symbol").orderBy("block", "end")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = marked.select("text_id", "symbol", "block", (F.lag("block", 1, -1).over(order) + 1).alias("first"), before.alias("occ")).where("first <= block")
    return spans.withColumn("block", F.explode(F.sequence("first", "block"))).select("text_id", (F.col("block") * step).cast("int").alias("rank"), "symbol", "occ")
