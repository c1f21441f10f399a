"""Queries of the core over a folder of tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import PositionalIndex, RankedSearch
from ..functions.analysis import BOOLEAN, DATED, ENGLISH_STOP_WORDS, POSITIONAL, RANKED, RUSSIAN_STOP_WORDS, token_table
from ..functions.porter import stems
from ..functions.terms import normal_term
from ..operators import boolean, kdtree, kv, positional, ranking, spatial, substring, temporal
from ..operators.hotkeys import distinct_per_key, heavy_keys, keyed_aggregate
from ..sources.kvstore import KeyValueStore
from ..sources.store import decoded_postings, load_table, save_table
from ..sources.tables import checkpoint_dir, table
from ..streaming.ingest import ingest_postings
from .stem_sql import stem_tables

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_TERM = "lower(trim(term, chr(32) || chr(9)))"


def _keyed(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name).withColumn("term", normal_term(F.col("term")))


@query(
    " UNION ALL ".join(
        f"SELECT '{t}' AS index_name, term FROM (SELECT {_TERM} AS term, count(*) AS n FROM {t} GROUP BY 1) WHERE term <> '' AND n >= 0.02 * (SELECT count(*) FROM {t})"
        for t in ("postings", "positional_index")
    )
)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    each = [heavy_keys(_keyed(spark, d, t), "term", 0.02).select(F.lit(t).alias("index_name"), "term") for t in ("postings", "positional_index")]
    return each[0].unionByName(each[1])


@query(
    f"""SELECT term, n_rows, n_docs, n_positions FROM
    (SELECT {_TERM} AS term, count(*) AS n_rows, CAST(coalesce(sum(len(positions)), 0) AS BIGINT) AS n_positions, count(DISTINCT doc_id) AS n_docs
     FROM positional_index WHERE term IS NOT NULL GROUP BY 1) WHERE term <> ''"""
)
def p2_term_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = _keyed(spark, d, "positional_index")
    size = F.when(F.col("positions").isNotNull(), F.size("positions"))
    stats = keyed_aggregate(rows, "term", [F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(size), F.lit(0)).alias("n_positions")])
    return stats.join(distinct_per_key(rows, "term", "doc_id", "n_docs"), "term", "left").fillna(0, ["n_docs"]).select("term", "n_rows", "n_docs", "n_positions")


# Text analysis (T) ---------------------------------------------------------------------------------------------------

_EN = ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS)
_ALL_STOP = ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS + RUSSIAN_STOP_WORDS)
_WORD = POSITIONAL.pattern


def _tokens_sql(source: str, terms: str) -> str:
    return f"SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS term FROM (SELECT doc_id, {terms} AS l FROM {source} WHERE text IS NOT NULL)"


def _pre(pattern: str) -> str:
    return f"list_filter(regexp_extract_all(lower(text), '{pattern}'), lambda x: x NOT IN ({_EN}))"


_RAW = f"list_transform(regexp_extract_all(text, '{_WORD}'), lambda x: lower(x))"
_NO_STOP = f"list_filter({_RAW}, lambda x: x NOT IN ({_ALL_STOP}))"


@query(_tokens_sql("documents", _pre("[A-Za-z0-9_]+")))
def t_tokens_ascii(spark: SparkSession, d: str) -> DataFrame:
    return token_table(table(spark, d, "documents"), BOOLEAN.without_stems())


@query(_tokens_sql("documents", _pre("[A-Za-z0-9_-]+")))
def t_tokens_hyphen(spark: SparkSession, d: str) -> DataFrame:
    return token_table(table(spark, d, "documents"), DATED.without_stems())


@query(_tokens_sql("documents", _RAW))
def t_tokens_cyrillic(spark: SparkSession, d: str) -> DataFrame:
    return token_table(table(spark, d, "documents"), POSITIONAL.without_stems())


@query(_tokens_sql("documents", _NO_STOP))
def t_tokens_ranked(spark: SparkSession, d: str) -> DataFrame:
    return token_table(table(spark, d, "documents"), RANKED.without_stems())


_STEM_DOCS = f"raw AS ({_tokens_sql('documents', _RAW)}), {stem_tables('raw')}"


@query(f"WITH {_STEM_DOCS} SELECT term, stem FROM stemmed")
def t_stem_vocab(spark: SparkSession, d: str) -> DataFrame:
    words = token_table(table(spark, d, "documents"), POSITIONAL.without_stems()).select("term").distinct()
    return words.select("term", F.get(stems(F.array("term")), F.lit(0)).alias("stem"))


@query(
    f"""WITH {_STEM_DOCS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS pos, stem AS term
    FROM raw JOIN stemmed USING (term) WHERE stem NOT IN ({_ALL_STOP})"""
)
def t_tokens_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return token_table(table(spark, d, "documents"), RANKED)


# Records of the index domain -------------------------------------------------------------------------------------------

_DOCS = """docs AS (SELECT doc_id, text, start_date, end_date FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY
    loaded_at DESC NULLS LAST, start_date DESC NULLS LAST, end_date DESC NULLS LAST, text DESC NULLS LAST) AS rn FROM dated_docs) WHERE rn = 1)"""
_PLAIN = DATED.without_stems()
_WORDS = POSITIONAL.without_stems()
_RANK = RANKED.without_stems()
_BOOL = f"WITH {_DOCS}, post AS (SELECT DISTINCT term, doc_id FROM ({_tokens_sql('docs', _pre('[A-Za-z0-9_-]+'))}))"
_POS = f"WITH {_DOCS}, tok AS ({_tokens_sql('docs', _RAW)})"


def records(spark: SparkSession, d: str, text: bool = True) -> DataFrame:
    """Records as last delivered: (doc_id[, text], start_date, end_date). Without `text` the texts are neither read nor moved."""
    wanted = ["start_date", "end_date", *(["text"] if text else [])]
    last = table(spark, d, "dated_docs").groupBy("doc_id").agg(F.max(F.struct("loaded_at", *wanted)).alias("r"))
    return last.select("doc_id", *[f"r.{c}" for c in wanted])


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, d: str, name: str, write: Callable[[str], None]) -> str:
    """The folder of a table or index that is written once in a session for each folder of tables, in the shared checkpoint folder."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _STORED:
        path = scratch(spark, name)
        write(path)
        _STORED[key] = path
    return _STORED[key]


def _postings(spark: SparkSession, d: str) -> DataFrame:
    return boolean.boolean_postings(records(spark, d), _PLAIN)


_STEM_BOOL = f"WITH {_DOCS}, raw AS ({_tokens_sql('docs', _pre('[A-Za-z0-9_-]+'))}), {stem_tables('raw')}, post AS (SELECT DISTINCT stem AS term, doc_id FROM raw JOIN stemmed USING (term))"
_STEM_POS = f"WITH {_DOCS}, raw AS ({_tokens_sql('docs', _RAW)}), {stem_tables('raw')}, tok AS (SELECT doc_id, pos, stem AS term FROM raw JOIN stemmed USING (term))"


# Boolean retrieval (B) -------------------------------------------------------------------------------------------------


@query(f"{_BOOL} SELECT doc_id FROM post WHERE term = 'index'")
def b_term(spark: SparkSession, d: str) -> DataFrame:
    return boolean.query_term(_postings(spark, d), "index")


@query(f"{_BOOL} SELECT doc_id FROM post WHERE term = 'index' INTERSECT SELECT doc_id FROM post WHERE term = 'search' INTERSECT SELECT doc_id FROM post WHERE term = 'query'")
def b_and(spark: SparkSession, d: str) -> DataFrame:
    return boolean.query_and(_postings(spark, d), "index", "search", "query", "index")


@query(f"{_BOOL} SELECT DISTINCT doc_id FROM post WHERE term IN ('bloom', 'interval')")
def b_or(spark: SparkSession, d: str) -> DataFrame:
    return boolean.query_or(_postings(spark, d), "bloom", "interval")


@query(f"{_BOOL} SELECT doc_id FROM post WHERE term = 'search' EXCEPT SELECT doc_id FROM post WHERE term = 'index'")
def b_and_not(spark: SparkSession, d: str) -> DataFrame:
    return boolean.query_and_not(_postings(spark, d), "search", "index")


_FLAGS = "f AS (SELECT doc_id, bool_or(term = 'index') AS i, bool_or(term = 'search') AS s, bool_or(term = 'bloom') AS b, bool_or(term = 'query') AS q FROM post GROUP BY doc_id), g AS (SELECT docs.doc_id, start_date, end_date, coalesce(i, false) AS i, coalesce(s, false) AS s, coalesce(b, false) AS b, coalesce(q, false) AS q FROM docs LEFT JOIN f ON docs.doc_id = f.doc_id)"
_TREE = ("OR", ("AND", ("OR", "index", ("TERM", "search")), "bloom"), ("AND_NOT", "query", "index"))


@query(f"{_BOOL}, {_FLAGS} SELECT doc_id FROM g WHERE ((i OR s) AND b) OR (q AND NOT i)")
def b_tree(spark: SparkSession, d: str) -> DataFrame:
    return boolean.query_tree(records(spark, d), _postings(spark, d), _TREE, _PLAIN)


@query(f"{_BOOL}, {_FLAGS} SELECT doc_id FROM g WHERE NOT (i OR s)")
def b_not(spark: SparkSession, d: str) -> DataFrame:
    return boolean.query_tree(records(spark, d), _postings(spark, d), ("NOT", ("OR", "index", "search")), _PLAIN)


@query(
    f"""{_BOOL}, {_FLAGS} SELECT doc_id FROM g WHERE ((i AND start_date <= DATE '2023-06-30' AND coalesce(end_date, DATE '9999-12-31') >= DATE '2023-06-01')
    OR (s AND start_date BETWEEN DATE '2024-01-01' AND DATE '2024-12-31')) AND start_date <= DATE '2024-09-30'"""
)
def b_tree_dates(spark: SparkSession, d: str) -> DataFrame:
    tree = ("OR", ("AND", "index", ("DATE", "2023-06-01", "2023-06-30", "valid")), ("AND_DATE", "search", "2024-01-01", "2024-12-31", "appeared"))
    return boolean.query_tree(records(spark, d), _postings(spark, d), tree, _PLAIN, end="2024-09-30")


@query(f"{_BOOL} SELECT p.doc_id FROM post p JOIN docs USING (doc_id) WHERE term = 'index' AND start_date <= DATE '2023-03-31' AND coalesce(end_date, DATE '9999-12-31') >= DATE '2023-03-01'")
def b_and_date(spark: SparkSession, d: str) -> DataFrame:
    return boolean.query_tree(records(spark, d), _postings(spark, d), ("AND", "index"), _PLAIN, "2023-03-01", "2023-03-31")


@query(f"{_BOOL} SELECT DISTINCT term, doc_id FROM post WHERE doc_id % 2 = 0 UNION SELECT term, doc_id FROM post WHERE doc_id % 3 = 0")
def b_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = _postings(spark, d)
    return boolean.merge_postings(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 3 = 0"))


@query(f"{_BOOL} SELECT term, count(*) AS df FROM post GROUP BY term")
def b_term_frequency(spark: SparkSession, d: str) -> DataFrame:
    return _postings(spark, d).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query(f"{_STEM_BOOL} SELECT doc_id FROM post WHERE term = 'queri' INTERSECT SELECT doc_id FROM post WHERE term = 'index' EXCEPT SELECT doc_id FROM post WHERE term = 'bloom'")
def b_stemmed(spark: SparkSession, d: str) -> DataFrame:
    tree = ("AND_NOT", ("AND", "Queries", ("TERM", "indexing")), "bloom")
    return boolean.query_tree(records(spark, d), boolean.boolean_postings(records(spark, d), DATED), tree, DATED)


@query(f"{_STEM_BOOL} SELECT term, doc_id FROM post")
def b_stemmed_postings(spark: SparkSession, d: str) -> DataFrame:
    return boolean.boolean_postings(records(spark, d), DATED)


# Dates (D) -------------------------------------------------------------------------------------------------------------


@query(f"WITH {_DOCS} SELECT doc_id FROM docs WHERE start_date <= DATE '2023-12-31' AND coalesce(end_date, DATE '9999-12-31') >= DATE '2023-12-01'")
def d_valid(spark: SparkSession, d: str) -> DataFrame:
    return temporal.docs_by_date(records(spark, d, text=False), "2023-12-01", "2023-12-31")


@query(f"WITH {_DOCS} SELECT doc_id FROM docs WHERE start_date BETWEEN DATE '2023-12-01' AND DATE '2023-12-31'")
def d_appeared(spark: SparkSession, d: str) -> DataFrame:
    return temporal.docs_by_date(records(spark, d, text=False), "2023-12-01", "2023-12-31", "appeared")


@query(f"WITH {_DOCS} SELECT doc_id FROM docs WHERE start_date <= DATE '2022-06-30'")
def d_open_start(spark: SparkSession, d: str) -> DataFrame:
    return temporal.docs_by_date(records(spark, d, text=False), None, "2022-06-30")


@query(f"WITH {_DOCS} SELECT doc_id FROM docs WHERE start_date IS NOT NULL AND coalesce(end_date, DATE '9999-12-31') >= DATE '2025-01-01'")
def d_open_end(spark: SparkSession, d: str) -> DataFrame:
    return temporal.docs_by_date(records(spark, d, text=False), "2025-01-01")


_MONTHS = [(12 * (y - 2022) + m, f"{y}-{m:02d}-01", f"{y}-{m:02d}-28") for y in (2022, 2023, 2024) for m in range(1, 13)]


@query(
    f"""WITH {_DOCS}, w AS (SELECT * FROM (VALUES {", ".join(f"({q}, DATE '{a}', DATE '{b}')" for q, a, b in _MONTHS)}) v(query_id, lo, hi))
    SELECT CAST(query_id AS BIGINT) AS query_id, count(*) AS n FROM w JOIN docs ON start_date <= hi AND coalesce(end_date, DATE '9999-12-31') >= lo GROUP BY query_id"""
)
def d_windows(spark: SparkSession, d: str) -> DataFrame:
    return temporal.window_overlaps(records(spark, d, text=False), _MONTHS).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_DOCS}, w AS (SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS query_id, min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders GROUP BY 1),
    m AS (SELECT query_id, CAST(lo + INTERVAL 28 YEAR AS DATE) AS lo, CAST(hi + INTERVAL 28 YEAR AS DATE) AS hi FROM w)
    SELECT query_id, doc_id FROM m JOIN docs ON start_date <= hi AND coalesce(end_date, DATE '9999-12-31') >= lo"""
)
def d_window_join(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    months = table(spark, d, "orders").groupBy((F.year(day) * 100 + F.month(day)).cast("long").alias("query_id")).agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    moved = months.select("query_id", *[F.add_months(c, 28 * 12).alias(c) for c in ("lo", "hi")])  # to the years of the records
    return temporal.window_join(records(spark, d, text=False), moved)


@query(f"WITH {_DOCS} SELECT doc_id FROM docs WHERE start_date < DATE '2023-07-15'")
def d_bitslice_lt(spark: SparkSession, d: str) -> DataFrame:
    return temporal.sliced_start_before(records(spark, d, text=False), "2023-07-15")


@query(f"WITH {_DOCS} SELECT doc_id FROM docs WHERE start_date BETWEEN DATE '2022-11-01' AND DATE '2023-07-15'")
def d_bitslice_between(spark: SparkSession, d: str) -> DataFrame:
    return temporal.sliced_start_between(records(spark, d, text=False), "2022-11-01", "2023-07-15")


# Phrases (P) -----------------------------------------------------------------------------------------------------------


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return token_table(records(spark, d), _WORDS)


_PHRASE = f"{_POS}, hit AS (SELECT a.doc_id, a.pos AS start FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'search' AND b.term = 'index')"


@query(f"{_PHRASE} SELECT doc_id, start FROM hit")
def ph_positions(spark: SparkSession, d: str) -> DataFrame:
    return positional.phrase_positions(_tokens(spark, d), _WORDS.of_query("search index"))


@query(f"{_PHRASE} SELECT DISTINCT doc_id FROM hit")
def ph_docs(spark: SparkSession, d: str) -> DataFrame:
    return positional.search_phrase(_tokens(spark, d), _WORDS.of_query("Search INDEX"))


@query(f"{_PHRASE} SELECT doc_id, count(*) AS cnt FROM hit GROUP BY doc_id")
def ph_count(spark: SparkSession, d: str) -> DataFrame:
    return positional.count_phrase(_tokens(spark, d), ["search", "index"])


@query(f"{_POS} SELECT a.doc_id, a.pos AS start FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'index' AND b.term = 'index'")
def ph_repeated(spark: SparkSession, d: str) -> DataFrame:
    return positional.phrase_positions(_tokens(spark, d), ["index", "index"])


@query(
    f"""{_POS}, b(query_id, x, y) AS (VALUES (1, 'search', 'index'), (2, 'index', 'of'), (3, 'of', 'the'))
    SELECT CAST(query_id AS BIGINT) AS query_id, s.doc_id, s.pos AS start FROM b JOIN tok s ON s.term = x JOIN tok t ON t.term = y AND t.doc_id = s.doc_id AND t.pos = s.pos + 1"""
)
def ph_batch(spark: SparkSession, d: str) -> DataFrame:
    return positional.phrase_batch(_tokens(spark, d), [(1, ["search", "index"]), (2, ["index", "of"]), (3, ["of", "the"])])


@query(f"{_POS} SELECT doc_id, pos FROM tok WHERE term = 'search'")
def ph_term_positions(spark: SparkSession, d: str) -> DataFrame:
    return positional.get_positions(_tokens(spark, d), "search")


@query(f"{_POS} SELECT term, doc_id, list(pos ORDER BY pos) AS positions, CAST(count(*) AS INTEGER) AS tf FROM tok GROUP BY term, doc_id")
def ph_postings(spark: SparkSession, d: str) -> DataFrame:
    return positional.positional_postings(_tokens(spark, d))


_STEM_PHRASE = f"{_STEM_POS} SELECT a.doc_id, a.pos AS start FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'search' AND b.term = 'index'"


@query(_STEM_PHRASE)
def ph_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return positional.phrase_positions(token_table(records(spark, d), POSITIONAL), POSITIONAL.of_query("Searching indexes"))


def _positional_index(spark: SparkSession, d: str) -> PositionalIndex:
    return PositionalIndex.load(spark, stored(spark, d, "positional", lambda path: PositionalIndex(records(spark, d).select("doc_id", "text")).save(path)))


@query(_STEM_PHRASE)
def ph_saved(spark: SparkSession, d: str) -> DataFrame:
    return _positional_index(spark, d).phrase_positions("Searching indexes")


@query(f"{_STEM_POS} SELECT term, doc_id, list(pos ORDER BY pos) AS positions, CAST(count(*) AS INTEGER) AS tf FROM tok GROUP BY term, doc_id")
def ph_saved_postings(spark: SparkSession, d: str) -> DataFrame:
    return _positional_index(spark, d).postings


# Ranking (R) -----------------------------------------------------------------------------------------------------------

_KEPT = f"kept AS ({_tokens_sql('docs', _NO_STOP)})"
_STEM_KEPT = f"raw AS ({_tokens_sql('docs', _RAW)}), {stem_tables('raw')}, kept AS (SELECT doc_id, stem AS term FROM raw JOIN stemmed USING (term) WHERE stem NOT IN ({_ALL_STOP}))"


def _stats_sql(kept: str) -> str:
    return f"""WITH {_DOCS}, {kept}, n AS (SELECT greatest(count(*), 1) AS n FROM docs), tf AS (SELECT term, doc_id, count(*) AS tf FROM kept GROUP BY term, doc_id),
    st AS (SELECT term, count(*) AS df, ln((max(n.n) + 1) / (count(*) + 1)) + 1 AS idf FROM tf, n GROUP BY term),
    wt AS (SELECT tf.term, doc_id, tf, idf, (1 + ln(tf)) * idf AS w FROM tf JOIN st USING (term)),
    nm AS (SELECT doc_id, sum(tf) AS length, sqrt(sum(w * w)) AS norm FROM wt GROUP BY doc_id)"""


_STATS = _stats_sql(_KEPT)


def _weights(spark: SparkSession, d: str) -> DataFrame:
    docs = records(spark, d)
    return ranking.term_weights(ranking.term_counts(docs, _RANK), ranking.document_count(docs))


@query(f"{_STATS} SELECT term, df, round(idf, 9) AS idf FROM st")
def r_df_idf(spark: SparkSession, d: str) -> DataFrame:
    docs = records(spark, d)
    return ranking.term_stats(ranking.term_counts(docs, _RANK), ranking.document_count(docs)).select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"{_STATS} SELECT term, doc_id, tf, round(w, 9) AS w FROM wt")
def r_weights(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, d).select("term", "doc_id", "tf", F.round("w", 9).alias("w"))


@query(f"{_STATS} SELECT docs.doc_id, CAST(coalesce(length, 0) AS BIGINT) AS length, round(coalesce(norm, 0), 6) AS norm FROM docs LEFT JOIN nm ON docs.doc_id = nm.doc_id")
def r_norms(spark: SparkSession, d: str) -> DataFrame:
    return ranking.doc_stats(records(spark, d), _weights(spark, d)).select("doc_id", "length", F.round("norm", 6).alias("norm"))


_QUERY = "index поиск query bloom index"
_QW = "q(term, qtf) AS (VALUES ('index', 2), ('поиск', 1), ('query', 1), ('bloom', 1)), qw AS (SELECT q.term, (1 + ln(qtf)) * idf AS wq FROM q JOIN st USING (term)), sc AS (SELECT doc_id, sum(wq * w) AS score FROM qw JOIN wt USING (term) GROUP BY doc_id)"


def _index(spark: SparkSession, d: str) -> ranking.RankedIndex:
    return ranking.RankedIndex.build(records(spark, d), _RANK)


def _ranked(spark: SparkSession, d: str, model: str, inexact: bool = False, k: int = 10) -> DataFrame:
    index = _index(spark, d)
    q = ranking.query_table(index.weights, [(0, _QUERY)], _RANK)
    return ranking.search(index, q, k, model, inexact).select("doc_id", "score", "rank")


@query(f"{_STATS}, {_QW} SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM (SELECT doc_id, round(score, 9) AS score FROM sc) ORDER BY score DESC, doc_id LIMIT 10")
def r_tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, "tfidf")


@query(
    f"""{_STATS}, {_QW}, cs AS (SELECT sc.doc_id, round(score / norm / (SELECT sqrt(sum(wq * wq)) FROM qw), 9) AS score FROM sc JOIN nm USING (doc_id))
    SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM cs ORDER BY score DESC, doc_id LIMIT 10"""
)
def r_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, "vector")


_TIERS = "rk AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY round(w, 12) DESC, doc_id) AS rn FROM wt)"


@query(f"{_STATS}, {_TIERS} SELECT term, doc_id, CASE WHEN rn <= 8 THEN 'hot' WHEN rn <= 16 THEN 'warm' ELSE 'cold' END AS tier FROM rk")
def r_tiers(spark: SparkSession, d: str) -> DataFrame:
    return ranking.tiers(_weights(spark, d)).select("term", "doc_id", "tier")


_INEXACT = f"""{_STATS}, {_TIERS}, {{q}}, h AS (SELECT query_id, doc_id, min(CASE WHEN rn <= 8 THEN 0 WHEN rn <= 16 THEN 1 ELSE 2 END) AS step, min((tp, rn)) AS place FROM qq JOIN rk USING (term) GROUP BY query_id, doc_id),
    c AS (SELECT *, count(*) FILTER (WHERE step = 0) OVER (PARTITION BY query_id) AS hot, count(*) FILTER (WHERE step <= 1) OVER (PARTITION BY query_id) AS near,
          row_number() OVER (PARTITION BY query_id ORDER BY step > 1, place, doc_id) AS o FROM h),
    cand AS (SELECT query_id, doc_id FROM c WHERE CASE WHEN hot >= {{k}} THEN step = 0 WHEN near >= {{k}} THEN step <= 1 ELSE step <= 1 OR o <= {{t}} END)"""
_QQ = "qq(query_id, term, tp) AS (VALUES (0, 'index', 0), (0, 'bloom', 1), (1, 'search', 0))"


@query(_INEXACT.format(q=_QQ, k=30, t=90) + " SELECT CAST(query_id AS BIGINT) AS query_id, doc_id FROM cand")
def r_inexact_candidates(spark: SparkSession, d: str) -> DataFrame:
    weights = _weights(spark, d)
    return ranking.inexact_candidates(ranking.query_table(weights, [(0, "index bloom"), (1, "search")], _RANK), weights, 30)


_QX = "qq(query_id, term, tp) AS (VALUES (0, 'index', 0), (0, 'поиск', 1), (0, 'query', 2), (0, 'bloom', 3))"
_COSINE = f"cs AS (SELECT sc.doc_id, round(score / norm / (SELECT sqrt(sum(wq * wq)) FROM qw), 9) AS score FROM sc JOIN nm USING (doc_id))"
_TOP = "SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM cs ORDER BY score DESC, doc_id LIMIT 10"
_INEXACT_TOP = f"{_INEXACT.format(q=_QX, k=10, t=30)}, {_QW}, {_COSINE} {_TOP.replace('FROM cs', 'FROM (SELECT * FROM cs WHERE doc_id IN (SELECT doc_id FROM cand))')}"


def _with_stems(sql: str) -> str:
    """The same query over stems: the stem of 'query' is 'queri', the other terms are their own."""
    return sql.replace(_KEPT, _STEM_KEPT).replace("'query'", "'queri'")


@query(_INEXACT_TOP)
def r_inexact_topk(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, "vector", inexact=True)


def _ranked_index(spark: SparkSession, d: str) -> RankedSearch:
    return RankedSearch.load(spark, stored(spark, d, "ranked", lambda path: RankedSearch(records(spark, d).select("doc_id", "text")).save(path)))


@query(_with_stems(f"{_STATS}, {_QW}, {_COSINE} {_TOP}"))
def r_stemmed_topk(spark: SparkSession, d: str) -> DataFrame:
    index = ranking.RankedIndex.build(records(spark, d), RANKED)
    return ranking.search(index, ranking.query_table(index.weights, [(0, _QUERY)], RANKED), 10).select("doc_id", "score", "rank")


@query(_with_stems(f"{_STATS}, {_QW}, {_COSINE} {_TOP}"))
def r_saved_topk(spark: SparkSession, d: str) -> DataFrame:
    return _ranked_index(spark, d).search_vector(_QUERY, 10)


@query(_with_stems(_INEXACT_TOP))
def r_saved_inexact(spark: SparkSession, d: str) -> DataFrame:
    return _ranked_index(spark, d).search_inexact_top_k(_QUERY, 10)


@query(_with_stems(f"{_STATS} SELECT term, df, round(idf, 9) AS idf FROM st"))
def r_saved_terms(spark: SparkSession, d: str) -> DataFrame:
    return _ranked_index(spark, d).index.stats.select("term", "df", F.round("idf", 9).alias("idf"))


@query(
    f"""{_STATS}, qt AS (SELECT query_id, unnest({_NO_STOP.replace('text', 'query')}) AS term FROM rank_queries), q AS (SELECT query_id, term, count(*) AS qtf FROM qt GROUP BY 1, 2),
    qw AS (SELECT query_id, q.term, (1 + ln(qtf)) * idf AS wq FROM q JOIN st USING (term)), qn AS (SELECT query_id, sqrt(sum(wq * wq)) AS qnorm FROM qw GROUP BY 1),
    sc AS (SELECT query_id, doc_id, sum(wq * w) AS dot FROM qw JOIN wt USING (term) GROUP BY 1, 2),
    cs AS (SELECT query_id, doc_id, round(CASE WHEN model = 'tfidf' THEN dot ELSE dot / (norm * qnorm) END, 9) AS score, top_k FROM sc JOIN nm USING (doc_id) JOIN qn USING (query_id) JOIN rank_queries USING (query_id))
    SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cs) WHERE rank <= top_k"""
)
def r_batch_topk(spark: SparkSession, d: str) -> DataFrame:
    asked, index = table(spark, d, "rank_queries"), _index(spark, d)
    scored = ranking.score(ranking.queries_of_table(asked, _RANK), index.weights, index.norms, index.stats)
    scored = scored.join(asked.select("query_id", "model"), "query_id")
    return ranking.top_k_of_each(scored.withColumn("score", F.when(F.col("model") == "tfidf", F.col("dot")).otherwise(F.col("cosine"))), asked)


@query(f"WITH {_DOCS} SELECT count(*) AS n_docs FROM docs")
def r_document_count(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).agg(F.count(F.lit(1)).alias("n_docs"))


# Key-value log (K) -----------------------------------------------------------------------------------------------------

_LOG = "log AS (SELECT 'k' || user_id AS key, value, event_id AS seq, event_type = 'error' AS gone, day(ts) // 11 AS level FROM events UNION ALL SELECT event_type || ':' || user_id, value, event_id, event_type = 'error', day(ts) // 11 FROM events)"
_LIVE = f"WITH {_LOG}, live AS (SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1 AND NOT gone)"


def event_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as a log of keys 'k<user>' and '<type>:<user>', an error deleting its keys."""
    e = table(spark, d, "events")
    keys = F.array(F.concat(F.lit("k"), "user_id"), F.concat("event_type", F.lit(":"), "user_id"))
    return e.select(F.explode(keys).alias("key"), "value", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "D").otherwise("U").alias("op"), F.floor(F.day("ts") / 11).alias("level"))


@query(f"{_LIVE} SELECT key, value FROM live WHERE key = 'click:8'")
def k_get(spark: SparkSession, d: str) -> DataFrame:
    return kv.get(event_log(spark, d), "click:8")


@query(f"{_LIVE} SELECT key, value FROM live WHERE key IN ('k1', 'k10', 'k100', 'click:7', 'missing')")
def k_multiget(spark: SparkSession, d: str) -> DataFrame:
    return kv.multi_get(event_log(spark, d), ["k1", "k10", "k100", "click:7", "missing"])


@query(f"{_LIVE} SELECT key, value FROM live WHERE regexp_full_match(key, 'k[0-9]+') AND CAST(substr(key, 2) AS BIGINT) BETWEEN 9 AND 101")
def k_range_numeric(spark: SparkSession, d: str) -> DataFrame:
    return kv.key_range(event_log(spark, d), "k9", "k101")


@query(f"{_LIVE} SELECT key, value FROM live WHERE NOT regexp_full_match(key, 'k[0-9]+') AND key BETWEEN 'click:10' AND 'purchase:5'")
def k_range_string(spark: SparkSession, d: str) -> DataFrame:
    return kv.key_range(event_log(spark, d), "click:10", "purchase:5")


@query(f"{_LIVE} SELECT key, value, seq FROM live")
def k_latest(spark: SparkSession, d: str) -> DataFrame:
    return kv.latest(event_log(spark, d))


@query(f"{_LIVE} SELECT key, value FROM live")
def k_scan(spark: SparkSession, d: str) -> DataFrame:
    return kv.scan(event_log(spark, d))


@query(f"WITH {_LOG} SELECT CAST(level AS BIGINT) AS level, count(*) AS n_entries, count(DISTINCT key) AS n_keys, count(*) FILTER (WHERE gone) AS n_deletes FROM log GROUP BY level")
def k_stats(spark: SparkSession, d: str) -> DataFrame:
    return kv.stats(event_log(spark, d))


@query(f"{_LIVE} SELECT key, value, seq FROM live")
def k_compact(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "compact")
    kv.compact(event_log(spark, d).drop("level"), path)
    return spark.read.parquet(path).select("key", "value", "seq")


_STORE = """WITH log AS (SELECT key, CAST(round(value * 100) AS BIGINT) AS cents, event_id AS seq, event_type = 'error' AS gone FROM
    (SELECT 'k' || user_id AS key, value, event_id, event_type FROM events UNION ALL SELECT event_type || ':' || user_id, value, event_id, event_type FROM events)),
    live AS (SELECT key, CAST(cents AS VARCHAR) AS value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1 AND NOT gone)"""


def _store(spark: SparkSession, d: str) -> KeyValueStore:
    """The events as a store of several runs and levels: three batches of changes, each of puts and deletions."""

    def write(path: str) -> None:
        log = event_log(spark, d).withColumn("value", F.round(F.col("value") * 100).cast("long").cast("string"))
        store = KeyValueStore(spark, path, level_factor=2)
        for level in (0, 1, 2):
            batch = log.where(F.col("level") == level)
            store.put(batch.where("op = 'U'"))
            store.delete(batch.where("op = 'D'"))

    return KeyValueStore(spark, stored(spark, d, "events_store", write), level_factor=2)


def _decoded(rows: DataFrame) -> DataFrame:
    return rows.select("key", F.decode("value", "utf-8").alias("value"))


@query(f"{_STORE} SELECT key, value FROM live WHERE key = 'click:8'")
def ks_get(spark: SparkSession, d: str) -> DataFrame:
    return _decoded(_store(spark, d).get("click:8"))


@query(f"{_STORE} SELECT key, value FROM live WHERE key IN (SELECT 'k' || c_custkey FROM customer)")
def ks_multiget_table(spark: SparkSession, d: str) -> DataFrame:
    return _decoded(_store(spark, d).multi_get(table(spark, d, "customer").select(F.concat(F.lit("k"), "c_custkey").alias("key"))))


@query(f"{_STORE} SELECT key, value FROM live WHERE regexp_full_match(key, 'k[0-9]+') AND CAST(substr(key, 2) AS BIGINT) BETWEEN 9 AND 101")
def ks_range(spark: SparkSession, d: str) -> DataFrame:
    return _decoded(_store(spark, d).range("k9", "k101"))


@query(f"{_STORE} SELECT key, value FROM live")
def ks_scan(spark: SparkSession, d: str) -> DataFrame:
    return _decoded(_store(spark, d).scan())


@query()
def ks_stats(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).report_stats()


# Nearest points (N) ----------------------------------------------------------------------------------------------------


@query(
    """WITH q AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: -CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id % 50 = 0),
    r AS (SELECT query_id, vec_id AS point_id, list_distance(v, CAST(embedding AS DOUBLE[])) AS distance FROM q, embeddings)
    SELECT query_id, point_id, round(distance, 9) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, point_id) AS rn FROM r) WHERE rn = 1"""
)
def n_nn_batch(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    points = e.select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("coords"))
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.transform("embedding", lambda x: -x.cast("double")).alias("coords"))
    dims = e.agg(F.max(F.size("embedding"))).first()[0] or 1
    return kdtree.nearest_table(points, asked, dims).select("query_id", "point_id", F.round("distance", 9).alias("distance"))


@query(
    """WITH q(query_id, x, y) AS (VALUES (0, 0.0, 0.0), (1, 5000.0, 700.0), (2, -999.0, 1400.0), (3, 2500.5, 10.0)),
    r AS (SELECT query_id, c_custkey AS point_id, sqrt((x - c_acctbal) ** 2 + (y - c_custkey) ** 2) AS distance FROM q, customer)
    SELECT CAST(query_id AS BIGINT) AS query_id, point_id, round(distance, 9) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, point_id) AS rn FROM r) WHERE rn = 1"""
)
def n_nn_2d(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "customer").select(F.col("c_custkey").alias("point_id"), F.array("c_acctbal", F.col("c_custkey").cast("double")).alias("coords"))
    found = spatial.nearest_batch(points, [(0, [0.0, 0.0]), (1, [5000.0, 700.0]), (2, [-999.0, 1400.0]), (3, [2500.5, 10.0])])
    return found.select("query_id", "point_id", F.round("distance", 9).alias("distance"))


# Substrings (S) --------------------------------------------------------------------------------------------------------


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text")


def _names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("text_id"), F.col("p_name").alias("text"))


def _places_sql(p: str) -> str:
    n = len(p)
    return f"SELECT doc_id AS text_id, CAST(unnest(list_filter(range(length(text) - {n} + 1), lambda i: substr(text, i + 1, {n}) = '{p}')) AS INTEGER) AS pos FROM documents WHERE contains(text, '{p}')"


@query(_places_sql("ere"))
def s_locate(spark: SparkSession, d: str) -> DataFrame:
    return substring.locate(_texts(spark, d), "ere")


@query(_places_sql("ана"))
def s_locate_overlapping(spark: SparkSession, d: str) -> DataFrame:
    return substring.locate(_texts(spark, d), "ана")


@query("SELECT doc_id AS text_id, CAST(len(list_filter(range(greatest(length(text) - 2, 0)), lambda i: substr(text, i + 1, 3) = 'ana')) AS INTEGER) AS cnt FROM documents WHERE text IS NOT NULL")
def s_count(spark: SparkSession, d: str) -> DataFrame:
    return substring.count(_texts(spark, d), "ana")


@query("SELECT p_partkey AS text_id, CAST(unnest(range(length(p_name))) AS INTEGER) AS pos FROM part WHERE p_name <> ''")
def s_empty_pattern(spark: SparkSession, d: str) -> DataFrame:
    return substring.locate(_names(spark, d), "")


_SA = """WITH s AS (SELECT p_partkey AS text_id, p_name AS text, CAST(unnest(range(length(p_name) + 1)) AS INTEGER) AS pos FROM part WHERE p_name IS NOT NULL),
    sa AS (SELECT text_id, CAST(row_number() OVER (PARTITION BY text_id ORDER BY substr(text, pos + 1)) - 1 AS INTEGER) AS rank, pos, CASE WHEN pos > 0 THEN substr(text, pos, 1) ELSE chr(0) END AS bwt FROM s)"""


@query(f"{_SA} SELECT text_id, rank, pos FROM sa")
def s_suffix_array(spark: SparkSession, d: str) -> DataFrame:
    return substring.suffix_array(_names(spark, d)).select("text_id", "rank", "pos")


@query(f"{_SA} SELECT text_id, rank, ascii(bwt) AS symbol FROM sa WHERE pos > 0 UNION ALL SELECT text_id, rank, 0 FROM sa WHERE pos = 0")
def s_bwt(spark: SparkSession, d: str) -> DataFrame:
    return substring.suffix_array(_names(spark, d)).select("text_id", "rank", F.ascii("bwt").alias("symbol"))


_SYM = "x AS (SELECT text_id, CASE WHEN pos = 0 THEN 0 ELSE ascii(bwt) END AS symbol, rank FROM sa)"


@query(f"{_SA}, {_SYM} SELECT text_id, symbol, CAST(coalesce(sum(n) OVER (PARTITION BY text_id ORDER BY symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM (SELECT text_id, symbol, count(*) AS n FROM x GROUP BY 1, 2)")
def s_c_array(spark: SparkSession, d: str) -> DataFrame:
    return substring.c_array(substring.suffix_array(_names(spark, d))).select("text_id", F.ascii("symbol").alias("symbol"), "first")


@query(f"{_SA}, {_SYM} SELECT text_id, rank, occ FROM (SELECT text_id, rank, CAST(sum(CASE WHEN symbol = ascii('e') THEN 1 ELSE 0 END) OVER (PARTITION BY text_id ORDER BY rank) AS BIGINT) AS occ FROM x) WHERE rank % 4 = 0")
def s_occ(spark: SparkSession, d: str) -> DataFrame:
    return substring.occurrences(substring.suffix_array(_names(spark, d)), "e", 4)


@query(
    f"""{_SA}, {_SYM}, b AS (SELECT DISTINCT text_id, rank FROM x WHERE rank % 4 = 0), y AS (SELECT DISTINCT text_id, symbol FROM x)
    SELECT b.text_id, b.rank, y.symbol, CAST(count(x.rank) AS BIGINT) AS occ FROM b JOIN y ON y.text_id = b.text_id
    LEFT JOIN x ON x.text_id = b.text_id AND x.symbol = y.symbol AND x.rank < b.rank GROUP BY 1, 2, 3"""
)
def s_occ_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    return substring.occ_checkpoints(substring.suffix_array(_names(spark, d)), 4).select("text_id", "rank", F.ascii("symbol").alias("symbol"), "occ")


@query(
    """WITH s AS (SELECT item_id AS text_id, passage AS text, CAST(unnest(range(length(passage) + 1)) AS INTEGER) AS pos FROM eval_items WHERE passage IS NOT NULL)
    SELECT text_id, CAST(row_number() OVER (PARTITION BY text_id ORDER BY substr(text, pos + 1)) - 1 AS INTEGER) AS rank, pos FROM s"""
)
def s_suffix_array_long(spark: SparkSession, d: str) -> DataFrame:
    passages = table(spark, d, "eval_items").select(F.col("item_id").alias("text_id"), F.col("passage").alias("text"))
    return substring.suffix_array(passages, long_text=400).select("text_id", "rank", "pos")


# Persistence and streams (I) -------------------------------------------------------------------------------------------


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"SELECT DISTINCT term, doc_id FROM ({_tokens_sql('documents', _pre('[A-Za-z0-9_-]+'))})")
def i_stream_postings(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch(spark, "stream")
    return ingest_postings(spark, f"{d}/documents.parquet*", "doc_id BIGINT, text STRING", _PLAIN, f"{folder}/rows", f"{folder}/state", "*.parquet")


@query(f"WITH {_DOCS} SELECT term, doc_id, count(*) AS tf FROM ({_tokens_sql('docs', _NO_STOP)}) GROUP BY term, doc_id")
def i_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "store")
    save_table(ranking.term_counts(records(spark, d), _RANK), path, "postings")
    return load_table(spark, path, "postings")


@query(f"SELECT term, doc_id, positions FROM (WITH {_DOCS} SELECT term, doc_id, to_json(list(pos ORDER BY pos)) AS positions FROM ({_tokens_sql('docs', _RAW)}) GROUP BY term, doc_id)")
def i_json_postings(spark: SparkSession, d: str) -> DataFrame:
    return positional.positional_postings(_tokens(spark, d)).select("term", "doc_id", F.to_json("positions").alias("positions"))


@query(f"WITH {_DOCS} SELECT term, doc_id, CAST(count(*) AS BIGINT) AS tf FROM ({_tokens_sql('docs', _NO_STOP)}) GROUP BY term, doc_id")
def i_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    counts = ranking.term_counts(records(spark, d), _RANK).withColumn("block", F.pmod("doc_id", F.lit(64)))  # postings of a hot term in several blobs
    blobs = counts.groupBy("term", "block").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("doc_id", "tf")))).alias("blob"))
    return blobs.select("term", F.explode(decoded_postings(F.col("blob"))).alias("doc_id", "tf"))
