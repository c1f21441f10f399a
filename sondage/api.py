"""Indexes as objects: thin shells over the operators. Methods return lazy DataFrames; tables can be saved and read back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.analysis import BOOLEAN, DATED, POSITIONAL, RANKED, Analyzer, token_table
from .functions.dates import dated_records
from .operators import boolean, positional, ranking, spatial, substring, temporal
from .sources.store import load_table, save_table


class _Documents:
    """What all indexes of texts have."""

    docs: DataFrame

    def get_document(self, doc_id: int) -> DataFrame:
        return self.docs.where(F.col("doc_id") == doc_id).select("doc_id", "text")

    def get_document_count(self) -> DataFrame:
        return self.docs.agg(F.count_distinct("doc_id").alias("n_docs"))


class BooleanIndex(_Documents):
    """Boolean search over docs (doc_id, text)."""

    def __init__(self, docs: DataFrame, analyzer: Analyzer = BOOLEAN, postings: DataFrame | None = None):
        self.docs, self.analyzer = docs, analyzer
        self.postings = boolean.boolean_postings(docs, analyzer) if postings is None else postings

    def _terms(self, terms: Sequence[str]) -> list[str]:
        return [self.analyzer.term_of_query(t) for t in terms if t]

    def add_documents(self, docs: DataFrame):
        """An index that has these documents too."""
        new = boolean.boolean_postings(docs, self.analyzer)
        return type(self)(self.docs.unionByName(docs), self.analyzer, boolean.merge_postings(self.postings, new))

    def query_term(self, term: str) -> DataFrame:
        return boolean.query_term(self.postings, self.analyzer.term_of_query(term))

    def query_and(self, *terms: str) -> DataFrame:
        return boolean.query_and(self.postings, *self._terms(terms))

    def query_or(self, *terms: str) -> DataFrame:
        return boolean.query_or(self.postings, *self._terms(terms))

    def query_and_not(self, term: str, other: str) -> DataFrame:
        return boolean.query_and_not(self.postings, *self._terms([term, other]))

    def get_term_frequency(self, term: str) -> DataFrame:
        """(df): records that have the term."""
        return self.query_term(term).agg(F.count(F.lit(1)).alias("df"))

    def save(self, path: str) -> None:
        save_table(self.docs, path, "docs")
        save_table(self.postings, path, "postings")

    @classmethod
    def load(cls, spark: SparkSession, path: str, analyzer: Analyzer = BOOLEAN):
        return cls(load_table(spark, path, "docs"), analyzer, load_table(spark, path, "postings").select("term", "doc_id"))


class DatedIndex(BooleanIndex):
    """Boolean search over docs (doc_id, text, start_date, end_date) with validity dates.

    Dates given as texts are read strictly: a record with a missing or malformed start, or a malformed end, fails the job that reads it.
    """

    def __init__(self, docs: DataFrame, analyzer: Analyzer = DATED, postings: DataFrame | None = None):
        super().__init__(dated_records(docs), analyzer, postings)

    def add_documents(self, docs: DataFrame):
        return super().add_documents(dated_records(docs))

    @classmethod
    def load(cls, spark: SparkSession, path: str, analyzer: Analyzer = DATED):
        return super().load(spark, path, analyzer)

    def query_and_date(self, terms: Sequence[str] | None = None, start_date=None, end_date=None, mode: str = "valid") -> DataFrame:
        if not terms:
            return temporal.docs_by_date(self.docs, start_date, end_date, mode)
        return self.query_complex(("AND", *terms), start_date, end_date, mode)

    def query_complex(self, expression, start_date=None, end_date=None, mode: str = "valid") -> DataFrame:
        return boolean.query_tree(self.docs, self.postings, expression, self.analyzer, start_date, end_date, mode)

    query_boolean = query_complex


class PositionalIndex(_Documents):
    """Exact phrases over docs (doc_id, text), or over saved tables."""

    def __init__(self, docs: DataFrame, analyzer: Analyzer = POSITIONAL, postings: DataFrame | None = None):
        self.docs, self.analyzer, self._postings = docs, analyzer, postings
        self.tokens = token_table(docs, analyzer) if postings is None else positional.tokens_of(postings)

    @property
    def postings(self) -> DataFrame:
        """(term, doc_id, positions, tf)."""
        return positional.positional_postings(self.tokens) if self._postings is None else self._postings

    def add_documents(self, docs: DataFrame) -> PositionalIndex:
        """An index that has these documents too, of new ids: their postings stand beside those at hand, which aren't computed anew."""
        new = positional.positional_postings(token_table(docs, self.analyzer))
        return PositionalIndex(self.docs.select("doc_id", "text").unionByName(docs.select("doc_id", "text")), self.analyzer, self.postings.unionByName(new))

    def save(self, path: str) -> None:
        """Writes docs and postings; the latter in ranges of (term, doc_id), so that a term's look-up reads few row groups."""
        save_table(self.docs, path, "docs")
        save_table(self.postings, path, "positions")

    @classmethod
    def load(cls, spark: SparkSession, path: str, analyzer: Analyzer = POSITIONAL) -> PositionalIndex:
        return cls(load_table(spark, path, "docs"), analyzer, load_table(spark, path, "positions"))

    def _phrase(self, phrase: str | Sequence[str]) -> list[str]:
        """A str is analysed; of a list each truthy item is normalised, not split."""
        return self.analyzer.of_query(phrase) if isinstance(phrase, str) else [self.analyzer.term_of_query(t) for t in phrase if t]

    def query_term(self, term: str) -> DataFrame:
        return self.search_phrase([term])

    def query_and(self, *terms: str) -> DataFrame:
        return boolean.query_and(self.tokens, *self._phrase(terms))

    def get_positions(self, term: str, doc_id: int) -> DataFrame:
        return positional.get_positions(self.tokens, self.analyzer.term_of_query(term), doc_id)

    def phrase_positions(self, phrase: str | Sequence[str]) -> DataFrame:
        return positional.phrase_positions(self.tokens, self._phrase(phrase))

    def search_phrase(self, phrase: str | Sequence[str]) -> DataFrame:
        return positional.search_phrase(self.tokens, self._phrase(phrase))

    def count_phrase_occurrences(self, phrase: str | Sequence[str]) -> DataFrame:
        return positional.count_phrase(self.tokens, self._phrase(phrase))


class RankedSearch(_Documents):
    """TF-IDF and cosine ranking over docs (doc_id, text), or over saved tables."""

    def __init__(self, docs: DataFrame, analyzer: Analyzer = RANKED, champion_size: int = 8, tier_size: int = 8, index: ranking.RankedIndex | None = None):
        self.docs, self.analyzer, self.champion_size, self.tier_size = docs, analyzer, champion_size, tier_size
        self.index = ranking.RankedIndex.build(docs, analyzer) if index is None else index

    def add_documents(self, docs: DataFrame) -> RankedSearch:
        """An index that has these documents too, of new ids. Only they are analysed; statistics and weights, which depend on all records, follow from the counts."""
        every = self.docs.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
        counts = self.index.weights.select("term", "doc_id", "tf").unionByName(ranking.term_counts(docs, self.analyzer))
        return RankedSearch(every, self.analyzer, self.champion_size, self.tier_size, ranking.RankedIndex.of_counts(every, counts))

    def save(self, path: str) -> None:
        save_table(self.docs, path, "docs")
        self.index.save(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, analyzer: Analyzer = RANKED, champion_size: int = 8, tier_size: int = 8) -> RankedSearch:
        return cls(load_table(spark, path, "docs"), analyzer, champion_size, tier_size, ranking.RankedIndex.load(spark, path))

    def _search(self, query: str, top_k: int, model: str | None, inexact: bool) -> DataFrame:
        asked = ranking.query_table(self.index.weights, [(0, query)], self.analyzer)
        index = self.index.of_terms(sorted(set(self.analyzer.of_query(query))))
        return ranking.search(index, asked, top_k, model, inexact, self.champion_size, self.tier_size).drop("query_id").orderBy("rank")

    def search_tfidf(self, query: str, top_k: int = 10) -> DataFrame:
        return self._search(query, top_k, "tfidf", False)

    def search_vector(self, query: str, top_k: int = 10) -> DataFrame:
        return self._search(query, top_k, "vector", False)

    def search_inexact_top_k(self, query: str, top_k: int = 10, model: str | None = "vector") -> DataFrame:
        return self._search(query, top_k, model, True)

    def tiers(self) -> DataFrame:
        return ranking.tiers(self.index.weights, self.champion_size, self.tier_size)


class PointIndex:
    """Exact nearest neighbour over points (point_id, coords)."""

    def __init__(self, points: DataFrame):
        self.points = points

    def nearest_neighbor(self, query: Sequence[float]) -> DataFrame:
        return spatial.nearest_neighbor(self.points, query)

    def nearest_batch(self, queries: Sequence[tuple[int, Sequence[float]]]) -> DataFrame:
        return spatial.nearest_batch(self.points, queries)

    def save(self, path: str) -> None:
        save_table(self.points, path, "points")

    @classmethod
    def load(cls, spark: SparkSession, path: str):
        return cls(load_table(spark, path, "points"))


class TextIndex:
    """Substrings over texts (text_id, text)."""

    def __init__(self, texts: DataFrame):
        self.texts = texts

    def search(self, pattern: str) -> DataFrame:
        return substring.locate(self.texts, pattern)

    locate = search

    def count(self, pattern: str) -> DataFrame:
        return substring.count(self.texts, pattern)

    def suffix_array(self) -> DataFrame:
        return substring.suffix_array(self.texts)
