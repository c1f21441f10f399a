"""Text analysis: one analyser with parameters for pattern, case, stop words and stemming."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .porter import stem, stem_ascii, stems

#: Stop words (fixed values).
ENGLISH_STOP_WORDS = ("the", "a", "and", "is", "in", "on", "of", "to", "for", "with", "by")
RUSSIAN_STOP_WORDS = ("и", "в", "во", "на", "с", "со", "к", "ко", "по", "из", "у", "за", "под", "о", "об")


@dataclass(frozen=True)
class Analyzer:
    """How a text becomes terms. `stop_stage`: stop words go before stemming ('pre'), after it ('post') or stay ('none')."""

    pattern: str
    lower_first: bool = False
    stop_words: tuple[str, ...] = ()
    stop_stage: str = "none"
    stem: bool = True
    #: Whether single query terms are stemmed as indexed tokens are, those outside ASCII only lower-cased, or all in the same way.
    stem_all: bool = False

    def without_stems(self) -> Analyzer:
        return replace(self, stem=False)

    def terms(self, text: Column) -> Column:
        """The text's terms in order; an empty array for NULL, empty and token-free texts."""
        source = F.lower(text) if self.lower_first else text
        tokens = F.regexp_extract_all(source, F.lit(self.pattern), F.lit(0))
        if not self.lower_first:
            tokens = F.transform(tokens, F.lower)
        if self.stop_stage == "pre":
            tokens = self._kept(tokens)
        if self.stem:
            tokens = stems(tokens)
        if self.stop_stage == "post":
            tokens = self._kept(tokens)
        return F.coalesce(tokens, F.array().cast("array<string>"))

    def _kept(self, tokens: Column) -> Column:
        return F.filter(tokens, lambda t: ~t.isin(*self.stop_words))

    def of_query(self, text: str | None) -> list[str]:
        """The same for a query on the driver."""
        found = re.findall(self.pattern, (text or "").lower() if self.lower_first else text or "")
        found = [t.lower() for t in found]
        if self.stop_stage == "pre":
            found = [t for t in found if t not in self.stop_words]
        if self.stem:
            found = [stem_ascii(t) for t in found]
        if self.stop_stage == "post":
            found = [t for t in found if t not in self.stop_words]
        return found

    def term_of_query(self, term: str) -> str:
        """A single query term: stemmed only, neither split nor dropped."""
        if not self.stem:
            return term.lower()
        return stem(term) if self.stem_all else stem_ascii(term)


#: The four analysers in use: Boolean, Boolean with dates, positional, ranked. Their patterns are fixed values.
BOOLEAN = Analyzer("[A-Za-z0-9_]+", True, ENGLISH_STOP_WORDS, "pre", stem_all=True)
DATED = Analyzer("[A-Za-z0-9_-]+", True, ENGLISH_STOP_WORDS, "pre", stem_all=True)
POSITIONAL = Analyzer("[0-9A-Za-zА-Яа-яЁё_-]+", False, ENGLISH_STOP_WORDS + RUSSIAN_STOP_WORDS, "none")
RANKED = replace(POSITIONAL, stop_stage="post")


def token_table(docs: DataFrame, analyzer: Analyzer, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, term), one row for each term of each text, positions from 0. Texts without terms give no rows; no shuffle."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(analyzer.terms(F.col(text))).alias("pos", "term"))
