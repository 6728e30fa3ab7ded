"""Search in texts at hand, without a network: for tests, and for tables as a source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import SearchProvider


class CorpusSearch(SearchProvider):
    """Finds texts that contain a term, without regard to case. ``texts`` is a small list that goes to the executors."""

    def __init__(self, texts: list[str] | tuple[str, ...] = (), name: str = "corpus"):
        self.texts, self.name = tuple(texts), name

    def create_tool(self, max_results: int, **options):
        return lambda query: [t for t in self.texts if query.lower() in t.lower()][:max_results]

    def calculate_credits(self, search_count: int, **options) -> int:
        return search_count


def find_terms(terms: list[str], corpus: DataFrame, text: str, name: str = "term") -> DataFrame:
    """Pairs of a term and a row of ``corpus`` whose text contains it, without regard to case; the term under ``name``.

    The terms are a list that a person wrote; they are part of the plan, so the corpus is read once and not shuffled.
    """
    hits = F.array_compact(F.array(*[F.when(F.contains(F.lower(F.col(text)), F.lit(t.lower())), F.lit(t)) for t in dict.fromkeys(terms)]))
    return corpus.withColumn(name, F.explode(hits))
