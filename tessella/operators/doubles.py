"""Stand-ins for searchers: they check a request as the real ones do and return what they hold, unranked and unfiltered."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tessella.errors import EmptyText, EmptyVector
from tessella.model import valid_documents
from tessella.operators.search import Request


@dataclass(frozen=True)
class StoredSearcher:
    """Documents (id, content, attributes, relevance) that answer every valid request."""

    documents: DataFrame

    def dense(self, vector: Sequence[float], request: Request = Request()) -> DataFrame:
        if not len(vector):
            raise EmptyVector("query vector")
        return self._held(request)

    def lexical(self, text: str, request: Request = Request()) -> DataFrame:
        if not text or not text.strip():
            raise EmptyText("query text")
        return self._held(request)

    def tensor(self, rows: Sequence[Sequence[float]], request: Request = Request()) -> DataFrame:
        if not rows:
            raise EmptyVector("query tensor")
        return self._held(request)

    def _held(self, request: Request) -> DataFrame:
        request.bound()
        return valid_documents(self.documents)
