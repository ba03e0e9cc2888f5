"""Stores: a versioned table together with its schema and the operations on it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessella.errors import EmptyVector, InvalidArgument, MissingID
from tessella.model import Page, conformed, valid_records
from tessella.operators import graphs, search, stores
from tessella.runtime import stored
from tessella.schema import Schema, checked_name
from tessella.sources.tables import VersionedTable, VersionedTables


def _checked_schema(schema: Schema) -> Schema:
    if not schema.finalised:
        raise InvalidArgument("schema is not built")
    return schema


@dataclass
class LexicalIndex:
    """Full-text search over chosen fields of a table. ``build`` writes postings, of which later searches read their terms only."""

    documents: DataFrame
    fields: Sequence[str]
    schema: Schema
    postings: search.Postings | None = None

    def __post_init__(self) -> None:
        _checked_schema(self.schema)
        if not self.fields or len(set(self.fields)) != len(self.fields):
            raise InvalidArgument("search fields must be there and different")
        for f in self.fields:
            checked_name(f)

    def build(self, path: str) -> LexicalIndex:
        self.postings = search.Postings.build(self.documents, self.fields, path)
        return self

    def search(self, text: str, filter: object = None, page: Page | None = None) -> DataFrame:
        if self.postings is not None:
            return self.postings.search(self.documents, text, search.Request(filter, page, self.schema))
        return search.bm25(self.documents, text, self.fields, search.Request(filter, page, self.schema))


@dataclass
class DocumentStore:
    """Records (id, content, attributes, vector or tensor) at ``path``; ``name`` is that of the table."""

    spark: SparkSession
    path: str
    name: str
    schema: Schema
    value: str = "vector"

    def __post_init__(self) -> None:
        checked_name(self.name, "sql")
        _checked_schema(self.schema)
        self.table = VersionedTable(self.spark, f"{self.path}/{self.name}")

    def _type(self) -> T.StructType:
        kind = T.ArrayType(T.FloatType()) if self.value == "vector" else T.ArrayType(T.ArrayType(T.FloatType()))
        return T.StructType([T.StructField("id", T.StringType()), T.StructField("content", T.StringType()), T.StructField("attributes", self.schema.struct()), T.StructField(self.value, kind)])

    def upsert(self, records: Sequence[Mapping] | DataFrame) -> int:
        """Insert or replace records; all are checked before any is written. A DataFrame is checked while it is staged, and read once."""
        if isinstance(records, DataFrame):
            batch = stored(conformed(valid_records(records.select(*self._type().names), self.value), self.schema))
            self.table.upsert(batch)
            return batch.count()
        rows, seen = [], set()
        for r in records:
            if not r.get("id"):
                raise MissingID("record")
            if r["id"] in seen:
                raise InvalidArgument(f"id {r['id']!r} twice in a batch")
            seen.add(r["id"])
            if not r.get(self.value):
                raise EmptyVector(self.value)
            own = self.schema.normalise(r.get("attributes"))
            rows.append((r["id"], r.get("content") or "", own and {n: own.get(n) for n in self.schema.fields}, r[self.value]))
        if rows:
            self.table.upsert(self.spark.createDataFrame(rows, self._type()))
        return len(rows)

    def read(self) -> DataFrame:
        return self.table.read()

    def search(self, query: Sequence, filter: object = None, page: Page | None = None, **how: object) -> DataFrame:
        request = search.Request(filter, page, self.schema)
        return search.dense_search(self.read(), query, request, **how) if self.value == "vector" else search.tensor_search(self.read(), query, request, self.value)

    def lexical(self, fields: Sequence[str]) -> LexicalIndex:
        return LexicalIndex(self.read(), fields, self.schema)

    def find_by_ids(self, ids: Sequence[str]) -> DataFrame:
        return stores.find_by_ids(self.read(), ids)

    def _delete(self, deletion: stores.Deletion) -> int:
        count = deletion.deleted
        if count:
            self.table.write(deletion.survivors)
        return count

    def delete_by_ids(self, ids: Sequence[str]) -> int:
        return self._delete(stores.delete_by_ids(self.read(), ids)) if ids else 0

    def delete_by_filter(self, tree: object) -> int:
        return self._delete(stores.delete_by_filter(self.read(), tree, self.schema))


@dataclass
class GraphStore:
    """A property graph: nodes and edges in tables that change together."""

    spark: SparkSession
    path: str
    schema: graphs.GraphSchema

    def __post_init__(self) -> None:
        _checked_schema(self.schema.nodes), _checked_schema(self.schema.edges)
        self.tables = VersionedTables(self.spark, self.path, ("nodes", "edges"))

    def read(self) -> graphs.Graph:
        return graphs.Graph(**self.tables.tables())

    def upsert(self, snapshot: graphs.Graph) -> None:
        base = self.tables.number()
        new = graphs.upsert(self.read(), snapshot, self.schema) if base else graphs.checked(graphs.normalised(snapshot, self.schema))
        self.tables.commit({"nodes": new.nodes, "edges": new.edges}, base)

    def traverse(self, request: graphs.Traversal) -> graphs.Graph:
        return graphs.traverse(self.read(), request, self.schema)
