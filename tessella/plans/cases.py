"""Registered queries of checks, lowerings, stores and providers: what each case gives, as rows.

Their SQL states the outcomes as values, or computes them from the tables where the tables are what is checked.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella import errors as E
from tessella import predicate as P
from tessella.functions.vectors import cosine
from tessella.model import Page, record_problems
from tessella.observe import OPERATIONS, cancel, traced
from tessella.operators import chunking, graphs, ranking, search
from tessella.operators.doubles import StoredSearcher
from tessella.operators.embedding import Provider, embedded, embedded_inputs
from tessella.plans import queries as Q
from tessella.resilience import map_ordered, retrying, with_fallback
from tessella.runtime import local_rows, new_folder
from tessella.schema import STANDARD, Schema, SchemaBuilder, checked_name, is_identifier, normalised
from tessella.sources import tables
from tessella.sources.stores import DocumentStore, GraphStore, LexicalIndex
from tessella.sources.tables import VersionedTable

_QUERIES: dict[str, Q.Query] = {}
_SQL: dict[str, str] = {}
_KINDS = "|".join(k for k in vars(E) if isinstance(vars(E)[k], type) and issubclass(vars(E)[k], E.EngineError) and k != "EngineError")


def query(sql: str) -> Callable[[Q.Query], Q.Query]:
    def register(f: Q.Query) -> Q.Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return register


def _values(rows: list[tuple[str, str]]) -> str:
    text = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {text}) AS t(name, outcome)"


def _outcome(call: Callable[[], object]) -> str:
    """What a call gives as text, or the class of its error, also where Spark raised it while a query ran."""
    try:
        got = call()
    except E.EngineError as e:
        return type(e).__name__
    except Exception as e:
        found = re.search(rf"\b({_KINDS}): ", str(e))
        return found.group(1) if found else type(e).__name__
    return got if isinstance(got, str) else json.dumps(got, ensure_ascii=False, sort_keys=True)


def cases(want: dict[str, str]) -> Callable:
    """Register a function that gives calls by name; ``want`` is what they must come to."""

    def register(f: Callable[[SparkSession, str], dict[str, Callable[[], object]]]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            rows = {name: _outcome(call) for name, call in f(spark, sf_dir).items()}
            return local_rows(spark, name=list(rows), outcome=list(rows.values()))

        _QUERIES[f.__name__], _SQL[f.__name__] = run, _values(list(want.items()))
        return f

    return register


# Names, attributes, schemas


@cases({"identifier a_1": "ok", "identifier 1a": "InvalidArgument", "identifier a-b": "InvalidArgument", "identifier a newline": "InvalidArgument", "sql Docs": "ok", "sql a.b": "InvalidArgument", "index a-1_b": "ok", "index Ab": "InvalidArgument", "collection A-b": "ok", "collection _a": "InvalidArgument", "is a": "true", "is empty": "false"})
def name_policies(spark: SparkSession, sf_dir: str) -> dict:
    ok = lambda name, policy: lambda: checked_name(name, policy) and "ok"
    out = {f"{p} {n}": ok(n, p) for p, n in (("identifier", "a_1"), ("identifier", "1a"), ("identifier", "a-b"), ("sql", "Docs"), ("sql", "a.b"), ("index", "a-1_b"), ("index", "Ab"), ("collection", "A-b"), ("collection", "_a"))}
    return out | {"identifier a newline": ok("a\n", "identifier"), "is a": lambda: is_identifier("a"), "is empty": lambda: is_identifier("")}


@cases({"int": '{"x": 42}', "float": '{"x": 1.5}', "bool": '{"x": true}', "none": "null", "empty": "null", "list": "InvalidArgument", "map": "InvalidArgument", "null": "InvalidArgument", "key": "InvalidArgument", "nan": "InvalidArgument", "too large": "InvalidArgument", "copied": '{"x": 1}'})
def attribute_scalars(spark: SparkSession, sf_dir: str) -> dict:
    def copied() -> object:
        given = {"x": 1}
        got = normalised(given)
        given["x"] = 2
        return got

    values = {"int": 42, "float": 1.5, "bool": True, "list": [1], "map": {"a": 1}, "null": None, "nan": float("nan"), "too large": 1 << 63}
    out: dict = {k: (lambda v=v: normalised({"x": v})) for k, v in values.items()}
    return out | {"none": lambda: normalised(None), "empty": lambda: normalised({}), "key": lambda: normalised({"bad-field": 1}), "copied": copied}


@cases({"whole float": '{"age": 7}', "int for float": '{"score": 2.0}', "none": "null", "undeclared": "InvalidArgument", "text for int": "InvalidArgument", "part of int": "InvalidArgument", "float too large": "InvalidArgument", "lookup": "int", "lookup unknown": "null", "not built": "InvalidArgument", "is built": "true", "isn't built": "false", "twice": "InvalidArgument", "reserved": "InvalidArgument", "bad name": "InvalidArgument", "other kind": "InvalidArgument"})
def schema_attributes(spark: SparkSession, sf_dir: str) -> dict:
    n = lambda **a: lambda: STANDARD.normalise(a)
    return {
        "whole float": n(age=7.0), "int for float": n(score=2), "none": n(), "undeclared": n(other=1), "text for int": n(age="old"), "part of int": n(age=1.5), "float too large": n(age=1e20),
        "lookup": lambda: STANDARD.lookup("age").kind, "lookup unknown": lambda: STANDARD.lookup("other"), "not built": lambda: Schema().normalise({}), "is built": lambda: STANDARD.finalised, "isn't built": lambda: Schema().finalised,
        "twice": lambda: SchemaBuilder().int("a").string("a"), "reserved": lambda: SchemaBuilder().int("id"), "bad name": lambda: SchemaBuilder().int("1bad"), "other kind": lambda: STANDARD.string("age").name,
    }


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS qty, CAST(l_partkey AS DOUBLE) AS part, l_returnflag AS flag FROM lineitem")
def coerced_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "lineitem")
    schema = SchemaBuilder().int("qty").float("part").string("flag").build()
    own = {n: (F.col(c), rows.schema[c].dataType) for n, c in (("qty", "l_quantity"), ("part", "l_partkey"), ("flag", "l_returnflag"))}
    return rows.select("l_orderkey", "l_linenumber", schema.coerced(own).alias("a")).select("l_orderkey", "l_linenumber", "a.qty", "a.part", "a.flag")


# Requests and records


@cases({"dense": "ok", "dense empty": "EmptyVector", "dense empty before filter": "EmptyVector", "lexical blank": "EmptyText", "lexical filter": "InvalidArgument", "lexical no words": "EmptyText", "lexical fields": "InvalidArgument", "tensor empty": "EmptyVector", "tensor filter": "InvalidArgument", "page": "InvalidPage", "offset": "InvalidPage", "page kind": "InvalidArgument", "many": "InvalidPage"})
def request_checks(spark: SparkSession, sf_dir: str) -> dict:
    rows = local_rows(spark, id=["a"]).select("id", F.lit("x").alias("content"), F.lit(None).cast(STANDARD.struct()).alias("attributes"), F.array(F.lit(1.0).cast("float")).alias("vector"))
    other = P.normalise(P.equal(SchemaBuilder().string("other").build().string("other"), "x"))
    bad = search.Request(other)
    ran = lambda call: lambda: "ok" if call() is not None else "none"
    return {
        "dense": ran(lambda: search.dense_search(rows, [1.0])), "dense empty": ran(lambda: search.dense_search(rows, [])), "dense empty before filter": ran(lambda: search.dense_search(rows, [], bad)),
        "lexical blank": ran(lambda: search.bm25(rows, " \n", request=bad)), "lexical filter": ran(lambda: search.bm25(rows, "?", request=bad)), "lexical no words": ran(lambda: search.bm25(rows, "?")), "lexical fields": ran(lambda: search.bm25(rows, "x", ("content", "content"))),
        "tensor empty": ran(lambda: search.tensor_search(rows, [])), "tensor filter": ran(lambda: search.tensor_search(rows, [[1.0]], bad)),
        "page": lambda: Page(0).limit, "offset": lambda: Page(1, -1).limit, "page kind": ran(lambda: search.dense_search(rows, [1.0], search.Request(page=(1, 0)))), "many": ran(lambda: search.dense_search_many(rows, rows, 0)),
    }


@query("SELECT 'EmptyVector' AS problem, id FROM (SELECT DISTINCT id, coalesce(len(vector), 0) AS n FROM dense WHERE id IS NOT NULL) WHERE n = 0")
def refused_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_problems(tables.dense(spark, sf_dir, "vector"))


# Predicates

_T, _A, _S, _B = STANDARD.string("tenant"), STANDARD.int("age"), STANDARD.float("score"), STANDARD.bool("active")
_NAMED = {
    "empty": lambda: P.normalise(None),
    "equal": lambda: P.normalise(P.equal(_T, "acme")),
    "not equal": lambda: P.normalise(P.not_equal(_B, True)),
    "range": lambda: P.normalise(P.greater_or_equal(_S, 1)),
    "in": lambda: P.normalise(P.one_of(_A, 1, 2)),
    "nested": lambda: P.normalise(P.all_of(P.all_of(P.equal(_T, "it's"), P.less(_A, 5)), P.inverse(P.any_of(P.equal(_B, False), P.greater(_S, 0.5))))),
}


@cases({
    "empty": '["TRUE", []]', "equal": '["attributes->>\'tenant\' = $2", ["acme"]]', "not equal": '["(attributes->>\'active\')::boolean <> $2", [true]]', "range": '["(attributes->>\'score\')::double precision >= $2", [1.0]]',
    "in": '["(attributes->>\'age\')::bigint IN ($2, $3)", [1, 2]]',
    "nested": '["(attributes->>\'tenant\' = $2) AND ((attributes->>\'age\')::bigint < $3) AND (NOT (((attributes->>\'active\')::boolean = $4) OR ((attributes->>\'score\')::double precision > $5)))", ["it\'s", 5, false, 0.5]]',
})
def predicate_sql(spark: SparkSession, sf_dir: str) -> dict:
    return {name: (lambda make=make: list(P.as_sql(make(), 2))) for name, make in _NAMED.items()}


@cases({
    "empty": '{"match": "all"}', "equal": '{"eq": {"field": "tenant", "value": "acme"}}', "not equal": '{"neq": {"field": "active", "value": true}}', "range": '{"range": {"field": "score", "gte": 1.0}}', "in": '{"in": {"field": "age", "values": [1, 2]}}',
    "nested": '{"and": [{"eq": {"field": "tenant", "value": "it\'s"}}, {"range": {"field": "age", "lt": 5}}, {"not": {"or": [{"eq": {"field": "active", "value": false}}, {"range": {"field": "score", "gt": 0.5}}]}}]}',
})
def predicate_conditions(spark: SparkSession, sf_dir: str) -> dict:
    return {name: (lambda make=make: P.as_conditions(make())) for name, make in _NAMED.items()}


@cases({
    "empty": '{"match_all": {}}', "equal": '{"term": {"tenant": "acme"}}', "not equal": '{"bool": {"must_not": [{"term": {"active": true}}]}}', "range": '{"range": {"score": {"gte": 1.0}}}', "in": '{"terms": {"age": [1, 2]}}',
    "nested": '{"bool": {"filter": [{"term": {"tenant": "it\'s"}}, {"range": {"age": {"lt": 5}}}, {"bool": {"must_not": [{"bool": {"minimum_should_match": 1, "should": [{"term": {"active": false}}, {"range": {"score": {"gt": 0.5}}}]}}]}}]}}',
})
def predicate_dsl(spark: SparkSession, sf_dir: str) -> dict:
    return {name: (lambda make=make: P.as_query_dsl(make())) for name, make in _NAMED.items()}


@cases({"empty": "empty", "nested": "enter and, eq tenant, lt age, enter not, enter or, eq active, gt score, leave or, leave not, leave and", "in": "in age"})
def predicate_walk(spark: SparkSession, sf_dir: str) -> dict:
    def told(make: Callable[[], object]) -> str:
        seen: list[str] = []
        name = lambda t: "not" if isinstance(t, P.Negation) else t.op
        P.walk(make(), lambda x: seen.append(f"{x.op} {x.name}"), lambda t: seen.append(f"enter {name(t)}"), lambda t: seen.append(f"leave {name(t)}"), lambda t: seen.append("empty"))
        return ", ".join(seen)

    return {n: (lambda n=n: told(_NAMED[n])) for n in ("empty", "nested", "in")}


@cases({"empty in": "InvalidArgument", "empty and": "InvalidArgument", "nan": "InvalidArgument", "infinite": "InvalidArgument", "text in order": "InvalidArgument", "bool in order": "InvalidArgument", "bad field": "InvalidArgument", "mixed in": "InvalidArgument", "other schema": "InvalidArgument", "other kind": "InvalidArgument", "not built": "InvalidArgument", "no predicate": "InvalidArgument", "good": "ok"})
def predicate_checks(spark: SparkSession, sf_dir: str) -> dict:
    made = lambda call: lambda: "ok" if P.normalise(call()) else "none"
    tree = P.normalise(P.equal(_T, "acme"))
    return {
        "empty in": made(lambda: P.one_of(_T)), "empty and": made(P.all_of), "nan": made(lambda: P.equal(_S, float("nan"))), "infinite": made(lambda: P.one_of(_S, 1.0, float("inf"))),
        "text in order": made(lambda: P.greater(_T, "a")), "bool in order": made(lambda: P.Leaf("gt", "active", "bool", True)), "bad field": made(lambda: P.Leaf("eq", "a b", "string", "x")), "mixed in": made(lambda: P.Leaf("in", "age", "int", (1, "x"))),
        "other schema": lambda: "ok" if P.bind(tree, SchemaBuilder().int("age").build()) else "", "other kind": lambda: "ok" if P.bind(tree, SchemaBuilder().int("tenant").build()) else "", "not built": lambda: "ok" if P.bind(tree, Schema()) else "",
        "no predicate": made(lambda: "tenant = 1"), "good": lambda: "ok" if P.bind(tree, STANDARD) else "",
    }


@query("SELECT DISTINCT id FROM docstore WHERE id IS NOT NULL AND coalesce(attributes.age > 300, false) AND NOT (coalesce(attributes.tenant = 'goringatt', false) OR coalesce(attributes.score < 0.5, false))")
def predicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluator for records outside of Spark, over every row."""
    tree = P.normalise(P.all_of(P.greater(_A, 300), P.inverse(P.any_of(P.equal(_T, "goringatt"), P.less(_S, 0.5)))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.loc[[P.matches(tree, a and json.loads(a)) for a in pdf["a"]], ["id"]]

    rows = tables.table(spark, sf_dir, "docstore").filter("id IS NOT NULL").select("id", F.to_json("attributes").alias("a"))
    return rows.mapInPandas(run, "id string").distinct()


# Stores


def _stored_records(spark: SparkSession, sf_dir: str) -> tuple[DocumentStore, DataFrame]:
    store = DocumentStore(spark, new_folder(spark), "docs", STANDARD)
    rows = tables.dense(spark, sf_dir).filter(F.size("vector") > 0)
    store.upsert(rows)
    store.upsert(rows.filter("attributes.active").withColumn("content", F.concat("content", F.lit(" (new)"))))
    return store, rows


@query(f"WITH {Q._DENSE} SELECT id, CASE WHEN attributes.active THEN content || ' (new)' ELSE content END AS content, attributes.tenant AS tenant FROM ds WHERE len(vector) > 0")
def store_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_records(spark, sf_dir)[0].read().select("id", "content", "attributes.tenant")


@query(f"WITH {Q._DENSE} SELECT id, content FROM ds WHERE len(vector) > 0 AND NOT coalesce(attributes.active, false) AND id NOT IN {tuple(sorted(set(Q._IDS)))} AND id <> '{Q.PROBE}'")
def store_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = _stored_records(spark, sf_dir)
    store.delete_by_filter(P.normalise(P.equal(store.schema.bool("active"), True)))
    store.delete_by_ids([Q.PROBE, "unknown"])
    return store.read().select("id", "content")


@query(Q._SQL["tensor_maxsim"])
def tensor_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = DocumentStore(spark, new_folder(spark), "tensors", STANDARD, "tensor")
    rows = tables.table(spark, sf_dir, "embeddings")
    store.upsert(rows.select(F.col("vec_id").cast("string").alias("id"), F.lit("").alias("content"), F.lit(None).cast(STANDARD.struct()).alias("attributes"), search.as_tensor(F.col("embedding"), 4, 16).cast("array<array<float>>").alias("tensor")))
    probe = rows.filter("vec_id = 7").select("embedding").first()[0]
    return store.search([list(probe[k : k + 16]) for k in range(0, 64, 16)], page=Page(20)).select("id", F.round("score", 5).alias("score"))


def _indexed(spark: SparkSession, sf_dir: str) -> LexicalIndex:
    return LexicalIndex(tables.documents(spark, sf_dir, "content", "attributes"), ["content"], STANDARD).build(new_folder(spark))


@query(Q._SQL["bm25_topk"])
def lexical_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir).search(Q._BM25, page=Page(25)).select("id", F.round("score", 6).alias("score"))


@query(Q._SQL["bm25_filtered"])
def lexical_index_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir).search(Q._BM25, P.normalise(P.equal(_B, True)), Page(10, 5)).select("id", F.round("score", 6).alias("score"))


@cases({"table name": "InvalidArgument", "schema": "InvalidArgument", "no fields": "InvalidArgument", "field twice": "InvalidArgument", "field name": "InvalidArgument", "nothing yet": "InvalidArgument", "batch twice": "InvalidArgument", "undeclared": "InvalidArgument", "no id": "MissingID", "no vector": "EmptyVector", "wrong kind": "InvalidArgument", "schema told": "ok", "late writer": "Unavailable", "none written": "0"})
def store_checks(spark: SparkSession, sf_dir: str) -> dict:
    row = {"id": "a", "content": "x", "vector": [1.0]}
    docs = spark.createDataFrame([("a", "x")], "id string, content string")
    store, table = DocumentStore(spark, new_folder(spark), "docs", STANDARD), VersionedTable(spark, new_folder(spark))
    table.write(docs)
    return {
        "table name": lambda: DocumentStore(spark, "x", "bad-name", STANDARD).name, "schema": lambda: DocumentStore(spark, "x", "docs", Schema()).name, "no fields": lambda: LexicalIndex(docs, [], STANDARD).fields, "field twice": lambda: LexicalIndex(docs, ["a", "a"], STANDARD).fields,
        "field name": lambda: LexicalIndex(docs, ["a b"], STANDARD).fields, "nothing yet": lambda: store.read().columns, "batch twice": lambda: store.upsert([row, row]), "undeclared": lambda: store.upsert([row | {"attributes": {"other": 1}}]), "no id": lambda: store.upsert([row | {"id": ""}]),
        "no vector": lambda: store.upsert([row | {"vector": []}]), "wrong kind": lambda: store.upsert(spark.createDataFrame([row]).withColumn("attributes", F.struct(F.lit("old").alias("age")))), "schema told": lambda: "ok" if store.schema is STANDARD else "other",
        "late writer": lambda: table.write(docs, 0).columns, "none written": lambda: store.table.number(),
    }


@query("""SELECT * FROM (VALUES ('{"k": 1}', NULL), ('{"k": 2.0, "s": "a"}', NULL), ('{}', NULL), ('null', NULL), ('{"k": "1"}', 'k is not int'), ('{"k": 1.5}', 'k is not int'), ('{"s": 1}', 's is not string'), ('{"y": 1}', 'undeclared'), ('{"k"', 'malformed')) AS t(raw, problem)
    UNION ALL SELECT props, NULL FROM events""")
def attribute_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = SchemaBuilder().int("k").string("s").build()
    crafted = local_rows(spark, raw=['{"k": 1}', '{"k": 2.0, "s": "a"}', "{}", "null", '{"k": "1"}', '{"k": 1.5}', '{"s": 1}', '{"y": 1}', '{"k"'])
    rows = crafted.unionAll(tables.table(spark, sf_dir, "events").select(F.col("props").alias("raw")))
    return rows.select("raw", tables.attribute_problem(F.col("raw"), schema).alias("problem"))


@query(f"WITH ls AS (SELECT DISTINCT query_id, list_no, id, content, attributes, relevance FROM ranked WHERE content IS NOT NULL) SELECT query_id || '/' || list_no || '/' || id AS id, attributes.tenant AS tenant, attributes.age AS age, round(CASE WHEN relevance IS NOT NULL THEN greatest(0, least(1, relevance)) END, 6) AS relevance FROM ls")
def projected_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = SchemaBuilder().string("tenant").int("age").build()
    hits = tables.ranked(spark, sf_dir).filter("content IS NOT NULL").select(F.concat_ws("/", "query_id", "list_no", "id").alias("id"), "content", "attributes", F.col("relevance").alias("score"))
    return tables.projected(hits, schema).select("id", "attributes.tenant", "attributes.age", F.round("relevance", 6).alias("relevance"))


@query(f"WITH {Q._DOCS} SELECT id, content FROM docs WHERE relevance IS NULL OR relevance BETWEEN 0 AND 1")
def stored_searcher(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = StoredSearcher(tables.documents(spark, sf_dir))
    return held.dense([1.0], search.Request(P.normalise(P.equal(_T, "nobody")), Page(1))).select("id", "content")


@cases({"dense": "0", "lexical": "0", "tensor": "0", "ids": "0", "many": "0", "chunks": "0", "rerank": "0", "no lists": "null"})
def empty_results(spark: SparkSession, sf_dir: str) -> dict:
    rows = tables.dense(spark, sf_dir).limit(0)
    docs = tables.documents(spark, sf_dir).limit(0)
    return {
        "dense": lambda: search.dense_search(rows, [1.0], search.Request(page=Page(3))).count(), "lexical": lambda: search.bm25(docs, "x").count(), "tensor": lambda: search.tensor_search(rows.withColumn("tensor", F.array("vector").cast("array<array<float>>")), [[1.0]]).count(),
        "ids": lambda: Q.stores.find_by_ids(docs, []).count(), "many": lambda: search.dense_search_many(rows, rows.select(F.lit(1).cast("long").alias("query_id"), "vector"), 3).count(), "chunks": lambda: chunking.chunk_recursive(docs, chunking.Sizes(10)).count(),
        "rerank": lambda: ranking.reranked(docs, "q", lambda q, t: [(k, 0.5) for k in range(len(t))]).count(), "no lists": lambda: ranking.reciprocal_rank_fusion(ranking.tagged([]), 60),
    }


# Graphs


@query(
    f"""WITH {Q._GRAPH_SQL}, one AS (SELECT s AS id FROM edges WHERE t = 'region-1'), v AS (SELECT 'region-1' AS id UNION SELECT id FROM one)
    SELECT 'node' AS what, id, CASE WHEN id = 'region-1' THEN 'new' ELSE 'old' END AS content FROM v UNION ALL SELECT 'edge', s || '>' || t, kind FROM edges WHERE t = 'region-1'"""
)
def graph_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = GraphStore(spark, new_folder(spark), graphs.GraphSchema(Q._NODE_SCHEMA, Q._EDGE_SCHEMA))
    g = Q._customers(spark, sf_dir)
    store.upsert(graphs.Graph(g.nodes.withColumn("content", F.lit("old")), g.edges))
    # A region and its nations again, with the edges between them: all are replaced in their places.
    some = g.nodes.filter("id = 'region-1' OR id LIKE 'nation-%'").withColumn("content", F.when(F.col("id") == "region-1", "new").otherwise("old"))
    store.upsert(graphs.Graph(some, g.edges.filter("target_id = 'region-1'")))
    found = store.traverse(graphs.Traversal(["region-1"], "inbound"))
    return found.nodes.select(F.lit("node").alias("what"), "id", "content").unionByName(found.edges.select(F.lit("edge").alias("what"), "id", F.col("attributes.kind").alias("content")))


@cases({"good": "2", "kind of another kind": "InvalidArgument", "undeclared": "InvalidArgument", "dangling": "InvalidGraph", "stored dangling": "InvalidGraph", "stored dangling far": "1", "filter": "InvalidArgument", "label": "InvalidGraph", "no seeds": "InvalidArgument", "depth": "InvalidArgument", "direction": "InvalidArgument", "node twice": "InvalidGraph", "edge twice": "InvalidGraph"})
def graph_checks(spark: SparkSession, sf_dir: str) -> dict:
    nodes = spark.createDataFrame([("n1", ["Doc"], "", ("acme",), 0), ("n2", ["Doc"], "", ("acme",), 1)], "id string, labels array<string>, content string, attributes struct<tenant:string>, _ord long")
    edges = spark.createDataFrame([("e12", "n1", "n2", "LINKS", ("keep",), 0)], "id string, source_id string, target_id string, type string, attributes struct<kind:string>, _ord long")
    schema = graphs.GraphSchema(SchemaBuilder().string("tenant").build(), SchemaBuilder().string("kind").build())
    good, lost = graphs.Graph(nodes, edges), graphs.Graph(nodes.filter("id = 'n1'"), edges)
    put = lambda g: lambda: graphs.upsert(good, g, schema).edges.count() and graphs.upsert(good, g, schema).nodes.count()
    other = P.normalise(P.equal(SchemaBuilder().string("other").build().string("other"), "x"))
    return {
        "good": put(good), "kind of another kind": put(graphs.Graph(nodes, edges.withColumn("attributes", F.struct(F.lit(True).alias("kind"))))), "undeclared": put(graphs.Graph(nodes.withColumn("attributes", F.struct(F.lit("x").alias("other"))), edges)),
        "dangling": put(lost), "stored dangling": lambda: graphs.traverse(lost, graphs.Traversal(["n1"]), schema).nodes.count(), "stored dangling far": lambda: graphs.traverse(lost, graphs.Traversal(["n1"], "inbound"), schema).nodes.count(),
        "filter": lambda: graphs.traverse(good, graphs.Traversal(["n1"], node_filter=other), schema).nodes.count(), "label": put(graphs.Graph(nodes.withColumn("labels", F.array(F.lit("bad-label"))), edges)),
        "no seeds": lambda: graphs.Traversal([]).depth, "depth": lambda: graphs.Traversal(["a"], depth=0).depth, "direction": lambda: graphs.Traversal(["a"], "up").depth, "node twice": put(graphs.Graph(nodes.unionAll(nodes), edges)), "edge twice": put(graphs.Graph(nodes, edges.unionAll(edges))),
    }


# Vectors and chunks


_STEPS = "".join(f", s{k} AS (SELECT *, (a{k - 1} + na / a{k - 1}) / 2 AS a{k}, (b{k - 1} + nb / b{k - 1}) / 2 AS b{k} FROM s{k - 1})" for k in range(1, 9))


@query(
    f"""WITH {Q._DENSE}, v AS (SELECT id, vector::DOUBLE[] AS e FROM ds WHERE len(vector) = 64 AND list_aggregate(list_transform(vector, lambda x: abs(x)), 'max') > 0), p AS (SELECT e AS q FROM v WHERE id >= '{Q.PROBE}' ORDER BY id LIMIT 1),
    s0 AS (SELECT id, list_inner_product(e, q) AS d, list_inner_product(e, e) AS na, list_inner_product(q, q) AS nb, list_inner_product(e, e) AS a0, list_inner_product(q, q) AS b0 FROM v, p){_STEPS}
    SELECT id, round(d / (a8 * b8), 6) AS cosine FROM s8"""
)
def cosine_newton(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.dense(spark, sf_dir, "vector").filter((F.size("vector") == 64) & F.exists("vector", lambda x: x != 0))
    probe = rows.filter(F.col("id") >= Q.PROBE).orderBy("id").first()["vector"]
    return rows.select("id", F.round(cosine(F.col("vector"), F.array(*[F.lit(x) for x in probe]), 8), 6).alias("cosine"))


@query(f"WITH {Q._CHUNKS} SELECT id, source_id, index, row_number() OVER (PARTITION BY source_id ORDER BY index, id) - 1 AS position FROM cs")
def chunk_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = chunking.in_order(tables.chunks(spark, sf_dir, "source_id", "index"))
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("index", "id")) - 1
    return ordered.select("id", "source_id", "index", place.cast("long").alias("position"))


@query(f"WITH {Q._DOCS} SELECT id, {Q._TRIM.format('content')} <> '' AND content IS NOT NULL AS splittable FROM docs")
def split_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir, "content")
    good = chunking.sources(docs).select("id", F.lit(True).alias("splittable"))
    return docs.select("id").join(good, "id", "left").fillna(False, ["splittable"])


@cases({"no id": "MissingSourceID", "blank": "EmptyText", "good": "1", "size": "InvalidArgument", "overlap": "InvalidArgument", "no separators": '["\\n\\n", "\\n", " "]', "threshold": "InvalidArgument", "least": "InvalidArgument", "no sentences": "ProtocolError", "too few": "ProtocolError", "no dimensions": "ProtocolError", "ragged": "ProtocolError", "zero": "ProtocolError", "fits": "[2, 2]"})
def chunk_checks(spark: SparkSession, sf_dir: str) -> dict:
    docs = spark.createDataFrame([("a", "one. two."), ("", "x"), ("b", " \n")], "id string, content string")
    strict = lambda key: lambda: chunking.sources(docs.filter(F.col("id") == key), strict=True).count()
    fit = lambda n, v: lambda: list(chunking.checked_embeddings(["x"] * n, v).shape)
    return {
        "no id": strict(""), "blank": strict("b"), "good": strict("a"), "size": lambda: chunking.Sizes(0).size, "overlap": lambda: chunking.Sizes(5, 5).size, "no separators": lambda: list(chunking.Sizes(5, separators=()).separators),
        "threshold": lambda: chunking.chunk_semantic(docs, len, 1.5).columns, "least": lambda: chunking.chunk_semantic(docs, len, 0.5, 0).columns, "no sentences": fit(0, []), "too few": fit(2, [[1.0]]), "no dimensions": fit(1, [[]]), "ragged": fit(2, [[1.0], [1.0, 2.0]]), "zero": fit(1, [[0.0]]), "fits": fit(2, [[1.0, 0.0], [0.0, 1.0]]),
    }


@query(
    """WITH v AS (SELECT vec_id, vec_id // 16 AS grp, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT *, lag(e) OVER (PARTITION BY grp ORDER BY vec_id) AS p FROM v),
    c AS (SELECT vec_id, grp, CASE WHEN p IS NOT NULL AND list_cosine_similarity(p, e) < 0.1 THEN 1 ELSE 0 END AS cut FROM n) SELECT vec_id, CAST(sum(cut) OVER (PARTITION BY grp ORDER BY vec_id) AS INTEGER) AS part FROM c"""
)
def semantic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator itself, over runs of sixteen vectors, so that no group grows with the table."""
    rows = tables.table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 16).alias("grp"))
    runs = rows.agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("run"))
    parts = runs.select("run", chunking.semantic_groups(F.col("run.embedding").cast("array<array<double>>"), 0.1, 1).alias("parts"))
    return parts.select(F.explode(F.arrays_zip(F.col("run.vec_id").alias("vec_id"), F.col("parts").alias("part"))).alias("x")).select("x.vec_id", "x.part")


_KIND = "length(part) % 3"


def _remainders(texts: list[str]) -> list[list[float]]:
    return [[float(len(t) % 3 == k) for k in range(3)] for t in texts]


@query(
    f"""WITH {Q._DOCS}, s AS (SELECT id, {Q._SENTENCES} AS parts FROM docs WHERE {Q._SOLID}), e AS (SELECT id, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM s),
    c AS (SELECT *, CASE WHEN {_KIND} IS DISTINCT FROM lag({_KIND}) OVER (PARTITION BY id ORDER BY k) THEN 1 ELSE 0 END AS cut FROM e),
    g AS (SELECT *, sum(cut) OVER (PARTITION BY id ORDER BY k) - 1 AS grp FROM c) SELECT id AS source_id, CAST(grp AS INTEGER) AS index, string_agg(part, ' ' ORDER BY k) AS content FROM g GROUP BY id, grp"""
)
def chunk_semantic_plugins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic chunks with a segmenter and an embedder of one's own: a sentence's vector tells its length's remainder by three."""
    chunks = chunking.chunk_semantic(tables.documents(spark, sf_dir), _remainders, 0.5, 1, chunking.sentences)
    return chunks.select("source_id", "index", "content")


@query(
    f"""WITH RECURSIVE {Q._DOCS}, s AS (SELECT id, {Q._SENTENCES} AS parts FROM docs WHERE {Q._SOLID}), e AS MATERIALIZED (SELECT id, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM s),
    n AS MATERIALIZED (SELECT *, {_KIND} IS DISTINCT FROM lag({_KIND}) OVER (PARTITION BY id ORDER BY k) AS other FROM e),
    g AS (SELECT id, k, part, 1 AS held, 0 AS grp FROM n WHERE k = 1 UNION ALL
          SELECT n.id, n.k, n.part, CASE WHEN n.other AND g.held >= 2 THEN 1 ELSE g.held + 1 END, g.grp + CASE WHEN n.other AND g.held >= 2 THEN 1 ELSE 0 END FROM g JOIN n ON n.id = g.id AND n.k = g.k + 1)
    SELECT id AS source_id, CAST(grp AS INTEGER) AS index, string_agg(part, ' ' ORDER BY k) AS content FROM g GROUP BY id, grp"""
)
def chunk_semantic_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with at least two sentences before a cut."""
    chunks = chunking.chunk_semantic(tables.documents(spark, sf_dir), _remainders, 0.5, 2)
    return chunks.select("source_id", "index", "content")


# Merging and reranking


@query(f"WITH {Q._LISTS}, s AS (SELECT query_id, id, sum(1.0 / (60 + rank + 1)) AS score FROM ls GROUP BY query_id, id) SELECT query_id, id, round(score, 9) AS score FROM s")
def rrf_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge that refuses an id with two payloads; the payload is what doesn't depend on the list."""
    rows = tables.ranked(spark, sf_dir, "rank").withColumn("content", F.concat(F.lit("text of "), "id"))
    merged = ranking.reciprocal_rank_fusion(rows, 60, by=["query_id"], payload=["content"], check_payload=True)
    return merged.select("query_id", "id", F.round("score", 9).alias("score"))


@cases({"two lists": '[["b", 1.0], ["a", 0.504065], ["d", 0.495935], ["c", 0.488063]]', "repeats in a list": '[["a", 1.0]]', "other content": "InvalidArgument", "other attributes": "InvalidArgument", "same payload": '[["a", 1.0]]', "k": "InvalidArgument", "no lists": "null", "cancelled": "Cancelled", "cancel unknown": "InvalidArgument", "cancel nothing running": "null"})
def merge_cases(spark: SparkSession, sf_dir: str) -> dict:
    def lists(*own: list[tuple[str, str, int]]) -> DataFrame:
        return ranking.tagged([spark.createDataFrame([(i, n, c, (a,)) for n, (i, c, a) in enumerate(x)], "id string, rank int, content string, attributes struct<age:long>") for x in own])

    plain = lambda ids: [(i, "", 0) for i in ids]
    merged = lambda rows, **how: lambda: [[r.id, round(r.relevance, 6)] for r in ranking.reciprocal_rank_fusion(rows, 60, **how).collect()]
    both = {"payload": ["content", "attributes"], "check_payload": True}

    def cancelled() -> None:
        raise E.Cancelled("by the caller")

    return {
        "two lists": merged(lists(plain("abc"), plain("bd"))), "repeats in a list": merged(lists(plain("aa"))), "other content": merged(lists([("a", "x", 1)], [("a", "y", 1)]), **both), "other attributes": merged(lists([("a", "x", 1)], [("a", "x", 2)]), **both),
        "same payload": merged(lists([("a", "x", 1)], [("a", "x", 1)]), **both), "k": lambda: ranking.reciprocal_rank_fusion(lists(plain("a")), 0), "no lists": lambda: ranking.reciprocal_rank_fusion(ranking.tagged([]), 60),
        "cancelled": traced("ranking.merge", cancelled, spark), "cancel unknown": lambda: cancel("other", spark), "cancel nothing running": lambda: cancel("ranking.merge", spark),
    }


# Providers


def _canned(name: str, capability: str, calls: list) -> Provider:
    """A provider whose transport answers each input with its number, last first."""
    what = {"tensor": "tensor", "rerank": "relevance_score"}.get(capability, "vector" if name == "gemini" else "embedding")
    where = {"gemini": "embeddings", "cohere": "results"}.get(name, "data")

    def transport(url: str, headers: dict, payload: dict) -> tuple[int, bytes]:
        calls.append([url, headers.get("Authorization", ""), payload])
        n = len(payload.get("input", payload.get("inputs", payload.get("documents", []))))
        value = {"tensor": lambda k: [[float(k)]], "rerank": lambda k: (k + 1) / 10}.get(capability, lambda k: [float(k)])
        return 200, json.dumps({where: [{"index": k, what: value(k)} for k in reversed(range(n))]}).encode()

    return Provider(name, capability, "key", "m", "https://example.org/v1/" if name == "openai" else "", transport)


@cases({
    "openai dense": '[[[0.0], [1.0]], ["https://example.org/v1/embeddings", "Bearer key", {"input": ["a", "b"], "model": "m"}]]',
    "jina dense": '[[[0.0], [1.0]], ["https://api.jina.ai/v1/embeddings", "Bearer key", {"input": ["a", "b"], "model": "m"}]]',
    "gemini dense": '[[[0.0], [1.0]], ["https://generativelanguage.googleapis.com/v1beta/models/m:embed?key=key", "", {"input": ["a", "b"], "model": "m"}]]',
    "jina tensor": '[[[[0.0]], [[1.0]]], ["https://api.jina.ai/v1/tensor", "Bearer key", {"input": ["a", "b"], "model": "m"}]]',
    "gemini multimodal": '[[[0.0]], ["https://generativelanguage.googleapis.com/v1beta/models/m:embedMultimodal?key=key", "", {"inputs": [[{"kind": "text", "text": "a"}]], "model": "m"}]]',
    "cohere rerank": '[[[0, 0.1], [1, 0.2]], ["https://api.cohere.com/v2/rerank", "Bearer key", {"documents": ["a", "b"], "model": "m", "query": "q"}]]',
})
def provider_calls(spark: SparkSession, sf_dir: str) -> dict:
    def called(name: str, capability: str) -> object:
        calls: list = []
        p = _canned(name, capability, calls)
        if capability == "rerank":
            got: object = p.rerank("q", ["a", "b"])
        else:
            got = p.embed([[{"kind": "text", "text": "a"}]] if capability == "multimodal" else ["a", "b"])
        return [got, *calls]

    return {f"{n} {c}": (lambda n=n, c=c: called(n, c)) for n, c in (("openai", "dense"), ("jina", "dense"), ("gemini", "dense"), ("jina", "tensor"), ("gemini", "multimodal"), ("cohere", "rerank"))}


@cases({"blank key": "InvalidArgument", "blank model": "InvalidArgument", "no transport": "InvalidArgument", "capability": "InvalidArgument", "no texts": "EmptyText", "blank text": "EmptyText", "no inputs": "InvalidArgument", "bad part": "InvalidArgument", "not asked": "0", "blank query": "EmptyText", "no documents": "[]", "too few": "ProtocolError", "twice": "ProtocolError", "out of range": "ProtocolError", "no vector": "ProtocolError", "no json": "ProtocolError", "429": "Unavailable", "500": "Unavailable", "404": "InvalidArgument", "302": "ProtocolError", "down": "Unavailable"})
def provider_checks(spark: SparkSession, sf_dir: str) -> dict:
    calls: list = []
    jina = lambda **how: Provider(**({"name": "jina", "capability": "dense", "key": "k", "model": "m", "transport": _canned("jina", "dense", calls).transport} | how))
    says = lambda body, status=200: lambda: jina(transport=lambda *a: (status, body)).embed(["a", "b"])
    data = lambda *rows: json.dumps({"data": [{"index": k, "embedding": v} for k, v in rows]}).encode()
    many, rank = _canned("gemini", "multimodal", calls), _canned("cohere", "rerank", calls)

    def down(*a: object) -> tuple[int, bytes]:
        raise ConnectionError("no route")

    return {
        "blank key": lambda: jina(key=" ").name, "blank model": lambda: jina(model="").name, "no transport": lambda: jina(transport=None).name, "capability": lambda: jina(capability="rerank").name, "no texts": lambda: jina().embed([]), "blank text": lambda: jina().embed(["a", " "]),
        "no inputs": lambda: many.embed([]), "bad part": lambda: many.embed([[{"kind": "bytes", "bytes": b"x"}]]), "not asked": lambda: len(calls), "blank query": lambda: rank.rerank(" ", ["a"]), "no documents": lambda: rank.rerank("q", []),
        "too few": says(data((0, [1.0]))), "twice": says(data((0, [1.0]), (0, [2.0]))), "out of range": says(data((0, [1.0]), (2, [2.0]))), "no vector": says(data((0, [1.0]), (1, []))), "no json": says(b"{"),
        "429": says(b"", 429), "500": says(b"", 500), "404": says(b"", 404), "302": says(b"", 302), "down": lambda: jina(transport=down).embed(["a"]),
    }


def _lengths(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count("e"))] for t in texts]


@query(f"WITH {Q._DOCS} SELECT id, CAST(length(content) AS DOUBLE) AS x, CAST(length(content) - length(replace(content, 'e', '')) AS DOUBLE) AS y, CAST(length(content) AS DOUBLE) AS tensor FROM docs")
def embed_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and tensors of every text, by an embedder whose values SQL can tell."""
    docs = embedded(tables.documents(spark, sf_dir, "content"), _lengths)
    both = embedded(docs, lambda texts: [[v, v] for v in _lengths(texts)], output="tensor", tensor=True)
    return both.select("id", F.col("vector")[0].cast("double").alias("x"), F.col("vector")[1].cast("double").alias("y"), F.col("tensor")[1][0].cast("double").alias("tensor"))


@query(f"WITH {Q._DOCS} SELECT id, CAST(length({Q._TRIM.format('content')}) AS DOUBLE) AS text, CAST(octet_length(encode(id)) AS DOUBLE) AS bytes, 3.0::DOUBLE AS parts FROM docs WHERE {Q._SOLID}")
def embed_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of inputs of a text, bytes and a link each."""
    none = F.lit(None)
    part = lambda kind, mime=none, text=none, raw=none, url=none: F.struct(F.lit(kind).alias("kind"), mime.cast("string").alias("mime"), text.cast("string").alias("text"), raw.cast("binary").alias("bytes"), url.cast("string").alias("url"))
    parts = F.array(part("text", text=Q.trimmed(F.col("content"))), part("bytes", mime=F.lit("text/plain"), raw=F.col("id")), part("url", url=F.concat(F.lit("https://example.org/"), "id")))
    rows = chunking.sources(tables.documents(spark, sf_dir, "content")).select("id", parts.alias("parts"))

    def embed(inputs: list) -> list[list[float]]:
        return [[float(len(p[0]["text"])), float(len(p[1]["bytes"])), float(len(p))] for p in inputs]

    vector = F.col("vector")
    return embedded_inputs(rows, embed).select("id", *[vector[k].cast("double").alias(n) for k, n in enumerate(("text", "bytes", "parts"))])


# Errors, resilience, traces


@cases({"429": "Unavailable", "503": "Unavailable", "400": "InvalidArgument", "404": "InvalidArgument", "302": "ProtocolError", "own": "EmptyText", "cancelled": "Cancelled", "os": "Unavailable", "independent": "true", "body": "4108", "backend": "Unavailable", "backend own": "InvalidGraph"})
def error_classes(spark: SparkSession, sf_dir: str) -> dict:
    name = lambda e: type(e).__name__
    kinds = [E.InvalidArgument, E.Unsupported, E.ProtocolError, E.Unavailable, E.MissingID, E.MissingSourceID, E.EmptyText, E.EmptyVector, E.InvalidPage, E.InvalidGraph]

    def raised(error: BaseException) -> Callable:
        def call() -> None:
            raise error

        return E.backend_call(call)

    return {
        **{str(s): (lambda s=s: name(E.from_status(s))) for s in (429, 503, 400, 404, 302)}, "own": lambda: name(E.classified(E.EmptyText("x"))), "cancelled": lambda: name(E.classified(E.Cancelled("x"))), "os": lambda: name(E.classified(OSError("x"))),
        "independent": lambda: not any(issubclass(a, b) for a in kinds for b in kinds if a is not b) and len(kinds) == 10, "body": lambda: len(str(E.from_status(500, b"x" * 9999))), "backend": raised(ConnectionError("down")), "backend own": raised(E.InvalidGraph("x")),
    }


@cases({"third try": "3", "gives up": "Unavailable", "other errors": "InvalidArgument", "tries": "2", "attempts": "InvalidArgument", "fallback": "3", "fallback in a query": "3", "no fallback": "2", "fallback errors": "InvalidArgument", "concurrency": "InvalidArgument"})
def resilience_cases(spark: SparkSession, sf_dir: str) -> dict:
    def failing(times: int, error: type = E.Unavailable) -> tuple[Callable[[], int], list]:
        calls: list = []

        def call() -> int:
            calls.append(1)
            if len(calls) <= times:
                raise error("later")
            return len(calls)

        return call, calls

    def tries() -> int:
        call, calls = failing(9)
        try:
            retrying(call, 2, sleep=lambda s: None)()
        except E.Unavailable:
            return len(calls)
        return -1

    def raising(error: type) -> Callable:
        def call() -> DataFrame:
            raise error("no")

        return call

    in_query = lambda: spark.range(2).select(F.raise_error(F.lit("Unavailable: node")).cast("long").alias("id"))
    three = lambda: spark.range(3)
    quick = lambda call, n: lambda: retrying(call, n, sleep=lambda s: None)()
    return {
        "third try": quick(failing(2)[0], 5), "gives up": quick(failing(9)[0], 3), "other errors": quick(failing(1, E.InvalidArgument)[0], 3), "tries": tries, "attempts": lambda: retrying(three, 0)().count(),
        "fallback": lambda: with_fallback(raising(E.Unavailable), three)().count(), "fallback in a query": lambda: with_fallback(in_query, three)().count(), "no fallback": lambda: with_fallback(lambda: spark.range(2), three)().count(), "fallback errors": lambda: with_fallback(raising(E.InvalidArgument), three)().count(),
        "concurrency": lambda: map_ordered(spark.range(1), list, "id", "x", "long", 0).count(),
    }


@query(f"WITH {Q._DOCS} SELECT id, length(content) AS n, 2 * length(content) AS twice FROM docs WHERE content IS NOT NULL")
def mapped_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.documents(spark, sf_dir, "content").filter("content IS NOT NULL").select("id", F.char_length("content").cast("long").alias("n"))
    return map_ordered(rows, lambda xs: [2 * x for x in xs], "n", "twice", "long", 4)


@cases({f"{k:02d}": v for k, v in enumerate("dense.embed dense.search dense.upsert tensor.embed tensor.search tensor.upsert lexical.search multimodal.embed graph.traverse graph.upsert documents.find documents.delete_ids documents.delete_filter ranking.rerank ranking.merge".split())} | {"job description": "tessella.dense.search", "errors pass": "EmptyText", "unknown": "InvalidArgument", "nothing": "InvalidArgument"})
def traced_operations(spark: SparkSession, sf_dir: str) -> dict:
    def told(operation: str) -> str:
        ended: list = []
        traced(operation, lambda: spark.range(1).count(), spark, lambda name, error: ended.append(name))()
        return ended[0]

    def fails() -> None:
        raise E.EmptyText("x")

    described = traced("dense.search", lambda: spark.sparkContext.getLocalProperty("spark.job.description"), spark)
    out: dict = {f"{k:02d}": (lambda o=o: told(o)) for k, o in enumerate(OPERATIONS)}
    return out | {"job description": described, "errors pass": traced("dense.embed", fails, spark), "unknown": lambda: traced("other", fails), "nothing": lambda: traced("dense.embed", None)}


def queries() -> dict[str, Q.Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
