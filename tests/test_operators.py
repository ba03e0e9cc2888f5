from __future__ import annotations

import json
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella import errors as E
from tessella import predicate as P
from tessella.functions.vectors import cosine, maxsim
from tessella.model import PART_TYPE, Page, valid_chunks, valid_documents, valid_edges, valid_input, valid_nodes, valid_records
from tessella.observe import traced
from tessella.operators import chunking as C
from tessella.operators import embedding as M
from tessella.operators import graphs as G
from tessella.operators import ranking as R
from tessella.operators import search as S
from tessella.operators import stores as D
from tessella.resilience import map_ordered, retrying, with_fallback
from tessella.runtime import release, stored
from tessella.schema import STANDARD, Schema, SchemaBuilder
from tessella.sources.stores import DocumentStore, GraphStore
from tessella.sources.tables import VersionedTable, attribute_problem, decoded_attributes, upserted
from tessella.streaming.upserts import record_stream, upsert_stream

ATTRS = "struct<tenant:string,age:bigint,score:double,active:boolean>"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, (tenant, None, None, None) if tenant else None) for i, t, tenant in rows], f"id string, content string, attributes {ATTRS}")


def vectors(spark, rows):
    return spark.createDataFrame([(i, None, None, v) for i, v in rows], f"id string, content string, attributes {ATTRS}, vector array<float>")


def test_guards(spark):
    bad = [
        (valid_documents, spark.createDataFrame([("", 0.5)], "id string, relevance double"), "MissingID"),
        (valid_documents, spark.createDataFrame([("a", 1.5)], "id string, relevance double"), "relevance"),
        (valid_chunks, spark.createDataFrame([("a", None, 0)], "id string, source_id string, index int"), "MissingSourceID"),
        (valid_chunks, spark.createDataFrame([("a", "b", -1)], "id string, source_id string, index int"), "index"),
        (valid_records, spark.createDataFrame([("a", [])], "id string, vector array<float>"), "EmptyVector"),
        (valid_nodes, spark.createDataFrame([("a", ["bad-label"])], "id string, labels array<string>"), "labels"),
        (valid_nodes, spark.createDataFrame([("a", [])], "id string, labels array<string>"), "labels"),
        (valid_edges, spark.createDataFrame([("e", "a", "", "T")], "id string, source_id string, target_id string, type string"), "ends"),
        (valid_edges, spark.createDataFrame([("e", "a", "b", "T T")], "id string, source_id string, target_id string, type string"), "type"),
    ]
    for guard, df, text in bad:
        with pytest.raises(Exception, match=text):
            guard(df).select("id").collect()


def test_multimodal(spark):
    parts = [
        ([("text", None, "a", None, None)], True),
        ([("text", None, " ", None, None)], False),
        ([("bytes", "image/png", None, b"x", None)], True),
        ([("bytes", None, None, b"x", None)], False),
        ([("url", None, None, None, "https://x.org/a")], True),
        ([("url", None, None, None, "/a")], False),
        ([("text", None, "a", None, "https://x.org")], False),
        ([], False),
        (None, False),
    ]
    df = spark.createDataFrame([(p, k) for k, (p, _) in enumerate(parts)], f"parts array<{PART_TYPE.simpleString()}>, id int")
    assert [r.ok for r in df.select("id", valid_input(F.col("parts")).alias("ok")).orderBy("id").collect()] == [ok for _, ok in parts]
    good = df.filter("id in (0, 2)")
    assert len(M.embedded_inputs(good, lambda x: [[float(len(p))] for p in x]).collect()) == 2
    with pytest.raises(Exception, match="InvalidArgument"):
        M.embedded_inputs(df, lambda x: [[1.0]] * len(x)).collect()


def test_cosine(spark):
    pairs = [([1, 2, 3], [2, 4, 6], 1), ([1, 0], [-1, 0], -1), ([1, 0], [0, 1], 0), ([], [], 0), ([1], [1, 2], 0), ([0, 0], [1, 1], 0)]
    df = spark.createDataFrame([(list(map(float, a)), list(map(float, b)), float(c)) for a, b, c in pairs], "a array<float>, b array<float>, c double")
    for r in df.select(cosine(F.col("a"), F.col("b")).alias("x"), cosine(F.col("a"), F.col("b"), 8).alias("y"), "c").collect():
        assert abs(r.x - r.c) < 1e-9 and abs(r.y - r.c) < 1e-5
    d = spark.createDataFrame([([[1.0, 0.0], [0.6, 0.8]],)], "d array<array<float>>")
    assert abs(d.select(maxsim([[1, 0], [0, 1]], F.col("d"))).first()[0] - 1.8) < 1e-6


def test_dense_search(spark):
    df = vectors(spark, [("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0]), ("n", None), ("w", [1.0]), ("x", [float("nan"), 1.0])])
    got = S.dense_search(df, [1.0, 0.0], S.Request(page=Page(3))).collect()
    assert [(r.id, r.relevance, r.position) for r in got] == [("a", 1.0, 0), ("b", 1.0, 1), ("c", 0.5, 2)]
    assert [r.id for r in S.dense_search(df, [1.0, 0.0], S.Request(page=Page(2, 1)), content=False).collect()] == ["b", "c"]
    assert [r.id for r in S.dense_search(df, [1.0, 0.0]).collect()] == ["a", "b", "c", "z"]
    with pytest.raises(E.EmptyVector):
        S.dense_search(df, [])
    many = S.dense_search_many(df, spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, vector array<float>"), 2).collect()
    assert sorted((r.query_id, r.id, r.position) for r in many) == [(1, "a", 0), (1, "b", 1)]
    assert S.dense_search(df.limit(0), [1.0], S.Request(page=Page(1))).count() == 0


def test_lexical_and_tensor(spark):
    df = docs(spark, [("1", "red fox", "a"), ("2", "red red dog", "b"), ("3", None, None), ("4", "blue", None)])
    got = S.bm25(df, "RED fox", request=S.Request(page=Page(5))).collect()
    assert [r.id for r in got] == ["1", "2"] and got[0].score > got[1].score and 0 < got[0].relevance < 1
    tree = P.normalise(P.not_equal(STANDARD.string("tenant"), "a"))
    assert [r.id for r in S.bm25(df, "red", request=S.Request(tree, Page(5))).collect()] == ["2"]
    for text in ("", " \n", "!!"):
        with pytest.raises(E.EmptyText):
            S.bm25(df, text)
    with pytest.raises(E.InvalidArgument):
        S.bm25(df, "a", fields=[])
    with pytest.raises(E.EmptyVector):
        S.tensor_search(df, [])
    first = S.deduplicated(spark.createDataFrame([("1", 0), ("2", 1), ("1", 2)], "id string, o int"), [F.col("o")])
    assert sorted(tuple(r) for r in first.collect()) == [("1", 0), ("2", 1)]


def test_postings_rank_like_a_scan(spark, tmp_path):
    rows = [(f"d{k}", " ".join(w for n, w in enumerate("red fox Red hen the the owl sees a fox".split()) if (k * 7 + n) % 3), None if k % 5 else "fox", (k,)) for k in range(40)] + [("n", None, None, None), ("e", "", "", (1,))]
    docs = spark.createDataFrame(rows, "id string, content string, title string, attributes struct<age:long>")
    schema = SchemaBuilder().int("age").build()
    index = S.Postings.build(docs, ("content", "title"), f"file://{tmp_path}/p")
    some = P.normalise(P.greater(schema.int("age"), 10))
    for text in ("fox", "the RED fox", "unknown fox", "unknown"):
        for request in (S.Request(schema=schema), S.Request(some, Page(7, 2), schema)):
            want = [tuple(r) for r in S.bm25(docs, text, ("content", "title"), request).collect()]
            assert [tuple(r) for r in index.search(docs, text, request).collect()] == want
    assert S.Postings.build(docs.limit(0), ("content",), f"file://{tmp_path}/q").search(docs, "fox").count() == 0
    plan = spark.read.parquet(index.path).filter("bucket = 1 AND term = 'fox'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,fox)" in plan


def test_documents(spark):
    df = docs(spark, [("doc-1", "hello", "acme"), ("doc-2", "world", "globex"), ("doc-3", "", None)]).withColumn("relevance", F.lit(0.5))
    found = D.find_by_ids(df, ["doc-2", "none", "doc-1", "doc-2"]).collect()
    assert [(r.id, r.relevance) for r in found] == [("doc-2", 0.0), ("doc-1", 0.0), ("doc-2", 0.0)]
    assert D.find_by_ids(df, []).count() == 0
    gone = D.delete_by_ids(df, ["doc-1", "doc-1", "none"])
    assert gone.deleted == 1 and gone.survivors.count() == 2
    tree = P.normalise(P.equal(STANDARD.string("tenant"), "acme"))
    gone = D.delete_by_filter(df, tree)
    assert gone.deleted == 1 and sorted(r.id for r in gone.survivors.collect()) == ["doc-2", "doc-3"]
    for empty in (None, P.normalise(None)):
        with pytest.raises(E.InvalidArgument):
            D.delete_by_filter(df, empty)


def test_upserts(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    with pytest.raises(E.InvalidArgument):
        t.read()
    t.upsert(spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int"))
    before = t.read()
    t.upsert(spark.createDataFrame([("b", 3), ("c", 4)], "id string, x int"))
    assert sorted(map(tuple, t.read().collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, before.collect())) == [("a", 1), ("b", 2)]
    version = t.version()
    with pytest.raises(Exception, match="key twice"):
        t.upsert(spark.createDataFrame([("d", 1), ("d", 2)], "id string, x int"))
    assert t.version() == version
    with pytest.raises(Exception, match="MissingID"):
        upserted(t.read(), spark.createDataFrame([("", 1)], "id string, x int")).collect()
    schema = SchemaBuilder().int("k").string("s").build()
    raw = spark.createDataFrame([('{"k": 9007199254740993}',), ("{}",), ("null",), (None,)], "j string")
    assert [r[0] and r[0].k for r in raw.select(decoded_attributes(F.col("j"), schema)).collect()] == [9007199254740993, None, None, None]


def test_streamed_upserts(spark, tmp_path):
    rows = "id string, x int, ingested_at int"
    spark.createDataFrame([("a", 1, 1), ("a", 2, 2), (None, 0, 0)], rows).write.parquet(f"{tmp_path}/in", mode="append")
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    for extra in ([], [("a", 0, 0), ("b", 5, 1)]):
        if extra:
            spark.createDataFrame(extra, rows).write.parquet(f"{tmp_path}/in", mode="append")
        q = upsert_stream(record_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], rows).schema), t, f"{tmp_path}/ckpt").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(map(tuple, t.read().collect())) == [("a", 2, 2), ("b", 5, 1)]


def ranked(spark, *lists):
    return R.tagged([spark.createDataFrame([(i, n, c) for n, (i, c) in enumerate(x)], "id string, rank int, content string") for x in lists])


def test_rank_fusion(spark):
    got = R.reciprocal_rank_fusion(ranked(spark, [("a", ""), ("b", ""), ("c", "")], [("b", ""), ("d", "")]), 60).collect()
    assert [(r.id, r.relevance) for r in got] == [("b", 1.0), ("a", 0.5040650406504065), ("d", 0.4959349593495934), ("c", 0.48806297586785385)]
    tie = R.reciprocal_rank_fusion(ranked(spark, [("a", ""), ("b", "")], [("b", ""), ("a", "")]), 60).collect()
    assert [(r.id, r.relevance) for r in tie] == [("a", 1.0), ("b", 1.0)]
    with pytest.raises(E.InvalidArgument):
        R.reciprocal_rank_fusion(ranked(spark, [("a", "")]), 0)
    with pytest.raises(Exception, match="several payloads"):
        R.reciprocal_rank_fusion(ranked(spark, [("a", "x")], [("a", "y")]), 60, payload=["content"], check_payload=True).collect()
    same = R.reciprocal_rank_fusion(ranked(spark, [("a", "x")], [("a", "x")]), 60, payload=["content"], check_payload=True).collect()
    assert same[0].content == "x"


def test_first_lines_are_whole(spark):
    line = "word " * 60
    df = spark.createDataFrame([(f"\n {line}\nrest",), (None,)], "content string")
    got = [r[0] for r in df.select(C.first_line(F.col("content"), F.col("content"))).collect()]
    assert got == [line.strip(), None]


def test_whole_lists_are_ranked_and_fused(spark):
    df = spark.range(0, 5000, 1, 7).select(F.format_string("d%05d", "id").alias("id"), (F.col("id") * 37 % 500).alias("s"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables are sorted in several tasks too
    try:
        placed = R.placed(df, F.desc("s"), F.col("id"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(placed.inputFiles()) > 1
    rows = {r.id: r["rank"] for r in placed.collect()}
    want = sorted(df.collect(), key=lambda r: (-r.s, r.id))
    assert rows == {r.id: n for n, r in enumerate(want)}
    assert R.placed(df.limit(0), F.desc("s"), F.col("id")).count() == 0
    other = R.placed(df, F.asc("s"), F.col("id"))
    fused = R.reciprocal_rank_fusion(R.tagged([placed.select("id", "rank"), other.select("id", "rank")]), 60)
    back = {r.id: n for n, r in enumerate(sorted(want, key=lambda r: (r.s, r.id)))}
    assert {r.id: round(r.score, 12) for r in fused.collect()} == {i: round(1 / (61 + n) + 1 / (61 + back[i]), 12) for i, n in rows.items()}


def test_rerank(spark):
    df = docs(spark, [("a", "one", None), ("b", "two", None)]).coalesce(1)
    got = R.reranked(df, "q", lambda q, t: [(1, 0.9), (0, 0.1)]).collect()
    assert [(r.id, r.relevance) for r in got] == [("b", 0.9), ("a", 0.1)]
    for bad in ([(0, 1.0)], [(0, 1.0), (0, 2.0)], [(0, 1.0), (2, 2.0)]):
        with pytest.raises(E.ProtocolError):
            R.permuted(2, bad)
    with pytest.raises(E.EmptyText):
        R.reranked(df, " ", lambda q, t: [])


CASES = [
    ("aaaa bbbb cccc dddd", C.Sizes(10), ["aaaa bbbb", "cccc", "dddd"]),
    ("one two three four five\n\nshort", C.Sizes(12), ["short", "one two", "three", "four five"]),
    ("abcdefghijklmnop", C.Sizes(6, 2), ["abcdef", "efghij", "ijklmn", "mnop"]),
    ("one two three four", C.Sizes(32, 0, (" ",)), ["one two three four"]),
]


def test_recursive_and_markdown(spark):
    for text, sizes, want in CASES:
        assert C.recursive_parts(text, sizes) == want
    assert C.markdown_sections("a\n# b\nc\n  ## d") == ["a", "# b\nc", "  ## d"]
    df = docs(spark, [("d", CASES[1][0], "t"), ("e", " \n", None), ("", "x", None), ("n", None, None)])
    got = C.chunk_recursive(df, C.Sizes(12)).orderBy("index").collect()
    assert [(r.id, r.content, r.attributes.tenant, r.context) for r in got] == [(f"d_{k}", t, "t", "") for k, t in enumerate(CASES[1][2])]
    assert C.chunk_markdown(docs(spark, [("d", "# a\nb", None)]), C.Sizes(50)).count() == 1
    with pytest.raises(Exception, match="MissingSourceID"):
        C.sources(docs(spark, [("", "x", None)]), strict=True).collect()
    for bad in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(E.InvalidArgument):
            C.Sizes(*bad)


@given(st.text(alphabet="ab \n", max_size=60), st.integers(1, 9), st.integers(0, 3))
@settings(max_examples=150, deadline=None)
def test_parts_fit(text, size, overlap):
    sizes = C.Sizes(size, min(overlap, size - 1))
    parts = C.recursive_parts(text, sizes)
    assert all(len(p) <= size for p in parts)
    if not sizes.overlap:
        assert sorted("".join(parts).replace(" ", "").replace("\n", "")) == sorted(text.replace(" ", "").replace("\n", ""))


def test_fixed_and_sentences(spark):
    df = docs(spark, [("d", "abcdefghijklmnop", None), ("z", "你好。世界", None), ("e", "a...b? ", None)])
    fixed = C.chunk_fixed(df.filter("id = 'd'"), C.Sizes(6, 2)).orderBy("index").collect()
    assert [r.content for r in fixed] == CASES[2][2]
    got = {i: [r.content for r in C.chunk_sentences(df.filter(F.col("id") == i)).orderBy("index").collect()] for i in "ze"}
    assert got == {"z": ["你好。", "世界"], "e": ["a.", ".", ".", "b?"]}


def test_semantic(spark):
    table = {"alpha beta.": [1.0, 0.0], "gamma delta.": [0.0, 1.0]}
    df = docs(spark, [("d", "alpha beta. gamma delta. gamma delta.", None)])
    got = C.chunk_semantic(df, lambda t: [table[x] for x in t], 0.5).orderBy("index").collect()
    assert [r.content for r in got] == ["alpha beta.", "gamma delta. gamma delta."]
    for n, v in ((1, []), (1, [[]]), (2, [[1.0], [1.0, 2.0]]), (1, [[0.0, 0.0]]), (0, [])):
        with pytest.raises(E.ProtocolError):
            C.checked_embeddings(["x"] * n, v)
    x = np.random.default_rng(3).normal(size=(9, 4))
    one = spark.createDataFrame([(x.tolist(),)], "v array<array<double>>")
    for least in (1, 2, 3):
        assert one.select(C.semantic_groups(F.col("v"), 0.2, least)).first()[0] == C.groups_of(x, 0.2, least)


def test_context(spark):
    df = docs(spark, [("d", "one two three four", "t")])
    chunks = C.chunk_recursive(df, C.Sizes(32, 0, (" ",)))
    got = C.with_context(chunks, df, lambda source, own: F.lit("derived")).collect()
    assert [(r.context, r.content) for r in got] == [("derived", "one two three four")]
    alone = chunks.withColumn("source_id", F.lit("gone")).withColumn("context", F.lit("own"))
    assert [r.context for r in C.with_context(alone, df, lambda source, own: F.lit("derived")).collect()] == ["own"]
    assert [r["index"] for r in C.in_order(C.chunk_recursive(df, C.Sizes(5, 0, (" ",)))).collect()] == [0, 1, 2, 3]


def graph(spark):
    nodes = [(f"n{k}", ["Doc"], "", (t, 0.0), k) for k, t in ((1, "acme"), (2, "acme"), (3, "globex"))]
    edges = [(f"e{a}{b}", f"n{a}", f"n{b}", "LINKS", (k,), n) for n, (a, b, k) in enumerate([(1, 2, "keep"), (2, 3, "drop"), (3, 1, "keep")])]
    return G.Graph(
        spark.createDataFrame(nodes, "id string, labels array<string>, content string, attributes struct<tenant:string,weight:double>, _ord long"),
        spark.createDataFrame(edges, "id string, source_id string, target_id string, type string, attributes struct<kind:string>, _ord long"),
    )


def test_traversal(spark):
    g = graph(spark)
    schema = G.GraphSchema(SchemaBuilder().string("tenant").float("weight").build(), SchemaBuilder().string("kind").build())
    acme, keep = P.normalise(P.equal(schema.nodes.string("tenant"), "acme")), P.normalise(P.equal(schema.edges.string("kind"), "keep"))
    for request, nodes, edges in (
        (G.Traversal(["n1"]), "n1 n2", "e12"),
        (G.Traversal(["n1"], "inbound"), "n1 n3", "e31"),
        (G.Traversal(["n1", "n1", "gone"], "undirected", 2, acme, keep), "n1 n2", "e12"),
        (G.Traversal(["n1"], "undirected", 2, page=Page(1, 1)), "n2", ""),
        (G.Traversal(["n1"], "outbound", 5), "n1 n2 n3", "e12 e23 e31"),
        (G.Traversal(["n1"], "outbound", 2, acme), "n1 n2", "e12"),
    ):
        out = G.traverse(g, request, schema)
        assert " ".join(sorted(r.id for r in out.nodes.collect())) == nodes
        assert " ".join(sorted(r.id for r in out.edges.collect())) == edges
    for bad in (dict(seeds=[]), dict(seeds=["a"], depth=0), dict(seeds=["a"], direction="up")):
        with pytest.raises(E.InvalidArgument):
            G.Traversal(**bad)


def test_graph_upserts(spark):
    g = graph(spark)
    with pytest.raises(E.InvalidGraph):
        G.upsert(g, G.Graph(g.nodes.limit(0), g.edges))
    with pytest.raises(E.InvalidGraph):
        G.checked(G.Graph(g.nodes.unionByName(g.nodes), g.edges))
    new = G.Graph(g.nodes.filter("id = 'n1'").withColumn("content", F.lit("new")).unionByName(g.nodes.filter("id = 'n2'").withColumn("id", F.lit("n9"))), g.edges.limit(0))
    out = G.upsert(g, new)
    rows = {r.id: (r.content, r._ord) for r in out.nodes.collect()}
    assert rows["n1"] == ("new", 1) and rows["n9"][1] > 3 and len(rows) == 4 and out.edges.count() == 3
    with pytest.raises(Exception, match="dangling"):
        G.guarded_edges(G.Graph(g.nodes.filter("id != 'n3'"), g.edges)).edges.collect()


def test_store_facades(spark, tmp_path):
    store = DocumentStore(spark, f"file://{tmp_path}/d", "docs", STANDARD)
    store.upsert([{"id": "a", "content": "red fox", "attributes": {"tenant": "acme", "age": 7.0}, "vector": [1.0, 0.0]}, {"id": "b", "content": "dog", "vector": [0.0, 1.0]}])
    assert [r.id for r in store.search([1.0, 0.0], page=Page(1)).collect()] == ["a"] and store.schema is STANDARD
    assert store.lexical(["content"]).search("fox", page=Page(3)).first().id == "a"
    for bad in ([{"id": "c", "content": "x", "attributes": {"other": 1}, "vector": [1.0]}], [{"id": "", "content": "x", "vector": [1.0]}], [{"id": "c", "content": "x", "vector": []}], [{"id": "c", "vector": [1.0]}, {"id": "c", "vector": [2.0]}]):
        with pytest.raises(E.EngineError):
            store.upsert(bad)
    assert store.find_by_ids(["b", "c"]).count() == 1
    assert store.delete_by_filter(P.normalise(P.equal(STANDARD.string("tenant"), "acme"))) == 1 and store.delete_by_ids(["a", "b"]) == 1
    assert store.upsert([]) == 0 and store.delete_by_ids([]) == 0
    with pytest.raises(E.InvalidArgument):
        DocumentStore(spark, "x", "bad-name", STANDARD)
    with pytest.raises(E.InvalidArgument):
        DocumentStore(spark, "x", "docs", Schema())
    graph_store = GraphStore(spark, f"file://{tmp_path}/g", G.GraphSchema(SchemaBuilder().string("tenant").float("weight").build(), SchemaBuilder().string("kind").build()))
    graph_store.upsert(graph(spark))
    graph_store.upsert(graph(spark))
    out = graph_store.traverse(G.Traversal(["n1"], "outbound", 2))
    assert out.nodes.count() == 3 and out.edges.count() == 2
    base, g = graph_store.tables.number(), graph(spark)
    with pytest.raises(Exception, match="kind is not string"):
        graph_store.upsert(G.Graph(g.nodes, g.edges.withColumn("attributes", F.struct(F.lit(True).alias("kind")))))
    with pytest.raises(Exception, match="is not declared"):
        graph_store.upsert(G.Graph(g.nodes.withColumn("attributes", F.struct(F.lit("x").alias("other"))), g.edges))
    assert graph_store.tables.number() == base == 2
    with pytest.raises(E.Unavailable):  # a writer that began with version 1 comes too late
        graph_store.tables.commit({"nodes": g.nodes, "edges": g.edges}, 1)
    assert graph_store.tables.vacuum(1) == 1 and graph_store.read().nodes.count() == 3
    with pytest.raises(E.InvalidGraph):
        G.traverse(G.Graph(g.nodes.filter("id != 'n2'"), g.edges), G.Traversal(["n1"]))


def test_frames_are_checked_before_they_are_stored(spark, tmp_path):
    store = DocumentStore(spark, f"file://{tmp_path}/d", "docs", STANDARD)
    rows = spark.createDataFrame([("a", "x", [1.0]), ("b", "y", [2.0])], "id string, content string, vector array<float>")
    good = rows.withColumn("attributes", F.struct(F.lit(7.0).alias("age"), F.lit(1).alias("score")))
    assert store.upsert(good) == 2 and store.read().filter("attributes.age = 7 AND attributes.score = 1.0").count() == 2
    for bad, message in ((rows.withColumn("attributes", F.struct(F.lit("old").alias("age"))), "age is not int"), (good.withColumn("id", F.lit("")), "MissingID"), (good.withColumn("vector", F.array().cast("array<float>")), "EmptyVector"), (rows.withColumn("attributes", F.struct(F.lit(1).alias("other"))), "is not declared"), (good.withColumn("id", F.lit("a")), "key twice")):
        with pytest.raises(Exception, match=message):
            store.upsert(bad)
    assert store.table.number() == 1


def test_json_attributes_are_checked(spark):
    schema = SchemaBuilder().int("k").string("s").float("x").bool("b").build()
    cases = {'{"k": 1, "s": "a", "x": 2, "b": true}': None, '{"k": 2.0}': None, "{}": None, " ": None, "null": None, '{"k": null}': None, '{"k": 1.5}': "k is not int", '{"k": "1"}': "k is not int", '{"s": 1}': "s is not string", '{"b": 1}': "b is not bool", '{"y": 1}': "undeclared", '{"k"': "malformed", "[1]": "malformed"}
    raw = spark.createDataFrame([(j,) for j in cases], "j string")
    assert {r.j: r.p for r in raw.select("j", attribute_problem(F.col("j"), schema).alias("p")).collect()} == cases
    got = {r.j: r.a and tuple(r.a) for r in raw.select("j", decoded_attributes(F.col("j"), schema, strict=False).alias("a")).collect()}
    assert got['{"k": 1, "s": "a", "x": 2, "b": true}'] == (1, "a", 2.0, True) and got['{"k": 2.0}'] == (2, None, None, None) and got["{}"] is None
    with pytest.raises(Exception, match="undeclared"):
        raw.filter("j LIKE '%y%'").select(decoded_attributes(F.col("j"), schema)).collect()


def test_providers():
    seen = []

    def transport(url, headers, body):
        seen.append((url, headers, body))
        return 200, json.dumps({"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}).encode()

    p = M.Provider("openai", "dense", "k", "m", "https://api.example.org/v1/", transport)
    assert p.embed(["a", "b"]) == [[1.0], [2.0]] and seen[0][0] == "https://api.example.org/v1/embeddings" and seen[0][1]["Authorization"] == "Bearer k"
    with pytest.raises(E.EmptyText):
        p.embed(["a", " "])
    with pytest.raises(E.InvalidArgument):
        M.Provider("openai", "dense", " ", "m", "u", transport)
    for status, kind in ((429, E.Unavailable), (503, E.Unavailable), (404, E.InvalidArgument), (302, E.ProtocolError)):
        with pytest.raises(kind):
            M.Provider("jina", "dense", "k", "m", "https://x", lambda *a, s=status: (s, b"no")).embed(["a"])
    for body in (b"{", b'{"data": []}', b'{"data": [{"index": 0}]}', b'{"data": [{"index": 0, "embedding": []}]}'):
        with pytest.raises(E.ProtocolError):
            M.Provider("jina", "dense", "k", "m", "https://x", lambda *a, b=body: (200, b)).embed(["a"])

    def broken(*a):
        raise ConnectionError("down")

    with pytest.raises(E.Unavailable):
        M.Provider("gemini", "dense", "k", "m", "https://x", broken).embed(["a"])
    with pytest.raises(E.EmptyText):
        M.Provider("jina", "dense", "k", "m", transport=transport).embed([])
    assert M.Provider("jina", "dense", "k", "m", transport=transport).base_url == "https://api.jina.ai/v1"
    with pytest.raises(E.InvalidArgument):
        M.Provider("gemini", "multimodal", "k", "m", transport=broken).embed([[{"kind": "text", "text": " "}]])
    rerank = M.Provider("cohere", "rerank", "k", "m", "https://x", lambda *a: (200, b'{"results": [{"index": 0, "relevance_score": 0.5}]}'))
    assert rerank.rerank("q", ["a"]) == [(0, 0.5)] and rerank.rerank("q", []) == []


def test_embedding_columns(spark):
    df = spark.createDataFrame([("1", "a b"), ("2", None), ("3", "")], "id string, content string")
    got = {r.id: r.vector for r in M.embedded(df, M.hashed_embedder(8)).collect()}
    assert got["2"] is None and len(got["1"]) == len(got["3"]) == 8 and abs(sum(x * x for x in got["1"]) - 1) < 1e-6


def test_intermediate_tables_go_on_release(spark):
    kept = stored(spark.range(3))
    folder = kept.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert kept.count() == 3 and os.path.isdir(folder)
    assert release(spark) >= 1 and not os.path.exists(folder) and release(spark) == 0


def test_resilience_and_traces(spark):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise E.Unavailable("later")
        return 7

    assert retrying(flaky, 5, sleep=lambda s: None)() == 7 and len(calls) == 3
    with pytest.raises(E.InvalidArgument):
        retrying(lambda: (_ for _ in ()).throw(E.InvalidArgument("no")), 3)()

    def down():
        raise E.Unavailable("down")

    assert with_fallback(down, lambda: spark.range(3))().count() == 3
    doubled = map_ordered(spark.range(20), lambda xs: [2 * x for x in xs], "id", "twice", "long", 3)
    assert [r.twice for r in doubled.collect()] == [2 * k for k in range(20)]
    ended = []
    assert traced("dense.search", lambda: 5, spark, lambda *a: ended.append(a))() == 5 and ended == [("dense.search", None)]
    with pytest.raises(E.EmptyText):
        traced("ranking.merge", lambda: (_ for _ in ()).throw(E.EmptyText("x")), spark)()
    with pytest.raises(E.InvalidArgument):
        traced("other", lambda: 1)
    assert isinstance(E.classified(ValueError("x")), E.Unavailable) and isinstance(E.classified(E.Cancelled("x")), E.Cancelled)
