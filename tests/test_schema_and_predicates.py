from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella import predicate as P
from tessella.errors import InvalidArgument, InvalidPage
from tessella.model import Page, clamped, logistic
from tessella.schema import STANDARD, Schema, SchemaBuilder, checked_name, empty_schema, normalised

X = STANDARD.int("age")


def test_names_and_declarations():
    for bad in ("bad-field", "1bad", "id", "content", "type", "source_id", "target_id", "a\n"):
        with pytest.raises(InvalidArgument):
            SchemaBuilder().string(bad)
    with pytest.raises(InvalidArgument):
        SchemaBuilder().string("tenant").int("tenant")
    builder = SchemaBuilder().string("tenant")
    built = builder.build()
    builder.int("late")
    assert built.lookup("late") is None and built.lookup("tenant").kind == "string"
    assert checked_name("my-index_1", "index") and checked_name("My-Set", "collection")
    for bad, policy in (("Upper", "index"), ("1x", "collection"), ("a-b", "sql"), ("x\n", "index")):
        with pytest.raises(InvalidArgument):
            checked_name(bad, policy)


def test_attributes():
    assert normalised({"age": np.int32(42), "score": np.float32(1.5)}) == {"age": 42, "score": 1.5}
    assert normalised({}) is None and normalised(None) is None
    for bad in ([1], {"a": 1}, None, np.uint8(3), object(), float("nan"), math.inf, 1 << 63):
        with pytest.raises(InvalidArgument):
            normalised({"x": bad})
    with pytest.raises(InvalidArgument):
        normalised({"bad-field": 1})
    assert STANDARD.normalise({"age": 7.0, "score": 3}) == {"age": 7, "score": 3.0}
    for bad in ({"age": 1e20}, {"age": 1.5}, {"age": "old"}, {"other": 1}, {"active": 1}):
        with pytest.raises(InvalidArgument):
            STANDARD.normalise(bad)
    with pytest.raises(InvalidArgument):
        Schema().normalise({})


def test_coerced_columns(spark):
    df = spark.createDataFrame([(1.0, 2), (None, None)], "a double, b int")
    schema = SchemaBuilder().int("a").float("b").string("c").build()
    out = df.select(schema.coerced({"a": (F.col("a"), T.DoubleType()), "b": (F.col("b"), T.IntegerType())}).alias("x")).collect()
    assert out[0].x.a == 1 and out[0].x.b == 2.0 and out[0].x.c is None and out[1].x is None
    bad = spark.createDataFrame([(1.5,)], "a double")
    with pytest.raises(Exception, match="InvalidArgument"):
        bad.select(schema.coerced({"a": (F.col("a"), T.DoubleType())}).alias("x")).collect()


def test_invalid_predicates():
    for make in (lambda: P.one_of(X), lambda: P.normalise(P.all_of()), lambda: P.normalise(P.any_of(None)), lambda: P.normalise(P.inverse(None)), lambda: P.equal(STANDARD.float("score"), float("nan")), lambda: P.greater(STANDARD.float("score"), math.inf), lambda: P.normalise(P.greater(STANDARD.string("tenant"), "a")), lambda: P.normalise(P.less(STANDARD.bool("active"), True)), lambda: P.one_of(X, 1, "a"), lambda: P.equal(X, True), lambda: P.equal(X, 1.5)):
        with pytest.raises(InvalidArgument):
            make()
    with pytest.raises(InvalidArgument):
        P.bind(P.equal(SchemaBuilder().string("other").build().string("other"), "x"), STANDARD)
    with pytest.raises(InvalidArgument):
        P.bind(None, Schema())
    assert P.is_empty(P.bind(None, empty_schema()))


def test_normal_form_and_lowerings():
    t = P.equal(STANDARD.string("tenant"), "acme")
    tree = P.normalise(P.all_of(t, P.all_of(P.greater(X, 1), P.any_of(t))))
    assert [type(m).__name__ for m in tree.members] == ["Leaf", "Leaf", "Group"]
    assert P.as_sql(t, 2) == ("attributes->>'tenant' = $2", ["acme"])
    assert P.as_sql(P.normalise(P.inverse(P.greater(X, 3))))[0] == "NOT ((attributes->>'age')::bigint > $1)"
    assert P.as_sql(P.EVERYTHING) == ("TRUE", [])
    assert P.as_query_dsl(P.not_equal(X, 3)) == {"bool": {"must_not": [{"term": {"age": 3}}]}}
    assert P.as_query_dsl(P.any_of(t))["bool"]["minimum_should_match"] == 1
    assert P.as_conditions(P.greater(X, 1)) == {"range": {"field": "age", "gt": 1}}
    seen = []
    P.walk(tree, leaf=lambda x: seen.append(x.name), enter=lambda g: seen.append("("), leave=lambda g: seen.append(")"))
    assert seen == ["(", "tenant", "age", "(", "tenant", ")", ")"]


_leaves = st.one_of(
    st.builds(lambda f, v: f(X, v), st.sampled_from([P.equal, P.not_equal, P.greater, P.greater_or_equal, P.less, P.less_or_equal]), st.integers(0, 3)),
    st.builds(lambda v: P.one_of(STANDARD.string("tenant"), *v), st.lists(st.sampled_from("abc"), min_size=1, max_size=2)),
    st.builds(lambda f, v: f(STANDARD.bool("active"), v), st.sampled_from([P.equal, P.not_equal]), st.booleans()),
)
_trees = st.recursive(_leaves, lambda x: st.one_of(st.builds(P.inverse, x), st.builds(lambda m: P.all_of(*m), st.lists(x, min_size=1, max_size=3)), st.builds(lambda m: P.any_of(*m), st.lists(x, min_size=1, max_size=3))), max_leaves=6)


@given(st.lists(_trees, min_size=20, max_size=20))
@settings(max_examples=4, deadline=None)
def test_compiled_filters_agree_with_rows(spark, trees):
    rows = [(n, (a, b, None, c)) for n, (a, b, c) in enumerate([(a, b, c) for a in ("a", "b", None) for b in (0, 2, None) for c in (True, False, None)])]
    df = spark.createDataFrame(rows, "id int, attributes struct<tenant:string,age:bigint,score:double,active:boolean>")
    trees = [P.normalise(t) for t in trees]
    got = df.select("id", *[P.compiled(t).alias(f"t{k}") for k, t in enumerate(trees)]).collect()
    for r in got:
        own = dict(zip(("tenant", "age", "score", "active"), rows[r.id][1]))
        assert [bool(r[f"t{k}"]) for k in range(len(trees))] == [P.matches(t, own) for t in trees]


def test_filters_reach_the_scan(spark, tmp_path):
    df = spark.createDataFrame([("1", ("a", 1))], "id string, attributes struct<tenant:string,age:bigint>")
    df.write.parquet(str(tmp_path / "t"))
    tree = P.normalise(P.inverse(P.any_of(P.equal(STANDARD.string("tenant"), "x"), P.greater(X, 3))))
    plan = spark.read.parquet(str(tmp_path / "t")).filter(P.compiled(tree)).select("id")._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: ")[1].split("]")[0]
    assert "tenant" in pushed and "age" in pushed


def test_pages_and_relevance(spark):
    for bad in ((0, 0), (-1, 0), (1, -1), (True, 0), ("1", 0)):
        with pytest.raises(InvalidPage):
            Page(*bad)
    rows = [r.c for r in spark.createDataFrame([(2.0,), (-1.0,), (0.5,), (None,), (float("nan"),)], "x double").select(clamped(F.col("x")).alias("c")).collect()]
    assert rows[:4] == [1.0, 0.0, 0.5, None] and math.isnan(rows[4])
    big = spark.createDataFrame([(0.0,), (99.0,)], "x double").select(logistic(F.col("x")).alias("c")).collect()
    assert big[0].c == 0.5 and abs(big[1].c - 0.9999999979388463) < 1e-15
