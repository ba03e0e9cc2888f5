"""The registered queries of the engine's own operators, each with SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import predicate as P
from tessella.model import PART_TYPE, Page, clamped, trimmed, valid_chunks, valid_documents, valid_input
from tessella.operators import chunking, graphs, ranking, search, stores
from tessella.operators.embedding import embedded, hashed_embedder
from tessella.runtime import latest
from tessella.schema import STANDARD, SchemaBuilder
from tessella.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_TENANT, _AGE, _SCORE, _ACTIVE = STANDARD.string("tenant"), STANDARD.int("age"), STANDARD.float("score"), STANDARD.bool("active")

# Repeated rows carry the same payload, so DISTINCT is one row per key.
_DOCS = "docs AS (SELECT DISTINCT id, content, attributes, relevance FROM docstore WHERE id IS NOT NULL)"
_CHUNKS = "cs AS (SELECT DISTINCT id, source_id, index, content, context, attributes FROM chunks WHERE id IS NOT NULL)"
_DENSE = "ds AS (SELECT DISTINCT id, content, attributes, vector FROM dense WHERE id IS NOT NULL)"
_LISTS = "ls AS (SELECT DISTINCT query_id, list_no, id, rank, content, attributes FROM ranked)"
#: The record whose vector is the query of the single-vector searches.
PROBE = "vec-000000007"
# Java's and DuckDB's \s differ; the trim of texts is spelled out for both.
_TRIM = "regexp_replace(regexp_replace({0}, '^[\\t-\\r \\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ''), '[\\t-\\r \\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+$', '')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def _filter_query(name: str, tree: object, where: str, nulls: str = "two_valued") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # The filter comes before the removal of repeated rows, so it reaches the scan.
        rows = search.filtered(tables.table(spark, sf_dir, "docstore"), search.Request(tree, nulls=nulls))
        return rows.filter("id IS NOT NULL").select("id").distinct()

    _QUERIES[name], _SQL[name] = run, f"SELECT DISTINCT id FROM docstore WHERE id IS NOT NULL AND ({where})"


_tenants = ("goringatt", "oskuskdor", "kelvickn")
_a = {k: f"attributes.{k}" for k in ("tenant", "age", "score", "active")}
_filter_query("filter_eq", P.normalise(P.equal(_TENANT, "goringatt")), f"{_a['tenant']} = 'goringatt'")
_filter_query("filter_neq_missing", P.normalise(P.not_equal(_TENANT, "goringatt")), f"{_a['tenant']} IS DISTINCT FROM 'goringatt'")
_filter_query("filter_gt", P.normalise(P.greater(_AGE, 300)), f"{_a['age']} > 300")
_filter_query("filter_gte", P.normalise(P.greater_or_equal(_AGE, 300)), f"{_a['age']} >= 300")
_filter_query("filter_lt", P.normalise(P.less(_SCORE, 0.25)), f"{_a['score']} < 0.25")
_filter_query("filter_lte", P.normalise(P.less_or_equal(_SCORE, 0.25)), f"{_a['score']} <= 0.25")
_filter_query("filter_in", P.normalise(P.one_of(_TENANT, *_tenants)), f"{_a['tenant']} IN {_tenants}")
_filter_query("filter_and", P.normalise(P.all_of(P.equal(_ACTIVE, True), P.all_of(P.greater(_SCORE, 0.5), P.less(_AGE, 500)))), f"{_a['active']} AND {_a['score']} > 0.5 AND {_a['age']} < 500")
_filter_query("filter_or", P.normalise(P.any_of(P.equal(_ACTIVE, True), P.greater(_AGE, 600))), f"{_a['active']} = true OR {_a['age']} > 600")
_filter_query("filter_not_missing", P.normalise(P.inverse(P.greater(_AGE, 100))), f"NOT coalesce({_a['age']} > 100, false)")
_filter_query(
    "filter_nested",
    P.normalise(P.inverse(P.any_of(P.one_of(_TENANT, *_tenants), P.all_of(P.equal(_ACTIVE, False), P.inverse(P.less(_SCORE, 0.5)))))),
    f"NOT (coalesce({_a['tenant']} IN {_tenants}, false) OR (coalesce({_a['active']} = false, false) AND NOT coalesce({_a['score']} < 0.5, false)))",
)
_filter_query("filter_sql_nulls", P.normalise(P.inverse(P.equal(_TENANT, "goringatt"))), f"NOT ({_a['tenant']} = 'goringatt')", "sql")
_filter_query("filter_empty", P.normalise(None), "TRUE")


@query(f"WITH {_DOCS} SELECT id, content, attributes.tenant AS tenant, attributes.age AS age, round(relevance, 6) AS relevance FROM docs WHERE relevance IS NULL OR relevance BETWEEN 0 AND 1")
def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = valid_documents(tables.documents(spark, sf_dir))
    return docs.select("id", "content", "attributes.tenant", "attributes.age", F.round("relevance", 6).alias("relevance"))


@query(f"WITH {_CHUNKS} SELECT id, source_id, index, content FROM cs WHERE source_id <> '' AND index >= 0")
def normalize_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_chunks(tables.chunks(spark, sf_dir)).select("id", "source_id", "index", "content")


@query("WITH ls AS (SELECT DISTINCT query_id, list_no, id, content, relevance FROM ranked WHERE content IS NOT NULL) SELECT query_id, list_no, id, round(CASE WHEN relevance IS NOT NULL THEN greatest(0, least(1, relevance)) END, 6) AS relevance FROM ls")
def project_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = tables.ranked(spark, sf_dir, "content", "relevance").filter("content IS NOT NULL")
    return hits.select("query_id", "list_no", "id", F.round(clamped(F.col("relevance")), 6).alias("relevance"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = SchemaBuilder().int("k").build()
    rows = tables.table(spark, sf_dir, "events").select("event_id", tables.decoded_attributes(F.col("props"), schema).alias("a"))
    return rows.filter("a IS NOT NULL").select("event_id", F.col("a.k").alias("k"))


def _probe(spark: SparkSession, sf_dir: str) -> list[float]:
    row = tables.table(spark, sf_dir, "dense").filter((F.col("id") >= PROBE) & (F.size("vector") == 64)).select("id", "vector").orderBy("id").first()
    return list(row["vector"])


def _nearest_sql(where: str, tail: str, relevance: str = "1 / (1 + d)") -> str:
    probe = f"probe AS (SELECT vector FROM ds WHERE id >= '{PROBE}' AND len(vector) = 64 ORDER BY id LIMIT 1)"
    zero = "list_aggregate(list_transform({0}, lambda x: abs(x)), 'max') = 0"
    d = f"round(1 - CASE WHEN {zero.format('ds.vector')} THEN 0 ELSE list_cosine_similarity(ds.vector::DOUBLE[], probe.vector::DOUBLE[]) END, 9)"
    near = f"near AS (SELECT id, {d} AS d FROM ds, probe WHERE len(ds.vector) = 64 AND ({where}))"
    return f"WITH {_DENSE}, {probe}, {near} SELECT id, round({relevance}, 6) AS relevance FROM near ORDER BY d, id {tail}"


def _dense(spark: SparkSession, sf_dir: str, request: search.Request, relevance: str = "inverse") -> DataFrame:
    # Repeated rows agree, so the filter comes before their removal, and only vectors are carried.
    rows = search.filtered(tables.table(spark, sf_dir, "dense").filter("id IS NOT NULL"), request)
    found = search.dense_search(latest(rows, ["id"], ["vector"]), _probe(spark, sf_dir), search.Request(page=request.page), relevance, content=False)
    return found.select("id", F.round("relevance", 6).alias("relevance"))


@query(_nearest_sql("true", "LIMIT 10"))
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, search.Request(page=Page(10)))


@query(_nearest_sql("ds.attributes.active AND ds.attributes.age > 100", "LIMIT 10"))
def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = P.normalise(P.all_of(P.equal(_ACTIVE, True), P.greater(_AGE, 100)))
    return _dense(spark, sf_dir, search.Request(tree, Page(10)))


@query(_nearest_sql("true", "LIMIT 5 OFFSET 7"))
def dense_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, search.Request(page=Page(5, 7)))


@query(_nearest_sql("true", "LIMIT 10", "1 / (1 + exp(-(1 - d)))"))
def dense_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, search.Request(page=Page(10)), "logistic")


@query(_nearest_sql("true", ""))
def dense_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, search.Request())


@query(
    """WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0), v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    r AS (SELECT q.vec_id AS query_id, CAST(v.vec_id AS VARCHAR) AS id, round(1 - list_cosine_similarity(v.e, q.e), 9) AS d FROM q, v),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) - 1 AS position FROM r) SELECT query_id, id, round(d, 6) AS distance, position FROM n WHERE position < 10"""
)
def dense_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.col("vec_id").alias("query_id"))
    found = search.dense_search_many(rows.select("id", "vector"), rows.filter("query_id % 20 = 0").select("query_id", "vector"), 10)
    return found.select("query_id", "id", F.round("distance", 6).alias("distance"), F.col("position").cast("long").alias("position"))


@query(
    """WITH p AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 7), v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    t AS (SELECT vec_id, (SELECT sum((SELECT max(list_inner_product(v.e[j * 16 + 1 : j * 16 + 16], p.e[i * 16 + 1 : i * 16 + 16])) FROM range(4) AS b(j))) FROM range(4) AS a(i), p) AS s FROM v)
    SELECT CAST(vec_id AS VARCHAR) AS id, round(s, 5) AS score FROM t ORDER BY round(s, 9) DESC, id LIMIT 20"""
)
def tensor_maxsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "embeddings")
    probe = rows.filter("vec_id = 7").select("embedding").first()[0]
    tensor = [list(probe[k : k + 16]) for k in range(0, 64, 16)]
    records = rows.select(F.col("vec_id").cast("string").alias("id"), search.as_tensor(F.col("embedding"), 4, 16).alias("tensor"))
    found = search.tensor_search(records, tensor, search.Request(page=Page(20)))
    return found.select("id", F.round("score", 5).alias("score"))


_BM25 = "the tenant router rejects rows"
_BM25_SQL = f"""WITH {_DOCS}, w AS (SELECT id, attributes, regexp_extract_all(lower(coalesce(content, '')), '[\\p{{L}}\\p{{N}}]+') AS words FROM docs),
    n AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM w), q AS (SELECT unnest({_BM25.split()}) AS term),
    tf AS (SELECT id, attributes, term, len(words) AS dl, len(list_filter(words, lambda x: x = term)) AS f FROM w, q),
    df AS (SELECT term, count(*) FILTER (f > 0) AS df FROM tf GROUP BY term),
    s AS (SELECT id, any_value(attributes) AS attributes, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM tf JOIN df USING (term), n GROUP BY id)"""


@query(_BM25_SQL + " SELECT id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, id LIMIT 25")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(tables.documents(spark, sf_dir), _BM25, request=search.Request(page=Page(25))).select("id", F.round("score", 6).alias("score"))


@query(_BM25_SQL + " SELECT id, round(score, 6) AS score FROM s WHERE score > 0 AND attributes.active ORDER BY s.score DESC, id LIMIT 10 OFFSET 5")
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = search.Request(P.normalise(P.equal(_ACTIVE, True)), Page(10, 5))
    return search.bm25(tables.documents(spark, sf_dir), _BM25, request=request).select("id", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_LISTS}, s AS (SELECT query_id, id, sum(1.0 / (60 + rank + 1)) AS score FROM ls GROUP BY query_id, id),
    m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM s) SELECT query_id, id, round(score / top, 6) AS relevance FROM m"""
)
def rrf_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = ranking.reciprocal_rank_fusion(tables.ranked(spark, sf_dir, "rank"), 60, by=["query_id"])
    return merged.select("query_id", "id", F.round("relevance", 6).alias("relevance"))


@query(
    f"""WITH {_LISTS}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY list_no, rank) AS k FROM ls)
    SELECT query_id, id, content, attributes.tenant AS tenant FROM p WHERE k = 1"""
)
def rrf_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = ranking.reciprocal_rank_fusion(tables.ranked(spark, sf_dir), 60, by=["query_id"], payload=["content", "attributes"])
    return merged.select("query_id", "id", "content", "attributes.tenant")


@query(
    f"""WITH {_DOCS}, l AS (SELECT id, row_number() OVER (ORDER BY relevance DESC, id) - 1 AS rank FROM docs WHERE relevance IS NOT NULL
    UNION ALL SELECT id, row_number() OVER (ORDER BY attributes.score DESC, id) - 1 FROM docs WHERE attributes.score IS NOT NULL),
    s AS (SELECT id, sum(1.0 / (60 + rank + 1)) AS score FROM l GROUP BY id) SELECT id, round(score / (SELECT max(score) FROM s), 6) AS relevance FROM s"""
)
def rrf_two_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scored document of both lists takes part; ranks come from a distributed sort."""
    docs = tables.documents(spark, sf_dir, "relevance", "attributes")

    def ranks(score: str) -> DataFrame:
        return ranking.placed(docs.filter(F.col(score).isNotNull()).select("id", F.col(score).alias("s")), F.desc("s"), F.col("id")).select("id", "rank")

    merged = ranking.reciprocal_rank_fusion(ranking.tagged([ranks("relevance"), ranks("attributes.score")]), 60)
    return merged.select("id", F.round("relevance", 6).alias("relevance"))


@query(
    f"""WITH {_LISTS}, p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY query_id, list_no, rank) AS k FROM ls) SELECT id, query_id, list_no, rank FROM p WHERE k = 1"""
)
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col(c) for c in ("query_id", "list_no", "rank")]
    return search.deduplicated(tables.ranked(spark, sf_dir, "rank"), order).select("id", "query_id", "list_no", "rank")


@query(
    f"""WITH {_DOCS}, w AS (SELECT id, list_distinct(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+')) AS words FROM docs WHERE content IS NOT NULL)
    SELECT id, round(len(list_intersect(words, {_BM25.split()})) / 5.0, 6) AS relevance FROM w"""
)
def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    import re

    def score(query_text: str, texts: list[str]) -> list[tuple[int, float]]:
        terms = set(query_text.split())
        found = [(k, len(terms & set(re.findall(r"[^\W_]+", t.lower()))) / len(terms)) for k, t in enumerate(texts)]
        return found[::-1]  # any order will do: results are put back by index

    docs = tables.documents(spark, sf_dir, "content").filter("content IS NOT NULL")
    return ranking.reranked(docs, _BM25, score).select("id", F.round("relevance", 6).alias("relevance"))


_IDS = [f"doc-{n:09d}" for n in (3, 25, 45, 3, 121, 999999999, 136)]


@query(f"WITH {_DOCS}, want AS (SELECT unnest({_IDS}) AS id, unnest(range({len(_IDS)})) AS position) SELECT position, docs.id, content FROM want JOIN docs ON docs.id = want.id")
def find_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.find_by_ids(tables.documents(spark, sf_dir, "content"), _IDS).select("position", "id", "content")


@query(f"WITH {_DOCS} SELECT id FROM docs WHERE id NOT IN {tuple(sorted(set(_IDS)))}")
def delete_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.delete_by_ids(tables.table(spark, sf_dir, "docstore").filter("id IS NOT NULL").select("id").distinct(), _IDS).survivors.select("id")


@query(f"WITH {_DOCS} SELECT id FROM docs WHERE NOT coalesce(attributes.age > 300, false)")
def delete_by_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.delete_by_filter(tables.documents(spark, sf_dir, "attributes"), P.normalise(P.greater(_AGE, 300))).survivors.select("id")


@query(f"WITH {_DOCS} SELECT count(*) AS deleted FROM docs WHERE attributes.tenant = 'goringatt'")
def delete_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = stores.delete_by_filter(tables.documents(spark, sf_dir, "attributes"), P.normalise(P.equal(_TENANT, "goringatt"))).removed
    return removed.agg(F.countDistinct("id").alias("deleted"))


@query(
    f"""WITH {_DENSE}, new AS (SELECT id, content || ' (new)' AS content FROM ds WHERE attributes.active UNION ALL SELECT 'new-' || id, content FROM ds WHERE attributes.active)
    SELECT id, content FROM ds WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new"""
)
def upsert_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table is there before; the batch is a share of it with new contents, and as many new ids."""
    rows = tables.dense(spark, sf_dir, "content", "attributes")
    chosen = rows.filter("attributes.active").select("id", "content")
    batch = chosen.withColumn("content", F.concat("content", F.lit(" (new)"))).unionByName(chosen.withColumn("id", F.concat(F.lit("new-"), "id")))
    return tables.upserted(rows.select("id", "content"), batch)


_SOLID = f"{_TRIM.format('content')} <> ''"
_SENTENCES = f"list_filter(list_transform(regexp_extract_all(content, '[^.!?。！？]*[.!?。！？]|[^.!?。！？]+$'), lambda x: {_TRIM.format('x')}), lambda x: x <> '')"


@query(f"WITH {_DOCS}, s AS (SELECT id, {_SENTENCES} AS parts FROM docs WHERE {_SOLID}) SELECT id AS source_id, generate_subscripts(parts, 1) - 1 AS index, unnest(parts) AS content FROM s")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_sentences(tables.documents(spark, sf_dir, "content", "attributes")).select("source_id", F.col("index").cast("long").alias("index"), "content")


@query(
    f"""WITH {_DOCS}, t AS (SELECT id, {_TRIM.format('content')} AS content FROM docs WHERE {_SOLID}),
    w AS (SELECT id, unnest(range(greatest(1, CAST(ceil((length(content) - 40) / 360.0) AS BIGINT)))) AS index, content FROM t),
    c AS (SELECT id AS source_id, index, {_TRIM.format('substr(content, CAST(index * 360 + 1 AS BIGINT), 400)')} AS content FROM w) SELECT * FROM c WHERE content <> ''"""
)
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_fixed(tables.documents(spark, sf_dir), chunking.Sizes(400, 40)).select("source_id", F.col("index").cast("long").alias("index"), "content")


def _gathered_sql(separator: str, size: int = 400) -> str:
    """Neighbouring pieces of ``text`` between separators, joined while they fit; one that makes the join too long stands alone."""
    need = f"length(p) + {len(separator)}"
    sep = "chr(10)" if separator == "\n" else "chr(10) || chr(10)" if separator == "\n\n" else f"'{separator}'"
    start = "{'g': CAST([] AS VARCHAR[]), 'room': CAST(-1 AS BIGINT)}"
    step = f"""CASE WHEN s.room >= {need} THEN {{'g': list_append(s.g[1:-2], s.g[-1] || {sep} || p), 'room': s.room - ({need})}}
        WHEN s.room < 0 AND length(p) <= {size} THEN {{'g': list_append(s.g, p), 'room': {size} - length(p)}} ELSE {{'g': list_append(s.g, p), 'room': CAST(-1 AS BIGINT)}} END"""
    pieces = f"list_filter(list_transform(string_split(text, {sep}), lambda x: {_TRIM.format('x')}), lambda x: x <> '')"
    return f"CASE WHEN contains(text, {sep}) THEN list_reduce({pieces}, lambda s, p: {step}, {start}).g ELSE [text] END"


def _recursive_sql(source: str) -> str:
    """Parts of the texts of ``source`` (id, tenant, section, text), generation by generation."""
    gens = f"g0 AS (SELECT id, tenant, section, [0::BIGINT] AS path, {_TRIM.format('text')} AS text FROM {source})"
    for k, separator in enumerate(chunking.SEPARATORS):
        gens += f""", p{k} AS (SELECT id, tenant, section, path, {_gathered_sql(separator)} AS parts FROM g{k} WHERE length(text) > 400),
        g{k + 1} AS (SELECT id, tenant, section, list_append(path, k::BIGINT) AS path, part AS text FROM (SELECT id, tenant, section, path, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM p{k}))"""
    done = " UNION ALL ".join(f"SELECT id, tenant, section, {k} AS level, path, 0 AS w, text FROM g{k} WHERE length(text) BETWEEN 1 AND 400" for k in range(4))
    rest = f"SELECT id, tenant, section, 3, path, w, {_TRIM.format('substr(text, CAST(w * 360 + 1 AS BIGINT), 400)')} FROM (SELECT *, unnest(range(CAST(ceil((length(text) - 400) / 360.0) AS BIGINT) + 1)) AS w FROM g3 WHERE length(text) > 400)"
    return f"""{gens}, parts AS ({done} UNION ALL {rest}), placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY section, level, path, w) - 1 AS index FROM parts)
    SELECT id AS source_id, CAST(index AS INTEGER) AS index, text AS content, tenant FROM placed WHERE text <> ''"""


@query(f"WITH {_DOCS}, t AS (SELECT id, attributes.tenant AS tenant, 0 AS section, content AS text FROM docs WHERE {_SOLID}), {_recursive_sql('t')}")
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_recursive(tables.documents(spark, sf_dir), chunking.Sizes(400, 40)).select("source_id", "index", "content", "attributes.tenant")


@query(
    f"""WITH {_DOCS}, l AS (SELECT id, attributes.tenant AS tenant, string_split(content, chr(10)) AS lines FROM docs WHERE {_SOLID}), e AS (SELECT id, tenant, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM l),
    h AS (SELECT *, sum(CASE WHEN k > 1 AND starts_with({_TRIM.format('line')}, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY k) AS section FROM e),
    t AS (SELECT id, any_value(tenant) AS tenant, section, string_agg(line, chr(10) ORDER BY k) AS text FROM h GROUP BY id, section), {_recursive_sql('t')}"""
)
def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_markdown(tables.documents(spark, sf_dir), chunking.Sizes(400, 40)).select("source_id", "index", "content", "attributes.tenant")


@query()
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir)
    return chunking.chunk_semantic(docs, hashed_embedder(32), 0.2, 2).select("id", "source_id", "index", "content")


@query(
    f"""WITH {_DOCS}, {_CHUNKS}, f AS (SELECT id, content FROM docs) SELECT cs.id, cs.source_id, cs.index, cs.content, CASE WHEN f.id IS NOT NULL THEN {_TRIM.format("regexp_extract(" + _TRIM.format('f.content') + ", '^[^\\n\\r]*')")} ELSE cs.context END AS context
    FROM cs LEFT JOIN f ON cs.source_id = f.id"""
)
def chunk_contextual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk's context is the whole first line of its source."""
    out = chunking.with_context(tables.chunks(spark, sf_dir), tables.documents(spark, sf_dir, "content"), chunking.first_line)
    return out.select("id", "source_id", "index", "content", "context")


def _customers(spark: SparkSession, sf_dir: str) -> graphs.Graph:
    """region ← nation ← customer and supplier as a graph of attributed nodes and typed edges."""
    t = lambda name: tables.table(spark, sf_dir, name)

    def nodes(name: str, key: str, label: str, content: str, value: Column) -> DataFrame:
        return t(name).select(F.concat(F.lit(f"{name}-"), F.col(key)).alias("id"), F.array(F.lit(label)).alias("labels"), F.col(content).alias("content"), F.struct(F.lit(label).alias("tenant"), value.cast("double").alias("weight")).alias("attributes"))

    def edges(name: str, key: str, to: str, other: str, kind: str) -> DataFrame:
        ends = [F.concat(F.lit(f"{name}-"), F.col(key)), F.concat(F.lit(f"{to}-"), F.col(other))]
        return t(name).select(F.concat_ws(">", *ends).alias("id"), ends[0].alias("source_id"), ends[1].alias("target_id"), F.lit(kind).alias("type"), F.struct(F.lit(kind).alias("kind")).alias("attributes"))

    all_nodes = nodes("region", "r_regionkey", "Region", "r_name", F.lit(0)).unionByName(nodes("nation", "n_nationkey", "Nation", "n_name", F.lit(0)))
    all_nodes = all_nodes.unionByName(nodes("customer", "c_custkey", "Customer", "c_name", F.col("c_acctbal"))).unionByName(nodes("supplier", "s_suppkey", "Supplier", "s_name", F.col("s_acctbal")))
    all_edges = edges("nation", "n_nationkey", "region", "n_regionkey", "in_region").unionByName(edges("customer", "c_custkey", "nation", "c_nationkey", "buys_in"))
    all_edges = all_edges.unionByName(edges("supplier", "s_suppkey", "nation", "s_nationkey", "sells_in"))
    return graphs.Graph(all_nodes.withColumn("_ord", F.xxhash64("id")), all_edges.withColumn("_ord", F.xxhash64("id")))


_NODE_SCHEMA, _EDGE_SCHEMA = SchemaBuilder().string("tenant").float("weight").build(), SchemaBuilder().string("kind").build()
_GRAPH_SQL = """nodes AS (SELECT 'region-' || r_regionkey AS id, 'Region' AS label, 0.0 AS weight FROM region UNION ALL SELECT 'nation-' || n_nationkey, 'Nation', 0.0 FROM nation
    UNION ALL SELECT 'customer-' || c_custkey, 'Customer', c_acctbal FROM customer UNION ALL SELECT 'supplier-' || s_suppkey, 'Supplier', s_acctbal FROM supplier),
    edges AS (SELECT 'nation-' || n_nationkey AS s, 'region-' || n_regionkey AS t, 'in_region' AS kind FROM nation UNION ALL SELECT 'customer-' || c_custkey, 'nation-' || c_nationkey, 'buys_in' FROM customer
    UNION ALL SELECT 'supplier-' || s_suppkey, 'nation-' || s_nationkey, 'sells_in' FROM supplier)"""


def _both(g: graphs.Graph) -> DataFrame:
    return g.nodes.select(F.lit("node").alias("what"), "id").unionByName(g.edges.select(F.lit("edge").alias("what"), "id"))


@query(f"WITH {_GRAPH_SQL} SELECT 'node' AS what, 'nation-3' AS id UNION ALL SELECT 'node', t FROM edges WHERE s = 'nation-3' UNION ALL SELECT 'edge', s || '>' || t FROM edges WHERE s = 'nation-3'")
def graph_out_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(graphs.traverse(_customers(spark, sf_dir), graphs.Traversal(["nation-3", "nation-3", "unknown"])))


@query(
    f"""WITH {_GRAPH_SQL}, one AS (SELECT s AS id FROM edges WHERE t = 'region-1'), two AS (SELECT s AS id FROM edges WHERE t IN (SELECT id FROM one)), v AS (SELECT 'region-1' AS id UNION SELECT id FROM one UNION SELECT id FROM two)
    SELECT 'node' AS what, id FROM v UNION ALL SELECT 'edge', s || '>' || t FROM edges WHERE s IN (SELECT id FROM v) AND t IN (SELECT id FROM v)"""
)
def graph_in_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(graphs.traverse(_customers(spark, sf_dir), graphs.Traversal(["region-1"], "inbound", 2)))


@query(
    f"""WITH {_GRAPH_SQL}, b AS (SELECT s, t FROM edges UNION SELECT t, s FROM edges), one AS (SELECT t AS id FROM b WHERE s = 'customer-5'), two AS (SELECT t AS id FROM b WHERE s IN (SELECT id FROM one)),
    v AS (SELECT 'customer-5' AS id UNION SELECT id FROM one UNION SELECT id FROM two) SELECT 'node' AS what, id FROM v UNION ALL SELECT 'edge', s || '>' || t FROM edges WHERE s IN (SELECT id FROM v) AND t IN (SELECT id FROM v)"""
)
def graph_undirected_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(graphs.traverse(_customers(spark, sf_dir), graphs.Traversal(["customer-5"], "undirected", 2)))


@query(
    f"""WITH {_GRAPH_SQL}, e AS (SELECT * FROM edges WHERE kind <> 'sells_in'), one AS (SELECT s AS id FROM e WHERE t = 'region-2'), two AS (SELECT s AS id FROM e WHERE t IN (SELECT id FROM one)),
    v AS (SELECT 'region-2' AS id UNION SELECT id FROM one UNION SELECT id FROM two), k AS (SELECT id FROM nodes WHERE id IN (SELECT id FROM v) AND label = 'Customer' AND weight > 1000)
    SELECT 'node' AS what, id FROM k UNION ALL SELECT 'edge', s || '>' || t FROM e WHERE s IN (SELECT id FROM k) AND t IN (SELECT id FROM k)"""
)
def graph_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = P.normalise(P.all_of(P.equal(_NODE_SCHEMA.string("tenant"), "Customer"), P.greater(_NODE_SCHEMA.float("weight"), 1000)))
    edge = P.normalise(P.not_equal(_EDGE_SCHEMA.string("kind"), "sells_in"))
    request = graphs.Traversal(["region-2"], "inbound", 2, node, edge)
    return _both(graphs.traverse(_customers(spark, sf_dir), request, graphs.GraphSchema(_NODE_SCHEMA, _EDGE_SCHEMA)))


@query(
    f"""WITH {_GRAPH_SQL}, one AS (SELECT s AS id FROM edges WHERE t = 'region-0' UNION SELECT 'region-0'), k AS (SELECT id FROM one ORDER BY length(id) DESC, id DESC LIMIT 3 OFFSET 1)
    SELECT 'node' AS what, id FROM k UNION ALL SELECT 'edge', s || '>' || t FROM edges WHERE s IN (SELECT id FROM k) AND t IN (SELECT id FROM k)"""
)
def graph_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _customers(spark, sf_dir)
    # Inserted with the longest ids first, then backwards.
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("long") + F.when(F.col("id").startswith("region"), 1000).otherwise(0)
    first = graphs.Graph(g.nodes.withColumn("_ord", -F.length("id").cast("long") * 1_000_000 - number), g.edges)
    return _both(graphs.traverse(first, graphs.Traversal(["region-0"], "inbound", 1, page=Page(3, 1))))


@query("SELECT 'dangling target_id' AS problem, 'nation-' || n_nationkey || '>region-' || n_regionkey AS id FROM nation WHERE n_regionkey = 4")
def snapshot_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _customers(spark, sf_dir)
    return graphs.violations(graphs.Graph(g.nodes.filter("id != 'region-4'"), g.edges))


@query(
    f"""WITH {_GRAPH_SQL} SELECT 'node' AS what, id, CASE WHEN id LIKE 'region-%' THEN 'REGION' ELSE label END AS label FROM nodes
    UNION ALL SELECT 'edge', s || '>' || t, CASE WHEN kind = 'in_region' THEN 'lies_in' ELSE kind END FROM edges UNION ALL SELECT 'edge', 'region-' || r_regionkey || '>region-0', 'near' FROM region"""
)
def graph_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations again with other labels, the edges between them replaced, and new ones."""
    g = _customers(spark, sf_dir)
    some = g.nodes.filter("id LIKE 'region-%' OR id LIKE 'nation-%'").withColumn("labels", F.when(F.col("id").startswith("region-"), F.array(F.lit("REGION"))).otherwise(F.col("labels")))
    moved = g.edges.filter("attributes.kind = 'in_region'").withColumn("attributes", F.struct(F.lit("lies_in").alias("kind")))
    to = F.lit("region-0")
    near = g.nodes.filter("id LIKE 'region-%'").select(F.concat_ws(">", "id", to).alias("id"), F.col("id").alias("source_id"), to.alias("target_id"), F.lit("near").alias("type"), F.struct(F.lit("near").alias("kind")).alias("attributes"), F.xxhash64("id").alias("_ord"))
    out = graphs.upsert(g, graphs.Graph(some, moved.unionByName(near)), graphs.GraphSchema(_NODE_SCHEMA, _EDGE_SCHEMA))
    return out.nodes.select(F.lit("node").alias("what"), "id", F.col("labels")[0].alias("label")).unionByName(out.edges.select(F.lit("edge").alias("what"), "id", F.col("attributes.kind").alias("label")))


@query(f"WITH {_CHUNKS} SELECT 'node' AS what, id FROM cs UNION ALL SELECT DISTINCT 'node', source_id FROM cs UNION ALL SELECT 'edge', id || '→' || source_id FROM cs")
def graph_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, g = graphs.ingest(tables.chunks(spark, sf_dir), lambda rows: rows, graphs.sequence_graph)
    return _both(g)


@query(f"WITH {_DOCS} SELECT id, content IS NOT NULL AND {_TRIM.format('content')} <> '' AS valid FROM docs")
def multimodal_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.struct(F.lit("text").alias("kind"), F.lit(None).cast("string").alias("mime"), F.col("content").alias("text"), F.lit(None).cast("binary").alias("bytes"), F.lit(None).cast("string").alias("url"))
    raw = F.struct(F.lit("bytes").alias("kind"), F.lit("text/plain").alias("mime"), F.lit(None).cast("string").alias("text"), F.col("id").cast("binary").alias("bytes"), F.lit(None).cast("string").alias("url"))
    link = F.struct(F.lit("url").alias("kind"), F.lit(None).cast("string").alias("mime"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("bytes"), F.concat(F.lit("https://example.org/"), "id").alias("url"))
    parts = F.array(text.cast(PART_TYPE), raw.cast(PART_TYPE), link.cast(PART_TYPE))
    return tables.documents(spark, sf_dir, "content").select("id", valid_input(parts).alias("valid"))


@query(f"WITH {_DOCS} SELECT id, CASE WHEN content IS NULL THEN NULL ELSE 64 END AS dim FROM docs")
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = embedded(tables.documents(spark, sf_dir, "content"), hashed_embedder())
    return docs.select("id", F.when(F.col("content").isNotNull(), F.size("vector")).alias("dim"))


@query(f"WITH {_DOCS} SELECT id, {_TRIM.format('content')} AS content FROM docs")
def trim_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.documents(spark, sf_dir, "content").select("id", trimmed(F.col("content")).alias("content"))


@query("SELECT query_id, list_no, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, list_no, id ORDER BY ingested_at DESC) AS k FROM ranked) WHERE k = 1")
def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(tables.table(spark, sf_dir, "ranked"), ["query_id", "list_no", "id"], ["rank"])


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
