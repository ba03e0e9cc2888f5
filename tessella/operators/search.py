"""Dense, lexical and late-interaction search."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import EmptyText, EmptyVector, InvalidArgument
from tessella.functions.vectors import cosines, matrix, maxsim
from tessella.model import Page, logistic, paged
from tessella.predicate import bind, compiled, is_empty
from tessella.runtime import stored
from tessella.schema import STANDARD, Schema

#: Digits that decide the order of distances; beyond them, order of summation would.
DIGITS = 9
K1, B = 1.2, 0.75
TOKEN = r"[\p{L}\p{N}]+"


@dataclass(frozen=True)
class Request:
    """What all searches share: an optional filter and page."""

    filter: object = None
    page: Page | None = None
    schema: Schema = STANDARD
    nulls: str = "two_valued"

    def bound(self) -> object:
        tree = bind(self.filter, self.schema)
        if self.page is not None and not isinstance(self.page, Page):
            raise InvalidArgument("page must be a Page")
        return tree


def filtered(df: DataFrame, request: Request) -> DataFrame:
    tree = request.bound()
    return df if is_empty(tree) else df.filter(compiled(tree, request.schema.root, request.nulls))


def _best_cosines(query: np.ndarray, keep: int | None):
    """Per task: (id, distance) of the ``keep`` nearest rows. Only these leave Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap: list[tuple[float, str]] = []
        for batch in batches:
            at, x = matrix(batch.column(1), query.shape[1])
            d = np.round(1 - cosines(x, query)[:, 0], DIGITS)
            if keep is None:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(d)], names=["id", "distance"])
                continue
            if len(d) > keep:
                near = np.flatnonzero(d <= np.partition(d, keep - 1)[keep - 1])
                at, d = at[near], d[near]
            ids = batch.column(0).take(pa.array(at)).to_pylist()
            heap = heapq.nsmallest(keep, [*heap, *zip(d.tolist(), ids)])
        if keep is not None:
            yield pa.RecordBatch.from_arrays([pa.array([i for _, i in heap], pa.string()), pa.array([x for x, _ in heap], pa.float64())], names=["id", "distance"])

    return run


def dense_search(records: DataFrame, vector: Sequence[float], request: Request = Request(), relevance: str = "inverse", content: bool = True) -> DataFrame:
    """Records (id, content, attributes, vector) by cosine distance to ``vector``, nearest first, ties by id.

    relevance is 1/(1+distance), or the logistic of the similarity for ``relevance="logistic"``. Vectors of
    another length, null or with non-finite elements are no candidates. ``position`` numbers the results from 0.
    """
    if not len(vector):
        raise EmptyVector("query vector")
    if relevance not in ("inverse", "logistic"):
        raise InvalidArgument(f"relevance {relevance!r}")
    rows = filtered(records, request)
    page = request.page
    keep = None if page is None else page.offset + page.limit
    query = np.asarray(vector, dtype=np.float64)[None, :]
    near = rows.select("id", "vector").mapInArrow(_best_cosines(query, keep), "id string, distance double")
    scored = 1 / (1 + F.col("distance")) if relevance == "inverse" else logistic(1 - F.col("distance"))
    best = paged(near, page, F.col("distance"), F.col("id"))
    if page is not None:
        best = best.withColumn("position", F.row_number().over(Window.orderBy("distance", "id")) - 1 + F.lit(page.offset))
    best = best.withColumn("relevance", F.least(F.lit(1.0), F.greatest(F.lit(0.0), scored)))
    if not content:
        return best
    joined = records.select("id", "content", "attributes").join(F.broadcast(best) if page is not None and keep <= 10_000 else best, "id")
    return joined.orderBy("distance", "id")


def dense_search_many(records: DataFrame, queries: DataFrame, k: int, request: Request = Request()) -> DataFrame:
    """(query_id, id, distance, position): the k nearest records of each query (query_id, vector).

    Queries are collected in blocks of bounded size; each block is one scan of the records with local top-k.
    """
    Page(k)
    rows = filtered(records, request).select("id", "vector")
    total = queries.count()
    blocks = max(1, -(-total // 4096))
    numbered = queries.select("query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("_b")) if blocks > 1 else queries.select("query_id", "vector", F.lit(0).alias("_b"))
    found: DataFrame | None = None
    for b in range(blocks):
        block = numbered.filter(F.col("_b") == b).collect()
        if not block:
            continue
        part = rows.mapInArrow(_best_of_many([r["query_id"] for r in block], [r["vector"] for r in block], k), "query_id long, id string, distance double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return records.sparkSession.createDataFrame([], "query_id long, id string, distance double, position int")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("position", F.row_number().over(order) - 1).filter(F.col("position") < k)


def _best_of_many(names: list[int], vectors: list, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim: dict[int, list[int]] = {}
        for n, v in enumerate(vectors):
            if v is not None and len(v) and all(e is not None and math.isfinite(e) for e in v):
                by_dim.setdefault(len(v), []).append(n)
        best: dict[int, list] = {}
        for batch in batches:
            for dim, own in by_dim.items():
                at, x = matrix(batch.column(1), dim)
                if not len(at):
                    continue
                ids = batch.column(0).take(pa.array(at)).to_pylist()
                d = np.round(1 - cosines(x, np.array([vectors[n] for n in own], dtype=np.float64)), DIGITS)
                for col, n in enumerate(own):
                    near = np.flatnonzero(d[:, col] <= np.partition(d[:, col], min(k, len(d)) - 1)[min(k, len(d)) - 1])
                    best[n] = heapq.nsmallest(k, [*best.get(n, ()), *((float(d[j, col]), ids[j]) for j in near)])
        rows = [(names[n], i, x) for n, near in best.items() for x, i in near]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], names=["query_id", "id", "distance"])

    return run


def tokenised(text: Column) -> Column:
    """Lower-cased runs of letters and numbers."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), 1)


def query_terms(text: str) -> list[str]:
    """The distinct words of a query, as ``tokenised`` cuts them."""
    return sorted(set(re.findall(r"[^\W_]+", text.lower())))


def _counter(words: Column):
    return lambda term: F.size(F.filter(words, lambda x: x == term))


def _bm25_score(terms: Sequence[str], fields: int, docs: int, averages: Sequence[float | None], with_term: dict[tuple[int, int], int], tf: Callable[[int, int], Column], length: Callable[[int], Column]) -> Column:
    """The score of a row: of each field the sum over the terms in their order, the best field counting."""
    scores = []
    for n in range(fields):
        parts = []
        for k in range(len(terms)):
            df = with_term.get((n, k), 0)
            idf = math.log(1 + (docs - df + 0.5) / (df + 0.5))
            f = tf(n, k).cast("double")
            parts.append(F.lit(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * length(n) / F.lit(averages[n] or 1.0))))
        scores.append(sum(parts[1:], parts[0]))
    return F.round(scores[0] if len(scores) == 1 else F.greatest(*scores), DIGITS).alias("score")


def _best_scored(hits: DataFrame, page: Page | None) -> DataFrame:
    best = paged(hits, page, F.desc("score"), F.col("id")).withColumn("relevance", logistic(F.col("score")))
    return best if page is None else best.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1 + F.lit(page.offset))


def _asked(text: str, fields: Sequence[str], request: Request) -> list[str]:
    if not text or not text.strip():
        raise EmptyText("query text")
    if not fields or len(set(fields)) != len(fields):
        raise InvalidArgument("search fields must be there and different")
    request.bound()
    terms = query_terms(text)
    if not terms:
        raise EmptyText("query text has no words")
    return terms


def bm25(docs: DataFrame, text: str, fields: Sequence[str] = ("content",), request: Request = Request()) -> DataFrame:
    """(id, score, relevance, position): documents by BM25 (k1 1.2, b 0.75), the best field counting.

    Statistics cover all documents, the filter only decides which may be found. This is the way for a single query
    over documents without an index: one pass that counts the query's terms. ``Postings`` serve many queries.
    """
    terms = _asked(text, fields, request)
    # Words in a projection of their own: inside the counting lambda they would be cut out once for each term.
    words = docs.select("*", *[tokenised(F.coalesce(F.col(f), F.lit(""))).alias(f"_w{n}") for n, f in enumerate(fields)])
    wanted = F.array(*[F.lit(t) for t in terms])
    # Counted once, for the statistics and the scores: a few numbers a document.
    counted = stored(words.select(
        *[c for c in docs.columns if c not in fields or c in ("id", request.schema.root)],
        *[F.size(f"_w{n}").alias(f"_len{n}") for n in range(len(fields))],
        *[F.transform(wanted, _counter(F.col(f"_w{n}"))).alias(f"_tf{n}") for n in range(len(fields))],
    ))
    stats = counted.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f"_len{n}").alias(f"avg{n}") for n in range(len(fields))],
        *[F.sum((F.col(f"_tf{n}")[k] > 0).cast("long")).alias(f"df{n}_{k}") for n in range(len(fields)) for k in range(len(terms))],
    ).first()
    with_term = {(n, k): stats[f"df{n}_{k}"] or 0 for n in range(len(fields)) for k in range(len(terms))}
    score = _bm25_score(terms, len(fields), stats["n"], [stats[f"avg{n}"] for n in range(len(fields))], with_term, lambda n, k: F.col(f"_tf{n}")[k], lambda n: F.col(f"_len{n}"))
    return _best_scored(filtered(counted, request).select("id", score).filter(F.col("score") > 0), request.page)


@dataclass(frozen=True)
class Postings:
    """An index of words for many BM25 queries: rows (field, term, id, tf, len) in folders by a hash of the term.

    A query reads the folders of its terms only, and of those by the files' statistics the parts with its terms. The
    rows of a common term lie in several files, so they are written and read by several tasks.
    """

    path: str
    fields: tuple[str, ...]
    docs: int
    averages: tuple[float | None, ...]

    BUCKETS, FILES = 32, 4

    @classmethod
    def build(cls, docs: DataFrame, fields: Sequence[str], path: str) -> Postings:
        if not fields or len(set(fields)) != len(fields):
            raise InvalidArgument("search fields must be there and different")
        words = F.array(*[F.struct(F.lit(n).alias("field"), tokenised(F.coalesce(F.col(f), F.lit(""))).alias("words")) for n, f in enumerate(fields)])
        cut = stored(docs.select("id", F.explode(words).alias("w")).select("id", "w.field", "w.words", F.size("w.words").alias("len")))
        stats = {r["field"]: r for r in cut.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg")).collect()}
        rows = cut.select("id", "field", "len", F.explode("words").alias("term")).groupBy("field", "term", "id", "len").agg(F.count(F.lit(1)).alias("tf"))
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(cls.BUCKETS)).cast("int"))
        spread = rows.repartition(cls.BUCKETS * cls.FILES, "bucket", F.pmod(F.hash("id"), F.lit(cls.FILES))).sortWithinPartitions("bucket", "field", "term")
        spread.write.option("compression", "zstd").partitionBy("bucket").parquet(path)
        return cls(path, tuple(fields), stats[0]["n"] if stats else 0, tuple(stats[n]["avg"] if n in stats else None for n in range(len(fields))))

    def search(self, docs: DataFrame, text: str, request: Request = Request()) -> DataFrame:
        """(id, score, relevance, position) as ``bm25`` gives over the documents the index was built from; ``docs`` is read for the filter only."""
        terms = _asked(text, self.fields, request)
        spark = docs.sparkSession
        if not self.docs:
            return _best_scored(docs.limit(0).select("id", F.lit(0.0).alias("score")), request.page)
        folders = spark.range(1).select(F.array(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(self.BUCKETS)).cast("int") for t in terms])).first()[0]
        hits = spark.read.parquet(self.path).filter(F.col("bucket").isin(sorted(set(folders))) & F.col("term").isin(terms))
        counts = {(r["field"], terms.index(r["term"])): r["n"] for r in hits.groupBy("field", "term").agg(F.count(F.lit(1)).alias("n")).collect()}
        here = lambda n, k: (F.col("field") == n) & (F.col("term") == terms[k])
        pairs = [(n, k) for n in range(len(self.fields)) for k in range(len(terms))]
        by_id = hits.groupBy("id").agg(
            *[F.coalesce(F.max(F.when(here(n, k), F.col("tf"))), F.lit(0)).alias(f"_tf{n}_{k}") for n, k in pairs],
            *[F.coalesce(F.max(F.when(F.col("field") == n, F.col("len"))), F.lit(0)).alias(f"_len{n}") for n in range(len(self.fields))],
        )
        if not is_empty(request.bound()):
            by_id = by_id.join(filtered(docs, request).select("id"), "id", "left_semi")
        score = _bm25_score(terms, len(self.fields), self.docs, self.averages, counts, lambda n, k: F.col(f"_tf{n}_{k}"), lambda n: F.col(f"_len{n}"))
        return _best_scored(by_id.select("id", score).filter(F.col("score") > 0), request.page)


def tensor_search(records: DataFrame, query: list[list[float]], request: Request = Request(), column: str = "tensor") -> DataFrame:
    """(id, score, relevance): records by late interaction of token vectors (MaxSim with plain products)."""
    if not query:
        raise EmptyVector("query tensor")
    rows = filtered(records, request).filter(F.size(column) > 0)
    scored = rows.select("id", F.round(maxsim(query, F.col(column)), DIGITS).alias("score"))
    return paged(scored, request.page, F.desc("score"), F.col("id")).withColumn("relevance", logistic(F.col("score")))


def deduplicated(df: DataFrame, order: Sequence[Column], key: str = "id") -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_k") == 1).drop("_k")


def as_tensor(vector: Column, rows: int, dim: int) -> Column:
    """A flat vector as ``rows`` token vectors; null if it has another size."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice(vector, i * dim + 1, F.lit(dim)))
    return F.when(F.size(vector) == rows * dim, cut).cast(T.ArrayType(T.ArrayType(T.DoubleType())))
