"""Merging of ranked lists and query-aware reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.errors import EmptyText, InvalidArgument, ProtocolError
from tessella.model import clamped
from tessella.runtime import stored


def tagged(lists: Sequence[DataFrame], rank: str = "rank") -> DataFrame | None:
    """Ranked lists as one table with a list number."""
    out = None
    for n, df in enumerate(lists):
        one = df.withColumn("list_no", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


def placed(df: DataFrame, *order: Column) -> DataFrame:
    """All rows with their ``rank`` from 0 in ``order``, which must leave no ties: a distributed sort, and the number of rows before each of its partitions."""
    # The id holds the partition in its upper bits and the row within it in the lower 33.
    rows = stored(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).cast("int")
    before, sizes = {}, rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    total = 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        before[r["part"]] = total - (r["part"] << 33)
        total += r["n"]
    # One entry per partition of the sort, never more.
    shift = F.create_map(*[x for k, n in before.items() for x in (F.lit(k), F.lit(n).cast("long"))])[part] if before else F.lit(0)
    return rows.withColumn("rank", (F.col("_at") + shift).cast("long")).drop("_at")


def reciprocal_rank_fusion(ranked: DataFrame | None, k: float, by: Sequence[str] = (), payload: Sequence[str] = (), check_payload: bool = False) -> DataFrame | None:
    """(*by, id, *payload, score, relevance, and with ``by`` position), ordered by relevance without: lists (list_no, rank from 0, id) merged per ``by``.

    An item's score is the sum of 1/(k + rank + 1) over its places, added up in (list, rank) order so that the
    last digit doesn't depend on the partitioning; relevance is its share of the best score; ties go by id.
    The payload is that of the first place; with ``check_payload`` differing ones fail the query. No lists merge to None.
    """
    if not k > 0:
        raise InvalidArgument("k must be positive")
    if ranked is None:
        return None
    keys = [*by, "id"]
    place = F.struct("list_no", "rank")
    places = F.array_sort(F.collect_list(place))
    aggregates = [places.alias("_places"), *[F.min_by(c, place).alias(c) for c in payload]]
    if check_payload and payload:
        # Smallest and largest payload differ exactly if two differ; unlike a set of them, both are bounded.
        sides = [side(F.to_json(F.struct(*[F.col(c).alias(c) for c in payload]))) for side in (F.min, F.max)]
        aggregates += [sides[0].alias("_low"), sides[1].alias("_high")]
    merged = ranked.groupBy(*keys).agg(*aggregates)
    score = F.aggregate("_places", F.lit(0.0), lambda s, p: s + 1 / (F.lit(float(k)) + p["rank"] + 1))
    if check_payload and payload:
        merged = merged.filter(F.when(F.col("_low") == F.col("_high"), True).otherwise(F.raise_error(F.lit("InvalidArgument: one id, several payloads")).cast("boolean"))).drop("_low", "_high")
    scored = merged.withColumn("score", score).drop("_places")
    if by:
        whole = Window.partitionBy(*by)
        relevant = scored.withColumn("relevance", clamped(F.col("score") / F.max("score").over(whole)))
        return relevant.withColumn("position", F.row_number().over(whole.orderBy(F.desc("relevance"), "id")) - 1)
    # One ranking over everything: its best score is one number, its order a distributed sort, without a window over one task.
    top = scored.agg(F.max("score")).first()[0]
    return by_relevance(scored.withColumn("relevance", clamped(F.col("score") / F.lit(top))))


def by_relevance(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("relevance"), "id")


#: A reranker: the query and texts in, (index, score) pairs out, each index once.
Reranker = Callable[[str, list[str]], Sequence[tuple[int, float]]]


def permuted(n: int, pairs: Sequence[tuple[int, object]]) -> list:
    """Values in input order from (index, value) pairs, which must name each of ``n`` inputs once."""
    if len(pairs) != n:
        raise ProtocolError(f"{len(pairs)} results for {n} inputs")
    out: list = [None] * n
    seen = [False] * n
    for index, value in pairs:
        if not isinstance(index, int) or not 0 <= index < n or seen[index]:
            raise ProtocolError(f"bad index {index!r}")
        out[index], seen[index] = value, True
    return out


def reranked(docs: DataFrame, query: str, reranker: Reranker, batch: int = 256) -> DataFrame:
    """Documents (id, content, …) with a provider's scores as relevance, best first, ties by id. Each call sees ``batch`` texts of one task."""
    if not query or not query.strip():
        raise EmptyText("query")

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            scores: list[float] = []
            for at in range(0, len(texts), batch):
                part = list(texts.iloc[at : at + batch])
                scores += [float(x) for x in permuted(len(part), reranker(query, part))]
            yield pd.Series(scores, dtype="float64")

    # A column of its own, not a join by id: an id that occurs twice stays two documents.
    scored = docs.drop("relevance").withColumn("_score", F.pandas_udf(run, "double")(F.col("content")))
    return by_relevance(scored.withColumn("relevance", clamped(F.col("_score"))).drop("_score"))
