"""Lookup and deletion of documents by id or filter."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.errors import InvalidArgument
from tessella.predicate import bind, compiled, is_empty
from tessella.runtime import local_rows
from tessella.schema import STANDARD, Schema

#: Ids up to which a lookup list is sent to every task; a longer one is shuffled.
BROADCAST_IDS = 100_000


def _listed(docs: DataFrame, ids: Sequence[str]) -> DataFrame:
    wanted = local_rows(docs.sparkSession, id=list(ids), position=list(range(len(ids))))
    return F.broadcast(wanted) if len(ids) <= BROADCAST_IDS else wanted


def find_by_ids(docs: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Documents in the order asked for, repeated where asked twice; unknown ids are skipped, relevance is 0."""
    if not ids:
        return docs.limit(0).withColumn("relevance", F.lit(0.0)).withColumn("position", F.lit(0).cast("long"))
    return docs.drop("relevance").join(_listed(docs, ids), "id").withColumn("relevance", F.lit(0.0)).orderBy("position")


@dataclass(frozen=True)
class Deletion:
    """What stays, and what is deleted; both are lazy."""

    survivors: DataFrame
    removed: DataFrame

    @property
    def deleted(self) -> int:
        return self.removed.select("id").distinct().count()


def delete_by_ids(docs: DataFrame, ids: Sequence[str]) -> Deletion:
    if not ids:
        return Deletion(docs, docs.limit(0))
    wanted = _listed(docs, sorted(set(ids))).select("id")
    return Deletion(docs.join(wanted, "id", "left_anti"), docs.join(wanted, "id", "left_semi"))


def delete_by_filter(docs: DataFrame, tree: object, schema: Schema = STANDARD) -> Deletion:
    """Deletion of what a filter matches; the empty filter is refused."""
    if is_empty(tree):
        raise InvalidArgument("deletion needs a filter")
    bound = bind(tree, schema)
    return Deletion(docs.filter(compiled(bound, schema.root, negated=True)), docs.filter(compiled(bound, schema.root)))
