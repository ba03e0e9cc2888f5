"""Names of operations as Spark job descriptions and tags."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import SparkSession

from tessella.errors import InvalidArgument

# The operations that can be told apart.
OPERATIONS = (
    "dense.embed dense.search dense.upsert tensor.embed tensor.search tensor.upsert lexical.search multimodal.embed graph.traverse "
    "graph.upsert documents.find documents.delete_ids documents.delete_filter ranking.rerank ranking.merge"
).split()


def traced(operation: str, call: Callable, spark: SparkSession | None = None, on_end: Callable[[str, BaseException | None], None] | None = None) -> Callable:
    """``call`` under the operation's name: jobs it starts carry it. Errors pass through unchanged."""
    if operation not in OPERATIONS:
        raise InvalidArgument(f"operation {operation!r}")
    if call is None:
        raise InvalidArgument("nothing to trace")

    @wraps(call)
    def run(*args, **kwargs):
        session = spark or SparkSession.getActiveSession()
        context = session.sparkContext if session else None
        before = context.getLocalProperty("spark.job.description") if context else None
        tag = f"tessella.{operation}"
        if context:
            context.setLocalProperty("spark.job.description", tag)
            context.addJobTag(tag)
        error = None
        try:
            return call(*args, **kwargs)
        except BaseException as e:
            error = e
            raise
        finally:
            if context:
                context.removeJobTag(tag)
                context.setLocalProperty("spark.job.description", before)
            if on_end:
                on_end(operation, error)

    return run


def cancel(operation: str, spark: SparkSession) -> None:
    """Cancel the running jobs of an operation; it ends with Spark's error and without partial output."""
    if operation not in OPERATIONS:
        raise InvalidArgument(f"operation {operation!r}")
    spark.sparkContext.cancelJobsWithTag(f"tessella.{operation}")
