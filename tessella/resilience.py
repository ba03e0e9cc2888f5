"""Retries, fallbacks and bounded ordered parallelism around providers and searches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.errors import InvalidArgument, Unavailable
from tessella.runtime import stored


def retrying(call: Callable, attempts: int = 5, pause: float = 0.01, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call`` tried again after Unavailable only, with a fixed pause. Nothing else here retries."""
    if attempts < 1:
        raise InvalidArgument("attempts must be at least 1")

    @wraps(call)
    def run(*args, **kwargs):
        for k in range(attempts):
            try:
                return call(*args, **kwargs)
            except Unavailable:
                if k + 1 == attempts:
                    raise
                sleep(pause)

    return run


def with_fallback(first: Callable[..., DataFrame], second: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A search that runs ``second`` where ``first`` is unavailable. The first is run at once, as laziness would hide its failure."""

    @wraps(first)
    def run(*args, **kwargs) -> DataFrame:
        try:
            return stored(first(*args, **kwargs))
        except (Unavailable, PySparkException) as e:
            if isinstance(e, PySparkException) and "Unavailable" not in str(e):
                raise
            return second(*args, **kwargs)

    return run


def map_ordered(df: DataFrame, function: Callable[[Sequence], Sequence], column: str, output: str, kind: str, concurrency: int) -> DataFrame:
    """``function`` over a column in ``concurrency`` tasks; rows come out in the order of ``df``."""
    if concurrency <= 0:
        raise InvalidArgument("concurrency must be positive")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{output: list(function(list(pdf[column])))})

    numbered = df.withColumn("_ord", F.monotonically_increasing_id())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema.fields)
    return numbered.repartition(concurrency).mapInPandas(run, f"{fields}, {output} {kind}").orderBy("_ord").drop("_ord")
