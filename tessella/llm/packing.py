"""Filling containers of fixed capacity with items of varying size.

Items are spread over partitions and packed there by best-fit decreasing. Dual-feasible functions
give a lower bound for each partition's containers; a partition that meets it is finished. What lies
in poorly filled containers, or in partitions above their bound, is exchanged between partitions and
packed again, as long as that saves containers.

Defined results: an item over the capacity is split into full pieces and a rest, no other item is
split; items of size zero (null and empty texts) go into any container; equal items are interchangeable;
repeated keys are separate items; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.runtime import stored

CAPACITY = 2048
#: Items that one task packs at a time.
ITEMS = 60_000
ROUNDS = 3
#: Containers filled less than this are opened again.
FULL = 0.98
_SCHEMA = "key long, piece int, start long, size int, container long, fill int, containers int, bound int"


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """Containers that any packing needs: the best of the dual-feasible functions u(k) and U(eps), and plain volume."""
    counts = np.bincount(sizes[sizes > 0], minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * x).sum()) // capacity)
    for k in range(1, 21):
        # u(k)(x) = x where (k+1)x/C is whole, else floor((k+1)x/C)·C/k; times k to stay in integers.
        whole = (k + 1) * x % capacity == 0
        value = np.where(whole, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    # U(eps): 1 above C - eps, x from eps, 0 below.
    up = np.cumsum(counts * x)
    many = np.cumsum(counts)
    eps = np.arange(1, capacity // 2 + 1)
    large = many[capacity] - many[capacity - eps]
    middle = up[capacity - eps] - up[eps - 1]
    return max(best, int((large + -(-middle // capacity)).max()))


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The container of each item, numbered from 0; items of size zero go into container 0."""
    out = np.zeros(len(sizes), dtype=np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = made = 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        if size == 0:
            break
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            container = open_at[room].pop()
            if not open_at[room]:
                mask &= ~(1 << room)
        else:
            room, container = capacity, made
            made += 1
        out[k] = container
        left = room - size
        if left:
            open_at[left].append(container)
            mask |= 1 << left
    return out


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "key", "piece"], ascending=[False, True, True])
    sizes = pdf["size"].to_numpy(np.int64)
    container = best_fit_decreasing(sizes, CAPACITY)
    fill = np.bincount(container, weights=sizes).astype(np.int64)
    return pdf[["key", "piece", "start", "size"]].assign(container=container, fill=fill[container], containers=len(fill), bound=max(1, lower_bound(sizes)), part=pdf["part"])


def _packed(items: DataFrame, seed: int) -> DataFrame:
    """Pack items in as many partitions as their number asks for; container numbers are unique within a seed."""
    parts = max(1, -(-items.count() // ITEMS))
    spread = items.select("key", "piece", "start", "size", F.pmod(F.xxhash64("key", "piece", F.lit(seed)), F.lit(parts)).cast("int").alias("part"))
    out = spread.groupBy("part").applyInPandas(_pack, _SCHEMA + ", part int")
    return stored(out.withColumn("container", (F.lit(seed) * F.lit(1 << 56)) + (F.col("part").cast("long") * F.lit(1 << 28)) + F.col("container")))


def _used(packed: DataFrame) -> int:
    return packed.select("part", "containers").distinct().agg(F.sum("containers")).first()[0] or 0


def pieces(items: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, start, size): items over the capacity as full pieces and a rest, all others whole."""
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    count = F.greatest(F.lit(1), F.ceil(n / capacity)).cast("int")
    cut = items.select(F.col(key).cast("long").alias("key"), n.alias("_n"), F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    return cut.select("key", "piece", start.alias("start"), F.least(F.lit(capacity).cast("long"), F.col("_n") - start).cast("int").alias("size"))


def containers(items: DataFrame, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(key, piece, start, size, container) of every item of ``items``."""
    last = _packed(stored(pieces(items, key, size)), 0)
    done: list[DataFrame] = []
    for seed in range(1, ROUNDS + 1):
        again = (F.col("fill") < FULL * CAPACITY) | ((F.col("containers") > F.col("bound")) & (F.col("fill") < CAPACITY))
        loose = last.filter(again)
        old = loose.agg(F.countDistinct("container")).first()[0]
        if old < 2:
            break
        new = _packed(loose, seed)
        if _used(new) >= old:
            break
        done.append(last.filter(~again))
        last = new
    out = last
    for df in done:
        out = out.unionByName(df)
    return out.select(F.col("key").alias(key), "piece", "start", "size", "container")
