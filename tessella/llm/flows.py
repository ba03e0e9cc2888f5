"""One ranking per query from several scores, by outranking net flow.

Each list turns its scores into percentiles, so the size of its numbers doesn't matter. In a list an
item is preferred to every item of lower percentile; its net flow is the weighted share of items it is
preferred to, less the share preferred to it. Both shares are differences of prefix sums over the list
in sorted order. The sort is by (query, list, score, id), whose keys are all different, so a query or a
list of any size spreads over many tasks; what a run of equal scores or a list has in other tasks is
carried over by one summary row per task.

The leading places are decided by the same preferences one level up: an item outranks another that it is
preferred to in more than half of the (weighted) lists scoring both, and its majority flow is the share of
items it outranks less the share outranking it. Leaders, which fail to outrank fewer than ``places`` others,
have a greater majority flow than all other items and come first, in its order; the rest follow by net flow
over percentiles. Majority flows need pairs, but only of items that can lead: among TOGETHER items at most
2·places - 1 fail so rarely, so a knock-out in blocks leaves few of any number, and these alone are compared
with all items of their query.

Defined results: items without a score in a list (null or NaN) take no part in that list, and items
without any score aren't ranked; equal scores are no preference; items that no list compares don't outrank each other; repeated rows are one; equal flows are
ordered by the sum of percentiles, then by id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.ranking import placed
from tessella.runtime import HOT_SALTS, hot_keys, latest, skew_join, stored

#: Rows that one task sorts.
ROWS = 400_000
#: Items of a query that are compared with each other at once.
TOGETHER = 64
_KEYS = ["query_id", "list_no", "relevance"]


def _starts(keys: pd.DataFrame) -> np.ndarray:
    new = np.ones(len(keys), dtype=bool)
    if len(keys) > 1:
        values = [keys[c].to_numpy() for c in keys.columns]
        new[1:] = np.logical_or.reduce([v[1:] != v[:-1] for v in values])
    return np.flatnonzero(new)


def _summary(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row: how many rows a part has, its first and last keys, and where its first and last list and run end or begin."""
    pdf = pdf.sort_values([*_KEYS, "id"], kind="stable")
    lists, runs = _starts(pdf[_KEYS[:2]]), _starts(pdf[_KEYS])
    n = len(pdf)
    second = lambda at: int(at[1]) if len(at) > 1 else n
    first, last = pdf.iloc[0], pdf.iloc[-1]
    row = [pdf["part"].iloc[0], n, *(first[c] for c in _KEYS), *(last[c] for c in _KEYS), second(lists), second(runs), int(lists[-1]), int(runs[-1])]
    return pd.DataFrame([row], columns=_SUMMARY)


_SUMMARY = ["part", "n", "q0", "l0", "r0", "q1", "l1", "r1", "list_end", "run_end", "list_start", "run_start"]
_SUMMARY_SCHEMA = "part int, n long, q0 long, l0 long, r0 double, q1 long, l1 long, r1 double, list_end long, run_end long, list_start long, run_start long"


def _carried(rows: list) -> dict[int, tuple[int, int, int, int]]:
    """For each part: rows that its first list and first run have in earlier parts, and its last list and run in later ones."""
    rows = sorted(rows, key=lambda r: (r["q0"], r["l0"], r["r0"], r["part"]))
    before_list, before_run = [0] * len(rows), [0] * len(rows)
    for k in range(1, len(rows)):
        a, b = rows[k - 1], rows[k]
        if (a["q1"], a["l1"]) == (b["q0"], b["l0"]):
            before_list[k] = a["n"] - a["list_start"] + (before_list[k - 1] if a["list_start"] == 0 else 0)
            if a["r1"] == b["r0"]:
                before_run[k] = a["n"] - a["run_start"] + (before_run[k - 1] if a["run_start"] == 0 else 0)
    after_list, after_run = [0] * len(rows), [0] * len(rows)
    for k in range(len(rows) - 2, -1, -1):
        a, b = rows[k], rows[k + 1]
        if (a["q1"], a["l1"]) == (b["q0"], b["l0"]):
            after_list[k] = b["list_end"] + (after_list[k + 1] if b["list_end"] == b["n"] else 0)
            if a["r1"] == b["r0"]:
                after_run[k] = b["run_end"] + (after_run[k + 1] if b["run_end"] == b["n"] else 0)
    return {r["part"]: (before_list[k], before_run[k], after_list[k], after_run[k]) for k, r in enumerate(rows)}


def _flows(carried: dict[int, tuple[int, int, int, int]]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*_KEYS, "id"], kind="stable")
        before_list, before_run, after_list, after_run = carried[int(pdf["part"].iloc[0])]
        n = len(pdf)
        bounds = []
        for keys, before, after in ((_KEYS[:2], before_list, after_list), (_KEYS, before_run, after_run)):
            starts = _starts(pdf[keys])
            ends = np.append(starts[1:], n)
            at = np.repeat(np.arange(len(starts)), ends - starts)
            starts, ends = starts.copy(), ends.copy()
            starts[0] -= before
            ends[-1] += after
            bounds.append((starts[at], ends[at]))
        (list_start, list_end), (run_start, run_end) = bounds
        less, greater, others = run_start - list_start, list_end - run_end, np.maximum(list_end - list_start - 1, 1)
        return pd.DataFrame({"query_id": pdf["query_id"], "list_no": pdf["list_no"], "id": pdf["id"], "flow": (less - greater) / others, "percentile": (less + (run_end - run_start - 1) / 2) / others})

    return run


def list_flows(scores: DataFrame) -> DataFrame:
    """(query_id, list_no, id, flow, percentile) of every scored item of ``scores`` (query_id, list_no, id, relevance)."""
    scored = scores.filter(F.col("relevance").isNotNull() & ~F.isnan("relevance") & F.col("query_id").isNotNull() & F.col("list_no").isNotNull() & F.col("id").isNotNull())
    rows = stored(scored.select(F.col("query_id").cast("long").alias("query_id"), F.col("list_no").cast("long").alias("list_no"), "id", (F.col("relevance").cast("double") + F.lit(0.0)).alias("relevance")))
    parts = max(1, -(-rows.count() // ROWS))
    order = [*_KEYS, "id"]
    ranged = stored(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    carried = _carried(ranged.groupBy("part").applyInPandas(_summary, _SUMMARY_SCHEMA).collect())
    return ranged.groupBy("part").applyInPandas(_flows(carried), "query_id long, list_no long, id string, flow double, percentile double")


def weighed(marks: DataFrame, weights: dict[int, float] | None = None) -> DataFrame:
    """``marks`` with the weight ``w`` of their lists, 1 where none is told."""
    weight = F.lit(1.0)
    for list_no, w in (weights or {}).items():
        weight = F.when(F.col("list_no") == list_no, F.lit(float(w))).otherwise(weight)
    return marks.withColumn("w", weight)


def combined(marks: DataFrame) -> DataFrame:
    """(query_id, id, flow, standing) of every item: its weighted mean net flow and mean percentile over the lists that score it."""
    total = F.sum("w")
    # Rounded, so that the order of summation can't decide between equal flows.
    return marks.groupBy("query_id", "id").agg(F.round(F.sum(F.col("w") * F.col("flow")) / total, 12).alias("flow"), F.round(F.sum(F.col("w") * F.col("percentile")) / total, 12).alias("standing"))


def _compared(some: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """(query_id, id, above, below): how many of ``others`` with the same keys each item of ``some`` outranks, and how many outrank it.

    Both sides meet by the keys alone, so that counting by pair needs no further shuffle; a pair never leaves its task.
    """
    left = some.select(*keys, "id", "list_no", "percentile")
    right = others.select(*keys, F.col("id").alias("_id"), F.col("list_no").alias("_list"), F.col("percentile").alias("_percentile"), "w").hint("merge")
    met = left.join(right, keys).filter((F.col("list_no") - F.col("_list") == 0) & (F.col("id") != F.col("_id")))
    won, lost, all_of = (F.sum(F.when(c, F.col("w")).otherwise(0.0)) for c in (F.col("percentile") > F.col("_percentile"), F.col("percentile") < F.col("_percentile"), F.lit(True)))
    pairs = met.groupBy(*keys, "id", "_id").agg((2 * won > all_of).cast("int").alias("above"), (2 * lost > all_of).cast("int").alias("below"))
    return pairs.groupBy(*keys, "id").agg(F.sum("above").alias("above"), F.sum("below").alias("below")).groupBy("query_id", "id").agg(F.sum("above").alias("above"), F.sum("below").alias("below"))


def _items(marks: DataFrame, *keys: str) -> DataFrame:
    """How many items there are by the keys."""
    return marks.select(*keys, "id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("items"))


def leaders(marks: DataFrame, places: int = 3) -> DataFrame:
    """(query_id, id, majority) of all items that fail to outrank fewer than ``places`` others of their query, with their majority flow."""
    sizes = of_all = stored(_items(marks, "query_id"))
    hot = hot_of_all = hot_keys(marks, "query_id")
    alive, level = marks, 0
    together = max(TOGETHER, 8 * places)  # of each block at most 2·places - 1 stay, so every round leaves less than a third
    while (sizes.agg(F.max("items")).first()[0] or 0) > together:
        level += 1
        parted = skew_join(alive, sizes, "query_id", F.col("id"), hot=hot)
        small, large = parted.filter(F.col("items") <= together).drop("items"), parted.filter(F.col("items") > together)
        large = stored(large.withColumn("block", F.pmod(F.xxhash64("id", F.lit(level)), F.ceil(F.col("items") / together))).drop("items"))
        held = large.select("query_id", "block", "id").distinct()
        blocks = held.groupBy("query_id", "block").agg(F.count(F.lit(1)).alias("items"))
        beaten = held.join(blocks, ["query_id", "block"]).join(_compared(large, large, ["query_id", "block"]), ["query_id", "id"], "left")
        kept = beaten.filter(F.col("items") - 1 - F.coalesce("above", F.lit(0)) < places).select("query_id", "id")
        alive = stored(small.unionByName(large.drop("block").join(kept, ["query_id", "id"], "left_semi")))
        sizes, hot = stored(_items(alive, "query_id")), hot_keys(alive, "query_id")
    salted = _salted(hot_of_all)
    compared = _compared(salted(alive, True), salted(marks, False), ["query_id", "salt"])
    of_query = skew_join(alive.select("query_id", "id").distinct(), of_all, "query_id", F.col("id"), hot=[])
    counted = of_query.join(compared, ["query_id", "id"], "left").fillna(0, ["above", "below"])
    leading = counted.filter(F.col("items") - 1 - F.col("above") < places)
    return leading.select("query_id", "id", ((F.col("above") - F.col("below")) / F.greatest(F.col("items") - 1, F.lit(1))).alias("majority"))


def _salted(hot: list):
    """Items of hot queries are spread over HOT_SALTS tasks; those compared with them go to each of these."""
    is_hot = F.col("query_id").isin(hot) if hot else F.lit(False)

    def spread(df: DataFrame, everywhere: bool) -> DataFrame:
        if everywhere:
            return df.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(F.array(F.lit(0)))))
        return df.withColumn("salt", F.when(is_hot, F.pmod(F.hash("id"), F.lit(HOT_SALTS))).otherwise(F.lit(0)))

    return spread


def _judged(scores: DataFrame, weights: dict[int, float] | None, places: int) -> DataFrame:
    """(query_id, id, flow, standing, majority) of every item; only leaders have a majority."""
    marks = weighed(stored(list_flows(scores)), weights)
    return combined(marks).join(leaders(marks, places), ["query_id", "id"], "left")


_ORDER = (F.desc_nulls_last, "majority"), (F.desc, "flow"), (F.desc, "standing"), (F.asc, "id")


def ranking(scores: DataFrame, weights: dict[int, float] | None = None, places: int = 3) -> DataFrame:
    """(query_id, id, flow, position from 1): each query's whole ranking, numbered by one distributed sort over all queries."""
    rows = placed(stored(_judged(scores, weights, places)), F.asc("query_id"), *[way(c) for way, c in _ORDER])
    first = rows.groupBy("query_id").agg(F.min("rank").alias("_first"))
    numbered = skew_join(rows, first, "query_id", F.col("id"))
    return numbered.select("query_id", "id", "flow", (F.col("rank") - F.col("_first") + 1).cast("int").alias("position"))


def first_places(scores: DataFrame, places: int = 3, weights: dict[int, float] | None = None) -> DataFrame:
    """(query_id, id, position from 1): the first places of the same ranking. Each task passes on that many rows of a query only."""
    order = Window.partitionBy("query_id").orderBy(*[way(c) for way, c in _ORDER])
    return _judged(scores, weights, places).withColumn("position", F.row_number().over(order)).filter(F.col("position") <= places).select("query_id", "id", "position")


def scores_of(ranked: DataFrame) -> DataFrame:
    """The scores of a table of ranked lists; repeated rows are one record."""
    return latest(ranked, ["query_id", "list_no", "id"], ["relevance"])
