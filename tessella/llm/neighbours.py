"""The most similar vectors of every vector, by score-aware quantisation.

Vectors are scaled to unit length. A bounded sample of them trains cells (k-means) and 4-bit codebooks
whose loss weighs the residual along the vector, which changes the scores that matter, more than the
residual across it. Every vector is coded and indexed in its cell, and looks for neighbours in its nearest
cells: tables of its products with the codewords are summed by code. A vector's score is wrong by no more
than the length of its residual, so all rows that can reach the least cosine, and the NEIGHBOURS best so
far, are reranked with exact products: within a cell nothing is lost. How many cells a vector looks into is
measured: so many that QUERIES sampled vectors find RECALL of their true neighbours among all rows.
``exact=True`` looks into all cells, in blocks.

Neighbouring small cells share a task, so that a vector is sent once to several cells it looks into; large
ones are split into blocks, and many askers into parts. Equal vectors are one row of the index that carries
their smallest ids.

Defined results: null vectors, vectors of another length, with null, NaN or infinite elements, and
all-zero vectors take no part; a repeated id is one record; equal similarities are ordered by id;
fewer vectors than asked for give fewer neighbours; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.vectors import matrix
from tessella.runtime import skew_join, stored

DIM, NEIGHBOURS, LEAST_COSINE = 64, 10, 0.80
#: Vectors that train cells and codebooks, on average, and those of them whose neighbours are searched among all rows to measure recall.
SAMPLE, QUERIES, RECALL = 20_000, 512, 0.997
#: Cells per square root of the number of vectors, cells at most, vectors up to which cells share a task, vectors of a block.
CELLS, MOST_CELLS, GROUP, BLOCK = 0.5, 16_384, 8192, 65_536
#: Vectors that ask one block of an index in one task, and of them at once.
ASKERS, TOGETHER = 16_384, 256
#: Dimensions a codeword covers, weight of the residual along the vector (for scores above 0.2), candidates reranked before the bound is drawn closer.
STEP, ETA, RERANKED = 2, (DIM - 1) * 0.04 / 0.96, 48
_PARTS = DIM // STEP
#: Largest table entry: the sum of all tables stays within 16 bits.
_ENTRY = 32_000 // (_PARTS // 2)


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int, spherical: bool = False) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
        if spherical:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


def _nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    out = []
    half = (centres * centres).sum(axis=1) / 2
    for at in range(0, len(x), 8192):
        score = x[at : at + 8192] @ centres.T - half
        if k == 1:
            out.append(score.argmax(axis=1)[:, None])
        else:
            top = np.argpartition(-score, min(k, score.shape[1]) - 1, axis=1)[:, :k]
            out.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, axis=1), axis=1, kind="stable"), axis=1))
    return np.concatenate(out) if out else np.empty((0, k), np.int64)


def encode(x: np.ndarray, books: np.ndarray, rounds: int = 1) -> np.ndarray:
    """Codes of unit vectors: coordinate descent on |r|² + (ETA - 1)(r·x)² over one codeword after another."""
    sub = x.reshape(len(x), _PARTS, STEP)
    codes = np.empty((len(x), _PARTS), dtype=np.uint8)
    for m in range(_PARTS):
        codes[:, m] = ((sub[:, m, None, :] - books[m][None]) ** 2).sum(axis=2).argmin(axis=1)
    along = np.stack([((sub[:, m] - books[m][codes[:, m]]) * sub[:, m]).sum(axis=1) for m in range(_PARTS)], axis=1)
    total = along.sum(axis=1)
    for _ in range(rounds):
        for m in range(_PARTS):
            left = sub[:, m, None, :] - books[m][None]
            part = np.einsum("nkd,nd->nk", left, sub[:, m])
            cost = (left * left).sum(axis=2) + (ETA - 1) * (total[:, None] - along[:, m, None] + part) ** 2
            codes[:, m] = cost.argmin(axis=1)
            chosen = part[np.arange(len(x)), codes[:, m]]
            total += chosen - along[:, m]
            along[:, m] = chosen
    return codes


def train_codebooks(x: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Codebooks (_PARTS, 16, STEP): k-means first, then the exact least-squares solution of the weighted loss for fixed codes, in turn."""
    sub = x.reshape(len(x), _PARTS, STEP)
    books = np.stack([_kmeans(sub[:, m].copy(), 16, 8, m) for m in range(_PARTS)])
    if books.shape[1] < 16:
        books = np.concatenate([books, np.repeat(books[:, :1], 16 - books.shape[1], axis=1)], axis=1)
    size = _PARTS * 16 * STEP
    for _ in range(rounds):
        codes = encode(x, books)
        columns = (np.arange(_PARTS) * 16 + codes)[:, :, None] * STEP + np.arange(STEP)
        z = np.zeros((len(x), size), dtype=np.float32)
        np.put_along_axis(z, columns.reshape(len(x), -1), x, axis=1)
        used = np.bincount(columns.ravel(), minlength=size).astype(np.float64)
        a = (ETA - 1) * (z.T @ z).astype(np.float64) + np.diag(used + 1e-3)
        b = z.sum(axis=0, dtype=np.float64) + (ETA - 1) * (z * (x * x).sum(axis=1, keepdims=True)).sum(axis=0, dtype=np.float64)
        b += 1e-3 * books.ravel()
        books = np.linalg.solve(a, b).reshape(_PARTS, 16, STEP).astype(np.float32)
    return books


def scan(queries: np.ndarray, codes: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, float]:
    """Approximate products of all coded vectors (rows) with all queries (columns) as 16-bit integers, and what they are divided by.

    Two 4-bit codes at a time look up a row of the queries' tables.
    """
    tables = np.einsum("qmd,mkd->mkq", queries.reshape(len(queries), _PARTS, STEP), books)
    both = (tables[0::2, :, None, :] + tables[1::2, None, :, :]).reshape(_PARTS // 2, 256, len(queries))
    scale = _ENTRY / max(float(np.abs(both).max()), 1e-9)
    both = np.rint(both * scale).astype(np.int16)
    pairs = codes[:, 0::2].astype(np.int64) * 16 + codes[:, 1::2]
    out = np.take(both[0], pairs[:, 0], axis=0)
    row = np.empty_like(out)
    for j in range(1, _PARTS // 2):
        np.take(both[j], pairs[:, j], axis=0, out=row, mode="clip")
        out += row
    return out, scale


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, x = matrix(batch.column(1), DIM)
        top = np.abs(x).max(axis=1) if len(x) else np.empty(0)
        good = (top > 0) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)[at]
        x = x[good] / top[good, None]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * DIM), len(x), [None, pa.py_buffer(x.astype("<f4").tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[good])), rows], names=["id", "unit"])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<f4").reshape(-1, DIM)


def _measured(centres: np.ndarray, names: list[str], queries: np.ndarray):
    """How many vectors each cell holds (cell, held), and the queries' nearest vectors (query, cosine, place): at which place their cell comes for the query."""
    score = queries @ centres.T
    place_of = np.empty(score.shape, dtype=np.int64)
    np.put_along_axis(place_of, np.argsort(-score, axis=1, kind="stable"), np.arange(len(centres))[None, :], axis=1)
    number = {n: k for k, n in enumerate(names)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(len(centres), np.int64)
        best = [np.empty((0, 3)) for _ in names]
        for pdf in batches:
            if not len(pdf):
                continue
            x = _matrix(pdf["unit"])
            cell = _nearest(x, centres, 1)[:, 0]
            held += np.bincount(cell, minlength=len(centres))
            cosine = x @ queries.T
            for k, own in enumerate(pdf["gid"]):
                if own in number:
                    cosine[k, number[own]] = -1.0
            at, q = np.nonzero(cosine >= LEAST_COSINE)
            for k in np.unique(q):
                own = at[q == k]
                more = np.stack([np.full(len(own), k), cosine[own, k], place_of[k, cell[own]]], axis=1)
                both = np.concatenate([best[k], more])
                best[k] = both[np.argsort(-both[:, 1], kind="stable")[:NEIGHBOURS]]
        there = np.flatnonzero(held)
        yield pd.DataFrame({"cell": there, "held": held[there], "query": None, "cosine": None, "place": None})
        found = np.concatenate(best) if best else np.empty((0, 3))
        if len(found):
            yield pd.DataFrame({"cell": None, "held": None, "query": found[:, 0].astype(np.int64), "cosine": found[:, 1], "place": found[:, 2].astype(np.int64)})

    return run


def _probes(places: list[int], cells: int) -> int:
    """The least number of cells in which RECALL of the measured neighbours lie, but at least four."""
    if not places:
        return min(cells, 16)
    places = sorted(places)
    return min(cells, max(4, places[min(len(places) - 1, int(np.ceil(RECALL * len(places))) - 1)] + 1))


def _groups_of(centres: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The group of each cell: neighbouring cells that hold at most GROUP vectors together."""
    coarse = _kmeans(centres, max(1, min(len(centres), int(held.sum() // GROUP) + 1)), 5, 3, spherical=True)
    order = np.argsort(_nearest(centres, coarse, 1)[:, 0], kind="stable")
    out, group, size = np.zeros(len(centres), np.int64), -1, GROUP + 1
    for cell in order:
        if size + held[cell] > GROUP:
            group, size = group + 1, 0
        out[cell] = group
        size += held[cell]
    return out


def _assigned(centres: np.ndarray, books: np.ndarray, probes: int, group_of: np.ndarray, blocks: np.ndarray, askers: np.ndarray):
    """Rows for each vector's own block, one for each part of those who ask it, and a row for each block of each group the vector looks into."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x, gid, unit = _matrix(pdf["unit"]), pdf["gid"].to_numpy(dtype=object), pdf["unit"].to_numpy(dtype=object)
            near = _nearest(x, centres, probes)
            number = pd.util.hash_array(gid, categorize=False)
            packed = encode(x, books)
            packed = np.ascontiguousarray(packed[:, 0::2] << 4 | packed[:, 1::2]).astype(np.uint8)
            own = near[:, 0]
            group = group_of[own]
            parts = askers[group]
            at = np.repeat(np.arange(len(x)), parts)
            part = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
            codes, cells = [r.tobytes() for r in packed], own.astype("<u2")
            yield pd.DataFrame({"cell_group": group[at], "block": (number % blocks[group].astype(np.uint64)).astype(np.int64)[at], "part": part, "gid": gid[at], "unit": unit[at], "code": [codes[k] for k in at], "cells": [cells[k].tobytes() for k in at]})
            # Asks: the cells of one group travel together.
            row, cell = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
            order = np.lexsort((group_of[cell], row))
            row, cell = row[order], cell[order].astype("<u2")
            group = group_of[cell]
            starts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (group[1:] != group[:-1])]))
            ends = np.append(starts[1:], len(row))
            raw = cell.tobytes()
            asked = np.array([raw[2 * a : 2 * b] for a, b in zip(starts, ends)], dtype=object)
            row, group = row[starts], group[starts]
            part = ((number[row] >> np.uint64(20)) % askers[group].astype(np.uint64)).astype(np.int64)
            many = blocks[group]
            at = np.repeat(np.arange(len(row)), many)
            block = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            yield pd.DataFrame({"cell_group": group[at], "block": block, "part": part[at], "gid": gid[row[at]], "unit": unit[row[at]], "code": None, "cells": asked[at]})

    return run


def _best_in_cell(x: np.ndarray, codes: np.ndarray, residual: np.ndarray, queries: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of all rows that may be among a query's nearest: none of those is missing."""
    score, scale = scan(queries, codes, books)
    slack = _PARTS // 4 / scale + 1e-5  # rounding of the tables
    may = score >= ((LEAST_COSINE - slack - residual) * scale)[:, None]
    full = np.flatnonzero(may.sum(axis=0) > RERANKED)
    for at in range(0, len(full), 64):
        own = full[at : at + 64]
        part = score[:, own]
        top = np.argpartition(-part, RERANKED, axis=0)[:RERANKED]
        exact = np.einsum("kqd,qd->kq", x[top], queries[own])
        # One more than the neighbours, as the query itself may be among the rows.
        least = -np.partition(-exact, NEIGHBOURS, axis=0)[NEIGHBOURS] - 1e-6
        may[:, own] &= part / scale + residual[:, None] + slack >= least[None, :]
    row, query = np.nonzero(may)
    cosine = np.empty(len(row))
    for at in range(0, len(row), 100_000):
        own = slice(at, at + 100_000)
        cosine[own] = np.einsum("nd,nd->n", x[row[own]].astype(np.float64), queries[query[own]].astype(np.float64))
    good = cosine >= LEAST_COSINE - 1e-6
    return query[good], row[good], cosine[good]


def _searched(books: np.ndarray):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        stays = pdf["code"].notna().to_numpy()
        index, asks = pdf[stays], pdf[~stays]
        none = pd.DataFrame({"gid": np.empty(0, object), "other": np.empty(0, object), "cosine": np.empty(0)})
        if not len(index) or not len(asks):
            return none
        names, own = index["gid"].to_numpy(dtype=object), asks["gid"].to_numpy(dtype=object)
        order = np.lexsort((np.argsort(np.argsort(names.astype(str))), np.frombuffer(b"".join(index["cells"]), "<u2")))
        index, names = index.iloc[order], names[order]
        x, q = _matrix(index["unit"]), _matrix(asks["unit"])
        packed = np.frombuffer(b"".join(index["code"]), np.uint8).reshape(len(index), -1)
        codes = np.empty((len(index), _PARTS), dtype=np.uint8)
        codes[:, 0::2], codes[:, 1::2] = packed >> 4, packed & 15
        residual = np.linalg.norm(x - np.concatenate([books[m][codes[:, m]] for m in range(_PARTS)], axis=1), axis=1)
        held = np.frombuffer(b"".join(index["cells"]), "<u2")
        asked = np.frombuffer(b"".join(asks["cells"]), "<u2")
        asker = np.repeat(np.arange(len(asks)), [len(c) // 2 for c in asks["cells"]])
        asker = asker[np.argsort(asked, kind="stable")]
        asked = np.sort(asked, kind="stable")
        found = []
        for cell in np.unique(held):
            a, b = np.searchsorted(held, [cell, cell + 1])
            who = asker[slice(*np.searchsorted(asked, [cell, cell + 1]))]
            tile = max(1, min(TOGETHER, 4_000_000 // (b - a)))
            for at in range(0, len(who), tile):
                some = who[at : at + tile]
                query, row, cosine = _best_in_cell(x[a:b], codes[a:b], residual[a:b], q[some], books)
                found.append((some[query], row + a, cosine))
        if not found:
            return none
        query, row, cosine = (np.concatenate(c) for c in zip(*found))
        other = own[query] != names[row]
        query, row, cosine = query[other], row[other], cosine[other]
        by_name = np.empty(len(names), np.int64)
        by_name[np.argsort(names.astype(str), kind="stable")] = np.arange(len(names))
        order = np.lexsort((by_name[row], -cosine, query))
        query, row, cosine = query[order], row[order], cosine[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        best = place < NEIGHBOURS
        return pd.DataFrame({"gid": own[query[best]], "other": names[row[best]], "cosine": cosine[best]})

    return run


def neighbour_groups(groups: DataFrame, exact: bool = False) -> DataFrame:
    """(gid, other, cosine): for each distinct vector the most similar other ones found, of at least the cosine."""
    n = groups.count()
    none = groups.sparkSession.createDataFrame([], "gid string, other string, cosine double")
    if not n:
        return none
    # Hashed ids give the same sample whatever the partitioning. The hash is finer than any table, so the sample is SAMPLE on average at any size.
    bound = int(min(1.0, SAMPLE / n) * (1 << 62))
    drawn = groups.filter(F.pmod(F.xxhash64("gid"), F.lit(1 << 62)) <= bound).select("gid", "unit").collect()
    drawn = sorted(drawn or groups.select("gid", "unit").limit(SAMPLE).collect(), key=lambda r: r["gid"])
    x = _matrix([r["unit"] for r in drawn])
    cells = int(np.clip(CELLS * np.sqrt(n), 1, min(MOST_CELLS, len(x))))
    centres = _kmeans(x, cells, 10, 7, spherical=True)
    books = train_codebooks(x)
    some = np.random.default_rng(5).permutation(len(x))[:QUERIES]
    seen = stored(groups.select("gid", "unit").mapInPandas(_measured(centres, [drawn[k]["gid"] for k in some], x[some]), "cell long, held long, query long, cosine double, place long"))
    held = np.zeros(cells, np.int64)
    for r in seen.filter("cell IS NOT NULL").groupBy("cell").agg(F.sum("held").alias("held")).collect():
        held[r["cell"]] = r["held"]
    first = Window.partitionBy("query").orderBy(F.desc("cosine"), "place")
    truth = seen.filter("query IS NOT NULL").withColumn("k", F.row_number().over(first)).filter(F.col("k") <= NEIGHBOURS).select("place").collect()
    probes = cells if exact else _probes([r["place"] for r in truth], cells)
    group_of = _groups_of(centres, held)
    of_group = np.bincount(group_of, weights=held).astype(np.int64)
    blocks = np.maximum(1, -(-of_group // BLOCK))
    # Askers of a group as the sample has them: they only decide into how many parts its work is cut.
    near = np.unique(np.arange(len(x))[:, None] * len(of_group) + group_of[_nearest(x, centres, probes)])
    askers = np.maximum(1, np.ceil(np.bincount(near % len(of_group), minlength=len(of_group)) * (n / len(x)) / ASKERS)).astype(np.int64)
    rows = groups.select("gid", "unit").mapInPandas(_assigned(centres, books, probes, group_of, blocks, askers), "cell_group long, block long, part long, gid string, unit binary, code binary, cells binary")
    found = rows.groupBy("cell_group", "block", "part").applyInPandas(_searched(books), "gid string, other string, cosine double")
    best = Window.partitionBy("gid").orderBy(F.desc("cosine"), "other")
    return found.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= NEIGHBOURS).drop("k")


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From a distinct vector's smallest ids and its neighbours' ids: each id's nearest."""
    for pdf in batches:
        out = []
        for own, others in zip(pdf["ids"], pdf["others"]):
            more = sorted(((-o["cosine"], i) for o in (others if others is not None else ()) for i in o["ids"]))
            for i in own:
                near = [(1.0, j) for j in own if j != i][:NEIGHBOURS]
                near += [(-c, j) for c, j in more[: NEIGHBOURS - len(near)]]
                out += [(i, j, c) for c, j in near]
        yield pd.DataFrame(out, columns=["id", "neighbour", "cosine"])


def nearest(vectors: DataFrame, exact: bool = False) -> DataFrame:
    """(id, neighbour, cosine): up to NEIGHBOURS nearest of each id of ``vectors`` (id, vector), of at least the cosine."""
    unit = vectors.select("id", "vector").mapInArrow(_unit, "id string, unit binary").groupBy("id").agg(F.max("unit").alias("unit"))
    unit = stored(unit)
    # A vector shared by however many ids carries its smallest NEIGHBOURS + 1: no neighbour list needs more of them.
    place = F.row_number().over(Window.partitionBy("unit").orderBy("id"))
    first = unit.withColumn("k", place).filter(F.col("k") <= NEIGHBOURS + 1)
    groups = stored(first.groupBy("unit").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("gid", F.col("ids")[0]))
    found = stored(neighbour_groups(groups, exact))
    other = groups.select(F.col("gid").alias("other"), F.col("ids").alias("other_ids"))
    lists = found.join(other, "other").groupBy("gid").agg(F.collect_list(F.struct("cosine", F.col("other_ids").alias("ids"))).alias("others"))
    named = groups.select("gid", "ids").join(lists, "gid", "left").select("ids", "others").mapInPandas(_listed, "id string, neighbour string, cosine double")
    # Ids beyond the first of a shared vector: their nearest are the first ones.
    crowded = groups.filter(F.size("ids") > NEIGHBOURS).select("unit", F.slice("ids", 1, NEIGHBOURS).alias("near"), F.col("ids")[NEIGHBOURS].alias("last"))
    rest = skew_join(unit, crowded, "unit", F.col("id")).filter(F.col("id") > F.col("last")).select("id", F.explode("near").alias("neighbour"), F.lit(1.0).alias("cosine"))
    return named.unionByName(rest)


def similar_pairs(vectors: DataFrame, exact: bool = False) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of which at least one is among the other's nearest."""
    near = nearest(vectors, exact).filter(F.col("cosine") >= LEAST_COSINE)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
