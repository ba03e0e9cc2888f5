"""Splitting of oversized texts at natural boundaries, with overlap.

Every offset of a text is joined to its farthest legal successor: the next cut if a cut were there.
Squaring this table (pointer doubling) marks all cuts that the greedy walk from the start reaches,
in as many rounds as the logarithm of their number, for all texts of a batch at once.

Defined results: null, blank and small contents have no cut (one piece in ``split_texts``); a
repeated id is one record; a text without any boundary is cut every ``limit - overlap`` code points;
texts are cut whole whatever their length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import WS, code_points
from tessella.llm.sentences import MODEL_ROWS, _BLANK, sentence_spans, train, with_model
from tessella.runtime import stored

LIMIT, OVERLAP = 1200, 120
_SPACES = np.array(sorted(map(ord, WS)), dtype=np.uint32)


def _last_upto(marks: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """For each offset 0..n: the value of the last boundary whose piece ends at or before it, or -1."""
    out = np.full(n + 1, -1, dtype=np.int64)
    np.maximum.at(out, marks, values)
    return np.maximum.accumulate(out)


def cuts(text: str, sentence_ends: Callable[[], list[tuple[int, int]]], limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """Offsets of all cuts of a text; empty if it fits."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    stripped = text.strip(WS)
    if len(stripped) <= limit:
        return []
    start = len(text) - len(text.lstrip(WS))
    stop = start + len(stripped)
    n = stop
    white = np.isin(code_points(text[:stop]), _SPACES)
    # Runs of white space inside the text: a piece ends where one begins, the next cut is where it ends.
    edge = np.diff(white.astype(np.int8))
    run_from, run_to = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    run_from, run_to = run_from[run_from > start], run_to[run_to > start]
    begins = {int(a): int(b) for a, b in zip(run_from, run_to)}
    blank = [m.start() for m in _BLANK.finditer(text, start, stop)]
    blank_ends = []
    for b in blank:
        k = int(np.searchsorted(run_to, b, side="right"))
        blank_ends.append(int(run_from[k]))
    ends = [b for _, b in sentence_ends() if start < b < stop]
    kinds = []
    for marks in (blank_ends, ends):
        at = np.array(sorted(set(marks)), dtype=np.int64)
        kinds.append(_last_upto(at, np.array([begins.get(int(x), int(x)) for x in at], dtype=np.int64), n) if len(at) else None)
    kinds.append(_last_upto(run_from, run_to, n) if len(run_from) else None)
    # The successor of a cut at every offset; the walk begins at a virtual cut whose piece begins at ``start``.
    here = np.arange(n + 1, dtype=np.int64)
    succ = np.full(n + 1, n, dtype=np.int64)
    done = np.zeros(n + 1, dtype=bool)
    begin = here - overlap
    begin[:start + 1] = start
    begin[start] = start
    fits = n - begin <= limit
    done |= fits
    reach = np.minimum(begin + limit, n)
    for kind in kinds:
        if kind is not None:
            best = kind[reach]
            ok = ~done & (best > here)
            succ[ok] = best[ok]
            done |= ok
    succ[~done] = np.minimum(begin + limit, n)[~done]
    marked = np.zeros(n + 1, dtype=bool)
    marked[start] = True
    reached = np.array([start], dtype=np.int64)
    jump = succ
    while True:
        new = jump[reached]
        new = new[~marked[new]]
        if not len(new):
            break
        marked[new] = True
        reached = np.concatenate([reached, new])
        jump = jump[jump]
    marked[start] = marked[n] = False
    return [int(x) for x in np.flatnonzero(marked)]


def _cut_rows(key: str, text: str, has: Callable[[str], bool]) -> list[tuple[str, int]]:
    return [(key, c) for c in cuts(text, lambda: sentence_spans(text, has))]


def _piece_rows(key: str, text: str, has: Callable[[str], bool]) -> list[tuple[str, int, str, int, int]]:
    at = cuts(text, lambda: sentence_spans(text, has))
    start, stop = len(text) - len(text.lstrip(WS)), len(text.rstrip(WS))
    # A cut near the beginning has less before it to repeat.
    begins = [start, *[max(start, c - OVERLAP) for c in at]]
    return [(key, k, text[b : (at[k] if k < len(at) else stop)].rstrip(WS), b, at[k - 1] - b if k else 0) for k, b in enumerate(begins)]


def _applied(docs: DataFrame, rows: Callable, schema: str, limit: int) -> DataFrame:
    docs = stored(docs.select("id", "content").filter(F.col("content").isNotNull()))
    return with_model(docs, train(docs), rows, schema, limit)


def cut_points(docs: DataFrame, limit: int = MODEL_ROWS) -> DataFrame:
    """(id, cut_at) of every cut of every text over the limit; sentence ends come from the model of all ``docs``."""
    return _applied(docs, _cut_rows, "id string, cut_at long", limit)


def split_texts(docs: DataFrame, limit: int = MODEL_ROWS) -> DataFrame:
    """The pieces as chunks: (source_id, index, content, start_at, overlap); a text that fits is its only piece.

    ``overlap`` is how many code points at a piece's beginning are the end of the one before.
    """
    return _applied(docs, _piece_rows, "source_id string, index int, content string, start_at long, overlap int", limit)
