"""Splitting of documents into chunks: fixed, by sentences, recursive, markdown, semantic, with context."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.errors import InvalidArgument, ProtocolError
from tessella.functions.vectors import cosine
from tessella.model import SPACE, blank, guarded, some_id, trimmed

SEPARATORS = ("\n\n", "\n", " ")
MARKS = ".!?。！？"


@dataclass(frozen=True)
class Sizes:
    """Chunk size and overlap in code points, and separators from coarse to fine."""

    size: int
    overlap: int = 0
    separators: tuple[str, ...] = SEPARATORS

    def __post_init__(self) -> None:
        if not self.separators:
            object.__setattr__(self, "separators", SEPARATORS)
        if self.size <= 0 or not 0 <= self.overlap < self.size:
            raise InvalidArgument("size must be positive and overlap less than it")


def sources(docs: DataFrame, strict: bool = False) -> DataFrame:
    """Documents that can be split. ``strict`` fails the query on one without id or text instead of leaving it out."""
    if strict:
        return guarded(docs, (some_id(), "MissingSourceID: document"), (~blank(F.col("content")), "EmptyText: document"))
    return docs.filter(some_id() & ~blank(F.col("content")))


def as_chunks(split: DataFrame, parts: str = "parts") -> DataFrame:
    """Chunks (id, source_id, index, content, context, attributes) from an array of parts; blank parts leave gaps in the index."""
    each = split.select(F.col("id").alias("source_id"), "attributes", F.posexplode(parts).alias("index", "content")).filter(~blank(F.col("content")))
    return each.select(F.concat_ws("_", "source_id", "index").alias("id"), "source_id", "index", "content", F.lit("").alias("context"), "attributes")


def fixed_windows(text: Column, sizes: Sizes) -> Column:
    """Windows of ``size`` code points every ``size - overlap``, trimmed; the first to reach the end is the last."""
    step = sizes.size - sizes.overlap
    count = F.greatest(F.lit(1), F.ceil((F.char_length(text) - sizes.overlap) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: trimmed(F.substring(text, i * step + 1, F.lit(sizes.size))))


def sentences(text: Column) -> Column:
    """Sentences by their final marks alone, trimmed, blanks dropped; the rest of a text is its last one."""
    cut = F.regexp_extract_all(text, F.lit(f"([^{MARKS}]*[{MARKS}]|[^{MARKS}]+$)"), 1)
    return F.filter(F.transform(cut, trimmed), lambda s: s != "")


def chunk_fixed(docs: DataFrame, sizes: Sizes) -> DataFrame:
    # A projection of its own: inside the windows' lambda the text would be trimmed once for each window.
    texts = sources(docs).select("id", "attributes", trimmed(F.col("content")).alias("_text"))
    return as_chunks(texts.select("id", "attributes", fixed_windows(F.col("_text"), sizes).alias("parts")))


def chunk_sentences(docs: DataFrame) -> DataFrame:
    return as_chunks(sources(docs).select("id", "attributes", sentences(F.col("content")).alias("parts")))


def _gathered(text: str, separator: str, size: int) -> list[str]:
    """Neighbouring pieces between separators joined while they fit. A piece that makes the join too long stands alone."""
    pieces = text.split(separator)
    if len(pieces) == 1:
        return pieces
    groups: list[list[str]] = []
    room = -1  # code points left in the last group; -1 opens a new one
    for p in (p.strip(SPACE) for p in pieces):
        if not p:
            continue
        need = len(p) + len(separator)
        if room >= need:
            groups[-1].append(p)
            room -= need
        elif room < 0 and len(p) <= size:
            groups.append([p])
            room = size - len(p)
        else:
            groups.append([p])
            room = -1
    return [separator.join(g) for g in groups]


def _windows(text: str, sizes: Sizes) -> list[str]:
    step = sizes.size - sizes.overlap
    last = max(0, -(-(len(text) - sizes.size) // step))
    return [text[k * step : k * step + sizes.size].strip(SPACE) for k in range(last + 1)]


def recursive_parts(text: str, sizes: Sizes) -> list[str]:
    """Parts generation by generation: what fits is done, what doesn't is split by the next separator, so order is by depth."""
    out: list[str] = []
    generation = [text.strip(SPACE)]
    for separator in sizes.separators:
        out += [t for t in generation if t and len(t) <= sizes.size]
        generation = [p for t in generation if len(t) > sizes.size for p in _gathered(t, separator, sizes.size)]
    for t in generation:
        if t:
            out += [t] if len(t) <= sizes.size else _windows(t, sizes)
    return out


def markdown_sections(text: str) -> list[str]:
    """Stretches of lines of which each but the first begins at a heading."""
    lines = text.split("\n")
    heads = [k for k, line in enumerate(lines) if k and line.strip(SPACE).startswith("#")]
    return ["\n".join(lines[a:b]) for a, b in zip([0, *heads], [*heads, len(lines)])]


def markdown_parts(text: str, sizes: Sizes) -> list[str]:
    return [p for section in markdown_sections(text) for p in recursive_parts(section, sizes)]


def _split_in_python(docs: DataFrame, split: Callable[[str], list[str]]) -> DataFrame:
    """Only (id, content) go to Python and rows come back already exploded; attributes are joined on by Spark's own struct column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, a, k, p) for i, a, t in zip(pdf["id"], pdf["attributes"], pdf["content"]) for k, p in enumerate(split(t)) if p.strip(SPACE)]
            yield pd.DataFrame(rows, columns=["source_id", "attributes", "index", "content"])

    packed = sources(docs).select("id", F.to_json("attributes").alias("attributes"), "content")
    kind = docs.schema["attributes"].dataType
    out = packed.mapInPandas(run, "source_id string, attributes string, index int, content string")
    return out.select(F.concat_ws("_", "source_id", "index").alias("id"), "source_id", "index", "content", F.lit("").alias("context"), F.from_json("attributes", kind).alias("attributes"))


def chunk_recursive(docs: DataFrame, sizes: Sizes) -> DataFrame:
    return _split_in_python(docs, lambda t: recursive_parts(t, sizes))


def chunk_markdown(docs: DataFrame, sizes: Sizes) -> DataFrame:
    return _split_in_python(docs, lambda t: markdown_parts(t, sizes))


def checked_embeddings(sentences: Sequence[str], vectors: Sequence[Sequence[float]]) -> np.ndarray:
    """Embeddings of sentences as a matrix, if there is one of the same size for each and none is zero."""
    if not len(sentences):
        raise ProtocolError("no sentences")
    if len(vectors) != len(sentences) or len({len(v) for v in vectors}) != 1 or not len(vectors[0]):
        raise ProtocolError("embeddings don't fit the sentences")
    x = np.asarray(vectors, dtype=np.float64)
    if not (np.linalg.norm(x, axis=1) > 0).all():
        raise ProtocolError("zero embedding")
    return x


def semantic_groups(vectors: Column, threshold: float, least: int, newton_steps: int | None = None) -> Column:
    """The number of each sentence's group: a new one begins where the last has ``least`` sentences and the neighbours' cosine is under the threshold."""
    if not -1 <= threshold <= 1 or least <= 0:
        raise InvalidArgument("threshold must be in [-1, 1] and least positive")
    first = F.struct(F.array(F.lit(0)).alias("groups"), F.lit(1).alias("held"))
    later = F.when(F.size(vectors) > 1, F.sequence(F.lit(1), F.size(vectors) - 1)).otherwise(F.array().cast("array<int>"))

    def add(state: Column, i: Column) -> Column:
        cut = (state["held"] >= least) & (cosine(vectors[i - 1], vectors[i], newton_steps) < threshold)
        last = F.element_at(state["groups"], -1)
        return F.struct(F.concat(state["groups"], F.array(last + cut.cast("int"))).alias("groups"), F.when(cut, 1).otherwise(state["held"] + 1).alias("held"))

    return F.aggregate(later, first, add, lambda s: s["groups"])


def groups_of(x: np.ndarray, threshold: float, least: int) -> list[int]:
    """The same over a matrix."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit[1:] * unit[:-1]).sum(axis=1)
    out, held = [0], 1
    for s in near:
        cut = held >= least and s < threshold
        out.append(out[-1] + cut)
        held = 1 if cut else held + 1
    return out


def chunk_semantic(docs: DataFrame, embed: Callable[[list[str]], Sequence[Sequence[float]]], threshold: float, least: int = 1, segment: Callable[[Column], Column] = sentences) -> DataFrame:
    """Neighbouring sentences joined by a space while their embeddings stay similar. ``embed`` runs once per batch of documents."""
    if not -1 <= threshold <= 1 or least <= 0:
        raise InvalidArgument("threshold must be in [-1, 1] and least positive")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            flat = [s for own in pdf["sentences"] for s in own]
            if not flat:
                continue
            x, at, rows = checked_embeddings(flat, embed(flat)), 0, []
            for i, attributes, own in zip(pdf["id"], pdf["attributes"], pdf["sentences"]):
                if not len(own):
                    raise ProtocolError("no sentences")
                groups = groups_of(x[at : at + len(own)], threshold, least)
                at += len(own)
                joined: dict[int, list[str]] = {}
                for g, s in zip(groups, own):
                    joined.setdefault(g, []).append(s)
                rows.append((i, attributes, [" ".join(p) for p in joined.values()]))
            yield pd.DataFrame(rows, columns=["id", "attributes", "parts"])

    cut = sources(docs).select("id", F.to_json("attributes").alias("attributes"), segment(F.col("content")).alias("sentences"))
    parts = cut.mapInPandas(run, "id string, attributes string, parts array<string>")
    return as_chunks(parts.withColumn("attributes", F.from_json("attributes", docs.schema["attributes"].dataType)))


def with_context(chunks: DataFrame, docs: DataFrame, context: Callable[[Column, Column], Column]) -> DataFrame:
    """Chunks with a context made of their source and themselves; a chunk without its source keeps the context it has."""
    source = docs.select(F.col("id").alias("source_id"), F.col("content").alias("_source"), F.lit(True).alias("_there"))
    joined = chunks.join(source, "source_id", "left")
    made = F.when(F.col("_there"), context(F.col("_source"), F.col("content"))).otherwise(F.col("context"))
    return joined.withColumn("context", made).drop("_source", "_there").select(*chunks.columns)


def in_order(chunks: DataFrame) -> DataFrame:
    """Chunks of one source together and by index: one shuffle by source, no sort over all of them."""
    return chunks.repartition("source_id").sortWithinPartitions("source_id", "index")


def first_line(source: Column, content: Column) -> Column:
    """A context that needs no model: the source's first line, whole."""
    return trimmed(F.regexp_extract(trimmed(source), r"^[^\n\r]*", 0))
