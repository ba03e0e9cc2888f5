"""Embedding providers behind one interface, run as Arrow-batched functions.

A provider turns a batch of inputs into (index, vector) pairs. The pairs must name each input once;
results are put back in input order. HTTP providers build their requests here and take the transport as
a function, so tests and offline runs need no network.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.errors import EmptyText, InvalidArgument, ProtocolError, classified, from_status
from tessella.model import guarded, valid_input
from tessella.operators.ranking import permuted

#: POST: (url, headers, body) in, (status, body) out.
Transport = Callable[[str, dict[str, str], dict[str, Any]], tuple[int, bytes]]
Embed = Callable[[list], list]

# Paths, where results are and what they are called, per provider and capability.
ROUTES = {
    ("openai", "dense"): ("/embeddings", "data", "embedding", "header"),
    ("jina", "dense"): ("/embeddings", "data", "embedding", "header"),
    ("gemini", "dense"): ("/models/{model}:embed", "embeddings", "vector", "query"),
    ("jina", "tensor"): ("/tensor", "data", "tensor", "header"),
    ("gemini", "multimodal"): ("/models/{model}:embedMultimodal", "embeddings", "vector", "query"),
    ("cohere", "rerank"): ("/rerank", "results", "relevance_score", "header"),
}


# Where the providers are unless told otherwise.
BASE_URLS = {"openai": "https://api.openai.com/v1", "jina": "https://api.jina.ai/v1", "gemini": "https://generativelanguage.googleapis.com/v1beta", "cohere": "https://api.cohere.com/v2"}


def valid_parts(parts: list | None) -> bool:
    """``valid_input`` over one input that isn't in Spark: parts with kind, text, bytes, mime and url."""
    some = lambda p, name: bool(p.get(name)) and (not isinstance(p[name], str) or bool(p[name].strip()))
    forms = {"text": ({"text"}, {"bytes", "mime", "url"}), "bytes": ({"bytes", "mime"}, {"text", "url"}), "url": ({"url"}, {"text", "bytes"})}

    def valid(part: object) -> bool:
        p = part.asDict() if hasattr(part, "asDict") else dict(part)
        has, lacks = forms.get(p.get("kind"), (None, None))
        return has is not None and all(some(p, n) for n in has) and not any(p.get(n) for n in lacks) and (p["kind"] != "url" or bool(urlsplit(p["url"]).scheme))

    return bool(parts) and all(map(valid, parts))


@dataclass(frozen=True)
class Provider:
    """A configured HTTP provider of one capability."""

    name: str
    capability: str
    key: str
    model: str
    base_url: str = ""
    transport: Transport | None = None

    def __post_init__(self) -> None:
        if (self.name, self.capability) not in ROUTES:
            raise InvalidArgument(f"{self.name} has no {self.capability}")
        for what in ("key", "model"):
            if not getattr(self, what).strip():
                raise InvalidArgument(f"{what} is blank")
        if not self.base_url.strip():
            object.__setattr__(self, "base_url", BASE_URLS[self.name])
        if self.transport is None:
            raise InvalidArgument("a provider needs a transport")

    def call(self, payload: dict[str, Any], n: int) -> list:
        """Send a request about ``n`` inputs; values come back in input order."""
        path, where, what, auth = ROUTES[self.name, self.capability]
        url = self.base_url.rstrip("/") + path.format(model=self.model)
        headers = {"Content-Type": "application/json"}
        if auth == "header":
            headers["Authorization"] = f"Bearer {self.key}"
        else:
            url += f"?key={self.key}"
        try:
            status, body = self.transport(url, headers, payload)
        except Exception as e:
            raise classified(e) from e
        if not 200 <= status < 300:
            raise from_status(status, body)
        try:
            return permuted(n, [(r["index"], r[what]) for r in json.loads(body)[where]])
        except (ValueError, KeyError, TypeError) as e:
            raise ProtocolError(f"malformed response: {e}") from e

    def embed(self, inputs: list) -> list:
        if self.capability == "multimodal":
            if not inputs or not all(map(valid_parts, inputs)):
                raise InvalidArgument("multimodal input")
        elif not inputs or any(not t or not t.strip() for t in inputs):
            raise EmptyText("embedding input")
        values = self.call({"model": self.model, "input" if self.capability != "multimodal" else "inputs": inputs}, len(inputs))
        if any(not v for v in values):
            raise ProtocolError("empty embedding")
        return values

    def rerank(self, query: str, texts: list[str]) -> list[tuple[int, float]]:
        if not query.strip():
            raise EmptyText("query")
        if not texts:
            return []
        return list(enumerate(self.call({"model": self.model, "query": query, "documents": texts}, len(texts))))


def hashed_embedder(dim: int = 64, seed: int = 0) -> Embed:
    """A deterministic embedder that needs no model: signed hashes of words, scaled to unit length; never zero."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for k, t in enumerate(texts):
            for w in (t or "").lower().split() or [""]:
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
                out[k, h % dim] += 1 if h >> 32 & 1 else -1
            if not out[k].any():
                out[k, 0] = 1
        return (out / np.linalg.norm(out, axis=1, keepdims=True)).astype(np.float32).tolist()

    return embed


def embedded(df: DataFrame, embed: Embed, column: str = "content", output: str = "vector", tensor: bool = False, batch: int = 512) -> DataFrame:
    """``df`` with an embedding of each text; null texts have none. Each call of the provider sees at most ``batch`` texts."""
    kind = "array<array<float>>" if tensor else "array<float>"

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            out: list = [None] * len(s)
            at = [k for k, t in enumerate(s) if isinstance(t, str)]
            for a in range(0, len(at), batch):
                part = at[a : a + batch]
                for k, v in zip(part, embed([s.iloc[k] for k in part]), strict=True):
                    out[k] = v
            yield pd.Series(out)

    return df.withColumn(output, F.pandas_udf(run, kind)(F.col(column)))


def embedded_inputs(df: DataFrame, embed: Embed, column: str = "parts", output: str = "vector", batch: int = 64) -> DataFrame:
    """``df`` with an embedding of each multimodal input; an invalid input fails the query before any call."""
    valid = guarded(df, (valid_input(F.col(column)), "InvalidArgument: multimodal input"))
    rest = [c for c in df.columns if c != column]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch]
                yield part[rest].assign(**{output: embed([list(p) for p in part[column]])})

    fields = [df.schema[c] for c in rest]
    return valid.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", {output} array<float>")


