"""Encoding of a corpus with the public byte-level BPE vocabulary.

The vocabulary is serialised into a sentencepiece BPE model without any training: each token's bytes
become one printable character each, its score is its negative rank, and text is not normalised.
Pre-tokens are byte-mapped and encoded by that model; decoding is the inverse mapping.

Defined results: null and empty texts give an empty list; strings that look like special tokens are
plain text; a text of any length is encoded whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: How text is split before the merges; a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens whose ids a worker remembers.
REMEMBERED = 400_000


def byte_characters() -> list[str]:
    """The printable character of each byte: itself where printable in Latin-1, else the next from U+0100."""
    out, extra = [], 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes | float) -> bytes:
    """One protobuf field: an integer, a float, or bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialised_model(vocabulary: str) -> bytes:
    """A sentencepiece model of a byte-level BPE vocabulary file; ids are kept, one unknown piece follows at the end."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    special = {t["content"] for t in spec.get("added_tokens", ())}
    size = max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", ()))]) + 1
    pieces: list[tuple[bytes, float, int]] = [(f"<unused{k}>".encode(), 0.0, 5) for k in range(size)]
    for token, rank in vocab.items():
        pieces[rank] = (token.encode(), -float(rank), 3 if token in special else 1)
    for t in spec.get("added_tokens", ()):
        pieces[t["id"]] = (t["content"].encode(), 0.0, 3)
    pieces.append((b"<unk>", 0.0, 2))
    out = b"".join(_field(1, _field(1, p) + _field(2, s) + _field(3, k)) for p, s, k in pieces)
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, size)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return out + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes texts with a serialised model."""

    def __init__(self, model: bytes) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(PATTERN).findall
        chars = byte_characters()
        self.to_chars = {b: c for b, c in enumerate(chars)}
        self.to_byte = {c: b for b, c in enumerate(chars)}
        self.known: dict[str, list[int]] = {}

    def encode(self, texts: Iterable[str | None]) -> list[list[int]]:
        split = [self.split(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({w for words in split for w in words}.difference(self.known))
        mapped = [w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_chars) for w in new]
        self.known.update(zip(new, self.model.encode(mapped, num_threads=1)))
        known = self.known
        return [[i for w in words for i in known[w]] for words in split]

    def decode(self, ids: Iterable[int]) -> str:
        chars = "".join(self.model.id_to_piece([int(i) for i in ids]))
        return bytes(self.to_byte[c] for c in chars).decode("utf-8", "replace")


def _batches(model: bytes, key: str, text: str, sizes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = codec.encode(part.column(1).to_pylist())
                lengths = np.array([len(x) for x in ids], dtype=np.int32)
                if sizes:
                    value = pa.array(lengths)
                else:
                    flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(lengths.sum()))
                    value = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), value], names=[key, "n_tokens" if sizes else "ids"])

    return run


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS) -> DataFrame:
    """(key, ids) of each row."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(_batches(serialised_model(f"{tokenizers}/{VOCABULARY}"), key, text, False), f"{key} {kind}, ids array<int>")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS) -> DataFrame:
    """(key, n_tokens) of each row."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(_batches(serialised_model(f"{tokenizers}/{VOCABULARY}"), key, text, True), f"{key} {kind}, n_tokens int")


def decoded(rows: DataFrame, key: str = "doc_id", ids: str = "ids", tokenizers: str = TOKENIZERS) -> DataFrame:
    """(key, text) of each row of ids; null ids give null."""
    model = serialised_model(f"{tokenizers}/{VOCABULARY}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in batches:
            texts = [None if x is None else codec.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return rows.select(key, ids).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, text string")
