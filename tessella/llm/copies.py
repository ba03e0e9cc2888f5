"""Duplicates hidden by formatting.

A table over code points says what to skip (white space, punctuation, symbols) and what to fold
(full case folding). Texts stream through it, block by block, into polynomial hashes. A list of named
fields has a second hash that adds up one for each name and value, so that their order doesn't count.
Only ids and hashes are shuffled; contents move only where a hash is shared. Rows of an equal first hash
are verified against the smallest id by comparing both streams with a pointer into each, skipping as the
hash did; lists of an equal second hash likewise, field by field.

Marks between two digits and a sign directly before a number count. Format characters, marks and
everything else that isn't white space, punctuation or a symbol count as they are.

A list of named fields is JSON (nested objects and arrays too, where only the order of an object's members
doesn't count), tags, or at least two parts, each a name, a separator and a value, between line ends,
semicolons, bars, commas or ampersands. Names begin with a letter and may be of any length. A text that could
be either is both: as prose it is a copy of what has the same stream, as a list of what has the same fields.

Defined results: null and blank contents take no part; contents of nothing but punctuation are copies
of each other; a repeated id is one record, its last version; ties can't occur, the smallest id is kept;
hash collisions are told apart (rows that collide with a smaller id are grouped by a digest of their stream);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import WS, code_points, strings
from tessella.runtime import hot_keys, latest, skew_join, stored

_TABLE = 0x20000  # above it lie only letters, marks and unassigned code points, which stay as they are
_KEEP, _SKIP, _SPACE, _DIGIT, _WIDE = range(5)
_SIGNS = np.array([ord(c) for c in "+-−±＋－"], dtype=np.uint32)
_PRIMES = (2147483647, 2147483629)
_BASES = (1_000_003_511, 700_000_931)
_BLOCK = 1 << 16
#: Code points that are hashed at once.
_BUNDLE = 1 << 18
#: Fields that make a list.
MIN_FIELDS = 2
#: Hashes or ids up to which they are sent to every task, to leave all other contents where they are.
BROADCAST_KEYS = 100_000


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
    """What each code point is; what it folds to; those that fold to several."""
    kind = np.zeros(_TABLE, dtype=np.uint8)
    fold = np.arange(_TABLE, dtype=np.uint32)
    wide: dict[int, list[int]] = {}
    for c in range(_TABLE):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        cat = unicodedata.category(ch)
        if ch in WS or cat[0] == "Z":
            kind[c] = _SPACE
        elif cat[0] in "PS":
            kind[c] = _SKIP
        elif cat == "Nd":
            kind[c] = _DIGIT
        else:
            low = ch.casefold()
            if len(low) > 1:
                kind[c] = _WIDE
                wide[c] = [ord(x) for x in low]
            else:
                fold[c] = ord(low)
    return kind, fold, wide


def _kept(codes: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """Which code points count. ``first`` marks where a new text begins; neighbours don't reach over it."""
    kind, _, _ = _tables()
    kinds = np.where(codes < _TABLE, kind[np.minimum(codes, _TABLE - 1)], _KEEP)
    keep = (kinds != _SKIP) & (kinds != _SPACE)
    digit = kinds == _DIGIT
    before, after, word = np.zeros(len(codes), bool), np.zeros(len(codes), bool), np.zeros(len(codes), bool)
    before[1:], after[:-1], word[1:] = digit[:-1], digit[1:], keep[:-1]
    if first is not None and len(first):
        before[first] = word[first] = False
        after[first[first > 0] - 1] = False
    mark = kinds == _SKIP
    keep |= mark & before & after
    keep |= mark & after & ~word & np.isin(codes, _SIGNS)
    return keep


def _folded(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Folded code points, and how many each became if any became several."""
    kind, fold, wide = _tables()
    low = np.where(codes < _TABLE, fold[np.minimum(codes, _TABLE - 1)], codes)
    many = np.flatnonzero((codes < _TABLE) & (kind[np.minimum(codes, _TABLE - 1)] == _WIDE))
    if not len(many):
        return low, None
    counts = np.ones(len(codes), dtype=np.int64)
    counts[many] = [len(wide[int(c)]) for c in codes[many]]
    out = np.repeat(low, counts)
    at = np.cumsum(counts) - counts
    for k in many:
        out[at[k] : at[k] + counts[k]] = wide[int(codes[k])]
    return out, counts


@lru_cache(maxsize=32)
def _powers(base: int, prime: int, size: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    step = base
    while len(out) < size:
        out = np.concatenate([out, out * np.uint64(step) % np.uint64(prime)])
        step = step * step % prime
    return out


def hash_segments(segments: list[str]) -> np.ndarray:
    """A 62-bit hash of each segment's counting code points. Memory is bounded whatever their sizes."""
    out = np.zeros(len(segments), dtype=np.uint64)
    held, size = [], 0
    for k, s in enumerate(segments):
        if len(s) > _BUNDLE:
            out[k] = _hash_stream(s)
            continue
        held.append(k)
        size += len(s)
        if size > _BUNDLE:
            out[held] = _hash_bundle([segments[k] for k in held])
            held, size = [], 0
    if held:
        out[held] = _hash_bundle([segments[k] for k in held])
    return out


def _hash_stream(text: str) -> int:
    """The hash of a long text, rolled on from block to block."""
    sums, shifts = [0, 0], [1, 1]
    for block in _stream(text):
        for j, (base, prime) in enumerate(zip(_BASES, _PRIMES)):
            terms = (block.astype(np.uint64) + np.uint64(1)) * _powers(base, prime, 1 << max(0, len(block) - 1).bit_length())[: len(block)] % np.uint64(prime)
            sums[j] = (sums[j] + int(terms.sum(dtype=np.uint64)) % prime * shifts[j]) % prime
            shifts[j] = shifts[j] * pow(base, len(block), prime) % prime
    return sums[0] << 31 | sums[1]


def _hash_bundle(segments: list[str]) -> np.ndarray:
    sizes = np.array([len(s) for s in segments], dtype=np.int64)
    if not sizes.sum():
        return np.zeros(len(segments), dtype=np.uint64)
    codes = code_points("".join(segments))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(segments)), sizes)
    keep = _kept(codes, starts[sizes > 0])
    owner = owner[keep]
    low, counts = _folded(codes[keep])
    if counts is not None:
        owner = np.repeat(owner, counts)
    ends = np.searchsorted(owner, np.arange(len(segments) + 1))
    place = np.arange(len(owner)) - ends[owner]
    size = 1 << int(max(1, place.max() + 1 if len(place) else 1) - 1).bit_length()
    out = np.zeros(len(segments), dtype=np.uint64)
    for base, prime in zip(_BASES, _PRIMES):
        terms = (low.astype(np.uint64) + np.uint64(1)) * _powers(base, prime, size)[place] % np.uint64(prime)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
        out = out << np.uint64(31) | (sums[ends[1:]] - sums[ends[:-1]]) % np.uint64(prime)
    return out


_NAME = r"[^\W\d](?:[\w .\-/()']*[\w)'])?"
_PART = re.compile(rf"[^\w]*+(?:\d+[.)]\s+[^\w]*+)?({_NAME})[\"'`*\]]*\s*(?:=>|:=|->|[=:：＝])\s*(\S.*|)$", re.S)
_ROW = re.compile(rf"[^\w]*+({_NAME})\s*[|\t]\s*([^\s|].*?)[\s|]*$", re.S)
_TAG = re.compile(r"<([^\W\d][\w.\-]*)>([^<>]*)</\1>")
_TAGS = re.compile(r"</?[^<>]*>")
_BROKEN = re.compile(r"[\r\n]+")


def _flat(value: object, path: str, out: list[tuple[str, str]]) -> None:
    """The leaves of a JSON value by their paths. Objects come as tuples of pairs, so that repeated names stay."""
    if isinstance(value, tuple):
        for k, v in value:
            _flat(v, f"{path} {k}" if path else k, out)
    elif isinstance(value, list):
        for k, v in enumerate(value):
            _flat(v, f"{path} {k}", out)
    else:
        out.append((path, value if isinstance(value, str) else json.dumps(value)))


def fields(text: str) -> list[tuple[str, str]] | None:
    """The named fields a text consists of, in any of the usual notations; None if it is no such list."""
    t = text.strip(WS)
    if len(t) < 5 or not any(c in t for c in ":=|<\t：＝"):
        return None
    if t[0] in "{[" and t[-1] in "}]":
        try:
            got = json.loads(t, object_pairs_hook=tuple, parse_float=str, parse_int=str)
        except (ValueError, RecursionError):
            got = None
        if got is not None:
            leaves: list[tuple[str, str]] = []
            try:
                _flat(got, "", leaves)
            except RecursionError:
                return None
            return leaves if len(leaves) >= MIN_FIELDS and any(k for k, _ in leaves) else None
    if t[0] == "<" and (tags := _TAG.findall(t)) and len(tags) >= MIN_FIELDS and not _TAGS.sub("", _TAG.sub("", t)).strip(WS):
        return tags
    best: list[tuple[str, str]] | None = None
    for cut in ("\n", ";", "|", ",", "&"):
        # Most prose shows by what stands before the first cut; only likely lists are taken apart.
        first = re.search(r"[\r\n]" if cut == "\n" else re.escape(cut), t)
        head = t[: first.start()].strip(WS) if first else ""
        if not first or head and not (_PART.match(head) or cut == "\n" and _ROW.match(head)):
            continue
        parts = [p for p in (_BROKEN.split(t) if cut == "\n" else t.split(cut)) if p.strip(WS)]
        if len(parts) < max(MIN_FIELDS, len(best or ()) + 1):
            continue
        for shape in (_PART, _ROW) if cut == "\n" else (_PART,):
            got = []
            for p in parts:
                if not (m := shape.match(p.strip(WS))):
                    break
                got.append(m.groups())
            if len(got) == len(parts) and any(v for _, v in got):
                best = got
                break
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_texts(texts: list[str]) -> tuple[np.ndarray, list[int | None]]:
    """Of each text a hash of its stream, and one of its fields if it is a list of such; equal for copies."""
    segments, spans = list(texts), []
    for t in texts:
        at = len(segments)
        for k, v in fields(t) or ():
            segments += (k, v)
        spans.append((at, len(segments)))
    with np.errstate(over="ignore"):
        mixed = _mix(hash_segments(segments))
        listed = [_mix(_mix(mixed[a:b:2] * np.uint64(3) + mixed[a + 1 : b : 2]).sum(dtype=np.uint64) + np.uint64(b - a)).astype(np.int64) if b > a else None for a, b in spans]
    return mixed[: len(texts)].view(np.int64), [None if h is None else int(h) for h in listed]


def _stream(text: str) -> Iterator[np.ndarray]:
    """A text's counting code points, block by block."""
    for at in range(0, max(len(text), 1), _BLOCK):
        left, right = max(0, at - 1), min(len(text), at + _BLOCK + 1)
        codes = code_points(text[left:right])
        keep = _kept(codes)
        keep[: at - left] = False
        keep[len(codes) - (right - min(len(text), at + _BLOCK)) :] = False
        yield _folded(codes[keep])[0]


def _same_stream(a: str, b: str) -> bool:
    """Compare two texts by a pointer into each, skipping what doesn't count."""
    if a == b:
        return True
    left, right = _stream(a), _stream(b)
    x = y = np.empty(0, dtype=np.uint32)
    while True:
        while not len(x) and (n := next(left, None)) is not None:
            x = n
        while not len(y) and (n := next(right, None)) is not None:
            y = n
        size = min(len(x), len(y))
        if not size:
            return not len(x) and not len(y)
        if not np.array_equal(x[:size], y[:size]):
            return False
        x, y = x[size:], y[size:]


def same_fields(a: str, b: str) -> bool:
    """Whether two texts are lists of the same fields."""
    left, right = fields(a), fields(b)
    if left is None or right is None or len(left) != len(right):
        return False
    order = []
    for named in (left, right):
        h = hash_segments([x for pair in named for x in pair])
        order.append([named[k] for k in np.lexsort((h[1::2], h[::2]))])
    return all(_same_stream(k, m) and _same_stream(v, w) for (k, v), (m, w) in zip(*order))


def same(a: str, b: str) -> bool:
    """Whether two texts are copies."""
    return _same_stream(a, b) or same_fields(a, b)


def _digest(text: str) -> str:
    h = hashlib.blake2b(digest_size=16)
    for block in _stream(text):
        h.update(block.astype(np.uint32).tobytes())
    return h.hexdigest()


def _hash_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = [t if t and t.strip(WS) else None for t in strings(pdf["content"])]
        at = [k for k, t in enumerate(texts) if t]
        stream, listed = hash_texts([texts[k] for k in at])
        out = pd.DataFrame({"id": pdf["id"], "version": pdf["version"], "content": texts, "h": pd.array([None] * len(texts), dtype="Int64"), "f": pd.array([None] * len(texts), dtype="Int64")})
        out.iloc[at, 3], out.iloc[at, 4] = pd.array(stream, dtype="Int64"), pd.array(listed, dtype="Int64")
        yield out


def _verify_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        digests = [None if _same_stream(a, b) else _digest(a) for a, b in zip(pdf["content"], pdf["kept"])]
        yield pd.DataFrame({"id": pdf["id"], "h": pdf["h"], "digest": digests})


def _verify_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ok = np.array([same_fields(a, b) for a, b in zip(pdf["content"], pdf["kept"])], dtype=bool)
        yield pdf.loc[ok, ["h", "first_h"]]


def _contents(hashed: DataFrame, ids: DataFrame, hashes: DataFrame) -> DataFrame:
    """(id, h, content) of the wanted ids, whose hashes are ``hashes``: few hashes are sent to every task, so that no other content is shuffled."""
    wanted = stored(hashes.distinct())
    some = hashed.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted, "h", "left_semi")
    return some.join(ids.select("id", "version"), ["id", "version"], "left_semi").groupBy("id", "h").agg(F.max("content").alias("content"))


def _roots(edges: DataFrame) -> DataFrame:
    """(h, root): for each hash at an edge (h, first_h) one hash that all connected to it have in common."""
    edges = stored(edges)
    # A stream is mostly in one list's group: then its edges are stars, whose centres are the roots.
    several = edges.groupBy("h").agg(F.count_distinct("first_h").alias("n")).filter("n > 1").select("h")
    if several.unionAll(edges.select("h").join(edges.select(F.col("first_h").alias("h")), "h", "left_semi")).isEmpty():
        return edges.select("h", F.col("first_h").alias("root")).unionAll(edges.select("first_h", "first_h")).distinct()
    both = stored(edges.unionAll(edges.select(F.col("first_h").alias("h"), F.col("h").alias("first_h"))).distinct())
    labels = both.groupBy("h").agg(F.least("h", F.min("first_h")).alias("root"))
    while True:
        labels = stored(labels)
        told = both.join(labels.select(F.col("h").alias("first_h"), F.col("root").alias("_other")), "first_h").groupBy("h").agg(F.min("_other").alias("_other"))
        after = labels.join(told, "h").select("h", F.least("root", "_other").alias("root"), (F.col("_other") < F.col("root")).alias("_new"))
        after = stored(after)
        if after.filter("_new").isEmpty():
            return labels
        labels = after.select("h", "root")


def copies(docs: DataFrame, lists: bool = True) -> DataFrame:
    """(keep_id, copy_id) for every record of ``docs`` (id, content, perhaps ingested_at) that has the same content as one of smaller id.

    Without ``lists`` all contents are prose.
    """
    version = F.coalesce(F.unix_micros(F.col("ingested_at").cast("timestamp")), F.lit(0)) if "ingested_at" in docs.columns else F.lit(0)
    rows = docs.filter("id IS NOT NULL").select("id", version.cast("long").alias("version"), "content")
    hashed = stored(rows.mapInPandas(_hash_batches, "id string, version long, content string, h long, f long"))
    own = stored(hashed.groupBy("id").agg(F.max(F.struct("version", "h", "f")).alias("v")).select("id", "v.*").filter("h IS NOT NULL"))
    if not lists:
        own = own.withColumn("f", F.lit(None).cast("long"))
    hot = hot_keys(own, "h")
    groups = stored(own.groupBy("h").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "keep_id"))
    # Lists: of each stream that is one, its smallest id stands for it.
    listed = own.filter("f IS NOT NULL").groupBy("f", "h").agg(F.min("id").alias("id"), F.max("version").alias("version"))
    firsts = listed.groupBy("f").agg(F.min(F.struct("id", "h")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("f", F.col("first.id").alias("first_id"), F.col("first.h").alias("first_h"))
    listed = stored(skew_join(listed, firsts, "f", F.col("h"), hot=hot_keys(own, "f")))
    members = skew_join(own, groups, "h", F.col("id"), hot=hot).select("id", "version", "h")
    named = own.join(listed.select("id").distinct(), "id", "left_semi").select("id", "version", "h")
    texts = stored(_contents(hashed, members.unionByName(named).distinct(), groups.select("h").unionAll(listed.select("h"))))
    kept = texts.join(groups.select(F.col("keep_id").alias("id"), "h"), ["id", "h"]).select("h", F.col("content").alias("kept"))
    rest = skew_join(texts, groups, "h", F.col("id"), hot=hot).filter("id != keep_id")
    checked = stored(skew_join(rest, kept, "h", F.col("id"), hot=hot).select("id", "h", "content", "kept").mapInPandas(_verify_batches, "id string, h long, digest string"))
    # Rows that only collided with the smallest id: groups of their own, by a 128-bit digest.
    apart = checked.filter("digest IS NOT NULL")
    strays = apart.join(apart.groupBy("h", "digest").agg(F.min("id").alias("keep_id")), ["h", "digest"]).filter("id != keep_id").select("keep_id", F.col("id").alias("copy_id"))
    content_of = lambda name, as_: texts.select(F.col("id").alias(name), F.col("content").alias(as_))
    met = listed.filter("id != first_id").join(content_of("id", "content"), "id")
    met = skew_join(met, content_of("first_id", "kept"), "first_id", F.col("id"), hot=hot_keys(listed, "first_id"))
    roots = _roots(met.select("h", "first_h", "content", "kept").mapInPandas(_verify_lists, "h long, first_h long"))
    # Every stream that has copies or is a list found elsewhere, with the smallest stream connected to it.
    streams = groups.select("h").unionAll(roots.select("h")).distinct().join(roots, "h", "left").select("h", F.coalesce("root", "h").alias("root"))
    linked = skew_join(own.select("id", "h"), streams, "h", F.col("id"), hot=hot).join(apart.select("id"), "id", "left_anti").select("id", "root")
    keep = linked.groupBy("root").agg(F.min("id").alias("keep_id"))
    pairs = skew_join(linked, keep, "root", F.col("id"), hot=hot).filter("id != keep_id").select("keep_id", F.col("id").alias("copy_id"))
    return pairs.unionAll(strays)


def distinct_records(docs: DataFrame) -> DataFrame:
    """(id, copies) of every record that is the first of its content; copies counts the record itself."""
    pairs = stored(copies(docs))
    counts = pairs.groupBy(F.col("keep_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    last = latest(docs.filter("id IS NOT NULL").withColumn("_solid", F.length(F.regexp_replace(F.coalesce("content", F.lit("")), f"[{WS}]", "")) > 0), ["id"], ["_solid"])
    solid = last.filter("_solid").select("id")
    return solid.join(pairs, solid["id"] == pairs["copy_id"], "left_anti").join(counts, "id", "left").select("id", (F.coalesce("n", F.lit(0)) + 1).alias("copies"))
