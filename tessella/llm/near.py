"""Near-duplicate records with small edits, by a parity-sketch join.

The tokens of a text are its runs of five letters, marks and numbers. XOR-hashing them into bits gives
a sketch whose Hamming distance never exceeds the symmetric difference of two token sets; the number of
bits follows the band a text's size lies in, and wider sketches fold onto narrower ones by XOR.

Candidates come from joining blocks of a second sketch. Plain pigeonhole blocks can't be used at this
similarity: with up to 35 % of the tokens differing, blocks that must not all differ would hold fewer
than three tokens each and join nearly everything. So each block XORs the least tokens of BLOCK of the
BINS bins of a round, which makes two blocks equal with probability J^BLOCK whatever the sizes. Texts of
one language share blocks by chance, in numbers that grow with the square of the table. So each entry
carries its round's mark, a bit of the least token of each of MARKED bins; texts at J = 0.30 mostly differ
in over MARKS_APART bits, and such pairs go where the blocks are joined. By simulation of independent bins,
a pair at J = 0.70 is missed in all ROUNDS rounds once in 2,300, one at 0.75 once in 500,000. Candidates
pass the sizes, then the Hamming bound of the sketches (both exact), then the true similarity.

``exact=True`` finds candidates without any chance of a miss: two sets of this similarity share one of
the first n - ceil(SIMILARITY·n) + 1 tokens of each in any common order, so these prefixes, rarest first, are
joined instead of blocks, without marks. It costs some ninety entries and more a text, where blocks cost 72.

Texts of equal letters form one class; only one row per class and task enters the join, so a text that
a third of all rows share costs no more than any other. A block that more than RUN_LIMIT classes share is
cut into tiles of TILE by TILE classes, which go to tasks of their own and put out only those pairs that
pass the sizes and the Hamming bound.

Defined results: null, blank and short texts take no part; a repeated id is one record; exact copies are
pairs too; equal similarity needs no tie-break, as every pair is returned; very long texts are taken
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import strings
from tessella.llm.copies import hash_texts
from tessella.runtime import hot_keys, skew_join, stored

SIMILARITY, LEAST, RUN = 0.70, 220, 5
BLOCK, BINS, ROUNDS = 6, 72, 6
BLOCKS = BINS // BLOCK * ROUNDS
#: Bins of a round that give a bit of its mark each, and bits of two marks that may differ.
MARKED, MARKS_APART = 64, 13
#: Block entries that are joined at once, pairs that are held at once, classes of a block from which it is cut into tiles, classes of a tile's side.
ENTRIES, PAIRS, RUN_LIMIT, TILE = 400_000, 2_000_000, 1_000, 2_000
#: Counters that order tokens by how rare they are, where prefixes are joined.
COUNTERS = 1 << 20
#: Ids of linked texts up to which they are sent to every task, to leave unlinked texts where they are; more are joined by a shuffle.
BROADCAST_IDS = 100_000
#: Steps a factor e of a set's size has in a class's short code, whose upper ten bits they are; the rest is its hash.
_STEPS, _HASH_BITS = 32, 30
_BATCH = 1000


class _Kept(dict):
    """Drops everything but letters, marks and numbers in str.translate."""

    def __missing__(self, c: int) -> int | None:
        self[c] = c if unicodedata.category(chr(c))[0] in "LMN" else None
        return self[c]


_kept = _Kept()


def letters(text: str | None) -> str:
    """The part of a text that counts: lower-cased letters, marks and numbers."""
    return text.lower().translate(_kept) if text else ""


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def tokens(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct token hashes of each text (letters only)."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < RUN:
        return [np.empty(0, dtype=np.uint64) for _ in texts]
    h = np.zeros(len(codes) - RUN + 1, dtype=np.uint64)
    for j in range(RUN):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + len(h)] + np.uint64(1)
    h = mixed(h)
    ends = np.cumsum(sizes)
    return [np.unique(h[b - n : b - RUN + 1]) if n >= RUN else np.empty(0, dtype=np.uint64) for n, b in zip(sizes, ends)]


def sketch_bits(size: int) -> int:
    """Bits of the sketch of a token set: by its size band, at least 1.7 bits a token."""
    return 1 << max(9, int(np.ceil(np.log2(1.7 * max(size, 1)))))


def parity_sketch(hashes: np.ndarray) -> bytes:
    """One bit per place: the parity of the tokens that hash to it."""
    bits = sketch_bits(len(hashes))
    places = (mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """The Hamming distance of two sketches, the wider one folded: at most the symmetric difference of the sets."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def most_difference(a: int, b: int, similarity: float = SIMILARITY) -> int:
    """The largest symmetric difference at which sets of these sizes can have the similarity."""
    return int(np.floor((a + b) * (1 - similarity) / (1 + similarity) + 1e-9))


def block_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row per set of BLOCKS 64-bit blocks."""
    return _sketched(sets)[0]


def _sketched(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One row per set of BLOCKS 64-bit blocks, and one of the ROUNDS 64-bit marks."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    out, marks = [], []
    none = np.uint64(np.iinfo(np.uint64).max)
    for r in range(ROUNDS):
        x = mixed(flat ^ np.uint64(0x9E3779B97F4A7C15 * (r + 1) & (1 << 64) - 1))
        place = ((x >> np.uint64(40)) * np.uint64(BINS) >> np.uint64(24)).astype(np.int64)
        least = np.full(len(sets) * BINS, none, dtype=np.uint64)
        np.minimum.at(least, owner * BINS + place, x)
        least = mixed(least + np.tile(np.arange(BINS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), len(sets)))
        blocks = np.bitwise_xor.reduce(least.reshape(len(sets), BINS // BLOCK, BLOCK), axis=2)
        out.append(mixed(blocks + np.arange(r * 64 + 1, r * 64 + 1 + BINS // BLOCK, dtype=np.uint64)[None, :]))
        bits = (least.reshape(len(sets), BINS)[:, :MARKED] >> np.uint64(63)).astype(np.uint8)
        marks.append(np.packbits(bits, axis=1, bitorder="little").view("<u8"))
    return np.concatenate(out, axis=1), np.concatenate(marks, axis=1)


def _class_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1


def short_code(cls: int, size: int) -> int:
    """Forty bits that stand for a class while blocks are joined: its size band and a part of its hash."""
    return min(1023, round(np.log(size) * _STEPS)) << _HASH_BITS | cls & (1 << _HASH_BITS) - 1


def _taking_part(pdf: pd.DataFrame) -> Iterator[tuple[list, list[str]]]:
    ids, texts = [], []
    for i, t in zip(pdf["id"], strings(pdf["content"])):
        t = letters(t)
        if i is not None and len(t) >= LEAST:
            ids.append(i)
            texts.append(t)
    for k in range(0, len(ids), _BATCH):
        yield ids[k : k + _BATCH], texts[k : k + _BATCH]


def _members(prefix_of):
    """Rows (id, class, code, size, sketch, blocks, marks); only a class's first row in a task has blocks. Blocks take six bytes each; prefixes have no marks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in batches:
            for ids, texts in _taking_part(pdf):
                sets, own = tokens(texts), [_class_of(t) for t in texts]
                fresh = [k for k, c in enumerate(own) if c not in seen and not seen.add(c)]
                blocks: list = [None] * len(own)
                marks: list = [None] * len(own)
                if fresh:
                    some = [sets[k] for k in fresh]
                    found, marked = _sketched(some) if prefix_of is None else (map(prefix_of, some), [b""] * len(some))
                    for k, x, m in zip(fresh, found, marked):
                        blocks[k] = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
                        marks[k] = bytes(m)
                if len(seen) > 2_000_000:
                    seen.clear()
                yield pd.DataFrame({"id": ids, "class": own, "code": [short_code(c, len(s)) for c, s in zip(own, sets)], "size": [len(s) for s in sets], "sketch": [parity_sketch(s) for s in sets], "blocks": blocks, "marks": marks})

    return run


def _entries(parts: int):
    """Block entries of members, packed by the part of all blocks that they belong to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), _BATCH):
                own = pdf.iloc[at : at + _BATCH]
                wide = np.zeros((sum(map(len, own["blocks"])) // 6, 8), dtype=np.uint8)
                wide[:, :6] = np.frombuffer(b"".join(own["blocks"]), np.uint8).reshape(-1, 6)
                blocks, counts = wide.view("<u8").ravel(), [len(x) // 6 for x in own["blocks"]]
                codes = np.repeat(own["code"].to_numpy(np.uint64), counts)
                marks = np.zeros(len(blocks), dtype="<u8")
                if any(map(len, own["marks"])):
                    marks[:] = np.repeat(np.frombuffer(b"".join(own["marks"]), "<u8"), BINS // BLOCK)
                part = (blocks >> np.uint64(24)) % np.uint64(parts)
                # Five bytes of class, three of block and eight of mark an entry; of the rest of the block, the part's number is left.
                order = np.argsort(part, kind="stable")
                low = np.empty((len(order), 16), dtype=np.uint8)
                low[:, :5] = codes[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                low[:, 5:8] = wide[order, :3]
                low[:, 8:] = marks[order].view(np.uint8).reshape(-1, 8)
                there, edges = np.unique(part[order], return_index=True)
                edges = np.append(edges, len(order))
                yield pd.DataFrame({"part": there.astype(np.int32), "entries": [low[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]})

    return run


def _paired(part: int, packed: list[bytes], run_limit: int) -> Iterator[pd.DataFrame]:
    """Pairs (a, b) of classes of a part that share a block; of blocks shared by too many, the entries (a, block)."""
    raw = np.frombuffer(b"".join(packed), "<u8").reshape(-1, 2)
    # The first word is the block above the class.
    order = np.argsort(raw[:, 0], kind="stable")
    word, mark = raw[order, 0], raw[order, 1]
    new = np.ones(len(word), dtype=bool)
    new[1:] = (word[1:] != word[:-1]) | (mark[1:] != mark[:-1])
    word, mark = word[new], mark[new]
    block, cls = word >> np.uint64(40), (word & np.uint64((1 << 40) - 1)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    runs = np.diff(np.concatenate([starts, [len(block)]]))
    hot = np.repeat(runs > run_limit, runs)
    if hot.any():
        yield pd.DataFrame({"a": cls[hot], "b": None, "block": [f"{part}:{x}" for x in block[hot]]})
    place = np.arange(len(block)) - np.repeat(starts, runs)
    place[hot] = 0
    # Each entry pairs with those before it in its run: sorted by class, so the smaller class comes first.
    upto = np.cumsum(place)
    at = 0
    while at < len(place):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
        own = place[at:end]
        first = np.repeat(np.arange(at, end), own)
        other = first - 1 - (np.arange(len(first)) - np.repeat(np.cumsum(own) - own, own))
        near = np.flatnonzero(np.bitwise_count(mark[first] ^ mark[other]) <= MARKS_APART)
        a, b = cls[other[near]], cls[first[near]]
        # Codes begin with the size, so pairs of sizes too far apart show at once (one step of slack for rounding).
        close = ((b >> _HASH_BITS) - (a >> _HASH_BITS) <= np.log(1 / SIMILARITY) * _STEPS + 1) & (a != b)
        if close.any():
            pairs = np.unique(np.stack([a[close], b[close]], axis=1), axis=0)
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "block": None})
        at = end


def _joined(run_limit: int):
    """Over rows sorted by part: what ``_paired`` gives for each part, one part in memory at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, packed = None, []
        for pdf in batches:
            for part, entries in zip(pdf["part"], pdf["entries"]):
                if part != now and packed:
                    yield from _paired(now, packed, run_limit)
                    packed = []
                now = part
                packed.append(entries)
        if packed:
            yield from _paired(now, packed, run_limit)

    return run


def _folded(sketches: np.ndarray, width: int) -> np.ndarray:
    while sketches.shape[1] > width:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a tile that pass the sizes and the Hamming bound. A tile on the diagonal holds each class once."""
    out = []
    inner = pdf["low"].iloc[0] == pdf["high"].iloc[0]
    pdf = pdf.sort_values("class")
    sides = (pdf, pdf) if inner else (pdf[pdf["own"] == pdf["low"]], pdf[pdf["own"] == pdf["high"]])
    by_width = [{w: (g.reset_index(drop=True), np.frombuffer(b"".join(g["sketch"]), np.uint8).reshape(len(g), w)) for w, g in side.groupby(side["sketch"].map(len))} for side in sides]
    for wa, (left, x) in by_width[0].items():
        for wb, (right, y) in by_width[1].items():
            width = min(wa, wb)
            x8, y8 = (np.ascontiguousarray(_folded(z, width)).view("<u8") for z in (x, y))
            m, n = left["size"].to_numpy(np.int64), right["size"].to_numpy(np.int64)
            ca, cb = left["class"].to_numpy(np.int64), right["class"].to_numpy(np.int64)
            step = max(1, PAIRS // max(1, len(right) * x8.shape[1]))
            for at in range(0, len(left), step):
                far = np.bitwise_count(x8[at : at + step, None, :] ^ y8[None, :, :]).sum(axis=2, dtype=np.int64)
                both = m[at : at + step, None] + n[None, :]
                ok = far <= np.floor(both * (1 - SIMILARITY) / (1 + SIMILARITY) + 1e-9)
                if inner:
                    ok &= ca[at : at + step, None] < cb[None, :]
                i, j = np.nonzero(ok)
                out.append(pd.DataFrame({"class_a": ca[at + i], "class_b": cb[j], "rep_a": left["id"].to_numpy()[at + i], "rep_b": right["id"].to_numpy()[j]}))
    none = pd.DataFrame({"class_a": np.empty(0, np.int64), "class_b": np.empty(0, np.int64), "rep_a": np.empty(0, object), "rep_b": np.empty(0, object)})
    return pd.concat([none, *out])


def _bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ok = np.zeros(len(pdf), dtype=bool)
        a, b = pdf["sketch_a"].to_numpy(), pdf["sketch_b"].to_numpy()
        both = (pdf["size_a"] + pdf["size_b"]).to_numpy(np.int64)
        for (wa, wb), at in pdf.groupby([pdf["sketch_a"].map(len), pdf["sketch_b"].map(len)]).indices.items():
            step = max(1, PAIRS * 8 // max(wa, wb))
            for own in (at[k : k + step] for k in range(0, len(at), step)):
                x, y = (_folded(np.frombuffer(b"".join(z[own]), np.uint8).reshape(len(own), w), min(wa, wb)) for z, w in ((a, wa), (b, wb)))
                far = np.bitwise_count(np.ascontiguousarray(x).view("<u8") ^ np.ascontiguousarray(y).view("<u8")).sum(axis=1, dtype=np.int64)
                ok[own] = far <= np.floor(both[own] * (1 - SIMILARITY) / (1 + SIMILARITY) + 1e-9)
        yield pdf.loc[ok, ["class_a", "class_b", "rep_a", "rep_b"]]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ok = []
        for k in range(0, len(pdf), _BATCH):
            part = pdf.iloc[k : k + _BATCH]
            left, right = (tokens([letters(t) for t in part[c]]) for c in ("content_a", "content_b"))
            ok += [jaccard(x, y) >= SIMILARITY - 1e-12 for x, y in zip(left, right)]
        yield pdf.loc[ok, ["class_a", "class_b"]]


_NEAR = "class_a long, class_b long, rep_a string, rep_b string"


def _within_sizes() -> Column:
    return (F.col("size_a") >= SIMILARITY * F.col("size_b") - 1e-9) & (F.col("size_b") >= SIMILARITY * F.col("size_a") - 1e-9)


def class_pairs(members: DataFrame) -> DataFrame:
    """(class_a, class_b, rep_a, rep_b): classes of ``members`` that share a block and pass the bounds, with their smallest ids."""
    there = members.filter("blocks IS NOT NULL")
    parts = max(1, -(-(there.agg(F.sum(F.length("blocks"))).first()[0] or 0) // (6 * ENTRIES)))
    entries = there.select("code", "blocks", "marks").mapInPandas(_entries(parts), "part int, entries binary")
    found = stored(entries.repartition("part").sortWithinPartitions("part").mapInPandas(_joined(RUN_LIMIT), "a long, b long, block string"))
    classes = stored(members.groupBy("class").agg(F.min(F.struct("id", "code", "size", "sketch")).alias("one")).select("class", "one.*"))
    side = lambda s: classes.select(F.col("code").alias(s), F.col("class").alias(f"class_{s}"), F.col("id").alias(f"rep_{s}"), F.col("size").alias(f"size_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    pairs = stored(found.filter("b IS NOT NULL").select("a", "b").distinct())
    near = skew_join(skew_join(pairs, side("a"), "a", F.col("b")), side("b"), "b", F.col("a")).filter(_within_sizes()).mapInPandas(_bound, _NEAR)
    crowded = found.filter("block IS NOT NULL").select("block", F.col("a").alias("code")).distinct()
    tiles = crowded.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    owned = crowded.join(tiles, "block").join(classes, "code").withColumn("own", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int"))
    spread = owned.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = spread.select("block", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "class", "id", "size", "sketch")
    near = near.unionByName(tiled.groupBy("block", "low", "high").applyInPandas(lambda pdf: _tile(pdf), _NEAR))
    # A pair may come from a block and from tiles, in either order of its classes.
    turned = F.col("class_a") > F.col("class_b")
    ordered = near.select(*[F.when(turned, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{x}") for x, y in ("ab", "ba") for c in ("class", "rep")])
    return stored(ordered.distinct())


def _texts_of(docs: DataFrame, members: DataFrame, near: DataFrame, whole_classes: bool) -> DataFrame:
    """(id, content) of the texts that pairs need: of each class in ``near`` the smallest id, or all ids of all classes that make pairs."""
    reps = near.select(F.col("rep_a").alias("id")).unionAll(near.select(F.col("rep_b").alias("id"))).distinct()
    if whole_classes:
        linked = near.select(F.col("class_a").alias("class")).unionAll(near.select(F.col("class_b").alias("class")))
        several = members.groupBy("class").agg(F.countDistinct("id").alias("n")).filter("n > 1").select("class")
        reps = members.select("id", "class").join(linked.unionAll(several).distinct(), "class", "left_semi").select("id").distinct()
    reps = stored(reps)
    wanted = F.broadcast(reps) if reps.count() <= BROADCAST_IDS else reps
    return docs.select("id", "content").join(wanted, "id", "left_semi").groupBy("id").agg(F.max("content").alias("content"))


def verified(near: DataFrame, texts: DataFrame) -> DataFrame:
    """(class_a, class_b) of the pairs whose texts reach the similarity."""
    one = lambda s: texts.select(F.col("id").alias(f"rep_{s}"), F.col("content").alias(f"content_{s}"))
    both = skew_join(skew_join(near, one("a"), "rep_a", F.col("class_b")), one("b"), "rep_b", F.col("class_a"))
    return both.mapInPandas(_verify, "class_a long, class_b long")


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros(COUNTERS, dtype=np.int64)
    for pdf in batches:
        for _, texts in _taking_part(pdf):
            for own in tokens(texts):
                counts += np.bincount((own & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
    at = np.flatnonzero(counts)
    yield pd.DataFrame({"counter": at, "n": counts[at]})


def _prefixes(docs: DataFrame):
    """A function from a token set to the prefix that it must share with any set of the similarity. Rarity is counted over all texts, in COUNTERS numbers."""
    counts = np.zeros(COUNTERS, dtype=np.int64)
    rows = docs.select("id", "content").mapInPandas(_counted, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    counts[rows["counter"]] = rows["n"]

    def prefix_of(own: np.ndarray) -> np.ndarray:
        order = np.lexsort((own, counts[(own & np.uint64(COUNTERS - 1)).astype(np.int64)]))
        return own[order[: len(own) - int(np.ceil(SIMILARITY * len(own) - 1e-9)) + 1]]

    return prefix_of


def memberships(docs: DataFrame, exact: bool = False) -> DataFrame:
    """(id, class, code, size, sketch, blocks, marks) of every text long enough, from one pass over the texts."""
    schema = "id string, class long, code long, size int, sketch binary, blocks binary, marks binary"
    return stored(docs.select("id", "content").mapInPandas(_members(_prefixes(docs) if exact else None), schema))


def _copy_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        stream, listed = hash_texts(list(pdf["content"]))
        yield pd.DataFrame({"id": pdf["id"], "copy": [str(h) for h in stream], "fields": pd.array(listed, dtype="Int64")})


def links(docs: DataFrame, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(id, class) of every text long enough, and the (class_a, class_b) whose texts reach the similarity."""
    members = memberships(docs, exact)
    near = class_pairs(members)
    return members.select("id", "class").distinct(), stored(verified(near, stored(_texts_of(docs, members, near, False))))


def near_classes(docs: DataFrame, exact: bool = False) -> DataFrame:
    """(id, class_id, links): for every text long enough the smallest id of those with the same letters, and how many other such texts are similar to it.

    This form has one row a text however many copies there are.
    """
    ids, found = links(docs, exact)
    named = ids.groupBy("class").agg(F.min("id").alias("class_id"))
    ends = found.select(F.col("class_a").alias("class")).unionAll(found.select(F.col("class_b").alias("class")))
    counted = named.join(ends.groupBy("class").agg(F.count(F.lit(1)).alias("links")), "class", "left").fillna(0, ["links"])
    return skew_join(ids, counted, "class", F.col("id")).select("id", "class_id", "links")


def near_duplicates(docs: DataFrame, without_copies: bool = False, exact: bool = False) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of ``docs`` (id, content) that reach the similarity.

    ``without_copies`` leaves out pairs that are equal apart from formatting; they are never made.
    """
    members = memberships(docs, exact)
    near = class_pairs(members)
    texts = stored(_texts_of(docs, members, near, without_copies))
    found = stored(verified(near, texts))
    ids = members.select("id", "class").distinct()
    if without_copies:
        ids = texts.mapInPandas(_copy_hashes, "id string, copy string, fields long").join(ids, "id")
    else:
        ids = ids.select("id", F.col("id").alias("copy"), F.lit(None).cast("long").alias("fields"), "class")  # no text is a copy of another
    ids = stored(ids)
    left, right = (ids.select(F.col("id").alias(f"id_{s}"), F.col("class").alias(f"class_{s}"), F.col("copy").alias(f"copy_{s}"), F.col("fields").alias(f"fields_{s}")) for s in "ab")
    hot = hot_keys(ids, "class")
    across = skew_join(right, skew_join(left, found, "class_a", F.col("id_a"), hot=hot), "class_b", F.col("id_b"), hot=hot)
    # Only classes whose texts aren't all copies of each other make pairs of their own.
    several = ids.groupBy("class").agg(F.min("copy").alias("low"), F.max("copy").alias("high")).filter("low < high").select(F.col("class").alias("class_a"))
    inside = skew_join(left, several, "class_a", F.col("id_a"), hot=hot)
    within = skew_join(right, inside.withColumnRenamed("class_a", "class_b"), "class_b", F.col("id_b"), hot=hot).filter("id_a < id_b")
    pairs = across.unionByName(within.withColumn("class_a", F.col("class_b"))).filter("id_a != id_b AND copy_a != copy_b AND NOT coalesce(fields_a = fields_b, false)")
    return pairs.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
