from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import flows, near, neighbours, packing, tokens
from tessella.runtime import stored

ROWS = "id string, content string"
VOCABULARY = f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}"


# Near duplicates


def _text(rng, words=60):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(words))


def _edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        k = rng.randrange(len(words))
        words[k] = rng.choice(["x" + words[k], "", words[k][::-1], words[k] + " new"])
    return " ".join(words)


def _brute(rows):
    sets = {i: set(near.tokens([near.letters(t)])[0].tolist()) for i, t in rows if t and len(near.letters(t)) >= near.LEAST}
    ids = sorted(sets)
    return sorted((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= near.SIMILARITY * len(sets[a] | sets[b]) - 1e-9)


def test_near_duplicates(spark):
    rng = random.Random(5)
    rows = []
    for n in range(40):
        t = _text(rng, rng.choice([50, 60, 200]))
        rows += [(f"{n:03d}{c}", _edited(rng, t, e)) for c, e in zip("abcd", (0, 1, 3, 8))]
    rows += [("same1", rows[0][1]), ("same2", rows[0][1].upper() + "!"), ("null", None), ("short", "abc"), ("empty", ""), rows[3], ("long", _text(rng, 20_000))]
    docs = spark.createDataFrame(rows, ROWS).withColumn("class", F.lit(1))
    want = _brute(dict(rows).items())
    got = sorted(map(tuple, near.near_duplicates(docs).collect()))
    assert got == want and len(want) > 60
    without = sorted(map(tuple, near.near_duplicates(docs, without_copies=True).collect()))
    assert ("same1", "same2") in want and ("same1", "same2") not in without and set(without) < set(want)
    assert near.near_duplicates(docs.limit(0)).count() == 0


def test_hot_texts_enter_the_join_once(spark):
    rng = random.Random(6)
    t = _text(rng)
    docs = spark.createDataFrame([(f"h{k:04d}", t) for k in range(120)] + [("x", _edited(rng, t, 1))], ROWS)
    members = near.memberships(docs)
    assert near.class_pairs(members).count() == 1
    assert near.near_duplicates(docs).count() == 121 * 120 // 2


def test_crowded_blocks_are_cut_into_tiles(spark, monkeypatch):
    """Variants of one template share blocks by the hundreds; tiles find the same pairs, and so do prefixes instead of blocks."""
    rng = random.Random(9)
    template = _text(rng, 60)
    rows = [(f"t{k:03d}", template[: len(template) * (3 + k % 3) // 6] + " " + _text(rng, 20)) for k in range(150)]
    rows += [(f"u{k:03d}", _edited(rng, rows[k][1], 2)) for k in range(40)]
    docs, want = spark.createDataFrame(rows, ROWS), _brute(rows)
    assert sorted(map(tuple, near.near_duplicates(docs, exact=True).collect())) == want and len(want) >= 40
    monkeypatch.setattr(near, "RUN_LIMIT", 5)
    monkeypatch.setattr(near, "TILE", 16)
    assert sorted(map(tuple, near.near_duplicates(docs).collect())) == want
    assert sorted(map(tuple, near.near_duplicates(docs, exact=True).collect())) == want


def test_near_classes_have_one_row_a_text(spark):
    rng = random.Random(10)
    t = _text(rng)
    rows = [(f"h{k}", t) for k in range(5)] + [("g", t.upper()), ("x", _edited(rng, t, 1)), ("alone", _text(rng)), ("short", "abc"), ("null", None), ("x", _edited(rng, t, 1))]
    rows[-1] = rows[6]
    got = {r.id: (r.class_id, r.links) for r in near.near_classes(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {**{f"h{k}": ("g", 1) for k in range(5)}, "g": ("g", 1), "x": ("x", 1), "alone": ("alone", 0)}


@given(st.lists(st.sets(st.integers(0, 400), min_size=1, max_size=300), min_size=2, max_size=4))
@settings(max_examples=60, deadline=None)
def test_sketches_bound_differences(sets):
    arrays = [near.mixed(np.array(sorted(s), dtype=np.uint64)) for s in sets]
    sketches = [near.parity_sketch(a) for a in arrays]
    for s, a in zip(sets, sketches):
        for t, b in zip(sets, sketches):
            assert near.sketch_distance(a, b) <= len(s ^ t)
            if len(s & t) >= 0.7 * len(s | t):
                assert len(s ^ t) <= near.most_difference(len(s), len(t))


def test_block_recall():
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(300):
        core = rng.integers(0, 1 << 63, 280, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([core, rng.integers(0, 1 << 63, 60, dtype=np.uint64)])) for _ in range(2))  # J = 0.7
        x, y = near.block_sketches([a, b])
        missed += not (x == y).any()
    assert missed <= 3


def test_recall_with_marks():
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(1000):
        core = rng.integers(0, 1 << 63, 280, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([core, rng.integers(0, 1 << 63, 60, dtype=np.uint64)])) for _ in range(2))  # J = 0.7
        (x, y), marks = near._sketched([a, b])
        close = np.bitwise_count(marks[0] ^ marks[1]) <= near.MARKS_APART
        missed += not ((x == y).reshape(near.ROUNDS, -1).any(axis=1) & close).any()
    assert missed <= 3


def test_blocks_shared_by_chance_make_no_pairs(spark, monkeypatch):
    rng = random.Random(11)
    phrases = [_text(rng, 6) for _ in range(30)]
    rows = [(f"{n:04d}", ". ".join(rng.sample(phrases, 14))) for n in range(400)]  # a similarity of some 0.3
    rows += [(f"{i}x", _edited(rng, t, 2)) for i, t in rows[:40]]
    docs = spark.createDataFrame(rows, ROWS)
    kept = []
    monkeypatch.setattr(near, "stored", lambda df: kept.append(stored(df)) or kept[-1])
    members = near.memberships(docs)
    got = {(r.rep_a, r.rep_b) for r in near.class_pairs(members).collect()}
    found = next(df for df in kept if df.columns == ["a", "b", "block"])
    assert found.filter("b IS NOT NULL").select("a", "b").distinct().count() < 1_500  # 4,505 of 96,580 pairs share a block of five rounds
    assert sorted(map(tuple, near.near_duplicates(docs).collect())) == _brute(rows)
    assert {(i, f"{i}x") for i, _ in rows[:40]} <= got | {(b, a) for a, b in got}


# Vectors


def _brute_pairs(rows):
    good = {i: np.array(v, dtype=np.float64) for i, v in rows if v is not None and len(v) == 64 and all(e is not None and np.isfinite(e) for e in v) and any(v)}
    ids = sorted(good)
    if not ids:
        return set()
    x = np.array([good[i] / np.linalg.norm(good[i]) for i in ids])
    c = np.round(x @ x.T, 7)
    out = set()
    for k, i in enumerate(ids):
        best = sorted((j for j in range(len(ids)) if j != k), key=lambda j: (-c[k, j], ids[j]))[:10]
        out |= {tuple(sorted((i, ids[j]))) for j in best if c[k, j] >= 0.8}
    return out


def _vectors(seed, groups=40):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.normal(size=64)
        rows += [(f"v{g:03d}{k}", ((centre + rng.normal(size=64) * rng.uniform(0.1, 0.9)) * rng.lognormal(0, 2)).astype(np.float32).tolist()) for k in range(int(rng.integers(1, 16)))]
    return rows


def test_neighbours(spark):
    rows = _vectors(1)
    one = rows[0][1]
    rows += [(f"eq{k:02d}", one) for k in range(30)]
    rows += [("null", None), ("none", []), ("zero", [0.0] * 64), ("short", [1.0] * 63), ("nan", [float("nan")] * 64), ("part", [None] * 64), rows[5]]
    df = spark.createDataFrame(rows, "id string, vector array<float>").withColumn("unit", F.lit(1))
    got = {tuple(r) for r in neighbours.similar_pairs(df).collect()}
    want = _brute_pairs(dict(rows).items())
    assert len(want - got) <= 0.01 * len(want) and not got - want
    assert neighbours.similar_pairs(df.limit(0)).count() == 0
    assert {tuple(r) for r in neighbours.similar_pairs(spark.createDataFrame(rows[:2], "id string, vector array<float>")).collect()} == _brute_pairs(rows[:2])


def test_split_cells_find_the_same(spark, monkeypatch):
    rows = _vectors(2)
    df = spark.createDataFrame(rows, "id string, vector array<float>")
    monkeypatch.setattr(neighbours, "GROUP", 15)
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    monkeypatch.setattr(neighbours, "ASKERS", 50)
    assert {tuple(r) for r in neighbours.similar_pairs(df).collect()} == _brute_pairs(rows)
    assert {tuple(r) for r in neighbours.similar_pairs(df, exact=True).collect()} == _brute_pairs(rows)


def test_crowded_neighbourhoods_lose_nothing():
    """Hundreds of rows within reach of every query: the bound drawn from the first candidates keeps the true nearest."""
    rng = np.random.default_rng(4)
    x = (rng.normal(size=64) * 3 + rng.normal(size=(900, 64)) * rng.uniform(0.1, 1, size=(900, 1))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = neighbours.train_codebooks(x)
    codes = neighbours.encode(x, books)
    residual = np.linalg.norm(x - np.concatenate([books[m][codes[:, m]] for m in range(books.shape[0])], axis=1), axis=1)
    query, row, _ = neighbours._best_in_cell(x, codes, residual, x[:100], books)
    exact = x[:100].astype(np.float64) @ x.T.astype(np.float64)
    exact[np.arange(100), np.arange(100)] = -1
    for k in range(100):
        best = [j for j in np.argsort(-exact[k], kind="stable")[:10] if exact[k, j] >= 0.8]
        assert set(best) <= set(row[query == k].tolist())


def test_quantisation_keeps_scores():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = neighbours.train_codebooks(x)
    codes = neighbours.encode(x, books)
    back = np.concatenate([books[m][codes[:, m]] for m in range(books.shape[0])], axis=1)
    score, scale = neighbours.scan(x[:50], codes, books)
    slack = back.shape[1] // neighbours.STEP // 4 / scale + 1e-5
    assert np.abs(score / scale - back @ x[:50].T).max() <= slack < 0.02
    residual = x - back
    assert (np.abs(score / scale - x @ x[:50].T) <= np.linalg.norm(residual, axis=1)[:, None] + slack).all()  # so nothing within reach is skipped
    along = (residual * x).sum(axis=1)
    across = np.linalg.norm(residual, axis=1)
    assert np.abs(along).mean() < 0.25 * across.mean()  # score-aware: little of the residual lies along the vector


# Rankings


def _beats(lists, a, b):
    common = [s for s in lists.values() if a in s and b in s]
    return bool(common) and 2 * sum(s[a] > s[b] for s in common) > len(common)


def test_flows_and_first_places(spark, monkeypatch):
    rng = random.Random(3)
    rows, want = [], {}
    for q in range(12):
        items = [f"i{k:02d}" for k in range(rng.randint(4, 60))]
        lists = {}
        for n in range(5):
            scale = 10 ** rng.randint(-3, 4)
            lists[n] = {i: scale * (rng.random() + (k < 3) * (n < 3) * 2 - (k < 3) * (n >= 3) * 2) for k, i in enumerate(items) if k < 3 or n < 3 or rng.random() < 0.9}
        rows += [(q, n, i, s) for n, own in lists.items() for i, s in own.items()]
        want[q] = {a for a in items if sum(not _beats(lists, a, b) for b in items if b != a) <= 2}
    rows += [(0, 0, "none", None), (0, 1, "nan", float("nan")), (99, 0, "solo", 1.0), rows[0]]
    df = spark.createDataFrame(rows, "query_id long, list_no int, id string, relevance double").withColumn("flow", F.lit(0))
    df = flows.scores_of(df)
    for together in (64, 4):  # 4: a knock-out in blocks of 24, the least for three places
        monkeypatch.setattr(flows, "TOGETHER", together)
        got: dict = {}
        for r in flows.first_places(df).collect():
            got.setdefault(r.query_id, set()).add(r.id)
        assert {q: s for q, s in got.items() if q != 99} == want and got[99] == {"solo"}
        first = {(r.query_id, r.id) for r in flows.ranking(df).filter("position <= 3").collect()}
        assert first == {(q, i) for q, own in got.items() for i in own}
    whole = {(r.query_id, r.list_no, r.id): (r.flow, r.percentile) for r in flows.list_flows(df).collect()}
    monkeypatch.setattr(flows, "ROWS", 7)
    parts = {(r.query_id, r.list_no, r.id): (r.flow, r.percentile) for r in flows.list_flows(df).collect()}
    assert whole == parts
    values: dict = {}
    for q, n, i, s in set(rows):
        if s is not None and s == s:
            values.setdefault((q, n), {})[i] = s
    for (q, n), own in values.items():
        for i, s in own.items():
            flow = sum((s > t) - (s < t) for t in own.values()) / max(1, len(own) - 1)
            assert abs(whole[q, n, i][0] - flow) < 1e-12
    assert flows.first_places(df.limit(0)).count() == 0
    assert flows.ranking(df).filter("position = 1").count() == 13 and flows.ranking(df, {0: 2.0}).count() == df.filter("relevance IS NOT NULL AND NOT isnan(relevance)").select("query_id", "id").distinct().count()


def test_a_cyclic_query_of_any_size_ends(spark):
    """No item leads where all majorities form a cycle; places go by net flow. All rows are one query."""
    n = 6000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("query_id"), F.concat(F.lit("i"), F.lpad("id", 5, "0")).alias("id"), F.explode(F.array(*[F.struct(F.lit(k).alias("list_no"), F.pmod(F.col("id") + F.lit(k * n // 3), F.lit(n)).cast("double").alias("relevance")) for k in range(3)])).alias("s"))
    df = rows.select("query_id", "id", "s.list_no", "s.relevance")
    assert flows.leaders(flows.weighed(flows.list_flows(df), None)).count() == 0
    assert [r.position for r in flows.first_places(df).orderBy("position").collect()] == [1, 2, 3]
    assert sorted(r.position for r in flows.ranking(df).collect()) == list(range(1, n + 1))


def test_ties_are_no_preference(spark):
    df = spark.createDataFrame([(1, n, i, 1.0) for n in (0, 1) for i in "cab"], "query_id long, list_no int, id string, relevance double")
    assert [(r.id, r.flow) for r in flows.ranking(df).orderBy("position").collect()] == [("a", 0.0), ("b", 0.0), ("c", 0.0)]


# Tokens and containers


@pytest.fixture(scope="module")
def codec():
    return tokens.Codec(tokens.serialised_model(VOCABULARY))


TEXTS = ["", "<|endoftext|> x", " a  b\n\n\t", "I'LL it's", "日本語 ไทย नमस्ते", "\x00\x1c\x85​", "a" * 30_000, "👩‍💻🇪🇺", "<unk>", "▁x ▁"]


def test_ids_equal_the_public_tokenizer(codec):
    library = pytest.importorskip("tokenizers")
    public = library.Tokenizer.from_file(VOCABULARY)
    public.encode_special_tokens = True
    rng = random.Random(4)
    texts = TEXTS + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x600), rng.randrange(0x4E00, 0x5000)])) for _ in range(50)) for _ in range(200)]
    assert codec.encode(texts) == [e.ids for e in public.encode_batch(texts, add_special_tokens=False)]


@given(st.lists(st.text(max_size=30), max_size=4))
@settings(max_examples=200, deadline=None)
def test_round_trip(codec, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert [codec.decode(x) for x in codec.encode(texts)] == texts


def test_encoded_tables(spark):
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate([*TEXTS, None])], "doc_id long, text string, ids int")
    ids = tokens.encoded(docs)
    rows = {r.doc_id: r.ids for r in ids.collect()}
    assert rows[0] == [] and rows[len(TEXTS)] == [] and len(rows) == len(TEXTS) + 1
    assert {r.doc_id: r.text for r in tokens.decoded(ids).collect()} == {**dict(enumerate(TEXTS)), len(TEXTS): ""}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(docs).collect()} == {k: len(v) for k, v in rows.items()}
    assert tokens.encoded(docs.limit(0)).count() == 0


@given(st.lists(st.integers(0, 20), max_size=40))
@settings(max_examples=300, deadline=None)
def test_best_fit_and_bounds(sizes):
    x = np.array(sizes, dtype=np.int64)
    bins = packing.best_fit_decreasing(x, 20)
    fill = np.bincount(bins, weights=x) if len(x) else np.array([])
    assert (fill <= 20).all()
    bound = packing.lower_bound(x, 20)
    assert bound <= len(fill) or not x.any()
    assert len(fill) <= 11 / 9 * bound * 1.5 + 2


def test_bounds_see_large_items():
    assert packing.lower_bound(np.array([11] * 7), 20) == 7
    assert packing.lower_bound(np.array([7] * 9), 20) == 5


@pytest.mark.parametrize("items", [60_000, 50])
def test_containers(spark, monkeypatch, items):
    rng = random.Random(8)
    sizes = [rng.choice([0, 1, 30, 200, 700, 1500, 2048]) for _ in range(400)] + [5000, 2049, 4096, None]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens int").withColumn("size", F.lit(3))
    monkeypatch.setattr(packing, "ITEMS", items)
    rows = packing.containers(df).collect()
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r["size"], r.container))
    assert set(by_doc) == set(range(len(sizes)))
    for d, pieces in by_doc.items():
        n = sizes[d] or 0
        pieces.sort()
        assert [p for p, *_ in pieces] == list(range(max(1, -(-n // 2048)))) and sum(s for _, _, s, _ in pieces) == n
        assert all(a == p * 2048 and (s == 2048 or p == len(pieces) - 1) for p, a, s, _ in pieces)
    fill: dict = {}
    for r in rows:
        fill[r.container] = fill.get(r.container, 0) + r["size"]
    assert max(fill.values()) <= 2048
    bound = packing.lower_bound(np.array([r["size"] for r in rows]))
    assert len(fill) <= bound * (1.02 if items > 1000 else 1.1) + 2
    assert packing.containers(df.limit(0)).count() == 0
