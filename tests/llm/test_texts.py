from __future__ import annotations

import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import copies, lookalikes, sentences, splitting
from tessella.llm.common import WS

MODEL = {"en|A|dr", "en|A|a.m", "en|A|etc", "en|E|etc", "en|S|the", "en|C|a.m|utc", "en|A|p", "en|A|e.g", "de|C|##number|mai", "ru|A|т", "ru|A|д", "ru|E|д"}
ROWS = "id string, content string"


def cut(text, model=MODEL):
    return [text[a:b] for a, b in sentences.sentence_spans(text, set(model).__contains__)]


def test_sentences_by_case():
    for want in (
        ["Dr. Kelva came at 5 a.m. UTC and left.", "The rest stayed."],
        ["It keeps rows, ids, etc.", "The end."],
        ["A rate of 3.5 fell to 0.25.", "Next."],
        ["He said “Stop. Go on.” to us.", "Then we left."],
        ["The note read “all is lost.”", "Between 3 and 5 rows it fails."],
        ["“Is it down?” asked L. Taserra.", "Nobody knew!"],
        ["(The store never moves.)", "Why does it (cf. App. H) wait?", "So."],
        ["Is it this, or that?!", "Yes."],
        ["A heading", "A line\nbroken once.", "Last"],
        ["你好。", "“还在吗？”他问道。", "日志写着：“关闭了。请重试。”", "（从不移动。）", "完"],
        ["記録には「閉じました。写す。」とある。", "なぜか？"],
        ["यह है।", "क्यों?"],
        ["Γιατί αργεί;", "Δείτε."],
        ["هل توقف؟", "نعم."],
    ):
        for glue in (" ", "  ", "\n\n"):
            joined = want[0]
            for w in want[1:]:
                alone = want[0] == "A heading" or glue == "\n\n"
                joined += ("\n\n" if alone else glue) + w
            assert cut(joined) == want
    assert cut("It stops.Then it goes.") == ["It stops.", "Then it goes."]
    assert cut("Set it in rank_fuser.toml now. limits_ab.csv holds it.") == ["Set it in rank_fuser.toml now.", "limits_ab.csv holds it."]
    assert cut("Am 4. Mai war es die Ruhe. Der Rest ist da und nicht dort.") == ["Am 4. Mai war es die Ruhe.", "Der Rest ist da und nicht dort."]
    assert cut("ตัวชี้หยุด ตัวโหลดเริ่ม 5 ครั้ง ใช้ rank นาน") == ["ตัวชี้หยุด", "ตัวโหลดเริ่ม 5 ครั้ง", "ใช้ rank นาน"]
    assert cut("wait ... and then") == ["wait ... and then"]
    assert cut(" \n\r\n ") == [] and cut("") == []


@given(st.text(alphabet="aB. ?!\n\r\t“”()«»\"。ก1;…", max_size=80))
@settings(max_examples=400, deadline=None)
def test_sentences_cover_everything(text):
    at = 0
    for a, b in sentences.sentence_spans(text, set(MODEL).__contains__):
        assert at <= a < b and text[a:b] == text[a:b].strip(WS) and not text[at:a].strip(WS)
        at = b
    assert not text[at:].strip(WS)


def _corpus():
    rng = random.Random(1)
    out = []
    for n in range(400):
        name = "".join(rng.choices("abcdefgh", k=6)).title()
        verb = rng.choice(["keeps", "moves", "drops"])
        what = "".join(rng.choices("ijklmnop", k=5))
        out.append(f"Dr. {name} {verb} the {what}. The {what} is {verb} by {name}. Nobody {verb} {what}.")
    return out


def test_model_is_learned_and_joined(spark):
    rows = [(f"d{n}", t) for n, t in enumerate(_corpus())] + [("null", None), ("blank", " \n"), ("empty", "")]
    docs = spark.createDataFrame(rows, ROWS)
    model = {r.key for r in sentences.train(docs).collect()}
    assert "en|A|dr" in model and "en|S|the" in model and not any(k.startswith("en|E|") for k in model)
    sent = sorted(map(tuple, sentences.sentences(docs).collect()))
    joined = sorted(map(tuple, sentences.sentences(docs, limit=0).collect()))
    assert sent == joined and len(sent) == 1200
    assert sentences.sentences(docs.limit(0)).count() == 0


def test_numbers_quotations_and_initials_are_learned(spark):
    """"no" is too common a word for an abbreviation; "sgt" stands in quotations only; an initial isn't a unit of the same letter."""
    texts = [f'Ticket No. {n} is here. There is no end. No one has it. He said “We saw Sgt. {name} there in it. So we went.” Rates took {n} s.' for n, name in enumerate("".join(c) for c in zip("ABCDEFGH" * 50, "uvwxyz" * 70, "abcde" * 80))]
    docs = spark.createDataFrame([(f"d{n}", t) for n, t in enumerate(texts)], ROWS)
    model = {r.key for r in sentences.train(docs).collect()}
    assert {"en|C|no|##number", "en|A|sgt", "en|A|s", "en|E|s"} <= model and "en|A|no" not in model and "en|E|S" not in model
    assert cut("Ticket No. 7 is here. He met S. Velorra. It took 9 s. Then he left.", {"en|C|no|##number", "en|A|s", "en|E|s", "en|A|S"}) == ["Ticket No. 7 is here.", "He met S. Velorra.", "It took 9 s.", "Then he left."]


def test_glued_sentences_are_the_same_with_a_joined_model(spark):
    glued = ["He has left.Dr. Smith stayed.", "It went on!Dr. Smith stayed. So it is.", "(See the list.)Dr. Smith stayed.", "It counts 5.“Dr. Smith” stayed.The end."]
    docs = spark.createDataFrame([(f"d{n}", t) for n, t in enumerate(_corpus())] + [(f"g{n}", t) for n, t in enumerate(glued)], ROWS)
    sent = sorted(map(tuple, sentences.sentences(docs).collect()))
    assert sent == sorted(map(tuple, sentences.sentences(docs, limit=0).collect()))
    assert [(a, b) for i, a, b in sent if i == "g0"] == [(0, 12), (12, 29)]


@given(st.lists(st.sampled_from(["Dr", "a", "St", "5", "1.5", "the", "Γ", ".", ".", "!", "…", ";", " ", " ", '"', "“", "”", "(", ")", "'", "»", "\xa0", "\n\n", ","]), max_size=24), st.integers(0, 3))
@settings(max_examples=1500, deadline=None)
def test_every_key_that_is_asked_is_looked_up(parts, salt):
    text = "".join(parts)
    # A model's keys have no empty part, and numbers stand in it as one class.
    can_be = lambda k: all(k.split("|")[2:]) and not (k.split("|")[1] in "AE" and sentences._NUMBER.match(k.split("|")[2]))
    has = lambda k: can_be(k) and len(k) <= 20 and hash((k, salt)) % 2 == 0
    known = set(sentences._keys_of(text, 20))
    assert sentences.sentence_spans(text, has) == sentences.sentence_spans(text, lambda k: k in known and has(k))


def _greedy(text, ends, limit, overlap):
    """The rule, one cut after another."""
    s, e = len(text) - len(text.lstrip(WS)), len(text.rstrip(WS))
    step = lambda k: next((j for j in range(k, e) if text[j] not in WS), e)
    white = [k for k in range(s + 1, e) if text[k] in WS and text[k - 1] not in WS]
    blank = [k for k in white if sentences._BLANK.search(text[k : step(k)])]
    out, begin, last = [], s, s
    while e - begin > limit:
        for kind in (blank, ends, white):
            ok = [k for k in kind if k <= begin + limit and step(k) > last]
            if ok:
                last = step(max(ok))
                break
        else:
            last = begin + limit
        out.append(last)
        begin = last - overlap
    return out


@given(st.text(alphabet="ab .\n\r", max_size=160), st.integers(4, 30), st.integers(0, 3))
@settings(max_examples=400, deadline=None)
def test_cuts_follow_the_rule(text, limit, overlap):
    spans = sentences.sentence_spans(text, lambda k: False)
    stop = len(text.rstrip(WS))
    assert splitting.cuts(text, lambda: spans, limit, overlap) == _greedy(text, [b for _, b in spans if b < stop], limit, overlap)


def test_splitting(spark):
    assert splitting.cuts("x" * 5000, list) == [1200, 2280, 3360, 4440]
    assert len(splitting.cuts("word " * 200_000, list)) > 900
    early = spark.createDataFrame([("e", " Title\n\n" + "One two. " * 300)], ROWS)
    first, second = splitting.split_texts(early).orderBy("index").limit(2).collect()
    assert first.content == "Title" and (second.start_at, second.overlap) == (1, 7) and second.content.startswith("Title\n\nOne two.")
    docs = spark.createDataFrame([("a", "One two. " * 300), ("b", "short"), ("n", None), ("w", "  "), ("a2", "y" * 1300)], ROWS)
    pieces = splitting.split_texts(docs).collect()
    assert all(len(p.content) <= 1200 for p in pieces)
    of = sorted((p["index"], p.content, p.start_at) for p in pieces if p.source_id == "a")
    text = "One two. " * 300
    assert all(text[s : s + len(c)] == c for _, c, s in of) and [i for i, _, _ in of] == list(range(len(of)))
    assert {p.source_id for p in pieces} == {"a", "b", "a2"}
    assert splitting.cut_points(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        splitting.cuts("x", list, 5, 5)


COPIES = [
    ("Straße No. 5, ok", "STRASSE\nno 5 — OK!"),
    ("min-score: 0.5; max_depth: 3; owner: Dot", '{"MAX DEPTH": "3", "owner": "dot", "Min Score": "0.5"}'),
    ("- a  =  1\r\n- b  =  -2\r\n- c  =  x_y.z\n", "c: xy z | b: -2 | a: 1".replace(":", "=")),
    ("<r><a>1</a><b>2</b><c>3</c></r>", "c=3&a=1&b=2"),
    ("!!!", "?? ."),
    ("İx", "i̇X"),
]
OTHERS = [("3.5 rows", "35 rows"), ("3.5 rows", "3,5 rows"), ("a -5", "a 5"), ("one two", "two one"), ("x: 1; y: 2; z: 3", "x: 2; y: 1; z: 3"), ("x: 1; y: 2; z: 3", "x: 1; y: 2; z: 3; w: 4"), ("a​b", "ab"), ("é", "e")]


COPIES += [
    ('{"a":"x","b":"y"}', '{"b": "y", "a": "x"}'),
    ("name: Ada; city: Paris", "city: Paris; name: Ada"),
    ('{"a": {"b": 1, "c": [1, 2]}, "d": "x"}', '{"d": "X", "a": {"c": [1, 2], "b": 1}}'),
    ('[{"a": 1, "b": 2}, {"a": 3}]', '[{"b": 2, "a": 1}, {"a": 3}]'),
    ("the name by which all of the people in this town have always called the old mill on the river: Grist\nowner: Dot", "Owner = dot\nTHE NAME by which all of the people in this town have always called the old mill on the river = grist"),
    ("name (first): Ada | city: Paris", "city: paris | name first: ada"),
    ("name: Ada; city: Paris", "name Ada, city Paris"),  # as prose
    ("k: 1; k: 2", "k: 2; k: 1"),
]
OTHERS += [('{"a": [1, 2], "b": 3}', '{"a": [2, 1], "b": 3}'), ('{"a": {"x": 1, "y": 2}}', '{"a": {"x": 2, "y": 1}}'), ("a: 1; b: 2", "b: 1; a: 2"), ("red fox, blue jay", "blue jay, red fox")]


def _alike(a, b):
    (x, y), (f, g) = copies.hash_texts([a, b])
    return x == y or f is not None and f == g


def test_copies_by_case():
    for a, b in COPIES:
        assert copies.same(a, b) and _alike(a, b), (a, b)
    for a, b in OTHERS:
        assert not copies.same(a, b) and not _alike(a, b) and copies._digest(a) != copies._digest(b), (a, b)
    assert copies.same("RD-5x", "rd 5X") and _alike("RD-5x", "rd 5X")
    deep = "[" * 5000 + "]" * 5000
    assert copies.fields(deep) is None and copies.fields("-" * 300_000 + ": x") is None


def test_long_texts_are_hashed_block_by_block(monkeypatch):
    long = "Wörd 1.5, ß -3 " * 30_000
    whole = copies.hash_texts([long, long.upper().replace(", ", "\n"), long.replace("1.5", "15", 1)])[0]
    assert whole[0] == whole[1] != whole[2]
    monkeypatch.setattr(copies, "_BUNDLE", 1 << 30)
    assert copies.hash_texts([long])[0][0] == whole[0]


def _canonical(text):
    """The same rules for prose, by materialising."""
    import unicodedata

    out = []
    for k, c in enumerate(text):
        cat = unicodedata.category(c)
        before, after = text[k - 1] if k else " ", text[k + 1] if k + 1 < len(text) else " "
        if c in WS or cat[0] == "Z":
            continue
        if cat[0] in "PS":
            number = after.isdecimal() and (before.isdecimal() or c in "+-−±＋－" and unicodedata.category(before)[0] in "ZPS" or c in "+-−±＋－" and before in WS)
            if not number:
                continue
        out.append(c)
    return "".join(out).casefold()


@given(st.lists(st.text(alphabet="aB1 2-.,ß\nİ‐+é", max_size=12), min_size=1, max_size=8))
@settings(max_examples=300, deadline=None)
def test_hashes_follow_the_rule(texts):
    hashes = copies.hash_segments(texts)
    for a, x in zip(texts, hashes):
        for b, y in zip(texts, hashes):
            assert (x == y) == (_canonical(a) == _canonical(b)) == copies._same_stream(a, b)


def test_copies(spark):
    rows = [("c", "A b."), ("a", "a B"), ("b", "a b!"), ("a", "a B"), ("d", "a c"), ("n", None), ("w", " \n"), ("x", "A C")]
    docs = spark.createDataFrame(rows, ROWS).groupBy("id").agg({"content": "max"}).toDF("id", "content")
    assert sorted(map(tuple, copies.copies(docs).collect())) == [("a", "b"), ("a", "c"), ("d", "x")]
    assert sorted(map(tuple, copies.distinct_records(docs).collect())) == [("a", 3), ("d", 2)]
    assert copies.copies(docs.limit(0)).count() == 0
    long = "word 1.5, " * 20_000
    assert copies.same(long, long.upper().replace(", ", "\n")) and not copies.same(long, long.replace("1.5", "15", 1))


def test_lists_and_prose_join_their_groups(spark):
    """b is a list in another order than a, c is b as prose, d is another version of a; e was blank last; hashes alone are shuffled."""
    rows = [("a", "name: Ada; city: Paris", 1), ("b", "city: Paris; name: Ada", 1), ("c", "City Paris, Name Ada", 1), ("d", "old", 1), ("d", "NAME: ada | CITY: paris", 2), ("e", "city: Paris; name: Ada", 1), ("e", " ", 2), ("z", "city: Ada; name: Paris", 1)]
    docs = spark.createDataFrame(rows, "id string, content string, t int").select("id", "content", F.timestamp_seconds("t").alias("ingested_at"), F.lit(0).alias("h"))
    assert sorted(map(tuple, copies.copies(docs).collect())) == [("a", "b"), ("a", "c"), ("a", "d")]
    assert sorted(map(tuple, copies.distinct_records(docs).collect())) == [("a", 4), ("z", 1)]


def test_hash_collisions_are_told_apart():
    rows = pd.DataFrame({"id": ["b", "c", "d", "e"], "content": ["X.", "y", "Y!", "z"], "kept": "x", "keep_id": "a", "h": 7})
    checked = list(copies._verify_batches(iter([rows])))[0]
    assert checked["digest"].isna().tolist() == [True, False, False, False]
    assert checked["digest"][1] == checked["digest"][2] != checked["digest"][3]


LOOKS = [("fi​le", "ﬁle"), ("Рaу", "Pay"), ("é", "é"), ("Ａｂ１", "Ab1"), ("a\xa0b", "a b"), ("wait…", "wait..."), ("x‑y", "x-y"), ("re­ad", "read"), ("οf", "of"), ("ガ", "ガ"), ("e​́", "é")]
DIFFER = [("a", "A"), ("e", "é"), ("x²", "x2"), ("a\tb", "a b"), ("a\nb", "a b"), ("a\r\nb", "a\nb"), ("l", "1"), ("O", "0"), ("a b", "a  b"), ("a—b", "a-b"), ("rn", "m")]


def test_looks_by_case():
    for a, b in LOOKS:
        assert lookalikes.plain(a) == lookalikes.plain(b), (a, b)
    for a, b in DIFFER:
        assert lookalikes.plain(a) != lookalikes.plain(b), (a, b)


def test_tries():
    trie = lookalikes.Trie()
    for w, n in (("курсор", 9), ("cursor", 5), ("файл", 2)):
        trie.add(w, n)
    assert trie.matches("кypcop") == [(0, "курсор", 9)] and trie.matches("cur​ѕor") == [(0, "cursor", 5)]
    assert trie.matches("cursors") == [] and trie.matches("cursors", budget=1) == [(1, "cursor", 5)]
    assert trie.matches("curser", budget=1) == [(1, "cursor", 5)]
    found = lookalikes.canonical_spellings(pd.DataFrame({"word": ["курсор", "кypсop", "Ｃat", "zｅbra"], "n": [3, 1, 1, 1]}))
    assert dict(zip(found.word, found.canonical)) == {"кypсop": "курсор", "Ｃat": "Cat", "zｅbra": "zebra"}


@given(st.lists(st.text(alphabet="aаoοСC​\xa0 -‐ﬁfié́…Ａ.", max_size=6), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_canonical_forms_are_equal_where_looks_are(texts):
    words = sorted({t[a:b] for t in texts for a, b in lookalikes.words(t)})
    known = lookalikes.canonical_spellings(pd.DataFrame({"word": words, "n": [1] * len(words)}))
    canonical = dict(zip(known.word, known.canonical))
    for a in texts:
        for b in texts:
            same = lookalikes.rewritten(a, canonical) == lookalikes.rewritten(b, canonical)
            assert same == (lookalikes.plain(a) == lookalikes.plain(b))


def test_same_looking(spark):
    rows = [(1, "The cаt"), (2, "The cat"), (3, "The cat"), (4, "the cat"), (5, None), (6, ""), (7, "​"), (8, " \xa0"), (9, "Тhe ｃat"), (10, "сон"), (11, "coн")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("canonical", F.lit(1))
    want = [(1, 2), (1, 3), (1, 9), (2, 9), (3, 9), (10, 11)]
    assert sorted(map(tuple, lookalikes.same_looking(docs).collect())) == want
    assert sorted(map(tuple, lookalikes.same_looking(docs, limit=0).collect())) == want
    forms = {r.doc_id: r.canonical for r in lookalikes.normalised(docs).collect()}
    assert forms[1] == forms[9] == "The cat" and forms[5] is None and forms[11] == "сон"
    assert lookalikes.same_looking(docs.limit(0)).count() == 0


def test_long_texts_ask_for_their_words_alone(spark, monkeypatch):
    # Each of 30,000 words once came with its text of 450 kB: 13 GB from one row.
    words = [f"слово{k}" for k in range(30_000)]
    rows = [(1, " ".join([*words, "café", "plain"])), (2, " ".join([*words[:-1], "сло​во29999", "café", "plain"])), (3, "ascii only"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [tuple(r) for r in lookalikes.same_looking(docs, limit=0).collect()] == [(1, 2)]
    monkeypatch.setattr(lookalikes, "ASKED", 1_000)
    frames = list(lookalikes._own_words([pd.DataFrame({"_t": [1, 2, 3, 4, 5], "text": [t for _, t in rows]})]))
    assert max(map(len, frames)) <= 1_000
    got = pd.concat(frames)
    assert set(got["word"][got["_t"] == 1]) == {*words, "café"} and set(got["_t"]) == {1, 2}
