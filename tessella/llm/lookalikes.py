"""One consistent form for texts that look the same.

A table maps every code point to its ordinary counterpart: nothing for invisible characters, a plain
space for horizontal spaces, ordinary characters for full-width forms, ligatures, the ellipsis,
hyphen variants and look-alike letters. Words aren't simply mapped: the vocabulary of the corpus is
held in tries, and an edit automaton walks them in which look-alikes and invisible characters cost
nothing. Of the spellings it finds, one in ASCII or else the most frequent one is canonical for all of
them; words that match no ordinary spelling, and what lies between words, are normalised by the table.

Defined results: null texts stay null; empty texts and texts with nothing visible get the form their
white space has, and take no part in ``same_looking``; equal counts are decided by the smallest spelling;
a repeated key gives a repeated row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import code_points, strings
from tessella.runtime import hot_keys, skew_join, stored

# Letters of other scripts that look like the Latin letter below them.
_LETTERS = (
    ("аеорсхуіјѕԁһӏԛԝүѵ", "aeopcxyijsdhlqwyv"),
    ("АВЕКМНОРСТХУІЈЅԌԚԜҮӀ", "ABEKMHOPCTXYIJSGQWYI"),
    ("ονρ", "ovp"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),
    ("օսհցԼՕՏՍ", "ouhgLOSU"),
)
# Hyphens, dots and spaces by what they count as.
_HYPHENS = "‐‑‒−⁃˗﹣－"
_DOTS = {"…": "...", "‥": "..", "․": "."}
_VISIBLE_FORMAT = "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2"
_UNSEEN_MORE = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u180f\u3164\uffa0"
_LINES = "\t\n\x0b\x0c\r\x85\u2028\u2029"
_CONFUSED = {"LATIN", "CYRILLIC", "GREEK", "ARMENIAN"}
_CONTROLS = regex.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
#: Most words whose canonical spelling is sent to every task; more are joined to the texts' own words.
WORDS = 200_000
#: Rows of texts' own words that are put out at once.
ASKED = 100_000
#: Words that share a trie.
TRIE_WORDS = 50_000


@lru_cache(maxsize=1)
def table() -> dict[int, str]:
    """What each code point of decomposed text counts as, where that isn't itself."""
    out: dict[int, str] = {}
    for c in range(sys.maxunicode + 1):
        if 0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xE000 or 0x20000 <= c < 0xE0000 or c >= 0xF0000:
            continue
        ch = chr(c)
        cat = unicodedata.category(ch)
        if ch in _LINES:
            continue
        if (cat == "Cf" and ch not in _VISIBLE_FORMAT) or cat == "Cc" or ch in _UNSEEN_MORE or 0xFE00 <= c <= 0xFE0F or 0xE0000 <= c <= 0xE0FFF:
            out[c] = ""
        elif cat == "Zs":
            out[c] = " "
        else:
            kind = unicodedata.decomposition(ch).partition(">")[0]
            name = unicodedata.name(ch, "") if kind == "<compat" else ""
            if kind in ("<wide", "<narrow", "<isolated", "<initial", "<medial", "<final") or kind == "<compat" and ("LIGATURE" in name or "ROMAN NUMERAL" in name):
                out[c] = unicodedata.normalize("NFKD", ch)
    out.update({ord(a): b for a, b in _DOTS.items()} | {ord(a): "-" for a in _HYPHENS})
    for other, latin in _LETTERS:
        out.update({ord(a): b for a, b in zip(other, latin, strict=True)})
    out.pop(0x20, None)
    return {c: "".join(out.get(ord(x), x) for x in s) if s else s for c, s in out.items()}


def plain(text: str) -> str:
    """The text as the table alone would have it; equal for texts that look the same."""
    if text.isascii() and not _CONTROLS.search(text):
        return text
    unseen = _unseen()
    low = unicodedata.normalize("NFD", text.translate(unseen))
    return unicodedata.normalize("NFC", low.translate(table()))


@lru_cache(maxsize=1)
def _touched() -> np.ndarray:
    """Which code points the table changes, composed characters of such included, or belong to scripts whose words may hold Latin look-alikes."""
    t, out = table(), np.zeros(sys.maxunicode + 1, dtype=bool)
    out[list(t)] = True
    for a, b in ((0x370, 0x590), (0x1C80, 0x1C90), (0x1F00, 0x2000), (0x2DE0, 0x2E00), (0xA640, 0xA6A0)):  # Greek, Cyrillic, Armenian and more of them
        out[a:b] = True
    for c in range(len(out)):
        if unicodedata.decomposition(chr(c)) and any(ord(x) in t for x in unicodedata.normalize("NFD", chr(c))):
            out[c] = True
    return out


def untouched(text: str) -> bool:
    """Whether a text is its own consistent form whatever the vocabulary."""
    if text.isascii():
        return not _CONTROLS.search(text)
    return not _touched()[code_points(text)].any() and unicodedata.is_normalized("NFC", text)


@lru_cache(maxsize=1)
def _unseen() -> dict[int, None]:
    return {c: None for c, s in table().items() if not s}


@lru_cache(maxsize=1)
def _word_characters() -> np.ndarray:
    """Which code points are letters, marks, digits or invisible, in whatever characters they are written."""
    out = np.zeros(sys.maxunicode + 1, dtype=bool)
    for c in range(len(out)):
        out[c] = (kind := unicodedata.category(chr(c)))[0] in "LMN" or kind == "Cf"
    out[ord("_")] = True
    for c, counts_as in table().items():
        out[c] = all(x.isalnum() for x in counts_as)
    return out


def words(text: str) -> list[tuple[int, int]]:
    """[start, end) of each run of word characters."""
    inside = np.zeros(len(text) + 2, dtype=np.int8)
    inside[1:-1] = _word_characters()[code_points(text)]
    edge = np.diff(inside)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def _odd(word: str) -> bool:
    """Whether a word holds anything but ordinary spelling: invisible or mapped characters, or letters of several scripts that look alike."""
    if word.isascii():
        return not word.isprintable()
    if unicodedata.normalize("NFC", word) != word:
        return True
    t = table()
    low = unicodedata.normalize("NFD", word)
    mapped = [ch for ch in low if ord(ch) in t]
    if any(not ch.isalpha() or unicodedata.decomposition(ch).startswith("<") or not t[ord(ch)] for ch in mapped):
        return True
    return len({_script(ch) for ch in low if ch.isalpha()} & _CONFUSED) > 1


@lru_cache(maxsize=100_000)
def _script(ch: str) -> str:
    name = unicodedata.name(ch, "?").split()[0]
    return "EAST" if name in ("CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "FULLWIDTH") else name


class Trie:
    """The ordinary spellings of a vocabulary with their counts."""

    def __init__(self) -> None:
        self.edges: list[dict[str, dict[str, int]]] = [{}]
        self.word: list[tuple[str, int] | None] = [None]

    def add(self, word: str, count: int) -> None:
        """Edges are kept under what their character counts as, so that all look-alikes of it are found at once."""
        at = 0
        t = table()
        for ch in unicodedata.normalize("NFD", word):
            to = self.edges[at].setdefault(t.get(ord(ch), ch), {})
            if ch not in to:
                to[ch] = len(self.edges)
                self.edges.append({})
                self.word.append(None)
            at = to[ch]
        self.word[at] = (word, count)

    def matches(self, word: str, budget: int = 0, substitution: int = 1, gap: int = 1) -> list[tuple[int, str, int]]:
        """(cost, spelling, count) of all spellings within the budget. Look-alikes and invisible characters cost nothing."""
        front = {0: 0}
        for ch in plain_letters(word):
            after: dict[int, int] = {}
            for at, cost in self._gaps(front, budget, gap).items():
                for looks, to in self.edges[at].items():
                    paid = cost + (0 if looks == ch else substitution)
                    if paid <= budget:
                        for node in to.values():
                            after[node] = min(paid, after.get(node, paid))
                if cost + gap <= budget:
                    after[at] = min(cost + gap, after.get(at, cost + gap))
            front = after
            if not front:
                return []
        return sorted((cost, *self.word[at]) for at, cost in self._gaps(front, budget, gap).items() if self.word[at])

    def _gaps(self, front: dict[int, int], budget: int, gap: int) -> dict[int, int]:
        if not gap or budget < gap:
            return front
        out, queue = dict(front), list(front.items())
        while queue:
            at, cost = queue.pop()
            if cost + gap <= budget:
                for to in self.edges[at].values():
                    for node in to.values():
                        if cost + gap < out.get(node, budget + 1):
                            out[node] = cost + gap
                            queue.append((node, cost + gap))
        return out


def plain_letters(word: str) -> str:
    low = unicodedata.normalize("NFD", word.translate(_unseen()))
    return unicodedata.normalize("NFD", low.translate(table()))


def canonical_spellings(pdf: pd.DataFrame) -> pd.DataFrame:
    """word, canonical: those words of a vocabulary (word, n) whose canonical spelling is another."""
    trie = Trie()
    odd: list[str] = []
    for word, n in zip(pdf["word"], pdf["n"]):
        if _odd(word):
            odd.append(word)
        else:
            trie.add(word, int(n))
    out = []
    for word in pdf["word"]:
        found = trie.matches(word)
        best = min(found, key=lambda m: (m[0], not m[1].isascii(), -m[2], m[1]))[1] if found else plain(word)
        if best != word:
            out.append((word, best))
    return pd.DataFrame(out, columns=["word", "canonical"])


def _vocabulary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()
    for pdf in batches:
        for t in strings(pdf["text"]):
            if t:
                counts.update([t[a:b] for a, b in words(t)])
        if len(counts) > 100_000:
            yield _counted(counts)
            counts.clear()
    yield _counted(counts)


def _counted(counts: Counter) -> pd.DataFrame:
    # Words of equal look must meet in one trie, so they are spread by what they count as.
    return pd.DataFrame([(w, n, *((w, False) if w.isascii() and w.isprintable() else (plain_letters(w), _odd(w)))) for w, n in counts.items()], columns=["word", "n", "looks", "odd"])


def spellings(docs: DataFrame) -> DataFrame:
    """(word, canonical) of all words of ``docs`` (text) that aren't canonical."""
    words = docs.select("text").mapInPandas(_vocabulary, "word string, n long, looks string, odd boolean").groupBy("word", "looks", "odd").agg(F.sum("n").alias("n"))
    words = stored(words)
    # An ordinary word that looks like no other is canonical. Only contested ones need a trie.
    contested = words.groupBy("looks").agg(F.count(F.lit(1)).alias("spellings"), F.max("odd").alias("some_odd")).filter("spellings > 1 OR some_odd").select("looks")
    entered = stored(words.join(contested, "looks").select("word", "n", "looks"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entered.count() // TRIE_WORDS))
    split = entered.withColumn("part", F.pmod(F.xxhash64("looks"), F.lit(parts)))
    return stored(split.groupBy("part").applyInPandas(lambda pdf: canonical_spellings(pdf), "word string, canonical string"))


@lru_cache(maxsize=10_000)
def _plain_gap(gap: str) -> str:
    return plain(gap)


def rewritten(text: str, canonical: dict[str, str]) -> str:
    """The text with each word in its canonical spelling and the rest normalised by the table."""
    if untouched(text):
        return text
    out, at = [], 0
    for a, b in words(text):
        word = text[a:b]
        out += (_plain_gap(text[at:a]), canonical.get(word, word))
        at = b
    out.append(plain(text[at:]))
    return unicodedata.normalize("NFC", "".join(out))


def _own_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(_t, word) of the words whose canonical spelling may be another; at most ASKED rows and the words of one text at once."""
    for pdf in batches:
        owners, own = [], []
        for h, t in zip(pdf["_t"], strings(pdf["text"])):
            if not t or untouched(t):
                continue
            # A word in ASCII without controls is its own canonical spelling.
            asked = {w for w in (t[a:b] for a, b in words(t)) if not (w.isascii() and w.isprintable())}
            owners += [h] * len(asked)
            own += asked
            while len(own) >= ASKED:
                yield pd.DataFrame({"_t": owners[:ASKED], "word": own[:ASKED]})
                del owners[:ASKED], own[:ASKED]
        yield pd.DataFrame({"_t": pd.array(owners, dtype="int64"), "word": pd.array(own, dtype=object)})


def normalised(docs: DataFrame, key: str = "doc_id", limit: int = WORDS) -> DataFrame:
    """(key, text, canonical) of each row of ``docs``; texts are equal in ``canonical`` if and only if they look the same."""
    kind = docs.schema[key].dataType.simpleString()
    docs = docs.select(key, "text")
    known = spellings(docs)
    schema = f"{key} {kind}, text string, canonical string"
    if known.count() <= limit:
        canonical = {r[0]: r[1] for r in known.collect()}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                texts = strings(pdf["text"])
                yield pd.DataFrame({key: pdf[key], "text": texts, "canonical": [None if t is None else rewritten(t, canonical) for t in texts]})

        return docs.mapInPandas(run, schema)

    asked = docs.select(F.xxhash64("text").alias("_t"), "text").mapInPandas(_own_words, "_t long, word string").distinct()
    pairs = asked.join(known, "word").groupBy("_t").agg(F.collect_list(F.struct("word", "canonical")).alias("_words"))

    def run_joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, rows = strings(pdf["text"]), []
            for t, own in zip(texts, pdf["_words"]):
                rows.append(None if t is None else rewritten(t, {p["word"]: p["canonical"] for p in (own if own is not None else ())}))
            yield pd.DataFrame({key: pdf[key], "text": texts, "canonical": rows})

    joined = skew_join(docs.withColumn("_t", F.xxhash64("text")), pairs, "_t", F.col(key), "left")
    return joined.select(key, "text", "_words").mapInPandas(run_joined, schema)


def same_looking(docs: DataFrame, key: str = "doc_id", limit: int = WORDS) -> DataFrame:
    """(key_a, key_b), key_a < key_b: pairs of rows whose texts differ in characters but look the same."""
    seen = normalised(docs, key, limit)
    visible = F.length(F.regexp_replace("canonical", r"\s", "")) > 0
    forms = stored(seen.filter(visible).select(key, F.sha2("canonical", 256).alias("looks"), F.sha2("text", 256).alias("exact")))
    several = forms.groupBy("looks").agg(F.min("exact").alias("low"), F.max("exact").alias("high")).filter("low < high").select("looks")
    members = forms.join(several, "looks")
    # Texts are paired once each, then spread over the rows that hold them: equal texts never meet in pairs.
    members = stored(members)
    texts = members.select("looks", "exact").distinct()
    pairs = texts.join(texts.withColumnRenamed("exact", "_exact"), "looks").filter(F.col("exact") < F.col("_exact")).select("exact", "_exact")
    hot = hot_keys(members, "exact")
    left = skew_join(members.select("exact", F.col(key).alias("_a")), pairs, "exact", F.col("_a"), hot=hot).select("_a", F.col("_exact").alias("exact"))
    both = skew_join(members.select("exact", F.col(key).alias("_b")), left, "exact", F.col("_b"), hot=hot)
    return both.select(F.least("_a", "_b").alias(f"{key}_a"), F.greatest("_a", "_b").alias(f"{key}_b"))
