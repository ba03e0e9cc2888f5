"""Sentence boundaries in many languages and scripts.

Training counts, over all documents and per language, how often each token type carries a final
period, ends a block, or is followed by which token. Log-likelihood ratios turn these counts into
three sets: abbreviations, collocations across a period, and frequent sentence starters. Every
period is then classified by these sets; marks that are unambiguous in their script need none.

Defined results: null or blank content gives no sentence; a repeated id is one record (its last
version); text of any length is segmented whole; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import LINE_ENDS, WS, code_points, strings
from tessella.runtime import skew_join, stored

_NL = rf"(?:\r\n|\r(?!\n)|[{LINE_ENDS.replace(chr(13), '')}])"
_H = "[" + "".join(c for c in WS if c not in LINE_ENDS) + "]"
_BLANK = re.compile(rf"{_NL}(?:{_H}*{_NL})+")
_SPACE = re.compile(f"[{WS}]+")
_WORD = re.compile(f"[^{WS}]+")

# Brackets and quotation marks with what may close them.
_PAIRS = {"“": "”“", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", '"': '"', "＂": "＂"}
_BRACKETS = "(（[【"
_OPENERS = "".join(_PAIRS) + "¿¡'‘"
_CLOSERS = "”“»›」』)）]】》\"＂'’"
_STRONG = "!?！？。｡؟।॥‽⁇⁈⁉;"
_STOPS = ".．…" + _STRONG
_MARK = re.compile("[" + re.escape("".join(_PAIRS) + _STOPS + ";") + "]")
_PAIRED = re.compile("[" + re.escape("".join(_PAIRS) + _CLOSERS) + "]")
_RUN = re.compile(f"[{re.escape(_STOPS)}]+(?:[{WS}]*[!?！？]+)*")
_INNER_STOPS = tuple(_STOPS)
_INNER = frozenset(WS + _STOPS + _CLOSERS + _OPENERS + ";")  # behind one of these the word before a period may begin
_CLOSED = re.compile(f"[{re.escape(_CLOSERS)}{WS}]*")
_STRIP = "".join(dict.fromkeys(_CLOSERS + _OPENERS + _STOPS + ",;:،؛，；：、"))
_NUMBER = re.compile(r"[+\-−]?\d[\d.,:/]*$")
_FILE = re.compile(r"(?=.*[_\d/\\-])[\w/\\-]+\.\w{1,8}$|\w+_\w+$")
_PARTICLES = "とはがをにのもへで"  # after a Japanese quotation these go on with the outer sentence
_SCRIPTS = "Ѐ-ԯ", "Ͱ-Ͽἀ-῿", "؀-ۿݐ-ݿ", "ऀ-ॿ", "぀-ヿ", "一-鿿㐀-䶿", "฀-๿", "A-Za-zÀ-ɏ"
_THAI_GAP = re.compile(f"(?<=[ก-ฺเ-๏๚๛])[{WS}]+(?=[ก-ฺเ-๏๚๛])")

# Frequent function words, to tell the languages of one script apart.
_FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as was on are this be by not from at or which",
    "de": "der die das und ist nicht mit von den dem ein eine auf für im zu des sich bei nach",
    "fr": "le la les des et est une un du pour dans que qui sur pas au ne avec par aux",
    "es": "el la los las de y en que del se por con una un para es al no lo como",
}
_WORDS_OF = {w: [k for k, v in _FUNCTION_WORDS.items() if w in v.split()] for v in _FUNCTION_WORDS.values() for w in v.split()}
_SCRIPT_LANGS = ("ru", "el", "ar", "hi", "ja", "zh", "th", "latin")

#: Thresholds of the log-likelihood ratios, as published for this method.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
#: Share of its uses at the end of a block from which an abbreviation can also end a sentence.
END_SHARE = 0.02
#: Share of its periods before numbers from which a word that is no abbreviation makes a collocation with them.
NUMBERED = 0.5
#: Most model entries that are sent to every task; a larger model is joined to the documents' own keys instead.
MODEL_ROWS = 200_000


@lru_cache(maxsize=1)
def _script_of() -> np.ndarray:
    """The number of each code point's script in _SCRIPTS, from 1."""
    out = np.zeros(0x10000, dtype=np.uint8)
    for k, ranges in enumerate(_SCRIPTS):
        for a, b in re.findall("(.)-(.)", ranges):
            out[ord(a) : ord(b) + 1] = k + 1
    return out


def language(block: str, fallback: str = "en") -> str:
    """The language of a block: by its script, for Latin script by function words."""
    if not block.isascii():
        codes = code_points(block)
        sizes = np.bincount(_script_of()[np.where(codes < 0x10000, codes, 0)], minlength=9)[1:].tolist()
        if not any(sizes):
            return fallback
        if sizes[4]:
            sizes[4] += sizes[5]
        # Order of preference among equals; kana come with Han letters.
        best = _SCRIPT_LANGS[max(range(8), key=sizes.__getitem__)]
        if best != "latin":
            return best
    elif not any(map(str.isalpha, block)):
        return fallback
    votes: Counter = Counter()
    for w in [w for w in block.lower().split() if w in _WORDS_OF]:
        votes.update(_WORDS_OF[w])
    if not votes:
        return fallback if fallback in _FUNCTION_WORDS else "en"
    return max(votes, key=lambda k: (votes[k], k == fallback, k))


@lru_cache(maxsize=1 << 16)
def token_type(word: str) -> str:
    """The class by which a word is counted: numbers and file-like names are one class each."""
    w = word.strip(_STRIP)
    if _NUMBER.match(w):
        return "##number"
    if _FILE.match(w):
        return "##file"
    return w.lower()


def _low(word: str) -> str:
    """The word in lower case, but a single letter as it is: an initial isn't a unit."""
    return word if len(word) == 1 else word.lower()


@lru_cache(maxsize=1 << 14)
def period_type(word: str) -> str | None:
    """The type of a word with one final period, without it; None for any other word."""
    w = word.lstrip(_OPENERS).rstrip(_CLOSERS)
    if len(w) < 2 or w[-1] not in ".．" or w[-2] in _STOPS:
        return None
    w = w[:-1]
    return "##number" if _NUMBER.match(w) else _low(w)


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """The stretches between blank lines, without surrounding white space."""
    at = 0
    for m in [*_BLANK.finditer(text), None]:
        end = m.start() if m else len(text)
        part = text[at:end]
        left = len(part) - len(part.lstrip(WS))
        if left < len(part):
            yield at + left, at + len(part.rstrip(WS))
        at = m.end() if m else end


def count_tokens(text: str, words_of: dict[str, Counter], counts: Counter) -> None:
    """Add a text's words by language to ``words_of``, and to ``counts`` of each type with a period:
    P how often, E at a block's end, L before a lower-case word or number, B the pair across the period.

    A period within a quotation counts like any other, but what follows a closing quote or bracket may belong to the
    outer sentence, so such a pair says nothing about the period.
    """
    lang = "en"
    for a, b in blocks(text):
        block = text[a:b]
        lang = language(block, lang)
        if lang in ("zh", "ja"):
            continue
        words = block.split()
        words_of[lang].update(words)
        last = len(words) - 1
        for k in [k for k, w in enumerate(words) if "." in w or "．" in w]:
            kind = period_type(words[k])
            if kind is None:
                continue
            counts[lang, "P", kind, ""] += 1
            if k == last:
                counts[lang, "E", kind, ""] += 1
            elif words[k][-1] in ".．" and (after := token_type(words[k + 1])):
                counts[lang, "B", kind, after] += 1
                c = words[k + 1].lstrip(_OPENERS)[:1]
                if after != "##file" and (c.islower() or c.isdigit()):
                    counts[lang, "L", kind, ""] += 1


def _count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words_of, counts = defaultdict(Counter), Counter()
    for pdf in batches:
        for text in strings(pdf["content"]):
            if text:
                count_tokens(text, words_of, counts)
        if len(counts) + sum(map(len, words_of.values())) > 200_000:
            yield _as_frame(_typed(words_of, counts))
            words_of, counts = defaultdict(Counter), Counter()
    yield _as_frame(_typed(words_of, counts))


def _typed(words_of: dict[str, Counter], counts: Counter) -> Counter:
    """``counts`` with the words by their types: T."""
    for lang, words in words_of.items():
        for word, n in words.items():
            if t := period_type(word) or token_type(word):
                counts[lang, "T", t, ""] += n
    return counts


def _as_frame(counts: Counter) -> pd.DataFrame:
    return pd.DataFrame([(*k, v) for k, v in counts.items()], columns=["lang", "kind", "a", "b", "n"])


def train(docs: DataFrame) -> DataFrame:
    """The model of all documents: rows (key) "lang|A|type" abbreviation, "lang|E|type" one that may end a sentence,
    "lang|S|type" sentence starter, "lang|C|type|next" collocation."""
    raw = docs.select("content").mapInPandas(_count_batches, "lang string, kind string, a string, b string, n long")
    counts = stored(raw.groupBy("lang", "kind", "a", "b").agg(F.sum("n").alias("n")))
    n_of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).cast("double")
    # One row per language, so never more than the languages told apart above.
    totals = F.broadcast(counts.groupBy("lang").agg(n_of("T").alias("tokens"), n_of("P").alias("periods")))
    types = counts.filter("kind != 'B'").groupBy("lang", "a").agg(n_of("T").alias("t"), n_of("P").alias("p"), n_of("E").alias("e"), n_of("L").alias("l")).join(totals, "lang")
    t, p = F.col("t"), F.col("p")
    rate = F.least(F.lit(0.999), F.greatest(F.lit(1e-9), F.col("periods") / F.col("tokens")))
    llr = -2 * ((p * F.log(rate) + (t - p) * F.log(1 - rate)) - (p * math.log(0.99) + (t - p) * math.log(0.01)))
    inner = F.length("a") - F.length(F.replace("a", F.lit("."), F.lit("")))
    plain = F.length("a") - inner + 1
    score = llr * F.exp(-plain.cast("double")) * (inner + 1) * F.pow(plain.cast("double"), -F.least(t - p, F.lit(50.0)))
    initial = (F.length("a") == 1) & F.col("a").rlike(r"^\p{L}$")
    number = F.col("a") == "##number"
    abbreviation = ~number & (p > 0) & (initial | ((score >= ABBREVIATION) & ((plain <= 5) | (F.col("l") >= 0.1 * p))))
    types = stored(types.select("lang", "a", "t", "p", "e", "tokens", abbreviation.alias("abbreviation")))
    right = types.select("lang", F.col("a").alias("b"), F.col("t").alias("c2"))
    pairs = counts.filter("kind = 'B'").select("lang", "a", "b", F.col("n").cast("double").alias("c12"))
    pairs = stored(pairs.join(types.drop("t", "e"), ["lang", "a"]).join(right, ["lang", "b"]))
    starts = pairs.filter(~F.col("abbreviation") & ~number).groupBy("lang", "b").agg(F.sum("c12").alias("c12"), F.first("c2").alias("c2"), F.first("tokens").alias("tokens"))
    starts_all = F.broadcast(pairs.filter(~F.col("abbreviation") & ~number).groupBy("lang").agg(F.sum("c12").alias("c1")))
    attracted = F.col("tokens") / F.col("c1") > F.col("c2") / F.col("c12")
    starters = stored(starts.join(starts_all, "lang").filter((F.col("c12") >= 5) & (_pair_llr() >= STARTER) & attracted).select("lang", "b"))
    across = pairs.filter(F.col("abbreviation") | number).withColumnRenamed("p", "c1").filter((F.col("c12") >= 2) & (_pair_llr() >= COLLOCATION) & attracted)
    across = across.select("lang", "a", "b").join(starters, ["lang", "b"], "left_anti")
    # A word too common without a period for an abbreviation ("No. 7") still stands before numbers, if most of its periods do.
    numbered = pairs.filter(~F.col("abbreviation") & ~number & (F.col("b") == "##number") & (F.col("c12") >= NUMBERED * F.col("p"))).withColumnRenamed("p", "c1")
    across = across.unionByName(numbered.filter((F.col("c12") >= 5) & (_pair_llr() >= STARTER) & attracted).select("lang", "a", "b"))
    found = types.filter("abbreviation")
    key = lambda kind, *cols: F.concat_ws("|", F.col("lang"), F.lit(kind), *[F.col(c) for c in cols]).alias("key")
    return (
        found.select(key("A", "a"))
        .unionAll(found.filter((F.col("e") >= 2) & (F.col("e") >= END_SHARE * F.col("p"))).select(key("E", "a")))
        .unionAll(starters.select(key("S", "b")))
        .unionAll(across.select(key("C", "a", "b")))
    )


def _pair_llr():
    """Dunning's log-likelihood ratio of a pair, from c1, c2, c12 and the number of tokens."""
    c1, c2, c12, n = (F.col(c).cast("double") for c in ("c1", "c2", "c12", "tokens"))
    c2 = F.greatest(c2, c12)
    clip = lambda x: F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), x))
    p, p1, p2 = clip(c2 / n), clip(c12 / c1), clip((c2 - c12) / F.greatest(n - c1, F.lit(1.0)))
    term = lambda k, m, q: k * F.log(q) + F.greatest(m - k, F.lit(0.0)) * F.log(1 - q)
    return -2 * (term(c12, c1, p) + term(c2 - c12, n - c1, p) - term(c12, c1, p1) - term(c2 - c12, n - c1, p2))


def _matched(block: str) -> dict[int, int]:
    """Offsets of openers and of what closes them; what has no partner is left out."""
    spans: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    for m in _PAIRED.finditer(block):
        k, c = m.start(), m.group()
        for depth in range(len(stack) - 1, -1, -1):
            if c in _PAIRS[stack[depth][0]]:
                spans[stack[depth][1]] = k
                del stack[depth:]
                break
        else:
            if c in _PAIRS:
                stack.append((c, k))
    return spans


def _starts_low(block: str, k: int) -> bool:
    """Whether the word at k begins in lower case and isn't a file-like name."""
    m = _WORD.match(block, k)
    return bool(m) and block[k].islower() and token_type(m.group()) != "##file"


def segment_block(block: str, lang: str, has: Callable[[str], bool]) -> list[int]:
    """Offsets at which the sentences of a block end."""
    n, ends, begin, at = len(block), [], 0, 0
    spans = _matched(block)
    gaps = [m.start() for m in _THAI_GAP.finditer(block)] if not block.isascii() and "฀" <= max(block) else []

    def after(k: int) -> int:
        m = _SPACE.match(block, k)
        return m.end() if m else k

    def close(k: int) -> int:
        """Past closing marks at k that belong to the sentence."""
        while k < n:
            j = k
            while j < n and block[j] in "\xa0\u202f " and j + 1 < n and block[j + 1] in "»›":
                j += 1
            if j < n and block[j] in _CLOSERS and j not in spans:
                k = j + 1
            else:
                break
        return k

    def end(k: int) -> None:
        nonlocal begin
        ends.append(k)
        begin = after(k)

    def plain_gaps(a: int, b: int) -> None:
        while gaps and gaps[0] < b:
            g = gaps.pop(0)
            if g >= max(a, begin):
                end(g)

    while m := _MARK.search(block, at):
        k, c = m.start(), m.group()
        plain_gaps(at, k)
        if k in spans:
            shut = spans[k]
            inside = block[k + 1 : shut].rstrip(WS)
            final = bool(inside) and inside.rstrip(_CLOSERS)[-1:] in tuple(_STOPS) and inside.rstrip(_CLOSERS)[-1:] != ""
            first = not block[begin:k].strip(_OPENERS + WS)
            at = close(shut + 1)
            while gaps and gaps[0] < at:
                gaps.pop(0)
            nxt = after(at)
            if not final or nxt >= n or block[nxt] in _STOPS:
                continue
            if c in _BRACKETS:
                if first:
                    end(at)
                continue
            d = block[nxt]
            lead = block[nxt:].lstrip(_OPENERS + WS)[:1]
            if d in ",;:،؛，；：、–—-―" or lead.islower() and not (token_type(_WORD.match(block, nxt).group()) == "##file" and not first):
                continue
            if d in _PARTICLES and lang == "ja":
                continue
            if not first or lead.isupper():
                end(at)
            continue
        if c == ";":
            word = block[max(begin, k - 40) : k].rstrip(_CLOSERS)
            greek = bool(word) and "Ͱ" <= word[-1] <= "῿" or lang == "el" and word[-1:].isalnum()
            at = k + 1
            if greek and (at >= n or block[at] in WS or block[at] in _CLOSERS):
                at = close(at)
                end(at)
            continue
        if c in _PAIRS:
            at = k + 1
            continue
        run = _RUN.match(block, k)
        marks, stop = run.group(), run.end()
        at = close(stop)
        nxt = after(at)
        if nxt >= n:
            break
        d = block[nxt]
        if any(x in _STRONG for x in marks):
            if d in ",;،，；、" or (nxt == at and at == stop and marks.isascii() and (d.isalnum() or d in "=&/_")) and not d.isupper():
                continue
            end(at)
        elif len(marks) > 1 or marks == "…":
            if nxt > at and (d in _OPENERS or d.isupper()) and not _starts_low(block, nxt):
                word = token_type(_WORD.match(block, nxt).group())
                if has(f"{lang}|S|{word}") or d.isupper():
                    end(at)
        elif _period_ends(block, begin, k, at, nxt, lang, has):
            end(at)
    plain_gaps(at, n + 1)
    if begin < n:
        ends.append(n)
    return ends


def _period_ends(block: str, begin: int, k: int, at: int, nxt: int, lang: str, has: Callable[[str], bool]) -> bool:
    """Whether the period at k ends a sentence; what follows it begins at nxt."""
    left = k
    while left > begin and block[left - 1] not in WS:
        left -= 1
    word, d = block[left:k].lstrip(_OPENERS), block[nxt]
    if d in ",;:،؛，；、":
        return False
    lead = block[nxt : nxt + 8].lstrip(_OPENERS)[:1] or d
    if nxt == k + 1:
        # No space after the mark: a decimal, a file name or call, an abbreviation with inner periods, or a missing space.
        prev = block[k - 1 : k]
        if not prev or prev in WS or d.isdigit() and prev.isdigit() or d in "_/\\)=-" or (d.isascii() and not d.isalnum() and d not in _OPENERS):
            return False
        if lead.islower() or (lead.isdigit() and d == lead and not lead.isalpha()):
            return False
        kind = word.rpartition(".")[2] if "." in word else word
        whole = _low(word)
        if has(f"{lang}|A|{whole}"):
            if not has(f"{lang}|E|{whole}"):
                return False
        elif len(kind) < 2 and not kind.isdigit():
            return False
        m = _WORD.match(block, nxt)
        rest = m.group().lstrip(_OPENERS)
        follows = has(f"{lang}|S|{token_type(rest)}") or not rest.isupper() or len(rest.strip(_STRIP)) == 1
        return bool(rest) and follows
    kind = "##number" if _NUMBER.match(word) else _low(word)
    m = _WORD.match(block, nxt)
    nxt_type = token_type(m.group()) or ""
    if not kind:
        return True
    if kind == "##number":
        if not block[:left].strip(_OPENERS + WS) or left == begin and len(word) <= 3 and "." not in word:
            return False
        return not (has(f"{lang}|C|{kind}|{nxt_type}") or lead.islower() and nxt_type != "##file")
    initial = len(kind) == 1 and kind.isalpha()
    if has(f"{lang}|C|{kind}|{nxt_type}"):
        return False
    if not initial and not has(f"{lang}|A|{kind}"):
        return True
    ends = has(f"{lang}|E|{kind}")
    if nxt_type == "##file" or d in "¿¡":
        return ends
    if lead.islower() or lead.isdigit():
        return False
    return ends or (not initial and has(f"{lang}|S|{nxt_type}"))


def sentence_spans(text: str, has: Callable[[str], bool]) -> list[tuple[int, int]]:
    """All sentences of a text as [start, end) offsets, without surrounding white space."""
    out, lang = [], "en"
    for a, b in blocks(text):
        block = text[a:b]
        lang = language(block, lang)
        at = 0
        for e in segment_block(block, lang, has):
            part = block[at:e]
            left = len(part) - len(part.lstrip(WS))
            if left < len(part):
                out.append((a + at + left, a + at + len(part.rstrip(WS))))
            at = e
    return out


def _keys_of(text: str, longest: int) -> list[str]:
    """Every key of at most ``longest`` characters that classifying a text may ask for.

    A sentence may begin within a word, behind any mark that ends or closes one, so each such rest of the word before a period is asked for.
    """
    keys: set[str] = set()
    lang = "en"
    for a, b in blocks(text):
        block = text[a:b]
        lang = language(block, lang)
        for m in re.finditer(r"[.．…]", block):
            k, right = m.start(), m.end()
            closed = _WORD.search(block, _CLOSED.match(block, right).end())
            nxt = _WORD.search(block, right)
            follows = {token_type(nxt.group()) if nxt else "", token_type(closed.group()) if closed else ""}
            keys |= {f"{lang}|S|{f}" for f in follows}
            kinds, left = {"##number"}, k
            # Of several marks none is asked for; a word longer than any key isn't in the model, and lower case never shortens it.
            while block[right : right + 1] not in _INNER_STOPS and left > 0 and block[left - 1] not in WS and k - left < longest:
                left -= 1
                if block[left] not in _OPENERS and (left == 0 or block[left - 1] in _INNER):
                    kinds.add(_low(block[left:k]))
            for kind in kinds:
                keys |= {f"{lang}|A|{kind}", f"{lang}|E|{kind}"} | {f"{lang}|C|{kind}|{f}" for f in follows}
    return sorted(key for key in keys if len(key) <= longest)


def with_model(docs: DataFrame, model: DataFrame, apply: Callable, schema: str, limit: int = MODEL_ROWS) -> DataFrame:
    """Run ``apply(id, content, has)``, which yields rows of ``schema``, over all documents.

    A model of at most ``limit`` keys travels with the tasks; a larger one is joined to the keys each document asks for.
    """
    model = stored(model.distinct())
    names = [f.split()[0] for f in schema.split(",")]
    if model.count() <= limit:
        keys = frozenset(r[0] for r in model.collect())

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [r for i, t in zip(pdf["id"], strings(pdf["content"])) if t and t.strip(WS) for r in apply(i, t, keys.__contains__)]
                yield pd.DataFrame(rows, columns=names)

        return docs.select("id", "content").mapInPandas(run, schema)

    longest = model.agg(F.max(F.length("key"))).first()[0] or 0

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(i, k) for i, t in zip(pdf["id"], strings(pdf["content"])) if t for k in _keys_of(t, longest)], columns=["id", "key"])

    # The commonest starters are asked for by most documents; a document's own keys are bounded by its length.
    every = stored(docs.select("id", "content").mapInPandas(asked, "id string, key string"))
    known = skew_join(every, model, "key", F.col("id"), "left_semi").groupBy("id").agg(F.collect_set("key").alias("keys"))

    def run_joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t, known_keys in zip(pdf["id"], strings(pdf["content"]), pdf["keys"]):
                if t and t.strip(WS):
                    rows += apply(i, t, set(known_keys if known_keys is not None else ()).__contains__)
            yield pd.DataFrame(rows, columns=names)

    return docs.select("id", "content").join(known, "id", "left").mapInPandas(run_joined, schema)


def sentences(docs: DataFrame, limit: int = MODEL_ROWS) -> DataFrame:
    """(id, start_at, end_at) of every sentence of ``docs`` (id, content); the model is learned from all of ``docs``."""
    docs = stored(docs.select("id", "content").filter(F.col("content").isNotNull()))
    return with_model(docs, train(docs), _rows, "id string, start_at long, end_at long", limit)


def _rows(key: str, text: str, has: Callable[[str], bool]) -> list[tuple[str, int, int]]:
    return [(key, a, b) for a, b in sentence_spans(text, has)]
