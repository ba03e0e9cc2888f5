"""The registered queries of this subpackage."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import copies, flows, lookalikes, near, neighbours, packing, sentences, splitting, tokens
from tessella.llm.common import WS, records
from tessella.runtime import stored


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(records(spark, sf_dir, "docstore", "content"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/chunks.parquet").select("id", "content", "ingested_at")


def p1_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many characters that aren't white space a record's sentences hold: all that it has."""
    docs = stored(records(spark, sf_dir, "docstore", "content"))
    parts = sentences.sentences(docs).join(docs, "id")
    held = F.substring("content", (F.col("start_at") + 1).cast("int"), (F.col("end_at") - F.col("start_at")).cast("int"))
    return parts.groupBy("id").agg(F.sum(_visible(held)).alias("covered"))


def _visible(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, f"[{WS}]", "")).cast("long")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copies(_chunks(spark, sf_dir))


def p2_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies by their streams alone, where the order of fields counts like any other."""
    return copies.copies(_chunks(spark, sf_dir), lists=False)


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.distinct_records(_chunks(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.similar_pairs(spark.read.parquet(f"{sf_dir}/dense.parquet"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.first_places(flows.scores_of(spark.read.parquet(f"{sf_dir}/ranked.parquet"))).select("query_id", "id")


def p4_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = flows.ranking(flows.scores_of(spark.read.parquet(f"{sf_dir}/ranked.parquet")))
    return ranked.withColumn("flow", F.round("flow", 9))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.cut_points(records(spark, sf_dir, "docstore", "content"))


def p5_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_texts(records(spark, sf_dir, "docstore", "content"))


def p5_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many characters that aren't white space a record's pieces hold without their overlaps, and whether all are within the limit."""
    pieces = splitting.split_texts(records(spark, sf_dir, "docstore", "content"))
    own = F.substring("content", F.col("overlap") + 1, F.lit(splitting.LIMIT))
    return pieces.groupBy(F.col("source_id").alias("id")).agg(F.sum(_visible(own)).alias("covered"), (F.max(F.char_length("content")) <= splitting.LIMIT).alias("fits"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, chunks = (spark.read.parquet(f"{sf_dir}/{t}.parquet").select("id", "content") for t in ("docstore", "chunks"))
    return near.near_duplicates(docs).unionAll(near.near_duplicates(chunks, without_copies=True))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [near.near_classes(spark.read.parquet(f"{sf_dir}/{t}.parquet").select("id", "content")).select(F.lit(t).alias("table_name"), "id", "class_id", "links") for t in ("docstore", "chunks")]
    return both[0].unionAll(both[1])


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that the ids stand for."""
    return tokens.decoded(tokens.encoded(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def p8_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document's pieces hold all its tokens once, in full pieces and a rest, and lie in containers that aren't too full."""
    counts = stored(tokens.token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    packed = stored(packing.containers(counts))
    fill = packed.groupBy("container").agg(F.sum("size").alias("fill"))
    parts = packed.join(fill, "container").join(counts, "doc_id")
    last = F.col("start") + F.col("size") == F.col("n_tokens")
    good = (F.sum("size") == F.max("n_tokens")) & (F.min("start") == 0) & (F.count_distinct("start") == F.count(F.lit(1))) & F.bool_and(last | (F.col("size") == packing.CAPACITY)) & (F.max("fill") <= packing.CAPACITY)
    return parts.groupBy("doc_id").agg(good.alias("whole"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(tokens.token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.same_looking(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def p9_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.normalised(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "canonical")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(v)}


# One row per key; a score that isn't there takes no part.
_SCORED = "s AS (SELECT DISTINCT query_id, list_no, id, relevance FROM ranked WHERE relevance IS NOT NULL AND NOT isnan(relevance))"
_LEADERS = """
outranked AS (SELECT x.query_id, x.id AS id, y.id AS other FROM s x JOIN s y ON x.query_id = y.query_id AND x.list_no = y.list_no AND x.id <> y.id
              GROUP BY ALL HAVING 2 * count(*) FILTER (WHERE x.relevance > y.relevance) > count(*)),
items AS (SELECT query_id, id, count(*) OVER (PARTITION BY query_id) AS items FROM (SELECT DISTINCT query_id, id FROM s)),
above AS (SELECT query_id, id, count(*) AS n FROM outranked GROUP BY ALL),
below AS (SELECT query_id, other AS id, count(*) AS n FROM outranked GROUP BY ALL),
leaders AS (SELECT query_id, id, (coalesce(above.n, 0) - coalesce(below.n, 0)) / greatest(items - 1, 1) AS majority
            FROM items LEFT JOIN above USING (query_id, id) LEFT JOIN below USING (query_id, id) WHERE items - 1 - coalesce(above.n, 0) < 3)"""
_RANKING = f"""
WITH {_SCORED}, {_LEADERS},
places AS (SELECT query_id, list_no, id, rank() OVER (PARTITION BY query_id, list_no ORDER BY relevance) - 1 AS less,
                  count(*) OVER (PARTITION BY query_id, list_no, relevance) AS equal, count(*) OVER (PARTITION BY query_id, list_no) AS n FROM s),
flows AS (SELECT query_id, id, round(avg((less - (n - less - equal)) / greatest(n - 1, 1)), 12) AS flow, round(avg((less + (equal - 1) / 2) / greatest(n - 1, 1)), 12) AS standing FROM places GROUP BY ALL)
SELECT query_id, id, round(flow, 9) AS flow, row_number() OVER (PARTITION BY query_id ORDER BY majority DESC NULLS LAST, flow DESC, standing DESC, id) AS position
FROM flows LEFT JOIN leaders USING (query_id, id)"""
_CLASSES = """
texts AS (SELECT 'docstore' AS table_name, id, content FROM docstore UNION SELECT 'chunks', id, content FROM chunks),
members AS (SELECT table_name, id, letters FROM (SELECT table_name, id, regexp_replace(lower(content), '[^\\p{L}\\p{M}\\p{N}]', '', 'g') AS letters FROM texts) WHERE length(letters) >= 220),
classes AS (SELECT table_name, letters, min(id) AS class_id FROM members GROUP BY ALL),
grams AS (SELECT DISTINCT table_name, class_id, substr(letters, k, 5) AS gram FROM (SELECT *, unnest(range(1, length(letters) - 3)) AS k FROM classes)),
sizes AS (SELECT table_name, class_id, count(*) AS n FROM grams GROUP BY ALL),
shared AS (SELECT x.table_name, x.class_id AS a, y.class_id AS b, count(*) AS n FROM grams x JOIN grams y ON x.table_name = y.table_name AND x.gram = y.gram AND x.class_id < y.class_id GROUP BY ALL),
linked AS (SELECT s.table_name, a, b FROM shared s JOIN sizes x ON s.table_name = x.table_name AND a = x.class_id JOIN sizes y ON s.table_name = y.table_name AND b = y.class_id WHERE s.n >= 0.7 * (x.n + y.n - s.n)),
ends AS (SELECT table_name, class_id, count(*) AS links FROM (SELECT table_name, a AS class_id FROM linked UNION ALL SELECT table_name, b FROM linked) GROUP BY ALL)
SELECT table_name, id, class_id, coalesce(links, 0) AS links FROM members JOIN classes USING (table_name, letters) LEFT JOIN ends USING (table_name, class_id)"""
_NEAREST = """
WITH v AS (SELECT DISTINCT id, vector::DOUBLE[] AS vector FROM dense WHERE id IS NOT NULL AND len(vector) = 64 AND list_aggregate(list_transform(vector, lambda x: abs(x)), 'max') > 0),
near AS (SELECT x.id AS id, y.id AS other, round(list_cosine_similarity(x.vector, y.vector), 6) AS cosine FROM v x JOIN v y ON x.id <> y.id),
best AS (SELECT id, other FROM near WHERE cosine >= 0.8 QUALIFY row_number() OVER (PARTITION BY id ORDER BY cosine DESC, other) <= 10)
SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM best"""
_PROSE = """
WITH texts AS (SELECT id, any_value(content) AS content FROM chunks WHERE id IS NOT NULL AND content IS NOT NULL GROUP BY id HAVING length(regexp_replace(any_value(content), '[\\t-\\r \\x{85}\\p{Z}]', '', 'g')) > 0),
marks AS (SELECT id, k, substr(content, k, 1) AS c FROM (SELECT id, content, unnest(range(1, length(content) + 1)) AS k FROM texts)),
kinds AS (SELECT id, k, c, regexp_matches(c, '^[\\t-\\r \\x{85}\\p{Z}]$') AS space, regexp_matches(c, '^[\\p{P}\\p{S}]$') AS mark, regexp_matches(c, '^\\p{Nd}$') AS digit FROM marks),
beside AS (SELECT *, coalesce(lag(digit) OVER w, false) AS before, coalesce(lead(digit) OVER w, false) AS after, coalesce(lag(NOT space AND NOT mark) OVER w, false) AS word FROM kinds WINDOW w AS (PARTITION BY id ORDER BY k)),
kept AS (SELECT id, k, replace(replace(lower(c), 'ß', 'ss'), 'ς', 'σ') AS c FROM beside WHERE NOT space AND (NOT mark OR after AND (before OR NOT word AND c IN ('+', '-', '−', '±', '＋', '－')))),
streams AS (SELECT texts.id, coalesce(string_agg(c, '' ORDER BY k), '') AS stream FROM texts LEFT JOIN kept ON texts.id = kept.id GROUP BY texts.id),
firsts AS (SELECT id, min(id) OVER (PARTITION BY stream) AS keep_id FROM streams)
SELECT keep_id, id AS copy_id FROM firsts WHERE id <> keep_id"""
_WHITE = "[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_VISIBLE = f"SELECT id, length(regexp_replace(any_value(content), '{_WHITE}', '', 'g')) AS covered, true AS fits FROM docstore WHERE id IS NOT NULL AND content IS NOT NULL GROUP BY id HAVING covered > 0"
_SQL = {
    "p1_covered": f"SELECT id, covered FROM ({_VISIBLE})",
    "p5_rebuilt": _VISIBLE,
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p8_whole": "SELECT doc_id, true AS whole FROM documents",
    "p2_prose": _PROSE,
    "p6_classes": f"WITH {_CLASSES.strip()}",
    "p3_found": _NEAREST,
    "p4_found": f"WITH {_SCORED}, {_LEADERS} SELECT query_id, id FROM leaders",
    "p4_ranking": _RANKING,
}


def _looks_sql() -> str:
    """``text`` as it looks, by the look-alike table alone: what the operator's spellings must be equal under."""
    single, several, unseen = {}, {}, []
    for c in range(0xE1000):
        ch = chr(c)
        if c in lookalikes.table() or unicodedata.decomposition(ch) and not 0xAC00 <= c < 0xD7A4:
            looks = lookalikes.plain(ch)
            if not looks:
                unseen.append(c)
            elif looks != unicodedata.normalize("NFC", ch):
                (single if len(looks) == 1 else several)[ch] = looks
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    ranges = [[unseen[0], unseen[0]]]
    for c in unseen[1:]:
        if c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    out = f"nfc_normalize(regexp_replace(text, '[{''.join(f'\\x{{{a:x}}}-\\x{{{b:x}}}' for a, b in ranges)}]', '', 'g'))"
    for ch, looks in several.items():
        if not 0xFB50 <= ord(ch) < 0xFF00:  # but for the hundreds of joined Arabic forms, which the tables don't hold
            out = f"replace({out}, {quoted(ch)}, {quoted(looks)})"
    return f"nfc_normalize(translate({out}, {quoted(''.join(single))}, {quoted(''.join(single.values()))}))"


def _p9_sql() -> dict[str, str]:
    looks = f"l AS MATERIALIZED (SELECT doc_id, text, {_looks_sql()} AS looks FROM documents)"
    pairs = "SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM l a JOIN l b ON a.looks = b.looks AND a.doc_id < b.doc_id AND a.text <> b.text WHERE regexp_replace(a.looks, '[\\t-\\r ]', '', 'g') <> ''"
    return {"p9_found": f"WITH {looks} {pairs}"}


def oracle_sql() -> dict[str, str]:
    """What SQL can say; the other operators are tested against brute force, round trips or the public tokenizer."""
    return _SQL | _p9_sql()
