"""Record types, pages, relevance, and guards that fail a query on invalid rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import InvalidPage
from tessella.schema import IDENTIFIER, Schema, fits

# Unicode white space, without the separators U+001C to U+001F that Python also strips.
SPACE = "".join(chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def document_type(schema: Schema) -> T.StructType:
    return T.StructType([T.StructField("id", T.StringType(), False), T.StructField("content", T.StringType()), T.StructField("attributes", schema.struct()), T.StructField("relevance", T.DoubleType())])


def chunk_type(schema: Schema) -> T.StructType:
    fields = [("id", T.StringType()), ("source_id", T.StringType()), ("index", T.IntegerType()), ("content", T.StringType()), ("context", T.StringType()), ("attributes", schema.struct())]
    return T.StructType([T.StructField(n, t) for n, t in fields])


@dataclass(frozen=True)
class Page:
    """A window over ordered results."""

    limit: int
    offset: int = 0

    def __post_init__(self) -> None:
        for name, low in (("limit", 1), ("offset", 0)):
            value = getattr(self, name)
            if not isinstance(value, int) or isinstance(value, bool) or value < low:
                raise InvalidPage(f"{name} must be at least {low}, not {value!r}")


def paged(df: DataFrame, page: Page | None, *order: Column) -> DataFrame:
    """The page of ``df`` in a total order; everything, ordered, without a page."""
    ordered = df.orderBy(*order)
    if page is None:
        return ordered
    return (ordered.offset(page.offset) if page.offset else ordered).limit(page.limit)


def clamped(relevance: Column) -> Column:
    """Relevance cut to [0, 1]; NaN and null stay as they are."""
    return F.when(relevance.isNull() | F.isnan(relevance), relevance).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), relevance)))


def logistic(score: Column, cut: float = 20.0) -> Column:
    """1 / (1 + e^-score), the score cut to ±20."""
    return F.when(score.isNotNull(), 1 / (1 + F.exp(-F.least(F.lit(cut), F.greatest(F.lit(-cut), score)))))


def trimmed(text: Column) -> Column:
    """Text without surrounding Unicode white space; Spark's trim takes off plain spaces only."""
    return F.btrim(text, F.lit(SPACE))


def blank(text: Column) -> Column:
    return F.coalesce(trimmed(text) == "", F.lit(True))


def guarded(df: DataFrame, *rules: tuple[Column, str]) -> DataFrame:
    """Fail the query on the first row that breaks a rule. Rules sit in a filter, so no column pruning can drop them."""
    keep = F.lit(True)
    for rule, message in reversed(rules):
        keep = F.when(F.coalesce(rule, F.lit(False)), keep).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    return df.filter(keep)


def some_id(name: str = "id") -> Column:
    return F.col(name).isNotNull() & (F.col(name) != "")


def valid_documents(df: DataFrame) -> DataFrame:
    x = F.col("relevance")
    return guarded(df, (some_id(), "MissingID: document"), (x.isNull() | (~F.isnan(x) & x.between(0.0, 1.0)), "InvalidArgument: relevance"))


def valid_chunks(df: DataFrame) -> DataFrame:
    return guarded(df, (some_id(), "MissingID: chunk"), (some_id("source_id"), "MissingSourceID: chunk"), (F.col("index") >= 0, "InvalidArgument: chunk index"))


def valid_records(df: DataFrame, value: str = "vector") -> DataFrame:
    return guarded(df, (some_id(), "MissingID: record"), (F.size(value) > 0, f"EmptyVector: {value}"))


def conformed(df: DataFrame, schema: Schema, column: str = "attributes") -> DataFrame:
    """``df`` with its struct of attributes in the schema's kinds; a value that isn't declared, or of another kind, fails the query."""
    if column not in df.columns or not isinstance(df.schema[column].dataType, T.StructType):
        return df
    own = df.schema[column].dataType
    declared = schema.fields or {}
    rules = [(F.col(f"{column}.{f.name}").isNull(), f"InvalidArgument: attribute {f.name} is not declared") for f in own if f.name not in declared]
    parts = {f.name: (F.col(f"{column}.{f.name}"), f.dataType) for f in own if f.name in declared}
    rules += [(rule, f"InvalidArgument: attribute {n} is not {declared[n]}") for n, (c, t) in parts.items() if (rule := fits(declared[n], c, t)) is not None]
    checked = guarded(df, *rules) if rules else df
    if not declared:
        return checked
    return checked.withColumn(column, schema.coerced(parts)).select(*df.columns)


def record_problems(df: DataFrame, value: str = "vector") -> DataFrame:
    """(problem, id) of records that an upsert refuses, one row each; the first problem of a record counts."""
    vector = F.col(value)
    problem = F.when(~F.coalesce(some_id(), F.lit(False)), "MissingID").when(F.coalesce(F.size(vector), F.lit(-1)) <= 0, "EmptyVector")
    return df.select(problem.alias("problem"), "id").filter("problem IS NOT NULL")


def valid_nodes(df: DataFrame) -> DataFrame:
    labels = F.col("labels")
    return guarded(df, (some_id(), "MissingID: node"), ((F.size(labels) > 0) & F.forall(labels, lambda x: x.rlike(rf"\A{IDENTIFIER}\z")), "InvalidGraph: labels"))


def valid_edges(df: DataFrame) -> DataFrame:
    ends = (some_id("source_id") & some_id("target_id"), "InvalidGraph: edge ends")
    return guarded(df, (some_id(), "MissingID: edge"), ends, (F.coalesce(F.col("type").rlike(rf"\A{IDENTIFIER}\z"), F.lit(False)), "InvalidGraph: edge type"))


PART_TYPE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("mime", T.StringType()), T.StructField("text", T.StringType()), T.StructField("bytes", T.BinaryType()), T.StructField("url", T.StringType())])


def valid_part(part: Column) -> Column:
    """Whether a part of a multimodal input has its kind's payload and no other."""
    no = lambda name: F.coalesce(F.length(part[name]), F.lit(0)) == 0
    text = (part["kind"] == "text") & ~blank(part["text"]) & no("bytes") & no("mime") & no("url")
    raw = (part["kind"] == "bytes") & ~no("bytes") & ~blank(part["mime"]) & no("text") & no("url")
    url = (part["kind"] == "url") & part["url"].rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]+$") & no("text") & no("bytes")
    return F.coalesce(text | raw | url, F.lit(False))


def valid_input(parts: Column) -> Column:
    return F.coalesce((F.size(parts) > 0) & F.forall(parts, valid_part), F.lit(False))
