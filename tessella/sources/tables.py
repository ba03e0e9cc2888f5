"""Tables of documents: reading, JSON attributes, and a versioned Parquet store with keyed upserts."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.errors import InvalidArgument, Unavailable
from tessella.model import clamped, guarded, some_id, valid_documents
from tessella.runtime import latest
from tessella.schema import Schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """(id, content, attributes, relevance), or the id and some of them only; repeated rows are one record."""
    return latest(table(spark, sf_dir, "docstore").filter("id IS NOT NULL"), ["id"], list(columns or ("content", "attributes", "relevance")))


def chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return latest(table(spark, sf_dir, "chunks").filter("id IS NOT NULL"), ["id"], list(columns or ("source_id", "index", "content", "context", "attributes")))


def dense(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return latest(table(spark, sf_dir, "dense").filter("id IS NOT NULL"), ["id"], list(columns or ("content", "attributes", "vector")))


def ranked(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return latest(table(spark, sf_dir, "ranked"), ["query_id", "list_no", "id"], list(columns or ("rank", "content", "attributes", "relevance")))


# Kinds of JSON values that a declared kind takes.
_JSON_KINDS = {"string": r"STRING", "bool": r"BOOLEAN", "int": r"BIGINT|DECIMAL.*|DOUBLE", "float": r"BIGINT|DECIMAL.*|DOUBLE|FLOAT"}


def attribute_problem(raw: Column, schema: Schema) -> Column:
    """What is wrong with attributes in JSON text, null if nothing: no JSON object, an undeclared name, another kind than declared."""
    value = F.try_parse_json(raw)
    names = F.map_keys(F.from_json(raw, "map<string,string>"))
    none = raw.isNull() | F.trim(raw).isin("", "null")
    found = F.when(none, F.lit(None).cast("string")).when(value.isNull() | names.isNull(), "malformed").when(F.exists(names, lambda n: ~n.isin(list(schema.fields or ("",)))), "undeclared")
    for n, kind in (schema.fields or {}).items():
        own = F.schema_of_variant(F.try_variant_get(value, f"$.{n}", "variant"))
        number = F.try_variant_get(value, f"$.{n}", "double")
        wrong = own.isNotNull() & (own != "VOID") & (~own.rlike(f"^({_JSON_KINDS[kind]})$") | (F.lit(kind == "int") & (number != F.floor(number))))
        found = found.when(wrong, f"{n} is not {kind}")
    return found


def decoded_attributes(raw: Column, schema: Schema, strict: bool = True) -> Column:
    """Attributes from JSON text: nothing, null and {} are no attributes; integers keep all their digits, whole floats become integers.

    What ``attribute_problem`` finds fails the query; it becomes null where ``strict`` is off.
    """
    value = F.try_parse_json(raw)
    types = {f.name: f.dataType.simpleString() for f in schema.struct()}
    parts = {n: F.try_variant_get(value, f"$.{n}", t) for n, t in types.items()}
    for n, kind in (schema.fields or {}).items():
        if kind == "int":
            number = F.try_variant_get(value, f"$.{n}", "double")
            parts[n] = F.coalesce(parts[n], F.when(number == F.floor(number), number.cast("long")))
    some = F.lit(False)
    for p in parts.values():
        some = some | p.isNotNull()
    decoded = F.when(some, F.struct(*[p.alias(n) for n, p in parts.items()]))
    if not strict:
        return decoded
    problem = attribute_problem(raw, schema)
    return F.when(problem.isNull(), decoded).otherwise(F.raise_error(F.concat(F.lit("InvalidArgument: attributes: "), problem)).cast(schema.struct()))


def projected(hits: DataFrame, schema: Schema) -> DataFrame:
    """Documents from hits (id, content, attributes, score): declared attributes only, relevance cut to [0, 1], both checked."""
    checked = guarded(hits, (F.col("content").isNotNull(), "ProtocolError: hit without content"))
    attributes = F.when(F.col("attributes").isNotNull(), F.struct(*[F.col(f"attributes.{n}").cast(f.dataType).alias(n) for n, f in zip(schema.struct().names, schema.struct().fields, strict=True)]))
    return valid_documents(checked.select("id", "content", attributes.alias("attributes"), clamped(F.col("score")).alias("relevance")))


def upserted(existing: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """The table after the batch: its rows replace rows of the same key. A key twice in a batch fails the query."""
    once = batch.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in batch.columns if c != key])
    once = guarded(once, (some_id(key), "MissingID: upsert"), (F.col("_n") == 1, "InvalidArgument: key twice in a batch")).drop("_n")
    return existing.join(once.select(key), key, "left_anti").unionByName(once.select(*existing.columns))


@dataclass
class VersionedTables:
    """Parquet tables that change together: each write makes a new version of all of them.

    The n-th write commits by creating the n-th pointer file, which only one writer can do; a writer that
    began with an older version fails and changes nothing. Readers keep the version they began with, so
    tables can be read and replaced in one job. All goes through Hadoop's file system, so any shared storage
    Spark reads will do. ``vacuum`` removes versions that nobody needs any more.
    """

    spark: SparkSession
    path: str
    names: tuple[str, ...] = ("",)

    def _at(self, *parts: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self) -> list[int]:
        fs, path = self._at("_versions")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []

    def number(self) -> int:
        """The current version's number, 0 before the first write."""
        return max(self._numbers(), default=0)

    def _folder(self, number: int) -> str:
        fs, path = self._at("_versions", f"{number:012d}")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())["version"]
        finally:
            stream.close()

    def version(self) -> str | None:
        number = self.number()
        return self._folder(number) if number else None

    def tables(self) -> dict[str, DataFrame]:
        current = self.version()
        if current is None:
            raise InvalidArgument(f"{self.path} holds no table yet")
        return {n: self.spark.read.parquet("/".join(filter(None, [self.path, current, n]))) for n in self.names}

    def commit(self, tables: dict[str, DataFrame], base: int | None = None) -> None:
        """Write all tables and make them version ``base + 1``, if ``base`` is still the current one."""
        base, folder = self.number() if base is None else base, f"v-{uuid.uuid4().hex}"
        for n in self.names:
            tables[n].write.option("compression", "zstd").parquet("/".join(filter(None, [self.path, folder, n])))
        fs, path = self._at("_versions", f"{base + 1:012d}")
        try:
            stream = fs.create(path, False)
        except Exception as e:
            fs.delete(self._at(folder)[1], True)
            raise Unavailable(f"{self.path}: another writer made version {base + 1}") from e
        try:
            stream.write(bytearray(json.dumps({"version": folder}).encode()))
        finally:
            stream.close()

    def vacuum(self, keep: int = 2) -> int:
        """Remove all but the last ``keep`` versions; readers of older ones must be done. Returns how many went."""
        old = self._numbers()[: -max(1, keep)]
        for number in old:
            fs, path = self._at("_versions", f"{number:012d}")
            fs.delete(self._at(self._folder(number))[1], True)
            fs.delete(path, False)
        return len(old)


class VersionedTable(VersionedTables):
    """A single table of this kind."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__(spark, path)

    def read(self) -> DataFrame:
        return self.tables()[""]

    def write(self, df: DataFrame, base: int | None = None) -> DataFrame:
        self.commit({"": df}, base)
        return self.read()

    def upsert(self, batch: DataFrame, key: str = "id") -> DataFrame:
        """Upsert and return the new table; an empty first batch makes an empty table."""
        base = self.number()
        return self.write(upserted(self.read() if base else batch.limit(0), batch, key), base)
