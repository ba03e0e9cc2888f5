"""Streams of records into a versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.runtime import latest
from tessella.sources.tables import VersionedTable


def record_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def upsert_stream(stream: DataFrame, target: VersionedTable, checkpoint: str, key: str = "id", version: str = "ingested_at"):
    """Upsert each micro-batch: the latest row of each key in it replaces the table's if it isn't older.

    A batch that is replayed after a failure upserts the same rows again and changes nothing.
    """

    def apply(batch: DataFrame, _: int) -> None:
        payload = [c for c in batch.columns if c != key]
        newest = latest(batch.filter(F.col(key).isNotNull()), [key], payload, version)
        base = target.number()
        table = latest(target.read().unionByName(newest), [key], payload, version) if base else newest
        target.write(table, base)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode("update")


def counts_by_window(stream: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Rows per time window and key; rows later than ``late`` are dropped, so state stays bounded."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))
