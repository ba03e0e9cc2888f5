"""Session helpers shared by all operators: durable intermediate tables and skew-proof joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as hot from 1/HOT_SHARE of all rows, so there are never more than HOT_SHARE hot keys.
HOT_SHARE = 256
#: Rows below which no key is worth splitting.
HOT_ROWS = 20_000
#: Pieces into which a hot key is split.
HOT_SALTS = 32

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only in local mode without that setting."""
    global _own_folder
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="tessella-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return f"file://{_own_folder}"


def local_rows(spark: SparkSession, **columns: list) -> DataFrame:
    """Values of the driver as a local relation, which the optimiser can see through."""
    return spark.createDataFrame(pa.table(columns))


#: Folders that ``new_folder`` named and nobody removed yet.
_named: list[str] = []


def _on_disk(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def new_folder(spark: SparkSession) -> str:
    """A name in the shared folder for what need not outlive the application: it goes at ``release`` or when the application ends."""
    path = f"{shared_folder(spark)}/tessella-{uuid.uuid4().hex}"
    files, where = _on_disk(spark, path)
    files.deleteOnExit(where)
    _named.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Remove the intermediate tables written so far; returns how many went. Results built on them must have been read or saved."""
    gone = 0
    while _named:
        files, where = _on_disk(spark, _named.pop())
        gone += bool(files.delete(where, True))
    return gone


def stored(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = new_folder(df.sparkSession)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def latest(df: DataFrame, key: list[str], payload: list[str], version: str = "ingested_at") -> DataFrame:
    """One row per key: the payload of the last version. Partial aggregation runs before the shuffle, so a hot key is harmless."""
    order = F.col(version) if version in df.columns else F.lit(0)
    picked = F.max(F.struct(order.alias("_version"), F.struct(*payload).alias("_payload"))).alias("_picked")
    return df.groupBy(*key).agg(picked).select(*key, *[F.col("_picked._payload")[c].alias(c) for c in payload])


def hot_keys(df: DataFrame, key: str) -> list:
    """Keys holding at least 1/HOT_SHARE of the rows: at most HOT_SHARE values by construction."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = df.count()
    if total < HOT_ROWS:
        return []
    least = max(HOT_ROWS // 4, -(-total // HOT_SHARE))
    return [r[0] for r in counts.filter((F.col("_n") >= least) & F.col(key).isNotNull()).select(key).collect()]


def skew_join(many: DataFrame, one: DataFrame, key: str, spread: Column, how: str = "inner", hot: list | None = None) -> DataFrame:
    """Join rows of ``many`` to the few rows per key of ``one``; hot keys are split over HOT_SALTS tasks.

    ``spread`` is any well-distributed expression over ``many``, ``hot`` its hot keys where they are known already.
    """
    hot = hot_keys(many, key) if hot is None else hot
    if not hot:
        return many.join(one, key, how)
    salt = F.when(F.col(key).isin(hot), F.pmod(F.hash(spread), F.lit(HOT_SALTS))).otherwise(F.lit(0))
    salts = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = many.withColumn("_salt", salt)
    right = one.withColumn("_salt", F.explode(salts))
    return left.join(right, [key, "_salt"], how).drop("_salt")
