"""Pieces shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.runtime import latest

#: Unicode White_Space, fixed values.
WS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Marks that end a line, fixed values.
LINE_ENDS = "\n\r\x85\u2028\u2029"


def records(spark: SparkSession, sf_dir: str, table: str, value: str) -> DataFrame:
    """(id, value) of a table whose repeated rows are one record: the last version of each id; null ids are dropped."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return latest(rows.filter(F.col("id").isNotNull()), ["id"], [value])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def strings(column) -> list[str | None]:
    """A pandas column as str or None."""
    return [x if isinstance(x, str) else None for x in column]
