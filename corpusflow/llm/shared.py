"""Session-level helpers of the corpus operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.session import checkpoint_dir, remove, stored, unused

__all__ = ["checkpoint_dir", "cut", "identity", "remove", "stored", "table", "unused"]


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder and forget how it was made."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def identity(*columns: str) -> Column:
    """128 bits that tell rows apart by these columns, nulls included."""
    parts = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.md5(F.concat(*parts).cast("binary")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
