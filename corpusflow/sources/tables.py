"""Keyed writes into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """``target`` with the updates' latest row of each key in the place of its own; a repetition changes nothing."""
    latest = updates.groupBy(F.col(key).alias("__k")).agg(F.max_by(F.struct(*updates.columns), F.col(order)).alias("r")).select("r.*")
    return target.join(latest.select(key), key, "left_anti").unionByName(latest, allowMissingColumns=True)


def append_new(target: DataFrame, incoming: DataFrame, key: str, order: str, text: str, least: int) -> DataFrame:
    """The incoming rows to append: first of their key, unseen, long enough.  Duplicates are told before lengths."""
    first = incoming.groupBy(F.col(key).alias("__k")).agg(F.min_by(F.struct(*incoming.columns), F.col(order)).alias("r")).select("r.*")
    return first.where(F.length(text) >= least).join(target.select(key), key, "left_anti")
