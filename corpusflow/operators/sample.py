"""Sorting, limits and seeded sampling.  Limits here are the feature: reports and samples of a stated size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def seeded(key: str, seed: int) -> Column:
    """An order that depends on nothing but the key and the seed."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def top_n(df: DataFrame, value: str, n: int, tie: str, descending: bool = True) -> DataFrame:
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    return df.orderBy(order, tie).limit(n)


def best_and_worst(df: DataFrame, value: str, n: int, tie: str) -> DataFrame:
    """The ``n`` lowest and the ``n`` highest rows, labelled."""
    best, worst = (top_n(df, value, n, tie, descending=d).withColumn("which", F.lit(w)) for d, w in ((False, "best"), (True, "worst")))
    return best.unionByName(worst)


def gap_list(df: DataFrame, score: str, threshold: float, tie: str) -> DataFrame:
    return df.where(F.col(score) < threshold).orderBy(score, tie)


def stratified(df: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows per group, or all of a smaller one; the same rows on every run."""
    w = Window.partitionBy(group).orderBy(seeded(key, seed), key)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def proportional(df: DataFrame, weight: str, total: int) -> DataFrame:
    """``df`` with allocation: max(1, round(total * weight / sum of weights)), halves to even."""
    share = total * F.col(weight) / F.sum(weight).over(Window.partitionBy())
    return df.withColumn("allocation", F.greatest(F.lit(1), F.bround(share, 0)).cast("long"))


def blind_ids(df: DataFrame, key: str, prefix: str = "clip", width: int = 4, seed: int = 42) -> DataFrame:
    """``df`` with a blind id in seeded random order.

    The order is counted in 256 groups of the hash and their running totals, not in one sorted task.
    """
    rows = df.withColumn("__h", seeded(key, seed)).withColumn("__b", F.substring("__h", 1, 2))
    counts = rows.groupBy("__b").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).drop("__n")  # 256 rows at most
    place = F.row_number().over(Window.partitionBy("__b").orderBy("__h", key))
    out = rows.withColumn("__r", place).join(F.broadcast(before), "__b")
    number = (F.col("__before") + F.col("__r")).cast("string")
    return out.withColumn("blind_id", F.concat_ws("_", F.lit(prefix), F.lpad(number, F.greatest(F.length(number), F.lit(width)), F.lit("0")))).drop("__h", "__b", "__r", "__before")


def downsample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """At most ``n`` rows, chosen by the seed."""
    return df.orderBy(seeded(key, seed), key).limit(n)


def size_filter(df: DataFrame, size: Column, least: int) -> tuple[DataFrame, DataFrame]:
    """Rows over the size, and the others."""
    return df.where(size > least), df.where(~F.coalesce(size > least, F.lit(False)))
