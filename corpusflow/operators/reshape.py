"""Set operations and reshaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_distinct(parts: list[DataFrame], key: str, last_wins: bool = False) -> DataFrame:
    """The parts' rows, one per key: from the first part that has it, or the last."""
    tagged = [p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    pick = F.max_by if last_wins else F.min_by
    cols = [c for c in rows.columns if c != "__part"]
    return rows.groupBy(F.col(key).alias("__k")).agg(pick(F.struct(*cols), F.col("__part")).alias("r")).select("r.*")


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key), key, "left_anti")


def intersection(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key), key, "left_semi")


def ratings_long(df: DataFrame, columns: list[str], clip_pattern: str = r"(clip_\d+)", keep: list[str] = ()) -> DataFrame:
    """Wide ratings as (clip, score): the clip id from the header, what isn't a number dropped."""
    text = df.select(*keep, *(F.col(c).cast("string").alias(c) for c in columns))
    long = text.unpivot(list(keep), list(columns), "header", "raw")
    return long.select(*keep, F.regexp_extract("header", clip_pattern, 1).alias("clip"), F.expr("try_cast(trim(raw) as double)").alias("score")).where("score is not null")


def pivot_complete(df: DataFrame, row: str, column: str, values: list[str], score: str, digits: int = 4) -> DataFrame:
    """Mean score per row and column value; only rows that have every value."""
    return df.groupBy(row).pivot(column, values).agg(F.round(F.avg(score), digits)).dropna(subset=values)


def rating_sheet(queries: DataFrame, conditions: list[str], criteria: list[str]) -> DataFrame:
    """A blank row per query, condition and criterion; the latter two are small fixed tables."""
    grid = F.explode(F.arrays_zip(F.lit([c for c in conditions for _ in criteria]).alias("condition"), F.lit(criteria * len(conditions)).alias("criterion")))
    return queries.select("*", grid.alias("g")).select(*queries.columns, "g.condition", "g.criterion", F.lit(None).cast("double").alias("score"))


def flatten_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The fields of a JSON column as columns."""
    return df.withColumn("__j", F.from_json(column, schema)).select(*(c for c in df.columns if c != column), "__j.*")


def append_curated(target: DataFrame, rows: list[dict], fixed: dict[str, str], text: str, key: str) -> DataFrame:
    """``target`` with curated rows: fixed metadata and an id made from the text, so that a repetition changes nothing."""
    from corpusflow.functions.chunking import uuid_of
    from corpusflow.sources.tables import upsert

    fields = sorted({k for r in rows for k in r})
    new = target.sparkSession.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], ", ".join(f"{f} string" for f in fields))
    new = new.withColumns({k: F.lit(v) for k, v in fixed.items()}).withColumn(key, uuid_of(text))
    return upsert(target, new, key, text)
