"""Filters, first-wins deduplication and reports over document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import strip, word_count


def dedup_first(df: DataFrame, key: str | Column, order: str) -> DataFrame:
    """The first row of each key in the given order; one aggregation with map-side combine."""
    row = F.struct(*df.columns)
    out = df.groupBy((F.col(key) if isinstance(key, str) else key).alias("__key")).agg(F.min_by(row, F.struct(order)).alias("r"))
    return out.select("r.*")


def dedup_prefix(df: DataFrame, text: str, order: str, n: int = 300) -> DataFrame:
    """The first row per first ``n`` characters of the text."""
    return dedup_first(df, F.substring(text, 1, n), order)


def min_length(df: DataFrame, text: str, least: int | dict[str, int], source: str | None = None, default: int = 200) -> DataFrame:
    """Rows with a long enough text; a number, or one per source."""
    if isinstance(least, int):
        return df.where(F.length(text) >= least)
    limits = df.sparkSession.createDataFrame(list(least.items()), f"{source} string, __least int")
    return df.join(F.broadcast(limits), source, "left").where(F.length(text) >= F.coalesce("__least", F.lit(default))).drop("__least")


def word_range(df: DataFrame, text: str, least: int = 150, most: int = 3000) -> DataFrame:
    return df.withColumn("word_count", word_count(text)).where(F.col("word_count").between(least, most))


def clean_report(df: DataFrame, before: str, after: str, least: int = 200) -> DataFrame:
    """One row: rows in, out, dropped, changed and the percentage changed."""
    kept = F.length(after) >= least
    out = df.agg(F.count("*").alias("n_in"), F.count_if(kept).alias("n_out"), F.count_if(kept & (F.col(before) != F.col(after))).alias("n_changed"))
    out = out.withColumn("n_dropped", F.col("n_in") - F.col("n_out"))
    return out.withColumn("pct_changed", F.round(F.when(F.col("n_out") > 0, 100.0 * F.col("n_changed") / F.col("n_out")).otherwise(0.0), 4))


def filter_report(df: DataFrame, key: str | Column, order: str, text: str, least: int = 150, most: int = 3000) -> DataFrame:
    """Rows per reason (skipped_dup before short and long, kept) with min, average and max words.

    Duplicates are told before lengths, so a short first copy hides a long later one.
    """
    from pyspark.sql.window import Window

    key = F.col(key) if isinstance(key, str) else key
    first = F.row_number().over(Window.partitionBy("__key").orderBy(order)) == 1
    rows = df.select(F.xxhash64(key).alias("__key"), order, word_count(text).alias("w")).withColumn("first", first)
    reason = F.when(~F.col("first"), "skipped_dup").when(F.col("w") < least, "short").when(F.col("w") > most, "long").otherwise("kept")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.min("w").alias("min_words"), F.round(F.avg("w"), 4).alias("avg_words"), F.max("w").alias("max_words"))


def source_allowlist(df: DataFrame, sources, source: str = "source") -> DataFrame:
    """Rows of the trusted sources, given as a list or a table with the same column."""
    table = sources if isinstance(sources, DataFrame) else df.sparkSession.createDataFrame([(s,) for s in sources], f"{source} string")
    return df.join(table, source, "left_semi")


def complete_cases(df: DataFrame, texts: list[str], arrays: list[str] = ()) -> DataFrame:
    """Rows whose texts aren't blank and whose arrays aren't empty."""
    ok = F.lit(True)
    for t in texts:
        ok = ok & (strip(F.coalesce(F.col(t), F.lit(""))) != "")
    for a in arrays:
        ok = ok & (F.coalesce(F.size(a), F.lit(0)) > 0)
    return df.where(ok)


def migrate_field(df: DataFrame, new: str = "contexts", old: str = "gold_context") -> DataFrame:
    """A legacy scalar field as the array field, where that is missing."""
    have = F.col(new) if new in df.columns else F.lit(None).cast("array<string>")
    return df.withColumn(new, F.coalesce(have, F.when(F.col(old).isNotNull(), F.array(old)))).drop(old)


def normalize_sample(df: DataFrame, question: str, ids: list[str]) -> DataFrame:
    """``df`` with id, the first of the id columns that isn't blank, else q_ and eight digits of md5(question); the question trimmed."""
    q = strip(F.coalesce(F.col(question), F.lit("")))
    given = [F.nullif(strip(F.col(c).cast("string")), F.lit("")) for c in ids if c in df.columns]
    return df.withColumn("id", F.coalesce(*given, F.concat(F.lit("q_"), F.substring(F.md5(q), 1, 8)))).withColumn(question, q)
