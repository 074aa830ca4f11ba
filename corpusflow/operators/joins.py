"""Joins of evaluation and cache data."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def pending(samples: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Samples that aren't done yet."""
    return samples.join(done.select(key), key, "left_anti")


def flag_join(df: DataFrame, known: DataFrame, key: str, flag: str = "is_new") -> DataFrame:
    """``df`` with a flag: its key isn't among the known ones."""
    seen = known.select(key).distinct().withColumn("__seen", F.lit(True))
    return df.join(seen, key, "left").withColumn(flag, F.col("__seen").isNull()).drop("__seen")


def first_candidate(df: DataFrame, key: str, candidates: Column, lookup: DataFrame, lookup_key: str, value: str) -> DataFrame:
    """The value of the first candidate that resolves to one that isn't empty; null if none does."""
    asked = df.select(key, F.posexplode(candidates).alias("__pos", lookup_key))
    found = asked.join(lookup.where((F.col(value).isNotNull()) & (F.col(value) != "")).select(lookup_key, value), lookup_key)
    best = found.groupBy(key).agg(F.min_by(value, "__pos").alias(value))
    return df.join(best, key, "left")


def _runs(ttl: float):
    """Batches sorted by key and time, the last two columns, to the same with hit for the time; runs go on over batches."""

    def fold(batches):
        key, written = None, None
        for batch in batches:
            n = batch.num_columns - 2
            keys, t = batch.column(n), batch.column(n + 1).to_numpy(zero_copy_only=False)
            codes = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]])
            hit = np.ones(len(t), bool)
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                own = keys[low].as_py()
                if own != key or written is None:
                    key, written = own, -np.inf
                at = low + int(np.searchsorted(t[low:high], written + ttl))
                while at < high:  # from write to write
                    hit[at], written = False, t[at]
                    at += max(1, int(np.searchsorted(t[at:high], written + ttl)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(hit)], [*batch.schema.names[:n], "hit"])

    return fold


def exact_cache_asof(requests: DataFrame, key: str, ts: str, ttl: float, order: str) -> DataFrame:
    """``requests`` with hit: the same key was written before, not longer than ``ttl`` seconds ago.

    A miss writes its key, a hit doesn't renew it, as a cache with expiry does: requests of a key fall into runs
    that begin with a miss.  The rows of a key are streamed in the order of their times, from write to write.
    """
    rows = requests.withColumns({"__key": F.col(key), "__t": F.col(ts).cast("double")})
    rows = rows.repartition("__key").sortWithinPartitions("__key", "__t", order)
    return rows.mapInArrow(_runs(ttl), T.StructType([*requests.schema.fields, T.StructField("hit", T.BooleanType())]))


def written_asof(requests: DataFrame, writes: DataFrame, key: str, ts: str, written: str, ttl: float) -> DataFrame:
    """``requests`` with the time of the latest write of their key that is not later and not expired, or null."""
    both = requests.select("*", F.lit(None).cast("timestamp").alias("__w"), F.lit(1).alias("__kind")).unionByName(
        writes.select(key, F.col(written).alias(ts), F.col(written).alias("__w"), F.lit(0).alias("__kind")), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy(ts, "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("__last", F.last("__w", ignorenulls=True).over(w)).where("__kind = 1")
    fresh = F.col(ts).cast("double") - F.col("__last").cast("double") < ttl
    return out.withColumn("written_at", F.when(fresh, F.col("__last"))).drop("__w", "__kind", "__last")


def interruptions(responses: DataFrame, speech: DataFrame, session: str, start: str, end: str, ts: str) -> DataFrame:
    """Speech that starts inside [start, end) of a response of its session: the response's columns with interrupted_at, the first such.

    An as-of join: both are put in one order by time, latest first, so that the last speech before a response is the next one after its start.
    """
    spoken = speech.select(session, F.col(ts).alias("__t"), F.col(ts).alias("interrupted_at"), F.lit(0).alias("__kind"))
    both = responses.withColumns({"__t": F.col(start), "__kind": F.lit(1)}).unionByName(spoken, allowMissingColumns=True)
    w = Window.partitionBy(session).orderBy(F.col("__t").desc(), "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = both.withColumn("interrupted_at", F.last("interrupted_at", ignorenulls=True).over(w)).where("__kind = 1")
    return told.where(F.col("interrupted_at") < F.col(end)).drop("__t", "__kind")


def compare_runs(new: DataFrame, base: DataFrame, metric: str, value: str) -> DataFrame:
    """Per metric: the means of both runs over rows with a value, and new - base."""
    mean = lambda df, name: df.where(F.col(value).isNotNull()).groupBy(metric).agg(F.avg(value).alias(name))
    out = mean(new, "new_mean").join(mean(base, "base_mean"), metric)
    return out.select(metric, F.round("new_mean", 4).alias("new_mean"), F.round("base_mean", 4).alias("base_mean"), F.round(F.col("new_mean") - F.col("base_mean"), 4).alias("delta"))
