"""Mixing sources to target weights by a low-discrepancy schedule.

Each source is an endless stream of words: its documents in a hashed order, then again in another one.  The stream is cut into blocks of
``block`` words.  Slot i of the mix takes the point i times the golden ratio, modulo 1, and belongs to the source in whose share of all
blocks the point falls; the slots of a source are ranked, and the r-th takes its r-th block, as far as the source's target goes.  So every source
is spread evenly over the mix, gets its target to the word, and no document comes more often than its source is streamed.

A schedule is computed by pieces of CHUNK slots from their numbers alone; ranks take one pass of counts per piece and source.  Streams are
laid out by running totals over ranges, so that a large source is spread over all tasks.  Sources, with their sizes and targets,
are known to the driver and to each task: more than SOURCES of them are an error.

A null text has no words.  Null sources are one source, the last.  Repeated rows are documents of their own; equal ones may change places.  Null ids are
kept.  Documents of any length span as many blocks as they need.  Without words every target is 0 and the mix is empty.  An empty table
gives no rows.  Extra columns are not passed, whatever their names.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.llm import vec
from corpusflow.llm.shared import stored
from corpusflow.operators import ordered

# fixed values: the query's weights, share of all words and largest multiple of a source
WEIGHTS, SHARE, MOST = (3, 1, 2), Fraction(3, 2), 2
BLOCK, CHUNK, SOURCES, SEED = 512, 1 << 16, 1 << 18, 17
#: The golden ratio's fraction, of 2**64.
GOLDEN = 0x9E3779B97F4A7C15


def targets(sizes: list[int], weights: list[int], share: Fraction = SHARE, most: int = MOST) -> list[Fraction]:
    """What each source gives of ``share`` of all words: by weight, but at most ``most`` times its size."""
    out, open_, left = [Fraction(0)] * len(sizes), list(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] > most * sizes[i] * total]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        gone = set(over)
        open_ = [i for i in open_ if i not in gone]
    return out


def _sizes(batches):
    for part in vec.slices(batches, "text"):
        data, off = vec.utf8(part.column(part.schema.get_field_index("text")))
        _, _, rows = vec.runs(~vec.WHITE[data], off)
        keep = [c for c in part.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), pa.array(np.bincount(rows, minlength=part.num_rows))], [*keep, "size"])


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, mark (a hash of id and text), size in words and row, its number, kept in the shared folder."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.lit(SEED), F.col(id_col), F.col(text_col)).alias("mark"), F.col(text_col).cast("string").alias("text"))
    sized = rows.mapInArrow(_sizes, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, source string, mark long, size long")
    return stored(sized.withColumn("row", F.monotonically_increasing_id()), "mix")


def sources(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> DataFrame:
    """The sources of ``documents``, by code point, null last: k from 0, source, source_size, target, quota (its words in the mix), head (the quotas before)."""
    found = rows.groupBy("source").agg(F.sum("size").alias("n")).limit(SOURCES + 1).collect()
    if len(found) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    each = targets([r["n"] for r in found], [weights[i % len(weights)] for i in range(len(found))], share, most)
    out = [(k, r["source"], r["n"], float(t), int(t + Fraction(1, 2))) for k, (r, t) in enumerate(zip(found, each))]
    return rows.sparkSession.createDataFrame(out, "k int, source string, source_size long, target double, quota long")


class _Points:
    """Which source a slot belongs to."""

    def __init__(self, blocks: list[int]):
        total, upto = sum(blocks), np.cumsum(blocks, dtype=object)
        self.n = len(blocks)
        self.bounds = np.array([(int(x) << 64) // total for x in upto[:-1]], np.uint64)

    def __call__(self, chunk: int) -> tuple[np.ndarray, np.ndarray]:
        slot = np.arange(chunk * CHUNK, (chunk + 1) * CHUNK, dtype=np.uint64)
        return slot, np.searchsorted(self.bounds, slot * np.uint64(GOLDEN), "right")


def _count(points: _Points):
    def run(batches):
        for b in batches:
            for chunk in b.column(0).to_pylist():
                n = np.bincount(points(chunk)[1], minlength=points.n)
                k = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), chunk)), pa.array(k.astype(np.int32)), pa.array(n[k])], ["chunk", "k", "n"])

    return run


def _slots(points: _Points, blocks: np.ndarray):
    def run(batches):
        for b in batches:
            for chunk, seen in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                slot, k = points(chunk)
                before = np.zeros(points.n, np.int64)
                for r in seen:
                    before[r["k"]] = r["before"]
                order = np.argsort(k, kind="stable")
                at = k[order]
                rank = np.arange(CHUNK) - np.searchsorted(at, at) + before[at]
                own = rank < blocks[at]
                yield pa.RecordBatch.from_arrays([pa.array(slot[order][own].astype(np.int64)), pa.array(at[own].astype(np.int32)), pa.array(rank[own])], ["slot", "k", "rank"])

    return run


def schedule(spark, blocks: list[int]) -> DataFrame:
    """(slot, k, rank): a slot for each of the ``blocks`` of every source k, in the order of the mix; other slots are left out."""
    total = sum(blocks)
    if not total:
        return spark.createDataFrame([], "slot long, k int, rank long")
    points = _Points(blocks)
    # the points in a share differ from it by some logarithm; should that not do for a small source, the schedule goes on
    slots = total + 16 * -(-total // min(b for b in blocks if b)) + 64
    while True:
        counts = stored(spark.range(0, -(-slots // CHUNK)).mapInArrow(_count(points), "chunk long, k int, n long"), "mix")
        got = {r["k"]: r["n"] for r in counts.groupBy("k").agg(F.sum("n").alias("n")).collect()}  # at most SOURCES rows
        if all(got.get(k, 0) >= b for k, b in enumerate(blocks)):
            break
        slots *= 2
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("k").orderBy("chunk")) - F.col("n"))
    each = before.groupBy("chunk").agg(F.collect_list(F.struct("k", "before")).alias("seen"))  # at most a row a source
    return each.mapInArrow(_slots(points, np.array(blocks)), "slot long, k int, rank long")


def _own(rows: DataFrame, each: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(each.withColumnRenamed("source", "own")), F.col("source").eqNullSafe(F.col("own"))).drop("own")


def streams(rows: DataFrame, each: DataFrame, block: int = BLOCK) -> DataFrame:
    """(k, rank, row, place, start, n): the words of documents that lie in each block of their source's stream."""
    filled = _own(rows.where("size > 0"), each).where("quota > 0")
    turns = filled.withColumn("turn", F.explode(F.sequence(F.lit(0), F.expr("cast((quota + source_size - 1) div source_size as int) - 1"))))
    turns = turns.select("k", "turn", "row", "doc_id", "size", "quota", "source_size", F.xxhash64("mark", "turn").alias("h"))
    laid = ordered.before(turns, ["k", "turn"], ["h", "doc_id", "size", "row"], "size", "at").withColumn("at", F.col("at") + F.col("turn") * F.col("source_size"))
    laid = laid.where("at < quota").withColumn("upto", F.least(F.col("at") + F.col("size"), F.col("quota")))
    cut = laid.withColumn("rank", F.explode(F.expr(f"sequence(at div {block}, (upto - 1) div {block})")))
    first = F.greatest(F.col("at"), F.col("rank") * block)
    return cut.select("k", "rank", "row", (first - F.col("rank") * block).alias("place"), (first - F.col("at")).alias("start"), (F.least(F.col("upto"), (F.col("rank") + 1) * block) - first).alias("n"))


def mix(rows: DataFrame, each: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, k, rank, row, place, start, n): slot by slot the words start .. start + n of the documents (``row``) in its block.

    ``rows`` and ``each`` are ``documents`` and ``sources``.
    """
    blocks = [-(-r["quota"] // block) for r in each.orderBy("k").collect()]  # at most SOURCES rows
    # slots are made of a small table of counts, from which the planner would take them to be few
    slots = schedule(rows.sparkSession, blocks).hint("merge")
    return slots.join(streams(rows, each, block), ["k", "rank"]).select("slot", "k", "rank", "row", "place", "start", "n")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target of its source, taken: its words in the mix."""
    rows = documents(docs, id_col, text_col, source_col)
    each = sources(rows, weights, share, most)
    taken = mix(rows, each, block).groupBy("row").agg(F.sum("n").alias("taken"))
    return _own(rows, each).join(taken, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
