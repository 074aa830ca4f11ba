"""Best-fit packing by minimum bin slack.

Documents become token sequences that end in id 0; those over the capacity are cut so that only the first
piece may be short.  Packing needs no more than how many pieces there are of each length, at most ``capacity``
numbers: per bin the longest piece left is taken and a bitset subset-sum over the other lengths finds the
fullest feasible combination, which is removed, as often at once as the counts allow.  The plan, a few
rows per combination, is bounded by the capacity and not by the corpus.  Pieces find their bin through their
rank among the pieces of equal length; ranks are counted in salted groups, so that no length is one group.

Null texts are empty and give one piece, the id 0.  Repeated rows and null ids are packed each.  Ties in rank are only
between equal rows.  Texts of any length are packed whole, in several pieces.  Extra columns are not passed, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.llm import tokens, vec
from corpusflow.llm.shared import cut

CAPACITY = 2048
SALTS = 256
_END = b"\0\0\0\0"


def _cut(capacity: int, ranks: str, json: str):
    def run(batches):
        encode = tokens.encoder(ranks, json)
        for batch in vec.slices(batches, "text"):
            ids, piece, start, length, crc = [], [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                b = encode(text) + _END
                n = len(b) // 4
                at, size = 0, n if n <= capacity else n % capacity or capacity
                k = 0
                while at < n:
                    ids.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(b[4 * at : 4 * (at + size)]))
                    at, size, k = at + size, capacity, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, ranks: str = tokens.RANKS, json: str = tokens.JSON) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _cut(capacity, ranks, json), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def fullest(seed: int, counts: np.ndarray, capacity: int) -> dict[int, int]:
    """The combination with ``seed`` that leaves the least slack: length to how many of it."""
    room = capacity - seed
    mask = (1 << (room + 1)) - 1
    reach, steps, goal = 1, [], 1 << room
    for length in (np.flatnonzero(counts[: room + 1])[::-1]).tolist():
        for _ in range(min(int(counts[length]) - (length == seed), room // length)):
            if reach & goal:
                break
            now = (reach | reach << length) & mask
            if now == reach:
                break
            steps.append((length, reach))
            reach = now
        if reach & goal:
            break
    left = reach.bit_length() - 1
    out = {seed: 1}
    for length, before in reversed(steps):
        if not before >> left & 1:
            out[length] = out.get(length, 0) + 1
            left -= length
    return out


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Rows sorted by length, first rank: pieces of ``length`` from rank ``first`` lie ``each`` to a bin from ``bin`` on, at ``offset``."""
    left = counts.astype(np.int64).copy()
    rows, bins, used = [], 0, np.zeros(capacity + 1, np.int64)
    top = capacity
    while True:
        while top > 0 and not left[top]:
            top -= 1
        if top <= 0:
            break
        combo = fullest(top, left, capacity)
        times = min(int(left[x]) // n for x, n in combo.items())
        offset = 0
        for x, n in sorted(combo.items(), reverse=True):
            rows.append((x, used[x], n, bins, offset))
            used[x] += times * n
            left[x] -= times * n
            offset += x * n
        bins += times
    rows.sort()
    names = ("length", "first", "each", "bin", "offset")
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(names)} | {"bins": np.array([bins])}


def _place(table: dict[str, np.ndarray]):
    key = table["length"] << 44 | table["first"]

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(key, length << 44 | rank, "right") - 1
            step = rank - table["first"][at]
            each = table["each"][at]
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(table["bin"][at] + step // each), pa.array(table["offset"][at] + step % each * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, ranks: str = tokens.RANKS, json: str = tokens.JSON) -> DataFrame:
    """``pieces`` with sequence_id and offset; each sequence is filled from 0 without gaps."""
    parts = cut(pieces(docs, id_col, text_col, capacity, ranks, json)).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    groups = cut(parts.groupBy("length", "salt").agg(F.count("*").alias("n")))
    counts = np.zeros(capacity + 1, np.int64)
    for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    before = groups.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = parts.withColumn("r", F.row_number().over(order)).join(before, ["length", "salt"])
    kind = parts.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("r") - 1).alias("rank")).mapInArrow(
        _place(plan(counts, capacity)), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
