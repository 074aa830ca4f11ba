"""Token-id output in training order.

Every document becomes sequences of at most ``seq_len`` ids.  Sequences are numbered densely, by partition of their
materialised table, and a keyed Feistel network over the next power of four permutes the numbers; values outside the range walk the cycle
until they fall inside, so that every sequence gets its own global slot.  Slots are range partitioned into
shards of ``shard_rows`` rows; a shard is one Parquet file sorted by slot whose ids column has a fixed stride
(``2 * seq_len`` bytes, or ``4 * seq_len`` for a ``wide`` vocabulary, padded with zeros, n_ids tells how many count), so a reader
resumes at any slot by shard number and row.

Null texts are empty: one sequence, the end id.  Repeated rows and null ids are written each; no two share a slot, so there
are no ties.  Texts of any length are written whole, in several sequences.  Ids that don't fit the width are an error.  Extra columns are not
passed, whatever their names.  An empty table gives no shards.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.llm import tokens, vec
from corpusflow.llm.shared import checkpoint_dir, cut

SEQ_LEN, SHARD_ROWS, KEY, ROUNDS = 1024, 16_384, 0x5EED, 6
#: Shards that a task writes one after the other where there are more than the session has shuffle partitions.
SHARDS_A_TASK = 64


def permute(index: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """A keyed bijection of 0 .. n-1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = vec.mix(np.arange(1, rounds + 1, dtype=np.uint64) * vec.BASE + np.uint64(key & (2**64 - 1)))

    def once(x):
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (vec.mix(right * vec.STEP + k) & mask)
        return left << np.uint64(half) | right

    out = once(index.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def _width(wide: bool) -> str:
    return "<u4" if wide else "<u2"


def _cut(seq_len: int, ranks: str, json: str, wide: bool):
    def run(batches):
        encode, press = tokens.encoder(ranks, json), zstandard.ZstdCompressor(level=9)
        for part in vec.slices(batches, "text"):
            ids, seq, size, body = [], [], [], []
            for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                got = np.append(np.frombuffer(encode(text), np.uint32), 0)
                if not wide and got.max() >> 16:
                    raise ValueError(f"id {got.max()} needs more than 16 bits: a wide vocabulary")
                got = got.astype(_width(wide))
                for k in range(0, len(got), seq_len):
                    ids.append(i)
                    seq.append(k // seq_len)
                    size.append(len(got[k : k + seq_len]))
                    body.append(press.compress(got[k : k + seq_len].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, part.schema.field(0).type), pa.array(seq, pa.int32()), pa.array(size, pa.int32()), pa.array(body, pa.binary())], ["doc_id", "seq", "n_ids", "z"])

    return run


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, ranks: str = tokens.RANKS, json: str = tokens.JSON, wide: bool = False) -> DataFrame:
    """doc_id, seq, n_ids and z, the ids as packed little-endian unsigned 16-bit (``wide``: 32-bit) integers."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_cut(seq_len, ranks, json, wide), f"doc_id {kind}, seq int, n_ids int, z binary")


def _slot(n: int, key: int):
    def run(batches):
        for b in batches:
            at = pa.array(permute(b.column(b.schema.get_field_index("index")).to_numpy(), n, key))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in ("doc_id", "seq", "n_ids", "z")), at], ["doc_id", "seq", "n_ids", "z", "slot"])

    return run


def _pad(stride: int):
    def run(batches):
        open_ = zstandard.ZstdDecompressor().decompress
        for b in batches:
            z = b.column(b.schema.get_field_index("z"))
            for at in range(0, b.num_rows, 1024):
                ids = pa.array([open_(x).ljust(stride, b"\0") for x in z[at : at + 1024].to_pylist()], pa.binary())
                own = b.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([*(own.column(own.schema.get_field_index(c)) for c in ("shard", "slot", "doc_id", "seq", "n_ids")), ids], ["shard", "slot", "doc_id", "seq", "n_ids", "ids"])

    return run


def materialise(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, shard_rows: int = SHARD_ROWS, key: int = KEY, ranks: str = tokens.RANKS, json: str = tokens.JSON, wide: bool = False) -> None:
    """Write all sequences of ``docs`` in training order under ``path``, a folder per shard."""
    parts = cut(sequences(docs, id_col, text_col, seq_len, ranks, json, wide))
    # the cut's partitions are fixed, so a row's number is its partition's first one and its place there; nothing moves
    placed = parts.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    groups = cut(placed.groupBy("part").agg(F.count("*").alias("n")))  # a row per partition
    n = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    before = groups.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    numbered = placed.join(F.broadcast(before), "part")
    kind = parts.schema["doc_id"].dataType.simpleString()
    slots = numbered.select("doc_id", "seq", "n_ids", "z", (F.col("before") + F.col("place")).alias("index")).mapInArrow(_slot(n, key), f"doc_id {kind}, seq int, n_ids int, z binary, slot long")
    slots = slots.withColumn("shard", (F.col("slot") / shard_rows).cast("long"))
    shards = max(1, -(-n // shard_rows))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(shards, max(least, -(-shards // SHARDS_A_TASK)))
    out = slots.repartitionByRange(tasks, "shard").sortWithinPartitions("shard", "slot")
    out = out.select("shard", "slot", "doc_id", "seq", "n_ids", "z").mapInArrow(_pad((4 if wide else 2) * seq_len), f"shard long, slot long, doc_id {kind}, seq int, n_ids int, ids binary")
    out.write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(path)


def read_from(spark: SparkSession, path: str, slot: int = 0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The sequences from a slot on; shards before it aren't opened."""
    return spark.read.parquet(path).where((F.col("shard") >= slot // shard_rows) & (F.col("slot") >= slot))


def _check(wide: bool):
    def run(batches):
        for b in batches:
            ids, size = b.column(b.schema.get_field_index("ids")).to_pylist(), b.column(b.schema.get_field_index("n_ids")).to_pylist()
            crc = [zlib.crc32(np.frombuffer(x, _width(wide))[:m].astype("<u4").tobytes()) for x, m in zip(ids, size)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in ("slot", "shard", "doc_id", "seq", "n_ids")), pa.array(crc, pa.int64()), pa.array([len(x) for x in ids], pa.int64())], ["slot", "shard", "doc_id", "seq", "n_ids", "ids_crc32", "stride"])

    return run


def digest(written: DataFrame, wide: bool = False) -> DataFrame:
    """slot, shard, doc_id, seq, n_ids, ids_crc32 (of the ids as 32-bit integers) and stride, read from the shards."""
    kind = written.schema["doc_id"].dataType.simpleString()
    rows = written.withColumn("shard", F.col("shard").cast("long"))
    return rows.mapInArrow(_check(wide), f"slot long, shard long, doc_id {kind}, seq int, n_ids int, ids_crc32 long, stride long")


def training_order(docs: DataFrame, **options) -> DataFrame:
    """Write the shards of ``docs`` to a new folder of the shared one and return their digest."""
    spark = docs.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"training-{uuid.uuid4().hex}")
    materialise(docs, path, **options)
    schema = f"slot long, doc_id {docs.schema[options.get('id_col', 'doc_id')].dataType.simpleString()}, seq int, n_ids int, ids binary, shard long"
    return digest(spark.read.schema(schema).parquet(path), options.get("wide", False))
