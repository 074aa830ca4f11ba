"""Nearest vectors within groups by blocks of rows and of queries.

Groups are cut into blocks, so that a large group is many tasks; a task multiplies two blocks and gives each query's best rows, never pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and queries of a block, and scores that a task holds at once.
ROW_BLOCK, QUERY_BLOCK, CELLS_AT_ONCE = 50_000, 20_000, 2_000_000


def unit(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as a matrix of vectors of length 1; zero vectors stay."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size > 0, size, 1)


def best_of(score: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ``k`` best finite scores of each row; ties go to the column of lower ``rank``.

    Only what reaches a row's k-th score is sorted.
    """
    if score.shape[1] > k:
        bar = np.partition(score, score.shape[1] - k, axis=1)[:, -k]
        q, c = np.nonzero((score >= bar[:, None]) & (score > -np.inf))
    else:
        q, c = np.nonzero(score > -np.inf)
    order = np.lexsort((rank[c], -score[q, c], q))
    q, c = q[order], c[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], c[place < k]


def _block(k: int, digits: int, least: float | None):
    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            asked, ids, q = unit(left["v"]), right["c"].to_pylist(), left["q"].to_numpy()
            now, until = left["at"].to_numpy(), right["at"].to_numpy()
            rank = np.empty(len(ids), np.int64)
            rank[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
            own, step = unit(right["v"]).T, max(1, CELLS_AT_ONCE // len(ids))
            for i in range(0, len(asked), step):
                score = np.round(asked[i : i + step] @ own, digits)
                score[until[None, :] < now[i : i + step, None]] = -np.inf
                if least is not None:
                    score[score < least] = -np.inf
                a, c = best_of(score, rank, k)
                out[0].append(q[i + a])
                out[1] += [ids[j] for j in c.tolist()]
                out[2].append(score[a, c])
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return pa.table({"q": pa.array(join(out[0], np.int64)), "c": pa.array(out[1], right.schema.field("c").type), "score": pa.array(join(out[2], float))})

    return run


def grouped_topk(queries: DataFrame, rows: DataFrame, keys: int, k: int, digits: int = 6, least: float | None = None) -> DataFrame:
    """(q, c, score): the best ``k`` rows of its group for each query, block by block; the best of the blocks are the group's.

    ``queries`` has k0, k1 .. (``keys`` columns), q (long), v and at; ``rows`` has the keys, c, v and at.  A row counts if its ``at`` isn't below the query's.
    """
    by = [f"k{i}" for i in range(keys)]
    n = rows.groupBy(*by).agg(F.ceil(F.count("*") / ROW_BLOCK).cast("int").alias("n"))
    m = queries.groupBy(*by).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("m"))
    sizes = n.join(m, by)
    own = lambda c, of: F.pmod(F.xxhash64(c), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = queries.join(sizes, by).withColumn("x", own("q", "m")).withColumn("y", every("n")).select(*by, "x", "y", "q", "v", "at")
    right = rows.join(sizes, by).withColumn("y", own("c", "n")).withColumn("x", every("m")).select(*by, "x", "y", "c", "v", "at")
    kind = rows.schema["c"].dataType.simpleString()
    return left.groupBy(*by, "x", "y").cogroup(right.groupBy(*by, "x", "y")).applyInArrow(_block(k, digits, least), f"q long, c {kind}, score double")
