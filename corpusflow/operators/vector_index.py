"""Exact nearest vectors by an inverted file whose cells are left out where a bound allows it.

``VectorIndex`` is an inverted file: centres are fitted on a bounded sample, every row is put into the cell of its nearest centre, and a
cell's radius is the largest angle in it.  A row of a cell is no nearer to a query than the angle to the centre less the radius.  A query looks
at its nearest cells first; what it finds there is the bar that the bounds of other cells must reach.  So the result is that of a scan.  How
much is left out depends on the vectors: much where they lie in clusters, nothing where they point everywhere alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.retrieval import top_ranked
from corpusflow.operators.vector_blocks import grouped_topk, unit
from corpusflow.session import stored

#: Cells of an index, rows that its centres are fitted on, and rounds of that.
CELLS, SAMPLE, ROUNDS = 256, 16_384, 12


def centres(vectors: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Directions that the unit ``vectors`` gather around."""
    cells = min(cells, len(vectors))
    out = vectors[np.random.default_rng(seed).choice(len(vectors), cells, False)]
    for _ in range(rounds):
        at = (vectors @ out.T).argmax(1)
        total = np.zeros_like(out)
        np.add.at(total, at, vectors)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        out = np.where(size > 0, total / np.where(size > 0, size, 1), out)
    return out


class VectorIndex:
    """An inverted file over all rows with a vector; further columns are kept for filters."""

    def __init__(self, rows: DataFrame, row_id: str, vec: str, keep: list[str] = (), cells: int = CELLS, sample: int = SAMPLE):
        self.id = row_id
        df = rows.where(F.col(vec).isNotNull()).select(F.col(row_id).alias("c"), F.col(vec).alias("v"), *(F.col(x) for x in keep))
        few = df.select("v", F.xxhash64("c").alias("h")).orderBy("h").limit(sample).select("v").toArrow()
        self.centres = centre = centres(unit(few["v"]), cells) if few.num_rows else np.zeros((1, 1))

        def put(batches):
            for b in batches:
                if b.num_rows:
                    score = unit(b.column(1)) @ centre.T
                    cell = score.argmax(1)
                    angle = np.arccos(np.clip(score[np.arange(len(cell)), cell], -1, 1))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], [*b.schema.names, "k0", "angle"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        self.rows = stored(df.mapInArrow(put, f"{schema}, k0 int, angle double"), "index")
        self.count, self.radius = np.zeros(len(centre), np.int64), np.zeros(len(centre))
        for r in self.rows.groupBy("k0").agg(F.count("*").alias("n"), F.max("angle").alias("r")).collect():  # at most ``cells`` rows
            self.count[r["k0"]], self.radius[r["k0"]] = r["n"], r["r"]

    def probes(self, asked: DataFrame, k: int, first: bool, digits: int = 6) -> DataFrame:
        """(k0, q, v, at): the cells that queries look at: ``first`` the nearest with ``k`` rows, else those beyond them whose bound reaches the query's ``bar``."""
        centre, count, radius = self.centres, self.count, self.radius

        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                angle = np.arccos(np.clip(unit(b.column(1)) @ centre.T, -1, 1))
                order = np.argsort(angle, axis=1, kind="stable")
                held = np.cumsum(count[order], axis=1) - count[order]
                near = np.empty(angle.shape, bool)
                np.put_along_axis(near, order, held < k, 1)
                near &= count > 0
                if not first:
                    bar = b.column(2).to_numpy(zero_copy_only=False)
                    near = ~near & (count > 0) & (np.cos(np.maximum(0, angle - radius)) >= bar[:, None] - 10.0**-digits)
                q, c = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), b.column(0).take(pa.array(q)), b.column(1).take(pa.array(q)), pa.array(np.zeros(len(q)))], ["k0", "q", "v", "at"])

        if not count.any():
            return asked.where("false").select(F.lit(0).alias("k0"), "q", "v", F.lit(0.0).alias("at"))
        kind = asked.schema["v"].dataType.simpleString()
        return asked.mapInArrow(run, f"k0 int, q long, v {kind}, at double")

    def topk(self, queries: DataFrame, k: int, query_id: str, query_vec: str, where: Column | None = None, digits: int = 6) -> DataFrame:
        """The ``k`` rows with the highest cosine for each query, of those that ``where`` allows: query, row, score, rank.  Query ids are integers."""
        rows = self.rows if where is None else self.rows.where(where)
        rows = rows.select("k0", "c", "v", F.lit(0.0).alias("at"))
        asked = queries.where(F.col(query_vec).isNotNull()).select(F.col(query_id).cast("long").alias("q"), F.col(query_vec).alias("v"))
        near = stored(grouped_topk(self.probes(asked, k, True, digits), rows, 1, k, digits), "near")
        bar = near.groupBy("q").agg(F.sort_array(F.collect_list("score"), False).alias("s"))  # some times k scores
        bar = bar.select("q", F.when(F.size("s") >= k, F.element_at("s", k)).otherwise(F.lit(float("-inf"))).alias("bar"))
        barred = asked.join(bar, "q", "left").select("q", "v", F.coalesce("bar", F.lit(float("-inf"))).alias("bar"))
        far = grouped_topk(self.probes(barred, k, False, digits), rows, 1, k, digits)
        found = near.unionByName(far).select(F.col("q").cast(queries.schema[query_id].dataType).alias(query_id), F.col("c").alias(self.id), "score")
        return top_ranked(found, query_id, "score", self.id, k)
