"""Running medians in groups of any size.

A group's rows are numbered and cut into blocks.  Inside a block of m rows the median moves by at most m/2 ranks either way of
where the rows before left it, so a block needs only the m values before it that lie around the median then, and how many lie
below.  Which these are is read from a table of counts by bucket of values and block: its totals over the blocks give what each
bucket holds before a block, its totals over the buckets the ranks.  Every block is then one small group, whatever the group's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.operators.ordered import before, changes
from corpusflow.session import stored

#: Rows of a block.  A task holds a block and at most about three times as many values before it; the counts are fewer than the
#: rows as long as a group has under BLOCK ** 2 / (2 * BUCKETS) of them.
BLOCK = 1 << 20
#: Buckets of values that a block's number of rows is dealt to, and the parts that a bucket's rows are sent out by.
BUCKETS, PARTS = 4, 64


def _kth(ranks: np.ndarray, cum: np.ndarray, upto: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The value numbers of the ``k``-th smallest of the first ``upto`` of ``ranks`` and of what ``cum`` counts below each number, for all queries at once.

    A wavelet matrix of the ranks is made from the top bit down and the queries go down with it.
    """
    last = len(cum) - 1
    left, right, node = np.zeros_like(upto), upto, np.zeros_like(upto)
    for bit in reversed(range(max(1, int(last - 1).bit_length()))):
        one = (ranks >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        a, b, middle = zeros[left], zeros[right], node + (1 << bit)
        lower = b - a + cum[np.minimum(middle, last)] - cum[np.minimum(node, last)]
        up = k >= lower
        k, node = np.where(up, k - lower, k), np.where(up, middle, node)
        left, right = np.where(up, zeros[-1] + left - a, a), np.where(up, zeros[-1] + right - b, b)
        ranks = np.concatenate([ranks[~one], ranks[one]])
    return node


def _block_medians(i: np.ndarray, v: np.ndarray, valid: np.ndarray, n: np.ndarray, start: np.ndarray, total: np.ndarray, every: int):
    """Checkpoints and medians of one block: rows with ``i`` of -1 are values before it, ``n`` times each."""
    old = i < 0
    below, held = (int(start[old].min()), int(total[old][0])) if old.any() else (0, 0)
    i, own, here = i[~old], v[~old], valid[~old]
    at = np.flatnonzero((i + 1) % every == 0)
    values, place = np.unique(np.concatenate([v[old], own[here]]), return_inverse=True)
    cum = np.concatenate([[0], np.cumsum(np.bincount(place[: old.sum()], n[old], len(values)).astype(np.int64))])
    upto = np.cumsum(here)[at]
    size = held + upto
    some = size > 0
    out = np.full(len(at), np.nan)
    if some.any():
        ends = (_kth(place[old.sum() :], cum, upto[some], k - below) for k in ((size[some] - 1) // 2, size[some] // 2))
        low, high = (values[e] for e in ends)
        out[some] = (low + high) / 2
    return i[at] + 1, out, some


def _medians(every: int, keys: int):
    def run(batches):
        last, held = None, []

        def done():
            whole = pa.Table.from_batches(held).combine_chunks()
            i, v, n, start, total = (whole.column(c) for c in ("i", "v", "n", "start", "total"))
            point, median, some = _block_medians(i.to_numpy(), v.fill_null(0.0).to_numpy(), v.is_valid().to_numpy(), n.to_numpy(), start.to_numpy(), total.to_numpy(), every)
            own = [pa.concat_arrays([whole.column(c).chunk(0).slice(0, 1)]).take(pa.array(np.zeros(len(point), np.int64))) for c in range(keys)]
            return pa.RecordBatch.from_arrays([*own, pa.array(point, pa.int64()), pa.array(median, mask=~some)], [*whole.column_names[:keys], "checkpoint", "median"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for c in range(keys + 1):  # the group and the block
                new |= changes(batch.column(c), last and last[c])
            cuts = np.flatnonzero(new)
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a in cuts and held:
                    yield done()
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
            last = [batch.column(c).slice(batch.num_rows - 1) for c in range(keys + 1)]
        if held:
            yield done()

    return run


def running_median(df: DataFrame, value: str, by: list[str], order: str, every: int = 100, digits: int = 4, block: int = BLOCK) -> DataFrame:
    """The median of all samples so far at every ``every``-th one, per group: ``by``, checkpoint, median.

    Null samples are numbered but not counted; where there are only such the median is null.  Nulls in ``by`` are a group.
    ``order`` should be total.  The rows are written to the shared folder once, numbered.
    """
    block = max(every, block - block % every)
    keys = [f"g{i}" for i in range(max(1, len(by)))]
    groups = [F.col(c) for c in by] or [F.lit(0)]
    rows = df.select(*(g.alias(k) for g, k in zip(groups, keys)), F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
    rows = before(rows, keys, ["o"], name="i").withColumn("b", F.floor(F.col("i") / block).cast("long"))

    def same(left: DataFrame, right: DataFrame, also: list[str], *beside) -> DataFrame:
        right = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
        equal = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys] + [F.col(c) == F.col(f"r_{c}") for c in also]
        for e in (*equal[1:], *beside):
            equal[0] = equal[0] & e
        return left.join(right, equal[0])

    ends = rows.groupBy(*keys).agg(F.max("b").alias("last")).where("last > 0")  # groups of one block need nothing before it
    seen = same(rows.where("v is not null"), ends, []).groupBy(*keys, "b", "v", F.col("r_last").alias("last")).agg(F.count("*").alias("n"))
    seen = stored(seen, "medians")
    share = max(1, block // BUCKETS)
    values = before(seen.groupBy(*keys, "v").agg(F.sum("n").alias("n")), keys, ["v"], "n", "below")
    # a value with that many rows is a bucket by itself, and its rows need not be sent
    values = values.select(*keys, "v", (F.floor(F.col("below") / share) * 2 + (F.col("n") >= share).cast("long")).alias("k"))
    seen = stored(same(seen, values, ["v"]).select(*keys, "b", "v", "n", "last", F.col("r_k").alias("k")), "medians")

    cells = seen.groupBy(*keys, "k", "b", "last").agg(F.sum("n").alias("n"), F.max("v").alias("v"))
    over = Window.partitionBy(*keys, "k").orderBy("b")
    cells = cells.withColumn("held", F.sum("n").over(over)).withColumn("until", F.coalesce(F.lead("b").over(over), "last")).where("b < until")
    filled = cells.select(*keys, "k", "v", "held", F.explode(F.sequence(F.col("b") + 1, F.col("until"))).alias("p"))
    at = Window.partitionBy(*keys, "p")
    filled = filled.withColumn("upto", F.sum("held").over(at.orderBy("k"))).withColumn("total", F.sum("held").over(at)).withColumn("start", F.col("upto") - F.col("held"))
    near = (F.col("start") <= F.floor((F.col("total") + block) / 2)) & (F.col("upto") > F.floor((F.col("total") - block) / 2) - 1)
    needed = stored(filled.where(near), "medians")

    sent = ["v", "n", "start", "total"]
    heavy = needed.where("k % 2 = 1").select(*keys, F.col("p").alias("b"), F.lit(-1).cast("long").alias("i"), "v", F.col("held").alias("n"), "start", "total")
    asked = needed.where("k % 2 = 0").select(*keys, "k", "p", "start", "total", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    given = seen.where("k % 2 = 0").withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int"))
    light = same(given, asked, ["k", "part"], F.col("b") < F.col("r_p"))
    light = light.select(*keys, F.col("r_p").alias("b"), F.lit(-1).cast("long").alias("i"), "v", "n", F.col("r_start").alias("start"), F.col("r_total").alias("total"))
    own = rows.select(*keys, "b", "i", "v", *(F.lit(0).cast("long").alias(c) for c in sent[1:]))
    blocks = own.unionByName(heavy).unionByName(light).repartition(*keys, "b").sortWithinPartitions(*keys, "b", "i")
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    out = blocks.mapInArrow(_medians(every, len(keys)), f"{schema}, checkpoint long, median double")
    return out.select(*(F.col(k).alias(c) for k, c in zip(keys, by)), "checkpoint", F.round("median", digits).alias("median"))
