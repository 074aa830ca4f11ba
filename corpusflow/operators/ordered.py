"""Numbering and running totals within groups of any size.

Rows are dealt by ranges of group and order, so that a large group is spread over many tasks; each task numbers what it has,
and a second pass adds what the tasks before it hold of a group that they share.  That second pass is one row a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusflow.session import stored, unused


def changes(a: pa.Array, last) -> np.ndarray:
    """Where a value isn't that of the row before; ``last`` stands before the first, as an array of one row or None."""
    if last is None:
        last = pa.nulls(0, a.type)
    before = pa.concat_arrays([last, a]).slice(0, len(a) - (1 - len(last)))
    now = a.slice(1 - len(last))
    differ = pc.or_(pc.fill_null(pc.not_equal(now, before), False), pc.xor(now.is_null(), before.is_null()))
    out = np.ones(len(a), bool)
    out[1 - len(last) :] = differ.to_numpy(zero_copy_only=False)
    return out


def _number(group: list[str], value: str, names: list[str]):
    """The columns of a sorted partition with its number, the total before each row, if the row is of the first group, and 1 at the first row and 2 at the last."""

    def run(batches):
        part, last, total, lead, held = TaskContext.get().partitionId(), None, 0, True, None

        def given(b: pa.RecordBatch, edge: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*b.columns, pa.array(edge)], [*b.schema.names, names[3]])

        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(b.schema.get_field_index(value)).to_numpy(zero_copy_only=False)
            new = np.zeros(b.num_rows, bool)
            for i, g in enumerate(group):
                new |= changes(b.column(b.schema.get_field_index(g)), last and last[i])
            if not group and last is None:
                new[0] = True
            sums = np.cumsum(v) - v
            at = np.flatnonzero(new)
            base = np.zeros(b.num_rows, v.dtype)
            if len(at):
                base[at] = np.diff(sums[at], prepend=0)
                base = np.cumsum(base)
            place = sums - base
            open_ = int(at[0]) if len(at) else b.num_rows
            place[:open_] += total
            leading = np.zeros(b.num_rows, bool)
            if lead:
                until = at[0] if len(at) and last is not None else at[1] if len(at) > 1 else b.num_rows
                leading[:until] = True
                lead = until == b.num_rows
            total = place[-1] + v[-1]
            edge = np.zeros(b.num_rows, np.int32)
            edge[0] = 1 if last is None else 0
            last = [b.column(b.schema.get_field_index(g)).slice(b.num_rows - 1) for g in group]
            b = pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(place), pa.array(leading)], [*b.schema.names, *names[:3]])
            if held:
                yield given(*held)
            held = b, edge
        if held:
            held[1][-1] += 2
            yield given(*held)

    return run


def before(df: DataFrame, group: list[str], order: list[Column | str], value: str | None = None, name: str = "before") -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` (without it, the number) over the rows before each in its group.

    ``order`` should be total, or ties fall as they come; nulls sort first.  ``value`` is a column of long or double that isn't null.  Nulls
    in ``group`` are a group.  ``df`` is run twice, once for a sample of its ranges, and the result is kept in the shared folder.
    """
    spark, columns = df.sparkSession, df.columns
    v, part, place, lead, edge, off = unused(df, "__v", "__part", "__place", "__lead", "__edge", "__off")
    by = [*(F.col(g) for g in group), *(F.col(o) if isinstance(o, str) else o for o in order)]
    rows = df.withColumn(v, F.col(value) if value else F.lit(1).cast("long"))
    kind = rows.schema[v].dataType.simpleString()
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    schema = StructType([*rows.schema.fields]).add(part, "integer").add(place, rows.schema[v].dataType).add(lead, "boolean").add(edge, "integer")
    numbered = stored(rows.mapInArrow(_number(group, v, [part, place, lead, edge]), schema), "ordered")
    key = F.struct(F.lit(0).alias("_"), *group)
    ends = numbered.groupBy(part).agg(
        F.sum(F.when(F.col(lead), F.col(v))).alias("lead"),
        F.first(F.when(F.col(edge).bitwiseAND(1) > 0, key), True).alias("head"),
        F.first(F.when(F.col(edge) >= 2, F.struct(key.alias("k"), (F.col(place) + F.col(v)).alias("n"))), True).alias("tail"),
    )
    none = 0.0 if kind in ("double", "float") else 0
    shift, open_, carried = [], None, none
    for r in sorted(ends.collect(), key=lambda r: r[part]):  # a row a task
        shift.append((r[part], carried if r["head"] == open_ else none))
        carried = (shift[-1][1] if r["tail"]["k"] == r["head"] else none) + r["tail"]["n"]
        open_ = r["tail"]["k"]
    shifts = spark.createDataFrame(shift, f"{part} int, {off} {kind}")
    out = numbered.join(F.broadcast(shifts), part)
    return out.select(*columns, (F.col(place) + F.when(F.col(lead), F.col(off)).otherwise(F.lit(0))).cast(kind).alias(name))
