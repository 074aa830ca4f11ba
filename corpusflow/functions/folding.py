"""Folds over arrays that give rows of their own, in time linear in what they give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items that are folded before what they gave is put aside.
CHUNK = 256


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: an expression inside a lambda is computed for each element, a lambda's variable isn't."""
    return F.transform(F.array(value), use)[0]


def fold(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """struct(state, out) after ``step(state, item)``, a new state and an array of ``kind``, along ``items``.

    What is given is gathered by pieces of the items, as each ``concat`` copies what it adds to: n items cost n times CHUNK, not n squared.
    """
    none = F.expr(f"cast(array() as array<{kind}>)")

    def cut(held: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(held), F.lit(1)), F.lit(CHUNK))
        return F.transform(starts, lambda i: F.slice(held, i, F.lit(CHUNK)))

    def item(acc, x):
        new, given = step(acc["state"], x)
        return F.struct(new.alias("state"), F.concat(acc["out"], given).alias("out"))

    def piece(acc, part):
        done = F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("out")), item)
        return once(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    start = F.struct(state.alias("state"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("out"))
    return F.aggregate(once(items, cut), start, piece, lambda acc: F.struct(acc["state"].alias("state"), F.flatten(acc["out"]).alias("out")))
