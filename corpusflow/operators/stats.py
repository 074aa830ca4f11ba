"""Evaluation statistics: rank percentiles, error rates, agreement tests, reports, window functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.functions.text import ColumnLike, col, simple_norm
from corpusflow.operators import ordered
from corpusflow.session import stored, unused


#: Ranges that a running total over all values is taken by.
RANGES = 10_000


def _by(df: DataFrame, by: list[str]):
    return df.groupBy(*by)


def _group(by: list[str]) -> Column:
    return F.struct(*by) if by else F.lit(0)


def _running(rows: DataFrame) -> DataFrame:
    """(g, v, t, upto, n): the distinct values of each group g, how many rows have them, have at most them, and are in the group.

    No group is sorted in one task: values are counted, dealt to at most RANGES ranges of equal width a group, and summed up by range
    first, then within each.
    """
    counts = rows.groupBy("g", "v").agg(F.count("*").alias("t"))
    span = counts.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("t").alias("n"))
    at = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (RANGES - 1))).otherwise(F.lit(0))
    placed = counts.join(span, "g").select("g", "v", "t", "n", at.cast("int").alias("b"))
    before = placed.groupBy("g", "b").agg(F.sum("t").alias("bt"))
    before = before.select("g", "b", (F.sum("bt").over(Window.partitionBy("g").orderBy("b")) - F.col("bt")).alias("before"))
    inside = F.sum("t").over(Window.partitionBy("g", "b").orderBy("v"))
    return placed.withColumn("inside", inside).join(before, ["g", "b"]).select("g", "v", "t", (F.col("before") + F.col("inside")).alias("upto"), "n")


def _ungroup(df: DataFrame, by: list[str]) -> DataFrame:
    return df.select(*(F.col(f"g.{c}").alias(c) for c in by), *(c for c in df.columns if c != "g"))


def rank_stats(df: DataFrame, value: str, by: list[str] = (), digits: int = 1, clamp: bool = False) -> DataFrame:
    """n, mean, median, p90, p95, min, max by rank: the element at floor(n * p), counted from 0, nulls left out.

    ``clamp`` holds the p95 index to n - 1.  Reads ``df`` several times, at once, see ``_located``.
    """
    rank = lambda n, p: F.least(F.floor(n * p), n - 1) if clamp else F.floor(n * p)
    rows = df.where(F.col(value).isNotNull()).select(_group(by).alias("g"), F.col(value).alias("v"))
    r = lambda c, n: F.round(c, digits).alias(n)
    out = _with_shares(rows, [F.count("*").alias("n"), r(F.avg("v"), "mean"), r(F.min("v"), "min"), r(F.max("v"), "max")], {"median": 0.5, "p90": 0.9, "p95": 0.95}, digits, rank)
    return _ungroup(out, list(by)).select(*by, "n", "mean", "median", "p90", "p95", "min", "max")


def timing_stats(df: DataFrame, value: str, by: list[str] = (), digits: int = 1) -> DataFrame:
    out = rank_stats(df, value, by, digits, clamp=True)
    return out.select(*by, F.col("mean").alias("avg"), F.col("median").alias("p50"), "p95", "min", "max")


#: Of the mergeable sketch that brackets ranks: its errors are at most one rank in so many.
ACCURACY = 10_000


def _bracketed(df: DataFrame, value: str, by: list[str], shares: list[float]) -> DataFrame:
    """(g, i, p): the interpolated percentile of each share i in each group, exactly."""
    return _located(df.select(_group(by).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null"), shares)


def _located(rows: DataFrame, shares: list[float], rank=None) -> DataFrame:
    """(g, i, p): the percentile of each share i in each group g of the values v, exactly: interpolated, or the value at ``rank(n, share)``.

    A sketch of each group brackets the ranks that are asked for, and one pass counts what lies below and keeps what lies inside, some
    ten-thousandths of the rows.  Groups that a bracket should miss are counted whole.
    """
    ends = [min(1.0, max(0.0, s + d / ACCURACY)) for s in shares for d in (-2, 2)]
    sketch = rows.groupBy("g").agg(F.count("*").alias("n"), F.percentile_approx("v", ends, ACCURACY).alias("q"))
    sides = F.array(*(F.struct(F.lit(i).alias("i"), F.col("q")[2 * i].alias("low"), F.col("q")[2 * i + 1].alias("high")) for i in range(len(shares))))
    sketch = stored(sketch.select("g", "n", F.filter(sides, lambda x: x["low"].isNotNull()).alias("sides")), "sketch")
    held = rows.join(sketch, "g").select("g", "n", "v", F.explode("sides").alias("x")).select("g", "n", "v", "x.*").where("v <= high")
    below = held.groupBy("g", "i", "n").agg(F.count_if(F.col("v") < F.col("low")).alias("below"))
    inside = held.where("v >= low").select(F.struct("g", "i").alias("g"), "v")
    found = _interpolated(_running(inside).select("g.g", "g.i", "v", "upto"), below, shares, rank)
    found = stored(found, "percentiles")
    missed = found.where("p is null or below > floor(at)").select("g").distinct()
    if missed.isEmpty():
        return found.select("g", "i", "p")
    whole = rows.join(missed, "g", "left_semi")
    none = whole.groupBy("g").agg(F.count("*").alias("n")).select("g", "n", F.explode(F.array(*map(F.lit, range(len(shares))))).alias("i"), F.lit(0).cast("long").alias("below"))
    again = _interpolated(_running(whole).join(none.select("g", "i"), "g").select("g", "i", "v", "upto"), none, shares, rank)
    return found.join(missed, "g", "left_anti").select("g", "i", "p").unionByName(again.select("g", "i", "p"))


def _interpolated(counted: DataFrame, below: DataFrame, shares: list[float], rank=None) -> DataFrame:
    """``below`` with at, the rank of each share from 0, and p, the value there; ``counted`` has how many values are at most v."""
    share = F.element_at(F.array(*map(F.lit, shares)), F.col("i") + 1)
    ranked = below.withColumn("at", rank(F.col("n"), share).cast("double") if rank else (F.col("n") - 1) * share)
    rows = counted.join(ranked, ["g", "i"]).withColumn("upto", F.col("upto") + F.col("below"))
    near = rows.groupBy("g", "i").agg(*(F.min(F.when(F.col("upto") > f("at"), F.col("v"))).alias(c) for f, c in ((F.floor, "a"), (F.ceil, "b"))))
    low, high = F.floor("at"), F.ceil("at")
    p = F.col("a") if rank else F.when((low == high) | (F.col("a") == F.col("b")), F.col("a")).otherwise((high - F.col("at")) * F.col("a") + (F.col("at") - low) * F.col("b"))
    return ranked.join(near, ["g", "i"], "left").withColumn("p", p)


def _with_shares(rows: DataFrame, aggregates: list[Column], shares: dict[str, float], digits: int, rank=None) -> DataFrame:
    """(g, ``aggregates`` of v, percentiles by name) of each group g, see ``_located``."""
    found = _located(rows, list(shares.values()), rank)
    each = (F.round(F.max(F.when(F.col("i") == i, F.col("p"))), digits).alias(name) for i, name in enumerate(shares))
    return rows.groupBy("g").agg(*aggregates).join(found.groupBy("g").agg(*each), "g")


def interp_percentiles(df: DataFrame, value: str, by: list[str] = (), points=(50, 90, 95, 99), digits: int = 4, approx: bool = False) -> DataFrame:
    """Percentiles by linear interpolation, exact without holding a group, or approximate ones from the sketch alone."""
    if approx:
        return _by(df, by).agg(*(F.round(F.percentile_approx(value, p / 100, ACCURACY), digits).alias(f"p{p}") for p in points))
    found = _bracketed(df, value, list(by), [p / 100 for p in points])
    at = lambda i: F.round(F.max(F.when(F.col("i") == i, F.col("p"))), digits)
    each = [at(i).alias(f"p{p}") for i, p in enumerate(points)]
    return _ungroup(found.groupBy("g").agg(*each), list(by)) if by else found.agg(*each)


def success_summary(df: DataFrame, ok: Column, by: list[str] = ()) -> DataFrame:
    out = _by(df, by).agg(F.count("*").alias("total"), F.count_if(ok).alias("success"))
    out = out.withColumn("error", F.col("total") - F.col("success"))
    return out.withColumn("rate_pct", F.round(F.when(F.col("total") > 0, 100.0 * F.col("success") / F.col("total")).otherwise(0.0), 2))


def with_overall(df: DataFrame, by: str, value: str, label: str = "Overall", digits: int = 4) -> DataFrame:
    """Means per group and over all rows."""
    out = df.rollup(by).agg(F.round(F.avg(value), digits).alias("mean"), F.count("*").alias("n"), F.grouping(by).alias("__g"))
    return out.select(F.when(F.col("__g") == 1, F.lit(label)).otherwise(F.col(by)).alias(by), "mean", "n")


def condition_summary(df: DataFrame, condition: str, metrics: list[str], order: list[str], digits: int = 4) -> DataFrame:
    """Median and interpolated p95 of the metrics per condition, in a fixed order; conditions without rows give nulls."""
    got = df.groupBy(condition).agg(F.count("*").alias("n"))
    for m in metrics:
        rows = df.where(F.col(m).isNotNull() & F.col(condition).isNotNull()).select(_group([condition]).alias("g"), F.col(m).cast("double").alias("v"))
        part = _with_shares(rows, [F.count("*").alias("__m")], {f"{m}_median": 0.5, f"{m}_p95": 0.95}, digits)
        got = got.join(_ungroup(part, [condition]).drop("__m"), condition, "left")
    return reindex(got, condition, order)


def reindex(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df`` in a fixed order of its categories, with position; absent ones give nulls."""
    table = df.sparkSession.createDataFrame(list(enumerate(order)), f"position int, {key} string")
    return F.broadcast(table).join(df, key, "left")


def metric_stats(df: DataFrame, metrics: list[str], digits: int = 4) -> DataFrame:
    """mean, std, min, max and number of missing per metric; NaN counts as missing, metrics without a value are dropped."""
    clean = df.select(*(F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double")).alias(m) for m in metrics))
    long = clean.unpivot([], metrics, "metric", "v")
    r = lambda c: F.round(c, digits)
    out = long.groupBy("metric").agg(r(F.avg("v")).alias("mean"), r(F.stddev_samp("v")).alias("std"), r(F.min("v")).alias("min"), r(F.max("v")).alias("max"), F.count_if(F.col("v").isNull()).alias("missing"))
    return out.where("mean is not null")


def coverage(df: DataFrame, score: str, threshold: float) -> DataFrame:
    """Answerable rows (score at least ``threshold``), gaps, their percentages and the mean score."""
    ok = F.col(score) >= threshold
    out = df.where(F.col(score).isNotNull()).agg(F.count("*").alias("n"), F.count_if(ok).alias("answerable"), F.round(F.avg(score), 4).alias("mean_score"))
    pct = lambda c: F.round(100.0 * c / F.nullif(F.col("n"), F.lit(0)), 2)
    return out.withColumn("gap", F.col("n") - F.col("answerable")).withColumn("answerable_pct", pct(F.col("answerable"))).withColumn("gap_pct", pct(F.col("gap")))


def edit_distance(a: list | str, b: list | str) -> int:
    """Insertions, deletions and substitutions from ``a`` to ``b``: a column of the distance table is one number, a bit a row.

    The columns are kept as differences between neighbours, +1 and -1 apart, and move on by a dozen operations on whole numbers.
    """
    start, n = 0, min(len(a), len(b))
    while start < n and a[start] == b[start]:
        start += 1
    end = 0
    while end < n - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if len(a) > len(b):
        a, b = b, a
    m = len(a)
    if not m:
        return len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    equal = {}
    for x, at in places.items():
        if len(at) * 16 > m:  # many: set them in one array
            bits = np.zeros(m, np.uint8)
            bits[at] = 1
            equal[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        else:
            equal[x] = sum(1 << i for i in at)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, distance = full, 0, m
    for x in b:
        same = equal.get(x, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right = down | (full ^ ((diagonal | up) & full))
        left = up & diagonal
        if right & top:
            distance += 1
        elif left & top:
            distance -= 1
        right = (right << 1 | 1) & full
        left = left << 1 & full
        up = left | (full ^ ((diagonal | right) & full))
        down = right & diagonal
    return distance


#: Numbers of 64 bits that the tables of a group of pairs take at most, and about how many a step works on at once.
TABLE, STEP = 1 << 22, 4096
#: Symbols that are held as numbers at once, if one pair hasn't more.
SYMBOLS = 1 << 22


def _coded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The longer and the shorter of two arrays of symbols without what they begin and end with alike, as numbers from 1 on, and how many there are; 0 is what the longer one hasn't."""
    if len(a) < len(b):
        a, b = b, a
    for _ in range(2):  # from the start, then from the end
        other = a[: len(b)] != b
        n = int(other.argmax()) if other.any() else len(b)
        a, b = a[n:][::-1], b[n:][::-1]
    known, of_a = np.unique(a, return_inverse=True)
    if not len(b):
        return of_a + 1, np.zeros(0, np.int64), len(known)
    of_b = np.minimum(np.searchsorted(known, b), len(known) - 1)
    return of_a + 1, np.where(known[of_b] == b, of_b + 1, 0), len(known)


def _within(pairs: list[tuple]) -> np.ndarray:
    """A distance of each pair (longer, shorter, symbols, k) that is never too small, and right where it is at most k.

    A path of k edits leaves the diagonals of the distance table by no more than k allows, so the rest is left out.  A column's 64 rows are one
    number for up and one for down, as in ``edit_distance``; all blocks of rows of all pairs move on together, each a column behind
    the block above it.  All get the same rows: what is added is the same at both ends and costs nothing.
    """
    rows = -(-max(len(a) for a, _, _, _ in pairs) // 64)
    gap = np.array([len(a) - len(b) for a, b, _, _ in pairs])
    most = np.array([k for *_, k in pairs])
    below, above = int(((most - gap) // 2).max()), int(((most + gap) // 2).max())
    columns, n = int(64 * rows - gap.min()), len(pairs)
    starts = np.cumsum([0] + [(s + 2) * rows for _, _, s, _ in pairs])
    table = np.zeros(starts[-1], np.uint64)
    own, at = np.empty((n, 64 * rows), np.int64), np.empty((columns, n), np.int64)
    for p, (a, b, s, _) in enumerate(pairs):
        own[p], at[:, p] = starts[p] + (s + 1) * rows, starts[p]
        own[p, : len(a)] = starts[p] + a * rows
        at[columns - len(b) :, p] = starts[p] + b[::-1] * rows  # the last column comes first: blocks are read in order then
        at[columns - (64 * rows - gap[p]) : columns - len(b), p] = starts[p] + (s + 1) * rows
    block = np.arange(rows)
    for bit in range(64):
        table[own[:, bit::64] + block] |= np.uint64(1 << bit)
    del own
    block = np.repeat(block[:, None], n, axis=1)
    one, last_bit = np.uint64(1), np.uint64(63)
    up, down = np.full((rows, n), ~np.uint64(0)), np.zeros((rows, n), np.uint64)
    plus, minus = np.ones((rows + 1, n), np.uint64), np.zeros((rows + 1, n), np.uint64)  # what each block hands to the next
    ends: dict[int, list[int]] = {}
    for p in range(n):
        ends.setdefault(int(64 * rows - gap[p]) + rows - 2, []).append(p)
    score, out = np.full(n, 64, np.uint64), np.zeros(n, np.int64)
    first = last = -1
    for t in range(max(ends) + 1):
        f, e = max(0, (t - 64 - below) // 65 + 1, t - columns + 1), min(rows - 1, t, (t + above) // 65)
        moved = f != first
        if moved or e != last:
            if 0 <= last < e:  # the next block begins where the last one was a column before
                score += np.uint64(64)
                score -= plus[e]
                score += minus[e]
            first, last = f, e
            u, d, hp, hm, place = up[f : e + 1], down[f : e + 1], plus[f : e + 1], minus[f : e + 1], block[f : e + 1]
            to_plus, to_minus, end_plus, end_minus = plus[f + 1 : e + 2], minus[f + 1 : e + 2], plus[e + 1], minus[e + 1]
            index, x, y, z = np.empty(u.shape, np.int64), *(np.empty(u.shape, np.uint64) for _ in range(3))
        np.add(at[columns - 1 - t + f : columns - t + e], place, out=index)
        table.take(index, out=y, mode="clip")
        np.bitwise_or(y, hm, out=y)  # equal, or less comes from above
        np.bitwise_and(y, u, out=x)
        np.add(x, u, out=x)
        np.bitwise_xor(x, u, out=x)
        np.bitwise_or(x, y, out=x)
        np.bitwise_or(x, d, out=x)  # the diagonal stays
        np.bitwise_or(x, u, out=z)
        np.invert(z, out=z)
        np.bitwise_or(z, d, out=z)  # right is more
        np.bitwise_and(x, u, out=y)  # right is less
        np.left_shift(z, one, out=u)
        np.bitwise_or(u, hp, out=u)
        np.right_shift(z, last_bit, out=to_plus)
        np.left_shift(y, one, out=z)
        np.bitwise_or(z, hm, out=z)
        np.right_shift(y, last_bit, out=to_minus)
        np.bitwise_and(x, u, out=d)
        np.bitwise_or(x, u, out=u)
        np.invert(u, out=u)
        np.bitwise_or(u, z, out=u)
        score += end_plus
        score -= end_minus
        if moved:  # nothing comes from above any more
            plus[f], minus[f] = 1, 0
        if t in ends:
            out[ends[t]] = score[ends[t]]
    return out


def _grouped(pairs: list[tuple]):
    """Lists of pairs (place, (longer, shorter, symbols, k)) of about the same size that are worked on together."""
    group, rows, symbols, wide = [], 0, 0, 0
    for place, p in sorted(pairs, key=lambda x: (x[1][3].bit_length(), len(x[1][0])), reverse=True):
        own = -(-len(p[0]) // 64)
        r, s, w = max(rows, own), symbols + p[2] + 2, max(wide, p[3] // 64 + 2)
        if group and (r * s > TABLE or w * (len(group) + 1) > STEP or 2 * own < r):
            yield group
            group, r, s, w = [], own, p[2] + 2, p[3] // 64 + 2
        group.append((place, p))
        rows, symbols, wide = r, s, w
    if group:
        yield group


def edit_distances(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """``edit_distance`` of many pairs of arrays of whole numbers, at once: first near the diagonal, and farther where the distance found asks for it."""
    out = np.zeros(len(pairs), np.int64)
    todo = []
    for i, (a, b) in enumerate(pairs):
        a, b, symbols = _coded(a, b)
        if not len(b):
            out[i] = len(a)
        elif (symbols + 2) * (len(a) // 64 + 1) > TABLE:
            out[i] = edit_distance(a.tolist(), b.tolist())
        else:
            todo.append((i, (a, b, symbols, min(len(a), len(a) - len(b) + len(b) // 10 + 16))))
    while todo:
        again = []
        for group in _grouped(todo):
            for (i, (a, b, symbols, k)), d in zip(group, _within([p for _, p in group]).tolist()):
                if d <= k:
                    out[i] = d
                else:
                    again.append((i, (a, b, symbols, min(d, 4 * k))))
        todo = again
    return out


def _symbols(texts: list[str], words: bool) -> list[np.ndarray]:
    """The words or characters of each text as numbers that are the same for the same ones."""
    if not words:
        return [np.frombuffer(x.replace(" ", "").encode("utf-32-le"), np.uint32) for x in texts]
    parts = pc.utf8_split_whitespace(pa.array([x.strip() for x in texts], pa.large_string()))  # at what str.split parts at
    numbers = parts.flatten().dictionary_encode().indices.to_numpy()
    cuts = np.cumsum(pc.list_value_length(parts).to_numpy())[:-1]
    return [n if x.strip() else n[:0] for x, n in zip(texts, np.split(numbers, cuts))]


def _rate(words: bool):
    def run(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
        out = np.full(len(reference), np.nan)
        texts = sorted(((len(r) + len(h), i) for i, (r, h) in enumerate(zip(reference, hypothesis)) if r is not None and h is not None), reverse=True)
        at = 0
        while at < len(texts):
            size, end = texts[at][0], at + 1
            while end < len(texts) and size + texts[end][0] <= SYMBOLS:
                size += texts[end][0]
                end += 1
            places = [i for _, i in texts[at:end]]
            said = _symbols([s.iat[i] for s in (reference, hypothesis) for i in places], words)
            length = np.array([len(r) for r in said[: len(places)]])
            pairs = list(zip(said[: len(places)], said[len(places) :]))
            out[places] = np.where(length > 0, edit_distances(pairs) / np.maximum(length, 1), 0.0)
            at = end
        return pd.Series(out)

    return F.pandas_udf(run, "double")


def wer(reference: ColumnLike, hypothesis: ColumnLike) -> Column:
    """Word edit distance over reference words; 0 for an empty reference, null for a null.  Texts of any length and vocabulary."""
    return _rate(True)(simple_norm(reference), simple_norm(hypothesis))


def cer(reference: ColumnLike, hypothesis: ColumnLike) -> Column:
    """Character edit distance without spaces over reference characters; 0 for an empty reference, null for a null."""
    return _rate(False)(simple_norm(reference), simple_norm(hypothesis))


def wer_summary(df: DataFrame, rate: str, by: list[str] = (), digits: int = 4) -> DataFrame:
    """Mean, median, population deviation, best, worst, shares up to 10/20/30/50 %, perfect and bad counts."""
    share = lambda t: F.round(100.0 * F.count_if(F.col(rate) <= t) / F.nullif(F.count(rate), F.lit(0)), 2).alias(f"le_{round(100 * t)}_pct")
    r = lambda c, n: F.round(c, digits).alias(n)
    rows = df.groupBy(_group(by).alias("g")) if by else df.groupBy()
    out = rows.agg(F.count(rate).alias("n"), r(F.avg(rate), "mean"), r(F.stddev_pop(rate), "std"), r(F.min(rate), "best"), r(F.max(rate), "worst"), *map(share, (0.1, 0.2, 0.3, 0.5)), F.count_if(F.col(rate) == 0).alias("perfect"), F.count_if(F.col(rate) >= 0.5).alias("bad"))
    out = (out if by else out.withColumn("g", F.lit(0))).join(_bracketed(df, rate, list(by), [0.5]).select("g", F.round("p", digits).alias("median")), "g", "left")
    names = ("n", "mean", "median", "std", "best", "worst", "le_10_pct", "le_20_pct", "le_30_pct", "le_50_pct", "perfect", "bad")
    return _ungroup(out.select("g", *names), list(by)) if by else out.select(*names)


def distinct_counts(df: DataFrame, columns: dict[str, str], approx: bool = False) -> DataFrame:
    """One row: how many different values each column has, by output name; nulls don't count.

    Exact by digests of 128 bits, so that texts stay where they are, or ``approx`` by sketches, of which a task gives one a column.
    """
    digest = lambda c: F.unhex(F.md5(F.col(c).cast("string").cast("binary")))
    if approx:  # sketches leave out empty strings, not their digests
        return df.agg(*(F.hll_sketch_estimate(F.hll_sketch_agg(digest(c))).alias(n) for n, c in columns.items()))
    each = F.array(*(F.struct(F.lit(i).alias("i"), digest(c).alias("d")) for i, c in enumerate(columns.values())))
    rows = df.select(F.explode(each).alias("x")).select("x.*").where("d is not null").distinct().groupBy("i").agg(F.count("*").alias("n"))
    return rows.agg(*(F.coalesce(F.max(F.when(F.col("i") == i, F.col("n"))), F.lit(0)).alias(n) for i, n in enumerate(columns)))


def rtf_stats(df: DataFrame, latency: Column, duration: Column, by: list[str], digits: int = 6) -> DataFrame:
    """Latency over duration: mean, median, p95, p99, max; rows without a duration count 0."""
    rows = df.select(_group(by).alias("g"), F.when(duration > 0, latency / duration).otherwise(0.0).alias("v"))
    r = lambda c, n: F.round(c, digits).alias(n)
    # a latency without a value is counted, but has no rank
    out = _with_shares(rows.where("v is not null"), [r(F.avg("v"), "mean"), r(F.max("v"), "max")], {"median": 0.5, "p95": 0.95, "p99": 0.99}, digits)
    out = rows.groupBy("g").agg(F.count("*").alias("n")).join(out, "g", "left")
    return _ungroup(out, list(by)).select(*by, "n", "mean", "median", "p95", "p99", "max")


def derived_latency(asr: Column, rag: Column, ttft: Column, flush: Column, tts: Column, tokens: Column, total: Column) -> list[Column]:
    """perceived, first_audio, tts_ttfc and tokens_per_s of a request; missing parts count 0."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return [(z(rag) + z(ttft)).alias("perceived"), (z(asr) + z(flush) + z(tts)).alias("first_audio"), z(tts).alias("tts_ttfc"), (z(tokens) / F.nullif(total / 1000.0, F.lit(0.0))).alias("tokens_per_s")]


def top_counts(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The ``n`` commonest keys; the report's own limit."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), key).limit(n)


def corpus_report(docs: DataFrame, summary: DataFrame, text: str, cuts=(0.9, 0.7, 0.5)) -> DataFrame:
    """One row: documents, average text length, questions covered, score mean/min/max, questions whose best score reaches each cut.

    ``summary`` has n, total, least and best of the scores of a question, as ``retrieval.vector_summary`` gives them.
    """
    a = docs.agg(F.count("*").alias("docs"), F.round(F.avg(F.length(text)), 4).alias("avg_chars"))
    reach = (F.count_if(F.col("best") >= t).alias(f"best_ge_{round(100 * t)}") for t in cuts)
    b = summary.agg(F.round(F.sum("total") / F.sum("n"), 4).alias("score_mean"), F.round(F.min("least"), 4).alias("score_min"), F.round(F.max("best"), 4).alias("score_max"), F.count("*").alias("questions"), *reach)
    return a.crossJoin(b)  # two rows of one row each


def cache_stats(df: DataFrame, status: str, compute_ms: str, size: Column, by: list[str] = ()) -> DataFrame:
    """hits, misses, writes, errors, bytes written, milliseconds saved, hit rate (0 without requests)."""
    is_ = lambda s: F.col(status) == s
    total = lambda when, what, name: F.round(F.coalesce(F.sum(F.when(when, what)), F.lit(0.0)), 4).alias(name)
    out = _by(df, by).agg(
        F.count_if(is_("hit")).alias("hits"), F.count_if(is_("miss")).alias("misses"), F.count_if(is_("write")).alias("writes"), F.count_if(is_("error")).alias("errors"),
        F.coalesce(F.sum(F.when(is_("write"), size)), F.lit(0)).cast("long").alias("bytes"), total(is_("hit"), F.col(compute_ms), "saved_ms"),
    )
    asked = F.col("hits") + F.col("misses")
    return out.withColumn("hit_rate", F.round(F.when(asked > 0, F.col("hits") / asked).otherwise(0.0), 4))


# fixed values: two-sided 95 % points of Student's t by degrees of freedom; beyond them the series below
T_95 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042)


def t_quantile(freedom: Column) -> Column:
    """Two-sided 95 % point of Student's t: tabled to 30 degrees, a series in 1/df beyond."""
    z = 1.959963984540054
    terms = [z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96]
    series = F.lit(terms[0]) + terms[1] / freedom + terms[2] / (freedom * freedom)
    return F.when(freedom.between(1, len(T_95)), F.element_at(F.array(*map(F.lit, T_95)), F.greatest(F.least(freedom, F.lit(len(T_95))), F.lit(1)).cast("int"))).when(freedom > len(T_95), series)


def mos_ci(df: DataFrame, condition: str, score: str, digits: int = 4) -> DataFrame:
    """mean, s / sqrt(n) and the 95 % half width per condition."""
    out = df.groupBy(condition).agg(F.count(score).alias("n"), F.avg(score).alias("m"), F.stddev_samp(score).alias("s"))
    error = F.col("s") / F.sqrt("n")
    return out.select(condition, "n", F.round("m", digits).alias("mean"), F.round(error, digits).alias("std_error"), F.round(t_quantile(F.col("n") - 1) * error, digits).alias("half_width"))


def friedman(df: DataFrame, block: str, condition: str, value: str, conditions: list[str], digits: int = 6) -> DataFrame:
    """Friedman's statistic over complete blocks, corrected for ties: chi2, blocks, freedom."""
    means = df.groupBy(block, condition).agg(F.avg(value).alias("v")).where(F.col(condition).isin(conditions))
    k = len(conditions)
    full = means.groupBy(block).agg(F.count("*").alias("c")).where(F.col("c") == k).select(block)
    w = Window.partitionBy(block)
    ranked = means.join(full, block).withColumn("r0", F.rank().over(w.orderBy("v"))).withColumn("ties", F.count("*").over(Window.partitionBy(block, "v")))
    ranked = ranked.withColumn("r", F.col("r0") + (F.col("ties") - 1) / 2.0)
    sums = ranked.groupBy(condition).agg(F.sum("r").alias("R")).agg(F.sum(F.col("R") * F.col("R")).alias("S"))
    tie = ranked.agg(F.count_distinct(block).alias("blocks"), F.sum(F.col("ties") * F.col("ties") - 1.0).alias("T"))
    n = F.col("blocks")
    raw = 12.0 * F.col("S") / (n * k * (k + 1)) - 3.0 * n * (k + 1)
    correction = 1.0 - F.col("T") / (n * (k**3 - k))
    return sums.crossJoin(tie).select(F.round(F.when(correction > 0, raw / correction), digits).alias("chi2"), n.alias("blocks"), F.lit(k - 1).cast("long").alias("freedom"))


def dunn_holm(df: DataFrame, condition: str, value: str) -> DataFrame:
    """Dunn's pairwise rank-sum z and Holm-adjusted p for all pairs of conditions.

    Ranks are counted over distinct values, not rows: the rows of each value, then a running total of those.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(condition).alias("c"), F.col(value).alias("v"))
    counts = rows.groupBy("v").agg(F.count("*").alias("t"))
    run = _running(rows.select(_group([]).alias("g"), "v"))
    ranks = run.select("v", "t", (F.col("upto") - (F.col("t") - 1) / 2.0).alias("r"))
    groups = rows.join(ranks.select("v", "r"), "v").groupBy("c").agg(F.count("*").alias("n"), F.avg("r").alias("m"))
    total = counts.agg(F.sum("t").alias("all_n"), F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("all_ties"))
    a, b = groups.alias("a"), groups.alias("b")
    pairs = a.join(b, F.expr("a.c < b.c")).crossJoin(total)
    scale = F.col("all_n") * (F.col("all_n") + 1) / 12.0 - F.col("all_ties") / (12.0 * (F.col("all_n") - 1))
    z = (F.col("a.m") - F.col("b.m")) / F.sqrt(scale * (1.0 / F.col("a.n") + 1.0 / F.col("b.n")))
    out = pairs.select(F.col("a.c").alias("first"), F.col("b.c").alias("second"), z.alias("z"))
    out = out.withColumn("p", 2.0 * (1.0 - normal_cdf(F.abs("z"))))
    w = Window.orderBy("p", "first", "second")  # pairs of conditions: a handful of rows
    m = F.count("*").over(Window.partitionBy())
    step = F.least(F.lit(1.0), F.col("p") * (m - F.row_number().over(w) + 1))
    return out.withColumn("__s", step).withColumn("p_holm", F.max("__s").over(w)).drop("__s")


def normal_cdf(x: Column) -> Column:
    """The normal distribution function for x >= 0, by a rational approximation (error under 1e-7)."""
    t = 1.0 / (1.0 + 0.2316419 * x)
    poly = F.lit(0.0)
    for c in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):  # fixed values of the approximation
        poly = (poly + c) * t
    return 1.0 - F.exp(-x * x / 2.0) / math.sqrt(2 * math.pi) * poly


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts per bin of equal width between the least and largest value, which belongs to the last bin."""
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    rows = df.select(F.col(value).alias("v")).where("v is not null").crossJoin(F.broadcast(span))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    return rows.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def kde(df: DataFrame, value: str, grid: int = 300, margin: float = 20.0, population: bool = False, digits: int = 8) -> DataFrame:
    """Gaussian kernel density on a grid, bandwidth 1.06 sd n^(-1/5).

    Equal values are counted first and the grid, a stated number of points, is laid against the distinct values.
    """
    sd = F.stddev_pop("v") if population else F.stddev_samp("v")
    rows = df.select(F.col(value).cast("double").alias("v")).where("v is not null")
    facts = rows.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), (1.06 * sd * F.pow(F.count("*").cast("double"), F.lit(-0.2))).alias("bw"))
    i = df.sparkSession.range(grid).crossJoin(F.broadcast(facts))
    points = i.select("id", (F.col("lo") - margin + F.col("id") * (F.col("hi") - F.col("lo") + 2 * margin) / (grid - 1)).alias("x"), "bw", "n")
    pairs = rows.groupBy("v").agg(F.count("*").alias("t")).crossJoin(F.broadcast(points))
    u = (F.col("x") - F.col("v")) / F.col("bw")
    return pairs.groupBy("id").agg(F.round(F.first("x"), digits).alias("x"), F.round(F.sum(F.col("t") * F.exp(-u * u / 2) / (F.col("n") * F.col("bw") * math.sqrt(2 * math.pi))), digits).alias("density"))


def stress_report(df: DataFrame, ok: Column, metrics: list[str], digits: int = 4) -> DataFrame:
    """Per metric over successful requests: mean, min, max, p50, p90, p99; failed is the same in every row."""
    rows = df.withColumn("__ok", ok)
    long = rows.where("__ok").select(*(F.col(m).cast("double").alias(m) for m in metrics)).unpivot([], metrics, "metric", "v")
    r = lambda c, n: F.round(c, digits).alias(n)
    values = long.where("v is not null").select(_group(["metric"]).alias("g"), "v")
    out = _ungroup(_with_shares(values, [r(F.avg("v"), "mean"), r(F.min("v"), "min"), r(F.max("v"), "max")], {f"p{p}": p / 100 for p in (50, 90, 99)}, digits), ["metric"])
    failed = rows.agg(F.count_if(~F.coalesce(F.col("__ok"), F.lit(False))).alias("failed"))
    return out.crossJoin(F.broadcast(failed))


def ttft_tpot(events: DataFrame, request: str, ts: Column, start: Column, digits: int = 4) -> DataFrame:
    """Per request: first chunk after its start, time per token after the first, tokens."""
    t = events.select(request, ts.alias("t"), start.alias("s"))
    out = t.groupBy(request).agg(F.count("*").alias("tokens"), F.min("t").alias("a"), F.max("t").alias("b"), F.min("s").alias("s"))
    tpot = F.when(F.col("tokens") > 1, (F.col("b") - F.col("a")) / (F.col("tokens") - 1)).otherwise(0.0)
    return out.select(request, "tokens", F.round(F.col("a") - F.col("s"), digits).alias("ttft"), F.round(tpot, digits).alias("tpot"))


def progress_yield(log: DataFrame, question: str, added: str, failed: Column) -> DataFrame:
    per = log.groupBy(question).agg(F.sum(added).alias("a"), F.max(failed.cast("int")).alias("f"))
    return per.agg(F.count_if(F.col("a") > 0).alias("improved"), F.count_if((F.col("a") <= 0) & (F.col("f") == 1)).alias("failed"), F.coalesce(F.sum("a"), F.lit(0)).cast("long").alias("chunks_added"))


def timing_merge(events: DataFrame, key: str, seq: str, text: str, timing: str, contexts: str) -> DataFrame:
    """One response per key: texts joined by spaces, later timing keys over earlier ones, the last contexts."""
    e = F.collect_list(F.struct(F.col(seq).alias("s"), F.col(text).alias("x"), F.col(timing).alias("m")))
    e = F.array_sort(e, lambda a, b: F.when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1).otherwise(0))  # maps have no order of their own
    empty = F.expr("cast(map() as map<string,double>)")
    merge = lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, _: ~F.map_contains_key(F.coalesce(x["m"], empty), k)), F.coalesce(x["m"], empty))
    out = events.groupBy(key).agg(e.alias("__e"), F.max_by(contexts, F.when(F.col(contexts).isNotNull(), F.col(seq))).alias(contexts))
    return out.select(key, F.array_join(F.filter(F.transform("__e", lambda x: x["x"]), lambda x: x.isNotNull() & (x != "")), " ").alias("text"), F.aggregate("__e", empty, merge).alias("timing"), contexts)


# window functions


def running_id(df: DataFrame, group: str, order: str, existing: DataFrame | None = None, number: str = "n", width: int = 4) -> DataFrame:
    """``df`` with syn_{group}_{n}, going on after the largest number of the group so far; groups of any size are numbered by ranges."""
    n, most = unused(df, "__n", "__max")
    out = ordered.before(df, [group], [order], name=n).withColumn(n, F.col(n) + 1)
    if existing is not None:
        out = out.join(existing.groupBy(group).agg(F.max(number).alias(most)), group, "left")
        out = out.withColumn(n, F.col(n) + F.coalesce(most, F.lit(0))).drop(most)
    return out.withColumn("syn_id", F.concat_ws("_", F.lit("syn"), F.col(group), F.lpad(F.col(n).cast("string"), width, "0"))).drop(n)


def last_turns(df: DataFrame, session: str, turn: str, n: int) -> DataFrame:
    w = Window.partitionBy(session).orderBy(F.col(turn).desc())
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def memory_fold(df: DataFrame, session: str, turn: str, limit: int = 3, keep: int = 2) -> DataFrame:
    """Which turns a session's memory holds after its last turn: (session, held, compressed, batches).

    Over ``limit`` turns all but ``keep`` are compressed at once, so the state after n turns follows from n.
    """
    n = df.groupBy(session).agg(F.count(turn).alias("n"))
    step = limit + 1 - keep
    batches = F.when(F.col("n") > limit, F.floor((F.col("n") - limit - 1) / step) + 1).otherwise(F.lit(0)).cast("long")
    return n.withColumn("batches", batches).select(session, (F.col("n") - F.col("batches") * step).alias("held"), (F.col("batches") * step).alias("compressed"), "batches")


def ecdf(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``df`` with ecdf: the share of the group's rows with at most the row's value."""
    run = _running(df.where(F.col(value).isNotNull()).select(_group(by).alias("g"), F.col(value).alias("v")))
    share = run.select(F.col("g").alias("__g"), F.col("v").alias("__v"), F.round(F.col("upto") / F.col("n"), 6).alias("ecdf"))
    return df.join(share, (_group(by) == F.col("__g")) & (F.col(value) == F.col("__v")), "left").drop("__g", "__v")


def share_of_total(df: DataFrame, key: str, digits: int = 4) -> DataFrame:
    out = df.groupBy(key).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("__all"))  # one row
    return out.crossJoin(F.broadcast(total)).withColumn("share_pct", F.round(100.0 * F.col("n") / F.col("__all"), digits)).drop("__all")


def flag_warmup(df: DataFrame, run: str, order: str, k: int = 3) -> DataFrame:
    return df.withColumn("warmup", F.row_number().over(Window.partitionBy(run).orderBy(order)) <= k)


def speech_segments(df: DataFrame, session: str, ts: Column, order: str, is_start: Column, is_end: Column, least_ms: int = 250) -> DataFrame:
    """Runs from a start event to the next end (or the last event of the session, if it stays open), of at least ``least_ms``."""
    w = Window.partitionBy(session).orderBy("__t", order)
    rows = df.where(is_start | is_end).select(session, order, ts.alias("__t"), is_start.alias("s"))
    rows = rows.withColumn("p", F.lag("s").over(w))
    rows = rows.withColumn("island", F.sum(F.when(F.col("s") & ~F.coalesce("p", F.lit(False)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first_end = F.min(F.when(~F.col("s"), F.col("__t")))
    out = rows.where("island > 0").groupBy(session, "island").agg(F.min("__t").alias("start_ms"), F.coalesce(first_end, F.max("__t")).alias("end_ms"))
    return out.withColumn("duration_ms", F.col("end_ms") - F.col("start_ms")).where(F.col("duration_ms") >= least_ms)
