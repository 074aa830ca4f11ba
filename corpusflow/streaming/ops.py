"""Structured Streaming forms of the stateful operators.

State is per key, typed and small, and lives in the RocksDB state store.  A micro-batch's rows of one key are folded in order, as columns; a
key with more than HELD rows goes through a list on disk and is folded range by range, so that memory doesn't grow with the key.
Without ``ts`` rows of one key that are read together travel as one row of arrays; with it each row keeps its own event time.
Time is event time: with ``ts``, a timestamp column behind a watermark, keys that stay idle are closed and forgotten when
the watermark passes them, and nothing depends on when a query runs.  Without it keys are kept.

Rows later than the watermark, where one is set, are dropped: the sources these jobs re-state have no late-data rule, so its delay is the
time to live they give their sessions.  Order holds within a micro-batch and between them as they come.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from corpusflow.functions.chunking import StreamBuffer

#: Rows of one key that are held in memory.
HELD = 200_000
#: Rows of one key that travel as one.
PACKED = 256
#: Types whose arrays come to Python as they are.
_PLAIN = (T.StringType, T.BooleanType, T.IntegralType, T.FloatType, T.DoubleType)
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Fold(StatefulProcessor):
    """Folds each key's rows in order.

    A subclass has the schema of its state and of its rows out; ``step`` takes the state (None where there is none) and one row's values, appends
    rows to ``out`` and returns the new state; ``close`` gives the last rows of a key that is idle.
    """

    state = ""
    made: list[str] = []

    def __init__(self, key: str, columns: list[str], kinds: str, order: list[int], ts: int | None, idle_ms: int | None, packed: bool):
        self.key, self.columns, self.kinds, self.order, self.ts, self.idle_ms, self.packed = key, columns, kinds, order, ts, idle_ms, packed

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.state)
        self.pending = handle.getListState("pending", self.kinds)
        if self.ts is not None:
            self.timer = handle.getValueState("timer", "at long")

    def step(self, state: tuple | None, row: tuple, out: list[tuple]) -> tuple | None:
        raise NotImplementedError

    def close(self, state: tuple | None = None, out: list[tuple] | None = None) -> None:
        """Also called without arguments when the query ends."""

    def expires(self, state: tuple | None, last: float) -> float:
        """When a key can be forgotten, in milliseconds of event time; ``last`` is that of its last row."""
        return last + self.idle_ms

    def _rank(self, row: tuple) -> tuple:
        return tuple((row[i] is not None, row[i]) for i in self.order)

    def _parts(self, pdf: pd.DataFrame) -> Iterator[Iterator[tuple]]:
        """The rows of a frame, in parts of bounded size."""
        if self.packed:
            for arrays in zip(*(pdf[c] for c in self.columns)):
                yield zip(*map(_values, arrays))
        else:
            yield zip(*(pdf[c].astype(object).where(pdf[c].notna(), None) for c in self.columns))

    def _sorted(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """The rows in order; with many, by ranges of what was put aside."""
        at, spilled, samples = [], 0, []
        for part in (part for pdf in rows for part in self._parts(pdf)):
            at += part
            if len(at) > HELD:
                spilled += len(at)
                samples += map(self._rank, at[:: max(1, HELD // 256)])
                self.pending.appendList(at)
                at = []
        if not spilled:
            at.sort(key=self._rank)
            yield from at
            return
        if at:
            spilled += len(at)
            samples += map(self._rank, at[:: max(1, HELD // 256)])
            self.pending.appendList(at)
        samples.sort()
        n = -(-spilled // HELD) * 2
        cuts = sorted({samples[len(samples) * i // n] for i in range(1, n)})
        for i in range(len(cuts) + 1):
            own = [tuple(r) for r in self.pending.get() if bisect_right(cuts, self._rank(tuple(r))) == i]
            own.sort(key=self._rank)
            yield from own
        self.pending.clear()

    def _given(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        got = pd.DataFrame({self.key: [key[0]] * len(out)} | dict(zip(self.made, map(list, zip(*out)))))
        out.clear()
        return got

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.held.get()
        out: list[tuple] = []
        last = None
        for row in self._sorted(rows):
            if self.ts is not None and row[self.ts] is not None and (last is None or row[self.ts] > last):
                last = row[self.ts]
            state = self.step(state, row, out)
            if len(out) >= HELD:
                yield self._given(key, out)
        self._keep(state)
        if last is not None and self.idle_ms is not None:
            was = self.timer.get()[0] if self.timer.exists() else None
            now = int(self.expires(state, last.timestamp() * 1000)) + 1
            if was is None or now > was:
                if was is not None:
                    self.handle.deleteTimer(was)
                self.handle.registerTimer(now)
                self.timer.update((now,))
        if out:
            yield self._given(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        if self.held.exists():
            self.close(tuple(self.held.get()), out)
        self.held.clear()
        self.timer.clear()
        if out:
            yield self._given(key, out)

    def _keep(self, state: tuple | None) -> None:
        if state is None:
            self.held.clear()
        else:
            self.held.update(state)


def _values(array: np.ndarray) -> list:
    return [None if x != x else x for x in array.tolist()] if array.dtype.kind == "f" else array.tolist()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's rows by their first column, up to PACKED of one key as one row: the key, and the others as arrays in the order they came."""
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(0).dictionary_encode("encode").indices.to_numpy()
        if (codes[1:] < codes[:-1]).any():
            by_key = np.argsort(codes, kind="stable")
            batch, codes = batch.take(pa.array(by_key)), codes[by_key]
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        place = np.arange(len(codes)) - np.repeat(first, np.diff(first, append=len(codes)))
        starts = np.flatnonzero(place % PACKED == 0)
        ends = pa.array(np.append(starts, len(codes)), pa.int32())
        arrays = [pa.ListArray.from_arrays(ends, c) for c in batch.columns[1:]]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(starts)), *arrays], names=batch.schema.names)


def _stateful(df: DataFrame, fold: type[_Fold], key: str, columns: list[str], order: list[str], out: str, ts: str | None, idle_ms: int | None, *args) -> DataFrame:
    names = list(dict.fromkeys([*columns, *order, *([ts] if ts else [])]))
    kinds = ", ".join(f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(names))
    kind = df.schema[key].dataType.simpleString()
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)  # the only store with typed state
    places, packed = [names.index(c) for c in order], not ts and all(isinstance(df.schema[c].dataType, _PLAIN) for c in (key, *names))
    if packed:
        kept = [f"{key}_{i}" for i in range(len(names))]
        df = df.select(key, *(F.col(c).alias(k) for c, k in zip(names, kept)))
        df = df.mapInArrow(_pack, T.StructType([df.schema[key], *(T.StructField(k, T.ArrayType(df.schema[k].dataType)) for k in kept)]))
        names = kept
    run = fold(key, names, kinds, places, names.index(ts) if ts else None, idle_ms, packed)
    run.made = [c.split()[0] for c in out.split(", ")]
    run.args = args
    return df.groupBy(key).transformWithStateInPandas(run, f"{key} {kind}, {out}", "append", "eventTime" if ts else "none")


class _Memory(_Fold):
    state = "turns array<struct<role:string,text:string>>"

    def step(self, state, row, out):
        limit, keep = self.args
        held = [*(tuple(t) for t in state[0]), (row[0], row[1])] if state else [(row[0], row[1])]
        if len(held) > limit:
            given, held = held[: len(held) - keep], held[len(held) - keep :]
            out.append((len(held), json.dumps(given, ensure_ascii=False)))
        return (held,)


def session_memory(turns: DataFrame, session: str, turn: str, role: str, text: str, limit: int = 3, keep: int = 2, idle_ms: int | None = 1_800_000, ts: str | None = None) -> DataFrame:
    """Rows (session, held, compressed): with more than ``limit`` turns all but ``keep`` are given out to be summarised."""
    return _stateful(turns, _Memory, session, [role, text], [turn], "held int, compressed string", ts, idle_ms, limit, keep)


def sessions(events: DataFrame, user: str, ts: str, gap: str) -> DataFrame:
    """Sessions closed by a gap: user, start, end, events.  Works on tables and, behind a watermark, on streams."""
    out = events.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events"))
    return out.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def dedup_stream(rows: DataFrame, key: str, ts: str, delay: str = "30 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def cache_counters(requests: DataFrame, status: str, size: Column, compute_ms: str) -> DataFrame:
    """Running counts per status; for the update or complete mode."""
    return requests.groupBy(status).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"), F.round(F.coalesce(F.sum(compute_ms), F.lit(0.0)), 4).alias("ms"))


class _Cache(_Fold):
    state = "at double, version string"

    def step(self, state, row, out):
        ttl, largest, versioned, sized = self.args
        now, order = float(row[0]), row[1]
        version = None if not versioned or row[2] is None else str(row[2])
        size = row[2 + versioned] if sized else None
        if state and state[1] == version and now < state[0] + ttl:
            out.append((order, "hit"))
            return state
        out.append((order, "miss"))
        return (now, version) if size is None or size <= largest else state

    def expires(self, state, last):
        return max(last, (state[0] + self.args[0]) * 1000 if state else 0)


def ttl_cache(requests: DataFrame, key: str, ts_s: str, order: str, ttl: float, version: str | None = None, size: str | None = None, largest: int = 8 << 20, idle_ms: int | None = 0, ts: str | None = None) -> DataFrame:
    """Rows (key, order, status): hit if the key was written under the same version not longer than ``ttl`` seconds ago.

    A miss writes the key unless its value is larger than ``largest`` bytes; a hit doesn't renew it.  ``ts`` is ``ts_s`` as a timestamp behind a
    watermark: a key is forgotten once the watermark is past its time to live, when every further request is a miss anyway.
    """
    kind = requests.schema[order].dataType.simpleString()
    columns = [ts_s, order, *(c for c in (version, size) if c)]
    return _stateful(requests, _Cache, key, columns, [ts_s, order], f"{order} {kind}, status string", ts, idle_ms, ttl, largest, bool(version), bool(size))


class _Tokens(_Fold):
    state = "text string, n int"

    def init(self, handle):
        super().init(handle)
        self.buffer = StreamBuffer(self.args[0])

    def step(self, state, row, out):
        self.buffer.text, n = state or ("", 0)
        chunks = self.buffer.add(row[0] or "")
        if row[1]:
            chunks += self.buffer.close()
        if chunks:
            out += ((n + i, c) for i, c in enumerate(chunks))
        return self.buffer.text, n + len(chunks)

    def close(self, state=None, out=None):
        if state:
            out += ((state[1] + i, c) for i, c in enumerate(StreamBuffer(self.args[0], state[0]).close()))


def token_chunks(tokens: DataFrame, session: str, seq: str, token: str, is_final: str, least: int = 20, idle_ms: int | None = 300_000, ts: str | None = None) -> DataFrame:
    """Rows (session, chunk_index, chunk) of a token stream; the rest is flushed at the final token or when it stays idle."""
    return _stateful(tokens, _Tokens, session, [token, is_final], [seq], "chunk_index int, chunk string", ts, idle_ms, least)


class _BargeIn(_Fold):
    state = "open double"

    def step(self, state, row, out):
        kind, at = row[0], float(row[1])
        if kind == "response_start":
            return (at,)
        if kind == "response_end":
            return None
        if kind == "speech_start" and state:
            out.append((state[0], at))
            return None
        return state


def barge_in(events: DataFrame, session: str, order: str, kind: str, ts_s: str, idle_ms: int | None = 300_000, ts: str | None = None) -> DataFrame:
    """Rows (session, response_start, interrupted_at): speech that starts while a response is open interrupts and closes it.

    Kinds: response_start, response_end, speech_start; others pass.
    """
    return _stateful(events, _BargeIn, session, [kind, ts_s], [order], "response_start double, interrupted_at double", ts, idle_ms)


class _Speech(_Fold):
    state = "start double, last double"

    def step(self, state, row, out):
        kind, at = row[0], float(row[1])
        if kind == "start":
            return (state[0] if state else at, at)
        if kind == "end" and state:
            self._segment(state[0], at, out)
            return None
        return state

    def close(self, state=None, out=None):
        if state:
            self._segment(state[0], state[1], out)

    def _segment(self, start, end, out):
        if end - start >= self.args[0]:
            out.append((start, end))


def speech_segments(events: DataFrame, session: str, order: str, kind: str, ts_ms: str, least_ms: int = 250, idle_ms: int | None = 30_000, ts: str | None = None) -> DataFrame:
    """Rows (session, start_ms, end_ms) from start and end events; open speech is closed at its last event when idle."""
    return _stateful(events, _Speech, session, [kind, ts_ms], [order], "start_ms double, end_ms double", ts, idle_ms, least_ms)


def first_chunk_latency(chunks: DataFrame, request: str, ts: str, started: str, delay: str = "5 minutes") -> DataFrame:
    """Per request and start the seconds to its first chunk; for update mode."""
    out = chunks.withWatermark(ts, delay).groupBy(request, started).agg(F.min(ts).alias("first"))
    return out.select(request, (F.col("first").cast("double") - F.col(started).cast("double")).alias("seconds"))


def incremental_upsert(stream: DataFrame, path: str, checkpoint: str, key: str, order: str):
    """Run a stream into a keyed table (``sources.merged``): a micro-batch writes its own rows only, and restarts at any batch give the same table."""
    from corpusflow.sources import merged

    def put(batch: DataFrame, batch_id: int) -> None:
        merged.put(batch, path, key, order, checkpoint, batch_id)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_old_on_error(new: Column, old: Column) -> Column:
    """A failed scorer or summariser gives null; the old value stays."""
    return F.coalesce(new, old)
