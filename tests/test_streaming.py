"""Streams over files agree with the batch forms."""

import os
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from corpusflow.functions.chunking import chunk_stream_buffer
from corpusflow.plans import formats
from corpusflow.sources import files, tables
from corpusflow.streaming import ops


def run(spark, df, mode="append"):
    name = "q" + uuid.uuid4().hex
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    return spark.table(name)


def stream(spark, df, tmp_path, name):
    path = str(tmp_path / name)
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_session_memory(spark, tmp_path):
    rows = spark.createDataFrame([("s", i, "user", f"t{i}") for i in range(7)] + [("r", 0, "user", "x")], "session string, turn int, role string, text string")
    got = run(spark, ops.session_memory(stream(spark, rows, tmp_path, "a"), "session", "turn", "role", "text", idle_ms=None)).collect()
    assert [(r.session, r.held, r.compressed.count("user")) for r in got] == [("s", 2, 2)] * 2


def test_token_chunks_agree_with_the_batch_form(spark, tmp_path):
    words = "Xin chào bạn. Đây là một câu. Và một câu dài hơn nhiều so với câu trước đó! Hết".split(" ")
    rows = spark.createDataFrame([("s", i, w + " ", i == len(words) - 1) for i, w in enumerate(words)], "session string, seq int, token string, final boolean")
    got = run(spark, ops.token_chunks(stream(spark, rows, tmp_path, "b"), "session", "seq", "token", "final", idle_ms=None)).orderBy("chunk_index").collect()
    assert [r.chunk for r in got] == [r.chunk for r in chunk_stream_buffer(rows, "session", "seq", "token").orderBy("chunk_index").collect()]


def test_barge_in_and_segments(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1, "response_start", 1.0), ("s", 2, "speech_start", 2.0), ("s", 3, "speech_start", 3.0), ("s", 4, "response_start", 4.0), ("s", 5, "response_end", 5.0), ("s", 6, "speech_start", 6.0)], "session string, o int, kind string, ts double")
    assert [tuple(r) for r in run(spark, ops.barge_in(stream(spark, rows, tmp_path, "c"), "session", "o", "kind", "ts", idle_ms=None)).collect()] == [("s", 1.0, 2.0)]
    rows = spark.createDataFrame([("s", 1, "start", 0.0), ("s", 2, "end", 100.0), ("s", 3, "start", 200.0), ("s", 4, "start", 300.0), ("s", 5, "end", 600.0)], "session string, o int, kind string, ts double")
    assert [tuple(r) for r in run(spark, ops.speech_segments(stream(spark, rows, tmp_path, "d"), "session", "o", "kind", "ts", idle_ms=None)).collect()] == [("s", 200.0, 600.0)]


def test_ttl_cache(spark, tmp_path):
    rows = spark.createDataFrame([("k", i, float(t), "v1" if i < 5 else "v2", 10 if i != 6 else 1 << 30) for i, t in enumerate([0, 5, 9, 11, 12, 13, 40, 41])], "key string, o int, ts double, version string, size long")
    got = run(spark, ops.ttl_cache(stream(spark, rows, tmp_path, "e"), "key", "ts", "o", 10, "version", "size", idle_ms=None)).orderBy("o").collect()
    assert [r.status for r in got] == ["miss", "hit", "hit", "miss", "hit", "miss", "miss", "miss"]


def test_counters_dedup_and_latency(spark, tmp_path):
    rows = spark.createDataFrame([("a", "hit", 1, 2.0, 10), ("a", "miss", 3, 4.0, 20), ("b", "hit", 5, 6.0, 30)], "url string, status string, bytes long, ms double, sec int")
    rows = rows.withColumn("ts", F.timestamp_seconds("sec")).withColumn("started", F.timestamp_seconds(F.lit(5)))
    src = stream(spark, rows, tmp_path, "f")
    assert {r.status: r.n for r in run(spark, ops.cache_counters(src, "status", F.col("bytes"), "ms"), "complete").collect()} == {"hit": 2, "miss": 1}
    assert sorted(r.url for r in run(spark, ops.dedup_stream(src, "url", "ts")).collect()) == ["a", "b"]
    assert {r.url: r.seconds for r in run(spark, ops.first_chunk_latency(src, "url", "ts", "started"), "update").collect()} == {"a": 5.0, "b": 25.0}


def test_incremental_upsert_restarts(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, o int")
    more = spark.createDataFrame([(2, "c", 2), (3, "d", 1)], "k int, v string, o int")
    inbox, path, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for part in (rows, more):
        part.coalesce(1).write.mode("append").parquet(inbox)
        ops.incremental_upsert(spark.readStream.schema(rows.schema).parquet(inbox), path, check, "k", "o").awaitTermination(120)
    assert sorted(map(tuple, files.read_snapshot(spark, path).collect())) == [(1, "a", 1), (2, "c", 2), (3, "d", 1)]
    assert sorted(map(tuple, tables.upsert(rows, more, "k", "o").collect())) == sorted(map(tuple, files.read_snapshot(spark, path).collect()))


def test_ndjson_stream(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "x.json").write_text('{"text": "a", "is_final": false}\n\nnot json\n{"text": "b", "is_final": true}\n')
    got = run(spark, files.stream_ndjson(spark, str(tmp_path / "n"), "text string, is_final boolean")).collect()
    assert sorted(r.text for r in got) == ["a", "b"]


def test_fallback_keeps_the_old_value(spark):
    df = spark.createDataFrame([("new", "old"), (None, "old")], "n string, o string")
    assert [r.x for r in df.select(ops.keep_old_on_error(F.col("n"), F.col("o")).alias("x")).collect()] == ["new", "old"]


def in_batches(spark, parts, tmp_path, name):
    """A stream that reads each part as a micro-batch."""
    path = str(tmp_path / name)
    for i, df in enumerate(parts):
        df.coalesce(1).write.mode("append").parquet(path)
        for f in (tmp_path / name).glob("part-*.parquet"):
            f.rename(tmp_path / name / f"{i}.parquet")
        os.utime(tmp_path / name / f"{i}.parquet", (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


CACHE = "key string, o int, t double"


def cache_rows(spark, times, start=0):
    return spark.createDataFrame([("k", start + i, float(t)) for i, t in enumerate(times)], CACHE).withColumn("ts", F.timestamp_seconds(F.col("t") + 1_000_000))


def test_written_keys_live_as_long_as_their_ttl(spark, tmp_path):
    """Four hours of event time between micro-batches, by default arguments; the watermark alone decides when a key goes."""
    parts = [cache_rows(spark, [0]), cache_rows(spark, [13_000], 1), cache_rows(spark, [14_399], 2), cache_rows(spark, [14_401], 3), cache_rows(spark, [90_000], 4)]
    src = in_batches(spark, parts, tmp_path, "g").withWatermark("ts", "10 seconds")
    got = run(spark, ops.ttl_cache(src, "key", "t", "o", 14_400, ts="ts")).orderBy("o").collect()
    assert [(r.o, r.status) for r in got] == [(0, "miss"), (1, "hit"), (2, "hit"), (3, "miss"), (4, "miss")]


def test_idle_sessions_are_closed_in_event_time(spark, tmp_path):
    said = "session string, seq int, token string, final boolean, sec int"
    parts = [spark.createDataFrame(r, said).withColumn("ts", F.timestamp_seconds(F.col("sec") + 1_000_000)) for r in ([("a", 0, "some words ", False, 0), ("b", 0, "other words ", False, 100)], [("b", 1, "and more ", False, 350)], [("c", 0, "late", True, 2000)], [("c", 1, "later", True, 4000)])]
    src = in_batches(spark, parts, tmp_path, "h").withWatermark("ts", "1 second")
    got = run(spark, ops.token_chunks(src, "session", "seq", "token", "final", least=100, ts="ts")).collect()
    assert sorted((r.session, r.chunk.strip()) for r in got) == [("a", "some words"), ("b", "other words and more"), ("c", "late"), ("c", "later")]
    kinds = "session string, o int, kind string, t double, sec int"
    parts = [spark.createDataFrame(r, kinds).withColumn("ts", F.timestamp_seconds(F.col("sec") + 1_000_000)) for r in ([("s", 0, "start", 0.0, 0), ("s", 1, "start", 400.0, 0)], [("x", 0, "end", 1.0, 500)], [("x", 0, "end", 1.0, 900)])]
    src = in_batches(spark, parts, tmp_path, "i").withWatermark("ts", "1 second")
    assert [tuple(r) for r in run(spark, ops.speech_segments(src, "session", "o", "kind", "t", ts="ts")).collect()] == [("s", 0.0, 400.0)]


def test_streams_go_on_after_a_restart(spark, tmp_path):
    """Each part is a run of its own over one checkpoint."""
    rows = [(f"s{i % 3}", i, "user", f"t{i}") for i in range(30)]
    kinds = "session string, turn int, role string, text string"
    inbox, out, check = (str(tmp_path / x) for x in ("inbox", "out", "check"))
    for k in range(0, 30, 7):
        spark.createDataFrame(rows[k : k + 7], kinds).coalesce(1).write.mode("append").parquet(inbox)
        src = spark.readStream.schema(kinds).parquet(inbox)
        ops.session_memory(src, "session", "turn", "role", "text").writeStream.option("checkpointLocation", check).trigger(availableNow=True).format("parquet").start(out).awaitTermination(120)
    whole = run(spark, ops.session_memory(stream(spark, spark.createDataFrame(rows, kinds), tmp_path, "j"), "session", "turn", "role", "text"))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, whole.collect())) and whole.count() == 12


def test_keys_with_more_rows_than_are_held(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ops, "HELD", 50)
    rows = [("k", (i * 7919) % 2003, float((i * 7919) % 2003)) for i in range(2003)] + [("few", 0, 1.0)]
    df = spark.createDataFrame(rows, CACHE)
    got = run(spark, ops.ttl_cache(stream(spark, df, tmp_path, "k"), "key", "t", "o", 10)).where("key = 'k'").orderBy("o").collect()
    assert [r.status for r in got] == ["hit" if i % 10 else "miss" for i in range(2003)]


def test_tokens_of_a_text_are_counted_once(spark, monkeypatch):
    """beside posexplode each token's row split its text anew."""
    made = []
    monkeypatch.setattr(formats, "_streamed", lambda rows, name: made.append(rows))
    monkeypatch.setattr(formats, "_ran", lambda stream, name: None)
    monkeypatch.setattr(ops, "token_chunks", lambda *a: None)
    formats.str6_token_chunks(spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
    above, below = made[0]._jdf.queryExecution().optimizedPlan().toString().split("Generate", 1)
    assert "split(" in below and "split(" not in above
    rows = made[0].groupBy("key").agg(F.count("*").alias("n"), F.max("seq").alias("last"), F.count_if("final").alias("finals"), F.max_by("final", "seq").alias("at_end"))
    assert rows.where("n <> last + 1 or finals <> 1 or not at_end").count() == 0 and rows.count() > 0


def unpacked(batches):
    return [(k, *row) for b in batches for k, *arrays in zip(*(c.to_pylist() for c in b.columns)) for row in zip(*arrays)]


def test_rows_of_a_key_travel_together(monkeypatch):
    """each row of a key went to Python on its own."""
    monkeypatch.setattr(ops, "PACKED", 5)
    rows = [(None if i % 7 == 3 else f"k{i % 7}", None if i % 11 == 0 else f"t{i}", i) for i in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["k", "k_0", "k_1"])
    packed = list(ops._pack([batch, batch.slice(0, 0), batch.slice(90)]))
    assert sorted(unpacked(packed), key=str) == sorted(rows + rows[90:], key=str)
    assert [b.num_rows for b in packed] == [7 * 3, 7]  # of 14 or 15 rows a key, five go together
    for k in {r[0] for r in rows}:
        assert [r for r in unpacked(packed[:1]) if r[0] == k] == [r for r in rows if r[0] == k]


class Aside:
    """A list state."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def appendList(self, rows):  # noqa: N802
        self.rows += rows
        self.calls += 1

    def get(self):
        return iter(self.rows)

    def clear(self):
        self.rows = []


def test_packed_rows_over_the_bound_go_aside(monkeypatch):
    monkeypatch.setattr(ops, "HELD", 50)
    monkeypatch.setattr(ops, "PACKED", 20)
    rows = [((i * 7919) % 2003, None if i % 5 == 0 else f"t{i}", None if i % 3 else i / 2) for i in range(2003)]
    batch = pa.RecordBatch.from_arrays([pa.array(["k"] * len(rows)), *(pa.array(c) for c in zip(*rows))], names=["k", "k_0", "k_1", "k_2"])
    fold = ops._Tokens("k", ["k_0", "k_1", "k_2"], "", [0], None, None, True)
    fold.pending = Aside()
    frames = [pa.Table.from_batches([b]).to_pandas() for b in ops._pack([batch])]
    assert list(fold._sorted(iter(frames))) == sorted(rows) and not fold.pending.rows
    assert fold.pending.calls > 30  # no more than HELD and one packed row at once
    few = pd.concat(frames).head(2)
    assert list(fold._sorted(iter([few]))) == sorted(rows[:40]) and fold.pending.calls < 45


def test_token_chunks_of_mixed_sessions(spark, tmp_path):
    """Sessions that are interleaved, out of order, over several files, with null tokens, give what each gives alone."""
    words = "Một câu. Rồi một câu khác\n\ndài hơn nhiều! Không có dấu gì cả trong đoạn này nhưng vẫn phải cắt ra. Hết".split(" ")
    rows = [(f"s{k}" if k else None, i, None if (i + k) % 9 == 0 else w + " ", i == len(words) - 1) for i, w in enumerate(words) for k in range(5)]
    df = spark.createDataFrame(rows[::-1], "session string, seq long, token string, final boolean").repartition(3)
    path = str(tmp_path / "mixed")
    df.write.parquet(path)
    got = run(spark, ops.token_chunks(spark.readStream.schema(df.schema).parquet(path), "session", "seq", "token", "final", idle_ms=None))
    want = chunk_stream_buffer(df.coalesce(1), "session", "seq", "token")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and got.count() > 10
