"""Keyed tables that are merged on reading."""

import os
import random

import pytest

from corpusflow.sources import files, merged
from corpusflow.streaming import ops

KINDS = "k long, v string, o long"


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_writes_merge_on_reading(spark, tmp_path):
    path, rng, want = str(tmp_path / "t"), random.Random(1), {}
    runs = []
    for i in range(9):
        rows = [(rng.randrange(60), f"v{i}-{j}", rng.randrange(5) * 10 + j % 10) for j in range(rng.choice([0, 3, 40]))]
        last = {}
        for k, v, o in rows:
            last[k] = max(last.get(k, (-1, "")), (o, v))
        want |= {k: (k, v, o) for k, (o, v) in last.items()}
        unique = {(k, o) for k, _, o in rows}
        rows = [r for r in rows if (r[2], r[1]) == last[r[0]] or (r[0], r[2]) in unique and r[2] < last[r[0]][0]]
        merged.put(spark.createDataFrame(rows, KINDS), path, "k", "o", buckets=4, fan=3)
        runs.append(len(merged._load(spark, path)["runs"]))
        if want:
            assert sorted(map(tuple, merged.read(spark, path).collect())) == sorted(want.values())
    assert max(runs) <= 3 * 3  # levels below the fan
    listed = {r["folder"] for n in merged._manifests(spark, path) for r in merged._load(spark, path, n)["runs"]}
    assert set(os.listdir(f"{path}/runs")) == listed and len(merged._manifests(spark, path)) == merged.LATE


def test_a_write_costs_what_it_brings(spark, tmp_path):
    path = str(tmp_path / "t")
    merged.put(spark.range(50_000).selectExpr("id AS k", "repeat(md5(string(id)), 4) AS v", "id AS o"), path, "k", "o", buckets=2)
    before = size(path)
    merged.put(spark.createDataFrame([(7, "new", 1), (60_000, "x", 1)], KINDS), path, "k", "o")
    assert size(path) - before < before / 100
    got = {r.k: r.v for r in merged.read(spark, path).where("k IN (7, 60000)").collect()}
    assert got == {7: "new", 60_000: "x"} and merged.read(spark, path).count() == 50_001


def test_batches_are_written_once(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = (spark.createDataFrame([(1, v, 1)], KINDS) for v in "ab")
    merged.put(one, path, "k", "o", "stream", 0, buckets=2)
    merged.put(two, path, "k", "o", "stream", 1)
    merged.put(one, path, "k", "o", "stream", 0)  # replayed after a restart
    assert merged.read(spark, path).first().v == "b"
    merged.put(one, path, "k", "o", "other stream", 0)
    assert merged.read(spark, path).first().v == "a"
    with pytest.raises(ValueError, match="__seq"):
        merged.put(one.withColumnRenamed("v", "__seq"), path, "k", "o")


def test_an_unfinished_write_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    one, two = (spark.createDataFrame([(1, v, 1)], KINDS) for v in "ab")
    merged.put(one, path, "k", "o", "stream", 0, buckets=2)
    with monkeypatch.context() as m:
        m.setattr(merged, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            merged.put(two, path, "k", "o", "stream", 1)
    assert merged.read(spark, path).first().v == "a"
    merged.put(two, path, "k", "o", "stream", 1)
    assert files.read_snapshot(spark, path).first().v == "b"


def test_stream_of_many_batches(spark, tmp_path):
    inbox, path, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for i in range(5):
        spark.createDataFrame([(k, f"{i}", i) for k in range(i, i + 3)], KINDS).coalesce(1).write.mode("append").parquet(inbox)
        ops.incremental_upsert(spark.readStream.schema(KINDS).parquet(inbox), path, check, "k", "o").awaitTermination(120)
    assert sorted(map(tuple, files.read_snapshot(spark, path).collect())) == [(k, str(min(k, 4)), min(k, 4)) for k in range(7)]
