"""Blockwise search and the inverted file give what a loop gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import retrieval, vector_blocks
from corpusflow.operators.vector_index import VectorIndex


def clustered(n, seed=0, spread=0.15, clusters=12):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(clusters, 16))
    return centre[np.arange(n) % clusters] + spread * rng.normal(size=(n, 16))


def plain(asked, rows, k, allowed=lambda q, c: True, least=-2.0):
    out = []
    for q, v in asked:
        found = []
        for c, w in rows:
            size = np.linalg.norm(v) * np.linalg.norm(w)
            score = float(np.round(np.dot(v, w) / size, 6)) if size else 0.0
            if allowed(q, c) and score >= least:
                found.append((-score, c))
        out += [(q, c, -s, i + 1) for i, (s, c) in enumerate(sorted(found)[:k])]
    return sorted(out)


def near(got, want):
    got = sorted(map(tuple, got))
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want]
    assert max((abs(a[2] - b[2]) for a, b in zip(got, want)), default=0) < 1e-6


def frame(spark, rows, name="id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], f"{name} long, v array<double>")


def test_index_gives_what_a_scan_gives(spark, monkeypatch):
    monkeypatch.setattr(vector_blocks, "ROW_BLOCK", 60)
    monkeypatch.setattr(vector_blocks, "CELLS_AT_ONCE", 500)
    m = clustered(1200)
    m[5] = 0
    m[600:640] = m[600]  # copies: ties by id
    rows = list(enumerate(m))
    asked = [(i, v) for i, v in rows if i % 40 == 0] + [(5, m[5])]
    index = VectorIndex(frame(spark, rows).withColumn("label", F.col("id") % 5).unionByName(frame(spark, []).withColumn("label", F.lit(1).cast("long"))), "id", "v", ["label"], cells=24, sample=400)
    q = frame(spark, asked, "q")
    near(index.topk(q, 6, "q", "v").collect(), plain(asked, rows, 6))
    near(index.topk(q, 3, "q", "v", F.col("label") == 2).collect(), plain(asked, rows, 3, lambda q, c: c % 5 == 2))
    near(index.topk(q.limit(1), 5000, "q", "v").collect()[:0], [])
    # in clusters, queries look at under a third of the rows
    a = q.where("q <> 5").withColumnRenamed("q", "id").select(F.col("id").alias("q"), "v")
    first = index.probes(a, 6, True)
    bar = index.topk(q, 6, "q", "v").where("rank = 6").select("q", F.col("score").alias("bar"))
    more = index.probes(a.join(bar, "q"), 6, False)
    seen = sum(int(index.count[r.k0]) for r in first.unionByName(more).select("k0").collect())
    assert seen < len(rows) * a.count() / 3


def test_index_of_vectors_that_point_everywhere(spark):
    rng = np.random.default_rng(3)
    rows = list(enumerate(rng.normal(size=(300, 8))))
    asked = [(i, v) for i, v in rows if i % 50 == 0]
    got = VectorIndex(frame(spark, rows), "id", "v", cells=10).topk(frame(spark, asked, "q"), 4, "q", "v")
    near(got.collect(), plain(asked, rows, 4))


def test_index_of_nothing(spark):
    none = frame(spark, [])
    assert VectorIndex(none, "id", "v").topk(frame(spark, [(1, [1.0, 0.0])], "q"), 3, "q", "v").collect() == []
    rows = spark.createDataFrame([(1, None), (2, [1.0, 0.0])], "id long, v array<double>")
    assert [tuple(r) for r in VectorIndex(rows, "id", "v").topk(rows.withColumnRenamed("id", "q"), 3, "q", "v").collect()] == [(2, 2, 1.0, 1)]


@pytest.mark.parametrize("block", [7, 50_000])
def test_lookup_of_a_hot_key(spark, monkeypatch, block):
    monkeypatch.setattr(vector_blocks, "ROW_BLOCK", block)
    monkeypatch.setattr(vector_blocks, "QUERY_BLOCK", block)
    m = clustered(120, 2)
    rows = [(f"c{i:03}", "hot" if i % 6 else None if i % 12 else "cold", [float(x) for x in m[i]], i) for i in range(120)]
    asked = [(i, "hot" if i % 4 else "cold", [float(x) for x in m[i]], 50) for i in range(40)]
    cache = spark.createDataFrame([*rows, ("null", "hot", None, 99), ("never", "hot", [0.0] * 16, None)], "c string, g string, v array<double>, until int")
    requests = spark.createDataFrame(asked, "r long, g string, v array<double>, now int")
    got = sorted(map(tuple, retrieval.semantic_lookup(requests, cache, ["g"], "r", "v", "c", "v", "now", "until", 0.9).collect()))
    want = []
    for r, g, v, now in asked:
        found = [(-float(np.round(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w), 6)), c) for c, h, w, until in rows if h == g and until >= now]
        found = sorted(x for x in found if -x[0] >= 0.9)
        want += [(r, found[0][1], -found[0][0])] if found else []
    assert [x[:2] for x in got] == [x[:2] for x in want] and len(got) > 10


def test_many_queries_are_scored_in_slices(spark, monkeypatch):
    """A task's scores are bounded whatever the number of queries."""
    seen = []
    scores = np.round
    rows = list(enumerate(clustered(90, 4)))
    asked = [(i, v) for i, v in enumerate(clustered(2000, 5))]
    run = retrieval._scanned(frame(spark, asked, "q").withColumn("g", F.lit(0)).toPandas(), lambda s, own: seen.append(s.size) or (np.zeros(0, int), np.zeros(0), np.zeros(0)), 6)
    monkeypatch.setattr(retrieval, "SCORED_CELLS", 5_000)
    list(run([frame(spark, rows, "c").withColumn("g", F.lit(0)).toPandas()]))
    assert scores is np.round and max(seen) <= 5_000 and sum(seen) == 2000 * 90


def test_context_scores_round_doubles(spark):
    rows = spark.createDataFrame([("a", 2, 0.36265), ("a", 1, 1.0), ("b", 1, None), ("c", 1, 0.32685), ("c", 2, None)], "q string, r int, s double")
    got = {r.q: r for r in retrieval.context_scores(rows, "q", "r", "s").collect()}
    # 0.36265 and 0.32685 lie below half way as doubles
    assert (got["a"].scores, got["a"].score_max, got["a"].score_min, got["a"].score_avg) == ([1.0, 0.3626], 1.0, 0.3626, 0.6813)
    assert (got["b"].scores, got["b"].score_max, got["b"].score_avg) == ([None], None, None)
    assert (got["c"].scores, got["c"].score_min, got["c"].score_avg) == ([0.3268, None], 0.3268, 0.3268)


def test_scores_held_at_once_are_bounded(spark, monkeypatch):
    """Pieces of documents stay within the cells and the words a task may hold, and give the same ranks."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j % 13}" for j in range(i % 40))) for i in range(200)] + [(200, None)], "d int, t string").coalesce(1)
    asked = spark.createDataFrame([(i, f"w{i} w{i + 1} w12") for i in range(8)], "q int, t string")
    want = sorted(map(tuple, retrieval.bm25_topk(asked, docs, 3, "q", "t", "d", "t").collect()))
    monkeypatch.setattr(retrieval, "SCORED_CELLS", 64)
    assert want and sorted(map(tuple, retrieval.bm25_topk(asked, docs, 3, "q", "t", "d", "t").collect())) == want
    import pandas as pd
    import pyarrow as pa

    seen, bincount = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, w, n: seen.append(len(x)) or bincount(x, w, n))
    rows = pd.DataFrame({"q": [1], "term": ["a"], "weight": [1.0]})
    batch = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array([["a", "b"] * 20] * 30)], ["d", "t"])
    assert sum(b.num_rows for b in retrieval._scored(rows, 30, 1.5, 0.75, 40.0, 4)([batch])) == 30
    assert len(seen) == 30  # 40 words each: one document at a time, though 64 cells would take all
