import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import joins, retrieval, sample, stats
from corpusflow.plans import queries


def test_wer(spark):
    rows = spark.createDataFrame([("a b c d", "a x c d e"), ("", "a"), ("Đường đi", "đường đi!"), (None, "a")], "r string, h string")
    assert [r.w for r in rows.select(stats.wer("r", "h").alias("w")).collect()][:3] == [0.5, 0.0, 0.0]
    assert rows.select(stats.cer("r", "h").alias("c")).first().c == 0.5


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_error_rates_of_turns(spark):
    sf = "/root/testdata/sf0.001"
    text = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    got = queries()["agg11_wer_cer"](spark, sf).collect()
    assert len(got) == sum((c, t + 1) in text for c, t in text)
    for r in got[::5]:
        a, b = (" ".join(re.sub(r"[^\w\s]", " ", text[r.conv_id, t].lower()).split()) for t in (r.turn, r.turn + 1))
        assert abs(r.wer - round(distance(a.split(), b.split()) / max(1, len(a.split())), 6)) < 2e-6
        a, b = a.replace(" ", ""), b.replace(" ", "")
        assert abs(r.cer - round(distance(a, b) / max(1, len(a)), 6)) < 2e-6


def test_edit_distance():
    rng = random.Random(6)
    for n in (0, 1, 3, 20, 63, 64, 65, 130, 300):
        for letters in (1, 2, 5, 400):
            a, b = ([rng.randrange(letters) for _ in range(rng.randrange(n + 1))] for _ in range(2))
            c = list(a)
            for _ in range(4):
                c[rng.randrange(len(c) + 1) : rng.randrange(len(c) + 1)] = [rng.randrange(letters)]
            for x, y in ((a, b), (a, c), (c, b)):
                assert stats.edit_distance(x, y) == stats.edit_distance(y, x) == distance(x, y)
    assert stats.edit_distance("kitten", "sitting") == 3


def test_edit_distances_of_many_pairs_near_the_diagonal(monkeypatch):
    rng = random.Random(8)
    pairs = []
    for n in (0, 1, 20, 63, 64, 65, 200, 700):
        for letters in (1, 2, 5, 400):
            a, b = ([rng.randrange(letters) for _ in range(rng.randrange(n + 1))] for _ in range(2))
            few, moved = [x for x in a if rng.random() > 0.1], a[n // 3 :] + a[: n // 3]
            pairs += [(a, b), (b, a), (a, few), (few, b), (a, moved), (moved + b, a)]
    as_arrays = [(np.array(a, np.int64), np.array(b, np.int64)) for a, b in pairs]
    right = [stats.edit_distance(a, b) for a, b in pairs]
    assert right[::9] == [distance(a, b) for a, b in pairs[::9]]
    assert stats.edit_distances(as_arrays).tolist() == right
    monkeypatch.setattr(stats, "STEP", 40)
    monkeypatch.setattr(stats, "TABLE", 2000)  # some pairs go one by one
    assert stats.edit_distances(as_arrays).tolist() == right
    monkeypatch.undo()
    kept, within = [], stats._within
    monkeypatch.setattr(stats, "_within", lambda pairs: kept.extend(k for *_, k in pairs) or within(pairs))
    text = np.array([rng.randrange(26) for _ in range(9000)])
    said = np.delete(text, np.arange(4, 9000, 9))
    assert stats.edit_distances([(text, said)]).tolist() == [1000]
    assert len(kept) == 1 and kept[0] < 2000  # of 9000 rows


def test_error_rates_of_any_vocabulary(spark):
    words = [f"w{i}" for i in range(60_000)]
    said = [w for i, w in enumerate(words) if i % 100] + ["x"]
    rows = spark.createDataFrame([(" ".join(words), " ".join(said)), ("a", None), ("a b", "")], "r string, h string")
    assert [r.w for r in rows.select(stats.wer("r", "h").alias("w")).collect()] == [601 / 60_000, None, 1.0]


def test_error_rates_of_documents(spark):
    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries()["agg11_wer_documents"](spark, sf).collect()
    assert len(got) == len(text)
    for r in got:
        if len(text[r.doc_id]) > 1500:
            continue
        kept = [w for i, w in enumerate(text[r.doc_id].split(" ")) if i % 9 != 4]
        said = " ".join(w[::-1] if i % 11 == 7 else w for i, w in enumerate(kept))
        a, b = (re.sub(r"[^\w\s]", " ", x.lower()).split() for x in (text[r.doc_id], said))
        assert abs(r.wer - round(distance(a, b) / max(1, len(a)), 6)) < 2e-6


def test_normal_cdf_and_t(spark):
    got = spark.createDataFrame([(0.0,), (1.96,)], "x double").select(stats.normal_cdf(F.col("x")).alias("p")).collect()
    assert abs(got[0].p - 0.5) < 1e-6 and abs(got[1].p - 0.9750021) < 1e-6
    t = spark.createDataFrame([(1,), (30,), (60,)], "d int").select(stats.t_quantile(F.col("d")).alias("t")).collect()
    assert [round(r.t, 3) for r in t] == [12.706, 2.042, 2.0]


def test_dunn_against_a_loop(spark):
    data = {"a": [1, 2, 2, 3], "b": [2, 5, 6], "c": [7, 8, 8, 9, 9]}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "c string, v double")
    every = sorted(v for vs in data.values() for v in vs)
    rank = {v: (every.index(v) + 1 + len(every) - every[::-1].index(v)) / 2 for v in every}
    n, ties = len(every), sum(every.count(v) ** 3 - every.count(v) for v in set(every))
    z = lambda x, y: (sum(rank[v] for v in data[x]) / len(data[x]) - sum(rank[v] for v in data[y]) / len(data[y])) / math.sqrt((n * (n + 1) / 12 - ties / (12 * (n - 1))) * (1 / len(data[x]) + 1 / len(data[y])))
    got = {(r["first"], r["second"]): r for r in stats.dunn_holm(rows, "c", "v").collect()}
    assert all(abs(got[x, y].z - z(x, y)) < 1e-9 for x, y in got) and len(got) == 3
    assert sorted(r.p_holm for r in got.values()) == [r.p_holm for r in sorted(got.values(), key=lambda r: r.p)]


def test_vector_topk_in_blocks_is_the_same(spark):
    rows = spark.createDataFrame([(i, [math.sin(i * j + 1) for j in range(8)]) for i in range(60)], "id int, v array<double>")
    q = rows.where("id % 3 = 0").withColumnRenamed("id", "q")
    a, b = (sorted(map(tuple, retrieval.vector_topk(q, rows, 4, "q", "v", "id", "v", block=n).collect())) for n in (1000, 6))
    assert a == b and len(a) == 80 and all(r[1] == r[0] for r in a if r[3] == 1)


def test_odd_vectors_and_blocks_of_terms(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 1.0])], "id int, v array<double>")
    got = retrieval.vector_topk(rows.withColumnRenamed("id", "q"), rows, 2, "q", "v", "id", "v").collect()
    assert {r.q for r in got} == {1, 3, 4} and all(r.id != 2 for r in got)
    assert retrieval.vector_topk(rows.where("v is null").withColumnRenamed("id", "q"), rows, 2, "q", "v", "id", "v").count() == 0
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 7}" for k in range(1, 9)) if i else None) for i in range(20)], "d int, t string")
    asked = docs.where("d % 3 = 1").select(F.col("d").alias("q"), F.col("t").alias("x"))
    a, b = (sorted(map(tuple, retrieval.bm25_topk(asked, docs, 3, "q", "x", "d", "t", block=n).collect())) for n in (1000, 4))
    assert a == b and len(a) == 3 * asked.count()
    assert retrieval.bm25_topk(asked.where("q < 0"), docs, 3, "q", "x", "d", "t").count() == 0


def test_cache_runs_go_on_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = spark.createDataFrame([(i, i % 3 if i % 4 else None, float((i * 7) % 50)) for i in range(120)], "o int, k int, t double")
        got = {r.o: r.hit for r in joins.exact_cache_asof(rows, "k", "t", 10, "o").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    written, want = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r.t, r.o)):
        want[r.o] = r.k in written and r.t < written[r.k] + 10
        if not want[r.o]:
            written[r.k] = r.t
    assert got == want


def test_samples_repeat(spark):
    rows = spark.range(500).withColumn("g", F.col("id") % 3)
    a, b = (sorted(r.id for r in sample.stratified(rows.repartition(n), "g", "id", 7).collect()) for n in (1, 5))
    assert a == b and len(a) == 21
    ids = [r.blind_id for r in sample.blind_ids(rows, "id").orderBy("blind_id").collect()]
    assert ids[0] == "clip_0001" and ids[-1] == "clip_0500" and len(set(ids)) == 500


def test_memory_fold_agrees_with_a_loop(spark):
    rows = spark.createDataFrame([(n, t) for n in range(1, 14) for t in range(n)], "s int, t int")
    got = {r.s: (r.held, r.compressed) for r in stats.memory_fold(rows, "s", "t").collect()}
    for n in range(1, 14):
        held = done = 0
        for _ in range(n):
            held += 1
            if held > 3:
                held, done = 2, done + held - 2
        assert got[n] == (held, done)


@pytest.mark.parametrize("accuracy", [10_000, 20, 2])
def test_percentiles_are_exact(spark, monkeypatch, accuracy):
    """With a coarse sketch brackets hold much, or miss and are counted whole."""
    monkeypatch.setattr(stats, "ACCURACY", accuracy)
    rng = random.Random(accuracy)
    data = {"a": [rng.gauss(0, 1) for _ in range(900)], "b": [float(rng.randrange(4)) for _ in range(301)], "one": [7.0], None: [1.0, 2.0], "wide": [10.0 ** rng.randrange(12) for _ in range(100)]}
    rows = spark.createDataFrame([(k, v, 1) for k, vs in data.items() for v in vs] + [("a", None, 1), ("never", None, 1)], "k string, v double, g int").repartition(5)
    got = {r.k: (r.p10, r.p50, r.p99) for r in stats.interp_percentiles(rows, "v", ["k"], (10, 50, 99), digits=9).collect()}
    assert got.keys() == data.keys()
    for k, vs in data.items():
        assert got[k] == pytest.approx([float(np.percentile(vs, p)) for p in (10, 50, 99)], rel=1e-9, abs=1e-9)
    every = [v for vs in data.values() for v in vs]
    assert stats.interp_percentiles(rows, "v", points=(50,)).first().p50 == pytest.approx(float(np.percentile(every, 50)), abs=1e-4)
    assert stats.interp_percentiles(rows.limit(0), "v", points=(50,)).collect()[0].p50 is None
    assert stats.wer_summary(rows.where("k = 'b'"), "v").first()["median"] == float(np.percentile(data["b"], 50))
    assert stats.wer_summary(rows.limit(0), "v").first().n == 0


def test_distinct_counts(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, None), (None, 2, None), ("", 3, None)] * 3, "t string, n int, x string")
    of = {"texts": "t", "numbers": "n", "none": "x"}
    assert tuple(stats.distinct_counts(rows, of).first()) == (2, 3, 0) and stats.distinct_counts(rows, of).columns == list(of)
    assert tuple(stats.distinct_counts(rows, of, approx=True).first()) == (2, 3, 0)
    assert tuple(stats.distinct_counts(rows.limit(0), of).first()) == (0, 0, 0)


def test_numbers_in_one_large_group(spark):
    rows = spark.createDataFrame([("g", i, "x", "y") for i in range(500)] + [("h", 5, "x", "y")], "g string, o int, __n string, __max string").repartition(6)
    got = {(r.g, r.o): r.syn_id for r in stats.running_id(rows, "g", "o", spark.createDataFrame([("g", 10)], "g string, n int")).collect()}
    assert got == {("g", i): f"syn_g_{i + 11:04}" for i in range(500)} | {("h", 5): "syn_h_0001"}
    merged = retrieval.merge_contexts(rows.where("o < 100"), rows.where("o >= 100"), "g", "o")
    assert {(r.g, r.o): r.merged_rank for r in merged.collect()} == {("g", i): i + 1 for i in range(500)} | {("h", 5): 1}


def test_summaries_rank_few_of_the_values(spark, monkeypatch):
    """Only what the sketch can't place is counted by value, not a group's every value."""
    n, ranked = 20_000, []
    plain = stats._running
    monkeypatch.setattr(stats, "_running", lambda rows: ranked.append(rows.count()) or plain(rows))
    rows = spark.range(n).select(F.lit("g").alias("k"), (F.col("id") * 7919 % n).cast("double").alias("v"), F.lit(1.0).alias("one"))
    odd = spark.createDataFrame([("h", None, 1.0), ("h", 3.0, 0.0), ("h", 4.0, 1.0)], "k string, v double, one double")
    got = {r.k: r for r in stats.rtf_stats(rows.union(odd), F.col("v"), F.col("one"), ["k"]).collect()}
    assert tuple(got["g"]) == ("g", n, (n - 1) / 2, (n - 1) / 2, pytest.approx(0.95 * (n - 1)), pytest.approx(0.99 * (n - 1)), n - 1.0)
    assert tuple(got["h"]) == ("h", 3, 2.0, 2.0, 3.8, 3.96, 4.0)
    assert tuple(stats.rank_stats(rows, "v", ["k"]).first())[1:] == (n, (n - 1) / 2, n / 2, 0.9 * n, 0.95 * n, 0.0, n - 1.0)
    assert stats.condition_summary(rows, "k", ["v"], ["g"]).first().v_median == (n - 1) / 2
    assert ranked and max(ranked) < n / 50
