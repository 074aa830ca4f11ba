"""Texts that equal only in weak hashes, clashing columns, and texts with many secrets."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import near_dup, quality_rules, secrets, training_order, vec


def thue_morse(n, a="a", b="b"):
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


@pytest.mark.parametrize("n", [1024, 2048, 1 << 16])
def test_hashes_of_thue_morse_strings(n):
    one, two = (np.frombuffer(x.encode(), np.uint8) for x in thue_morse(n))
    both = np.concatenate([one, two, one])
    h = vec.span_hash(vec.prefix_hash(both), np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
    assert h[0] == h[2] != h[1]


def test_span_hashes_are_those_of_the_spans():
    data = np.random.default_rng(1).integers(0, 256, 200_000).astype(np.uint8)
    starts = np.random.default_rng(2).integers(0, 199_000, 300)
    ends = starts + np.random.default_rng(3).integers(0, 1000, 300)
    alone = [vec.span_hash(vec.prefix_hash(data[s:e]), np.array([0]), np.array([e - s]))[0] for s, e in zip(starts, ends)]
    assert (vec.span_hash(vec.prefix_hash(data), starts, ends) == np.array(alone)).all()


def test_words_and_lines_of_thue_morse_strings(spark):
    one, two = thue_morse(2048)
    df = spark.createDataFrame([(1, one, "s"), (2, two, "s"), (3, f"{one}\n{two}", "s"), (4, one, "s")], "doc_id long, text string, source string")
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 1}
    assert {r.doc_id: r.n_dup_lines for r in quality_rules.judge(df).collect()}[3] == 0


def test_dedup_keeps_columns_of_any_name(spark):
    names = "doc_id long, text string, __gone string, __row long, gone int, row string, n int, __text string, __id int"
    text = "one two three four five six seven"
    for ids in ((1, 2, 3), (1, 1, 3)):  # with and without repeated ids
        rows = [(ids[0], text, "a", 1, 1, "r", 1, "t", 9), (ids[1], "other words are here and nothing else", "b", 2, 2, "s", 2, "u", 8), (ids[2], text, "c", 3, 3, "t", 3, "v", 7)]
        got = near_dup.dedup(spark.createDataFrame(rows, names))
        assert got.columns == [x.split()[0] for x in names.split(", ")]
        assert sorted(map(tuple, got.collect())) == sorted(rows[:2])


def test_text_with_many_secrets(spark):
    words = [hashlib.md5(str(i).encode()).hexdigest() for i in range(3000)]
    text = " ".join(w if i % 3 else f"password={w[:9]} {w}" for i, w in enumerate(words)) + " end"
    df = spark.createDataFrame([(1, text), (2, "nothing")], "doc_id long, text string")
    model = [0.0] * len(secrets.ALPHABET) ** 2
    got = secrets.scan(df, model).where("doc_id = 1").select("base", "spans").first()
    want, at = [], 0
    for i, w in enumerate(words):
        if i % 3 == 0:
            want.append((at, 0, at + 18))
            at += 19
        want.append((at, 2, at + 32))
        at += 33
    assert [tuple(s) for s in got.base] == want == [tuple(s) for s in got.spans]
    out = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert out[1] == " ".join(["[SECRET]"] * len(want)) + " end" and out[2] == "nothing"


@pytest.mark.parametrize("spans", [[], [(0, 0, 5), (2, 2, 9), (9, 2, 12), (30, 1, 40)], [(5, 0, 8)]])
@pytest.mark.parametrize("more", [[], [(0, 3, 3), (4, 3, 6), (12, 3, 20), (20, 3, 30), (39, 3, 45), (50, 3, 60)], [(8, 3, 9), (3, 3, 5)], [(0, 3, 100)]])
def test_free_spans(spark, spans, more):
    kind = "array<struct<start:int,kind:int,end:int>>"
    df = spark.createDataFrame([(spans, more)], f"b {kind}, m {kind}").select(secrets._free(F.array_sort(F.concat("b", "m"))).alias("s"))
    want = sorted([*spans, *(m for m in more if not any(b[0] < m[2] and m[0] < b[2] for b in spans))])
    assert [tuple(x) for x in df.first().s] == want


def test_several_shards_a_task(spark, tmp_path):
    rows = spark.createDataFrame([(i, "some words " * (i % 40)) for i in range(900)], "doc_id long, text string")
    path = str(tmp_path / "shards")
    training_order.materialise(rows, path, seq_len=8, shard_rows=4)
    shards = {int(p.name.split("=")[1]): list(p.glob("*.parquet")) for p in (tmp_path / "shards").glob("shard=*")}
    n = spark.read.parquet(path).count()
    assert sorted(shards) == list(range(-(-n // 4))) and len(shards) > 64
    assert all(len(files) == 1 for files in shards.values())
    assert [r.slot for r in training_order.read_from(spark, path, 1001, 4).orderBy("slot").collect()] == list(range(1001, n))


def test_repeats_are_removed_by_batch():
    """Places of all texts of a batch are read at once, from slices and with null lists and masks too."""
    import pyarrow as pa
    import zstandard

    from corpusflow.llm import suffix_dedup as S

    text = bytes(range(97, 117)) * 20
    mask = np.packbits(np.arange(S.PLACES) == 8).tobytes()
    found = [None, [{"pos": 90, "mask": None}], [], [{"pos": 10, "mask": mask}, {"pos": 300, "mask": mask}, {"pos": 350, "mask": mask}]]
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("mask", pa.binary())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array([zstandard.compress(text)] * 4), pa.array(found, kind)], ["doc", "z", "found"])
    for low in (0, 1):
        got = pa.Table.from_batches(S._remove([batch.slice(low)])).to_pylist()
        assert [[(s["start"], s["end"]) for s in r["spans"]] for r in got] == [[], [(22, 190)], [], [(2, 102), (292, 392)]][low:]
