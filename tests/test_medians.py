"""Running medians by blocks agree with a plain re-statement."""

import random
import statistics

import pytest

from corpusflow.operators.medians import running_median


def plain(rows, every):
    out, groups = {}, {}
    for g, _, v in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(g, []).append(v)
        if len(groups[g]) % every == 0:
            have = [x for x in groups[g] if x is not None]
            out[g, len(groups[g])] = round(statistics.median(have), 4) if have else None
    return out


@pytest.mark.parametrize(("every", "block"), [(1, 4), (3, 12), (5, 64), (7, 1 << 20)])
def test_blocks_of_any_size(spark, every, block):
    rng = random.Random(every)
    kinds = {
        "rising": lambda i: i + rng.random(),
        "falling": lambda i: -i * rng.random(),
        "few": lambda i: rng.choice([1.0, 1.0, 1.0, 2.0, None]),
        None: lambda i: None if i < 40 else rng.gauss(0, 1),
        "jump": lambda i: rng.random() + 1000 * (i > 150),
    }
    rows = [(g, 1000 * k + i, f(i)) for k, (g, f) in enumerate(kinds.items()) for i in range(310)] + [("small", 9000 + i, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, i long, v double").repartition(5)
    got = running_median(df, "v", ["g"], "i", every, block=block)
    assert got.columns == ["g", "checkpoint", "median"]
    got = got.collect()
    assert len(got) == len({(r.g, r.checkpoint) for r in got})
    assert {(r.g, r.checkpoint): r.median for r in got} == pytest.approx(plain(rows, every), abs=1e-9)


def test_all_rows_as_one_group_and_none(spark):
    rows = [(0, i, float(i * 37 % 101)) for i in range(500)]
    df = spark.createDataFrame(rows, "b long, i long, v double")
    got = running_median(df, "v", [], "i", 10, block=50)
    assert {(0, r.checkpoint): r.median for r in got.collect()} == plain(rows, 10)
    assert running_median(df.limit(0), "v", ["b"], "i").collect() == []
