"""Running totals over ranges agree with windows."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.operators import ordered


@pytest.mark.parametrize("hot", [0, 400])
def test_totals_before_each_row(spark, hot):
    rng = random.Random(hot)
    rows = [(rng.choice(["a", "b", None, "c"]), i, rng.randrange(9), "x") for i in range(300)] + [("hot", 1000 + i, 3, "y") for i in range(hot)]
    df = spark.createDataFrame(rows, "g string, i long, n long, __part string").repartition(7)
    w = Window.partitionBy("g").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    got = ordered.before(df, ["g"], [F.desc("i")], "n")
    assert got.columns == [*df.columns, "before"]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    numbers = ordered.before(df, [], ["i"], name="k").orderBy("i").collect()
    assert [r.k for r in numbers] == list(range(len(rows)))
    assert {r.k for r in ordered.before(df.where("g = 'a'"), ["g"], ["i"], name="k").collect()} == set(range(df.where("g = 'a'").count()))


def test_totals_of_doubles_pairs_of_columns_and_nothing(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (1, "a", 0.25), (1, "b", 1.0), (2, "a", 4.0), (2, None, 8.0)], "h int, g string, v double")
    got = {(r.h, r.g, r.v): r.before for r in ordered.before(df, ["h", "g"], [F.desc("v")], "v").collect()}
    assert got == {(1, "a", 0.5): 0, (1, "a", 0.25): 0.5, (1, "b", 1.0): 0, (2, "a", 4.0): 0, (2, None, 8.0): 0}
    assert ordered.before(df.limit(0), ["h"], ["v"]).collect() == []
