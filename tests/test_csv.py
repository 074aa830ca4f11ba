"""CSV that is read by splits gives the rows that were written."""

import random

import pytest

from corpusflow.sources import csv, files


@pytest.mark.parametrize("split", ["700", "4k", "128m"])
def test_quoted_line_breaks_across_splits(spark, tmp_path, split):
    rng = random.Random(1)
    parts = ["plain", 'say "hi"', "two\nlines", "", "a,b", "\n\n\n", '"', "x" * 300 + "\n" + "y" * 300, " spaced ", "é\r\nü", "line\n" * 40]
    rows = [(i, rng.choice(parts), rng.choice(parts) + "." + str(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, a string, b string").repartition(3)
    path = str(tmp_path / "csv")
    files.write_csv(df, path)
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        if split != "128m":
            assert csv._lines(spark, path).select("file", "block").distinct().count() > 3
        got = csv.read(spark, path, "id long, a string, b string").collect()
        assert sorted((r.id, r.a or "", r.b) for r in got) == rows
        got = csv.read(spark, path)
        assert got.columns == ["id", "a", "b"] and got.count() == len(rows)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_rows_are_those_of_the_whole_file_reader(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,"na,me"\n1,"a\nb"\n\n2,\n3,"c""d"\r\n')
    got = csv.read(spark, str(tmp_path / "x.csv"))
    assert got.columns == ["id", "na,me"]
    assert sorted(map(tuple, got.collect())) == [("1", "a\nb"), ("2", None), ("3", 'c"d')]
