import json

from corpusflow.sources import files, tables


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": 1, "t": "x"}\n\n{"id": 2, "t": "y"}\nbroken {\n')
    good, bad = files.read_jsonl_tolerant(spark, str(p), "id int, t string")
    assert sorted(r.id for r in good.collect()) == [1, 2] and bad.count() == 1
    q = tmp_path / "b.json"
    q.write_text(json.dumps([{"id": 1}, {"id": 2}]))
    assert files.read_json_array(spark, str(q), "id int").count() == 2


def test_csv_and_ids(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "b", c'), ("2", "x\ny")], "id string, t string")
    files.write_csv(df, str(tmp_path / "c"))
    assert sorted(files.read_csv(spark, str(tmp_path / "c")).collect()) == sorted(df.collect())
    (tmp_path / "ids.txt").write_text("a\n\n b \na\n")
    assert sorted(r.id for r in files.read_id_list(spark, str(tmp_path / "ids.txt")).collect()) == ["a", "b"]


def test_key_from_path(spark, tmp_path):
    d = tmp_path / "set_1"
    d.mkdir()
    (d / "clip 7+1 50%.txt").write_text("hello")
    row = files.key_from_path(spark.read.text(str(d))).first()
    assert row.id == "clip 7+1 50%" and row.eval_set == "set_1"


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "snap")
    a, b = spark.range(3), spark.range(5)
    assert files.write_snapshot(a, path, dry_run=True) == {"before": 0, "after": 3, "version": 1}
    assert files.snapshot_versions(spark, path) == []
    files.write_snapshot(a, path)
    assert files.write_snapshot(b, path) == {"before": 3, "after": 5, "version": 2}
    assert files.read_snapshot(spark, path).count() == 5 and files.read_snapshot(spark, path, 1).count() == 3
    assert files.restore_if_empty(spark.range(0), a).count() == 3 and files.restore_if_empty(b, a).count() == 5 and files.restore_if_empty(b, a, force=True).count() == 3


def test_upsert_is_idempotent(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, o int")
    u = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, o int")
    once = tables.upsert(t, u, "k", "o")
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1), (2, "d", 3), (3, "e", 1)] == sorted(map(tuple, tables.upsert(once, u, "k", "o").collect()))
    new = tables.append_new(t, spark.createDataFrame([(1, "aaaa", 0), (4, "x", 0), (4, "xxxx", 1), (5, "yyyy", 0)], "k int, v string, o int"), "k", "o", "v", 3)
    assert [r.k for r in new.collect()] == [5]
