"""The pipeline's result against its stages done plainly."""

import brute
import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    state, kept = docs, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, SF)
        assert state.columns == docs.columns
        rows = {r.doc_id: r for r in state.collect()}
        if name == "quality_rules":
            kept = {d: t for d, t in kept.items() if not brute.quality(t)[-1]}
        elif name == "near_duplicates":
            kept = {d: kept[d] for d, r in brute.near(kept.items()).items() if r[2]}
        elif name == "decontamination":
            hit = {d for d, r in brute.contamination(kept.items(), items).items() if r[-1]}
            assert hit and all((rows[d].text == t) == (d not in hit) for d, t in kept.items())
            kept = {d: rows[d].text for d in kept}
        else:
            assert not any(any(brute.base_secrets(r.text)[:3]) for r in rows.values())
            kept = {d: rows[d].text for d in kept}
        assert {d: r.text for d, r in rows.items()} == kept and all(r.n_chars == len(r.text) for r in rows.values())
        state = spark.createDataFrame(list(rows.values()), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, state, SF)
    assert {r.doc_id for r in packed.collect()} == set(kept)
    assert sorted(corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect()) == sorted(packed.select("doc_id", "piece", "length", "ids_crc32").collect())


LEAK = "one item of the benchmark that is long enough to be found whole by any search"


def hostile_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows, repeated and null ids."""
    prose = lambda k, n=60: " ".join(f"{k}{i % 41}w{i}" for i in range(n))
    long_ = prose("l", 20_000)
    rows = [(None, prose("a"), "de", None), (None, prose("b"), None, "s"), (1, None, "de", "s"), (2, "", "de", "s"), (3, " \n\t", None, None), (4, long_, "de", "s"), (5, long_, "de", "t")]
    rows += [(6, prose("c"), "de", "s")] * 2 + [(6, prose("d"), "de", "s"), (7, prose("c") + " x", "de", "s")]
    rows += [(8, f"{prose('e')} {LEAK} {prose('f')}", "de", "s"), (None, f"{prose('g')} {LEAK}", "de", "s"), (9, f"{prose('h')} password = hunter22x and on", "de", "s")]
    return rows


@pytest.fixture
def small(spark, tmp_path):
    spark.createDataFrame([(1, LEAK), (None, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in hostile_rows()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return docs, str(tmp_path)


def test_every_stage_takes_hostile_rows(spark, small):
    docs, path = small
    rows = lambda df: sorted((tuple(r) for r in df.select("doc_id", "text").collect()), key=repr)
    given = [r[:2] for r in hostile_rows()]
    stages = dict(corpus_pipeline.STAGES)
    full = [r for r in given if r[1] and r[1].strip()]
    kept = stages["quality_rules"](spark, docs, path)
    assert kept.columns == docs.columns and rows(kept) == sorted(full, key=repr)
    alone = rows(stages["near_duplicates"](spark, docs, path))
    assert alone == sorted((r for r in given if r[0] not in (5, 7)), key=repr)
    clean = rows(stages["decontamination"](spark, docs, path))
    assert clean == sorted(((d, t and t.replace(LEAK, "")) for d, t in given), key=repr)
    safe = rows(stages["secret_scan"](spark, docs, path))
    assert safe == sorted(((d, t and t.replace("password = hunter22x", "[SECRET]")) for d, t in given), key=repr)
    packed = stages["best_fit_packing"](spark, docs, path)
    assert packed.where("piece = 0").count() == len(given)
    for name, stage in stages.items():
        assert stage(spark, docs.where("false"), path).count() == 0, name
    assert corpus_pipeline.run(spark, path).where("piece = 0").count() == len([r for r in full if r[0] not in (5, 7)])


def test_extra_columns_are_dropped_after_the_first_stage(spark, small):
    docs, path = small
    more = docs.selectExpr("*", "1 AS key", "2 AS kept", "3 AS template", "4 AS spans", "5 AS base")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, more, path).columns == docs.columns, name
