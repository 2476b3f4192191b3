import pytest

import corpus_pipeline
from fleetscope.llm.queries import ORACLES, QUERIES
from tests.conftest import SMALL
from tests.oracle_harness import compare, duck


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    r = compare(spark, duck(SMALL), name, QUERIES[name], ORACLES[name], SMALL)
    assert r["status"] == "MATCH", r


def test_all_thirteen_and_the_pipeline_are_registered():
    import __spark_entry__ as E
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs_on_the_small_tables(spark, name):
    tables = {"op4": "pages"}
    df = QUERIES[name](spark, SMALL)
    rows = df.count()
    if name.split("_")[0] not in ("op2", "op5", "op9", "op11", "op12"):
        assert rows == spark.read.parquet(f"{SMALL}/{tables.get(name.split('_')[0], 'documents')}.parquet").count()


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "SimHash near-dedup", "suffix-array dedup", "benchmark decontamination",
        "mixing sources to target weights"]
    schema, before = docs.schema.simpleString(), docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SMALL).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert after.schema.simpleString() == schema
        assert 0 < after.count() <= before.count()
        assert after.join(before, "doc_id", "left_anti").count() == 0
        before = after
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert not [r for r in before.collect() for t in items if t in r.text]


def test_one_bad_row_does_not_take_the_others_of_its_id(spark, prose, tmp_path):
    """Rows that share a doc_id, or have none, are judged by their own text."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    clean, other = prose(1, 90), prose(2, 90)
    rows = spark.createDataFrame([(3, clean, "en", "s", 1), (5, other, "en", "s", 1), (5, clean, "en", "s", 1), (None, clean, "en", "s", 1),
                                  (7, f"{other} {item}", "en", "s", 1), (7, prose(4, 80), "en", "s", 1),
                                  (None, f"{clean} {item}", "en", "s", 1)], docs.schema)
    extra = rows.selectExpr("*", "doc_id as topic", "doc_id as n_tokens", "doc_id as _file", "doc_id as own", "doc_id as row")
    near = corpus_pipeline.near_dedup_stage(spark, extra, SMALL)
    assert near.columns == extra.columns
    assert {(r.doc_id, r.text) for r in near.collect()} >= {(3, clean), (5, other), (7, prose(4, 80))}
    assert not {(r.doc_id, r.text) for r in near.collect()} & {(5, clean), (None, clean)}
    left = {(r.doc_id, r.text) for r in corpus_pipeline.decontamination_stage(spark, extra, SMALL).collect()}
    assert left == {(r.doc_id, r.text) for r in extra.collect() if item not in r.text}
    mixed = corpus_pipeline.mixing_stage(spark, extra, SMALL)
    assert {"topic", "mix_topic", "n_tokens", "mix_n_tokens", "probability"} <= set(mixed.columns)
    slim = corpus_pipeline.repeats_stage(spark, extra.drop("n_chars"), SMALL)
    assert "n_chars" not in slim.columns and slim.count() > 0
    # the quality stage: a junk row goes, the good row of the same id stays
    good = [(i, prose(i, 80), "en", "s", 1) for i in range(1000, 1200)]
    junk = " ".join(w + "$%&" for w in prose(9, 60).split())
    spark.createDataFrame([(i, 1, 0) for i in range(1000, 1200, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    judged = spark.createDataFrame([*good, (1001, junk, "en", "s", 1), (None, junk, "en", "s", 1), (None, prose(1000, 80), "en", "s", 1)], docs.schema)
    kept = corpus_pipeline.quality_stage(spark, judged, str(tmp_path))
    assert kept.where(kept.text == junk).count() == 0
    assert kept.where("doc_id = 1001").count() == 1 and kept.where("doc_id is null").count() == 1


def test_stages_on_nulls_and_nothing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, "s", 0),
                                 (3, "plain words here", "en", None, 16), (3, "plain words here", "en", None, 16)], docs.schema)
    for rows in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            n = stage(spark, rows, SMALL).count()
            assert n <= rows.count()
