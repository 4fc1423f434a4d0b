import pytest

import corpus_pipeline
from sparkscrub.llm import quality
from sparkscrub.llm.common import stored
from tests.llm.brute import jaccard_classes


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    """The table before the pipeline and after each stage."""
    tables = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], sf_dir), name.replace(" ", "_")))
    return tables


def test_stages_keep_columns_and_order(results):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "source mix", "token ORC"]
    assert all(t.columns == results[0].columns for t in results[:-1])
    assert results[-1].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_decisions_against_brute_force(spark, sf_dir, results):
    rows = [{r.doc_id: r.text for r in t.collect()} for t in results[:-1]]
    rejected = {r.doc_id for r in quality.classify(results[0], spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("predicted = 0").collect()}
    assert set(rows[1]) == set(rows[0]) - rejected and rejected
    classes = jaccard_classes(list(rows[1].items()), 80, 5)
    assert set(rows[2]) == {i for i, (_, c) in classes.items() if i == c}
    items = [" ".join((r.text or "").lower().split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaks = {i for i, t in rows[2].items() if any(x and x in " ".join(t.lower().split()) for x in items)}
    assert leaks and not leaks & set(rows[3])
    assert len(set(rows[2]) - leaks - set(rows[3])) <= 2  # more only where an item appears with a few edits
    assert set(rows[4]) <= set(rows[3])
    assert results[5].count() == results[4].count()


def test_run_agrees_with_the_stages(spark, sf_dir, results):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, results[-1].collect()))


def test_stages_on_an_empty_table_with_odd_columns(spark, sf_dir):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, score double, area string")
    docs = empty
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == empty.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 0
