"""The corpus pipeline: each stage against the decisions of its operator, and the whole run against the stages."""

from __future__ import annotations

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from odflux.llm import langid, ngram_join, packing, quality_rules  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_the_stages_follow_their_operators(spark, sf_dir, docs):
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language ID", "quality rules", "n-gram Jaccard join", "packing"]
    told = steps["language ID"](spark, docs, sf_dir)
    assert told.columns == docs.columns
    assert ids(told) == sorted(r["doc_id"] for r in langid.identify(docs).collect() if r["lang_pred"] != "und" and r["margin"] >= 0.05 and r["known"] >= 0.5)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = steps["quality rules"](spark, told, sf_dir)
    assert good.columns == docs.columns
    assert ids(good) == sorted(r["doc_id"] for r in quality_rules.apply_rules(told, labels).collect() if r["kept"])
    one = steps["n-gram Jaccard join"](spark, good, sf_dir)
    assert one.columns == docs.columns
    assert ids(one) == sorted({r["component_id"] for r in ngram_join.join_components(good).collect()})
    packed = steps["packing"](spark, one, sf_dir)
    assert ids(packed) == ids(one)
    assert sorted(map(tuple, packed.collect())) == sorted(map(tuple, packing.pack(one).collect()))
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, packed.collect()))


def test_the_stages_take_awkward_and_empty_tables(spark, sf_dir, awkward, nothing):
    for table in (awkward, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, sf_dir).columns == table.columns, name
            assert stage(spark, table, sf_dir).count() <= table.count()
        assert corpus_pipeline.STAGES[-1][1](spark, table, sf_dir).count() == table.count()
