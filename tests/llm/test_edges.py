"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from askgrade.llm import (
    class_lm,
    exact_dedup,
    jaccard_join,
    licenses,
    line_templates,
    packing,
    raking,
    rule_ensemble,
    spot_signatures,
    token_file,
)
from tests.llm.helpers import rows, table


@pytest.fixture(scope="module")
def labels(spark):
    data = [(r[0], i % 2, 0) for i, r in enumerate(rows()) if r[0] is not None] + [(None, 1, 0), (4, None, 0), (7, 1, 1), (7, 0, 1)]
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int")


OPERATORS = {
    "spot_signatures": lambda d, _: spot_signatures.compare_with_next(d),
    "raking": lambda d, _: raking.mixed_sample(d),
    "packing": lambda d, _: packing.packed(d),
    "licenses": lambda d, _: licenses.scan(d),
    "rule_ensemble": lambda d, l: rule_ensemble.classify(d, l),
    "line_templates": lambda d, _: line_templates.digest(d),
    "token_file": lambda d, _: token_file.round_trip(d),
    "exact_dedup": lambda d, _: exact_dedup.exact_duplicates(d),
    "jaccard_join": lambda d, _: jaccard_join.linked(d),
    "class_lm": lambda d, _: class_lm.scored(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_is_answered_and_other_columns_do_not_matter(spark, labels, name):
    data = rows()
    plain = OPERATORS[name](table(spark), labels)
    clashing = OPERATORS[name](table(spark, clashing=True), labels)
    ids = sorted(str(r[0]) for r in data)
    first = plain if name != "packing" else plain.where("piece = 0")
    assert sorted(str(r.doc_id) for r in first.select("doc_id").collect()) == ids
    assert clashing.columns == plain.columns
    again = clashing if name != "packing" else clashing.where("piece = 0")
    assert sorted(str(r.doc_id) for r in again.select("doc_id").collect()) == ids


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, labels, name):
    assert OPERATORS[name](table(spark, []), labels.limit(0)).collect() == []


STAGES = [f for _, f in corpus_pipeline.STAGES[:-1]]


@pytest.fixture(scope="module")
def folder(spark, labels, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    labels.write.parquet(f"{path}/labels.parquet")
    table(spark).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("stage", STAGES, ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns(spark, folder, stage):
    docs = table(spark, clashing=True)
    out = stage(spark, docs, folder)
    assert out.dtypes == docs.dtypes
    assert 0 < out.count() <= docs.count()
    assert stage(spark, table(spark, []), folder).collect() == []


def test_pipeline_runs_over_everything(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing",
    ]
    out = corpus_pipeline.run(spark, folder)
    fill = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert fill.agg(F.max("n")).first()[0] <= 2048
