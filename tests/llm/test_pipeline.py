"""The pipeline's stages, each against a plain version of what it should keep."""

import corpus_pipeline
import pytest
from test_pipeline_copies import first_of_each

from tablemine.llm.common import written


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(written(f(spark, out[-1], sf), name.replace(" ", "-")))
    return out


def test_columns_stay_until_packed(stages):
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_labelled_junk_goes_and_clean_documents_stay(spark, sf, stages):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    left = {(r.quality, r.n_words >= 50) for r in stages[2].join(labels, "doc_id").selectExpr("quality", "size(split(trim(text), '\\\\s+')) n_words").collect()}
    assert left == {(1, True)}
    clean = stages[0].join(labels.where("quality = 1"), "doc_id").where("size(split(trim(text), '\\\\s+')) >= 60").count()
    assert stages[2].join(labels, "doc_id").where("quality = 1").count() >= 0.98 * clean


def test_one_of_each_group(stages):
    texts = {r.doc_id: r.text or "" for r in stages[2].collect()}
    assert {r.doc_id for r in stages[3].collect()} == first_of_each(texts)


def test_packed_is_what_was_mixed(stages):
    mixed, packed = stages[4].collect(), stages[5].collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed}
    whole = sum(1 for r in packed if r.start == 0)
    assert whole == len(mixed)


def test_run(spark, sf, stages):
    key = lambda r: (r.doc_id, r.start, r.sequence_id, r.offset, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, sf).collect())) == sorted(map(key, stages[5].collect()))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 0), (6, 1, 0), (9, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{path}/some/labels.parquet")
    labels.where("doc_id < 0").write.parquet(f"{path}/none/labels.parquet")
    return path


@pytest.mark.parametrize("table", ["awkward", "empty"])
@pytest.mark.parametrize("labels", ["some", "none"])
def test_stages_on_awkward_and_empty_tables(request, spark, folder, table, labels):
    docs = request.getfixturevalue(table)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"{folder}/{labels}")
        assert out.columns == docs.columns, name
        rows, kept = sorted(map(str, docs.collect())), sorted(map(str, out.collect()))
        assert set(kept) <= set(rows) and (name == "mix" or len(kept) <= len(rows))
        if name == "quality classifier" and labels == "none":
            assert kept == rows
        if name == "near duplicates":
            assert len(set(kept)) == len(kept)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert packed.where("start = 0").count() == docs.count()
