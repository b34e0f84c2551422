"""The pipeline: every stage keeps the columns, acts on its input, and the whole runs through."""

import gc

import corpus_pipeline
import pytest

from tidemark.llm import bpe, decontaminate, ngram_join
from tidemark.llm.components import components


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(folder / str(k)))
        docs = spark.read.parquet(str(folder / str(k)))
        out.append(docs)
    return out


def test_stages_return_the_columns_of_documents(spark, sf_dir, stages):
    names = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert len(stages) == 5 and all(s.columns == names for s in stages[:-1])


def test_what_each_stage_does(spark, sf_dir, stages):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    good = stages[0].join(labels, "doc_id")
    assert good.where("quality = 0").count() <= 1 and good.where("quality = 1").count() >= 0.98 * labels.where("quality = 1").count()
    assert ngram_join.near_duplicates(stages[1]).groupBy("component_id").count().where("count > 1").count() == 0
    left = stages[1].select("doc_id").exceptAll(stages[2].select("doc_id"))
    held = decontaminate.contained_items(stages[1], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    assert left.exceptAll(held).count() == 0 and left.count() == held.count() > 0
    assert stages[3].count() == stages[2].count() and stages[3].where("text RLIKE '[a-z0-9]@[a-z0-9]+[.]'").count() == 0
    changed = stages[3].join(stages[2].select("doc_id", "text").withColumnRenamed("text", "before"), "doc_id").where("text <> before")
    assert changed.count() > 0 and changed.where("NOT text LIKE '%[%]%'").count() == 0
    assert stages[4].count() == stages[3].count() and stages[4].where("size(ids) <> n_tokens").count() == 0


def test_run_gives_the_rows_of_the_last_stage(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir).select("doc_id", "ids_sha256").collect()
    assert sorted(got) == sorted(stages[-1].select("doc_id", "ids_sha256").collect())
    assert bpe.codec(__import__("public_tokenizers").path("word_bpe_49k.json")).automaton.token


def test_driver_keeps_no_codec(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    assert corpus_pipeline.to_tokens(spark, docs, sf_dir).count() == 20
    gc.collect()
    assert not [x for x in gc.get_objects() if isinstance(x, bpe.Codec)]


def test_few_edges_are_not_exchanged_after_their_union(spark):
    edges = spark.createDataFrame([(5, 3), (3, 9), (7, 8), (8, 8), (20, 9)], "a long, b long")
    got = components(edges)
    assert sorted(map(tuple, got.collect())) == [(3, 3), (5, 3), (7, 7), (8, 7), (9, 3), (20, 3)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
