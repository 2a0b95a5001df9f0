import cases
import pytest

import corpus_pipeline
from fairlead.llm import decontaminate, jaccard, line_dedup, pieces
from fairlead.llm.common import stored, table


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """The table after every stage."""
    docs, out = table(spark, sf_dir, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        out.append(docs)
    return out


def test_stages_keep_the_columns_of_documents(spark, sf_dir, steps):
    names = table(spark, sf_dir, "documents").columns
    assert [s.columns for s in steps[:-1]] == [names] * 4
    assert steps[-1].columns == ["doc_id", "n_tokens", "tokens"]


def test_each_stage_takes_effect(spark, sf_dir, steps):
    labels = table(spark, sf_dir, "labels")
    good = steps[0].join(labels, "doc_id").filter("quality = 1").count()
    assert good / table(spark, sf_dir, "documents").join(labels, "doc_id").filter("quality = 1").count() > 0.97
    assert steps[0].join(labels, "doc_id").filter("quality = 0").count() < 0.1 * labels.filter("quality = 0").count()
    again = line_dedup.drop_bitmaps(steps[1])
    assert again.count() == 0 and steps[1].count() == steps[0].count()
    groups = jaccard.near_duplicates(steps[2])
    assert groups.filter("doc <> component").count() == 0 and 0 < steps[2].count() < steps[1].count()
    found = decontaminate.contaminations(steps[3], table(spark, sf_dir, "benchmark"))
    assert found.count() == 0 and 0 < steps[3].count() < steps[2].count()
    kept = {r["doc_id"] for r in decontaminate.contaminations(steps[2], table(spark, sf_dir, "benchmark")).collect() for r in [{"doc_id": r["doc"]}]}
    assert {r["doc_id"] for r in steps[2].select("doc_id").collect()} - kept == {r["doc_id"] for r in steps[3].select("doc_id").collect()}


def test_run_gives_the_last_stage(spark, sf_dir, steps):
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, got.collect())) == sorted(map(str, steps[-1].collect()))
    texts = {r["doc_id"]: r["text"] for r in steps[3].collect()}
    words = pieces.load().prepare()
    assert all(words.encode([texts[r["doc_id"]]])[0].tolist() == r["tokens"] for r in got.limit(50).collect())


def test_edge_cases_pass_all_stages(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(i, t, "xx", None, None) for i, t in cases.texts()]
    for name, some in (("full", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(some, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert (len(got) > 10) == bool(some)
