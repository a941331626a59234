"""The pipeline's stages, each against its own rule, on planted documents."""

import inspect

import pytest
from llm_helpers import corpus, make_docs

import corpus_pipeline
from cohortia.llm.neardup import near_duplicates
from cohortia.llm.queries import REGISTRY


@pytest.fixture(scope="module")
def folder_of_planted(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("planted"))
    rows = corpus(seed=9)
    leak = "the benchmark passage that must never be read during training because it is a test of the model itself"
    rows += [(1000, "before " + leak + " after"), (1001, "vileness " * 4 + "and more"), (1002, "so much vileness is vileness")]
    rows += [(1100 + k, f"quiet words number {k} about nothing of note") for k in range(60)]
    rows += [(1200 + k, f"vileness {k} all over, vileness again, number {k}") for k in range(40)]
    make_docs(spark, rows, score="own", regions=1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(7, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(1100 + k, 1, 0) for k in range(60)] + [(1200 + k, 0, 1) for k in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_in_order(spark, folder_of_planted):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "suffix_array_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{folder_of_planted}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in docs.select("doc_id", "text").collect())
        docs = corpus_pipeline.stored(stage(spark, docs, folder_of_planted), "stage")
        if name != "packing":
            assert docs.columns == columns
            after = {r["doc_id"]: r for r in docs.collect()}
            seen[name] = after
        if name == "toxicity":
            assert not {1001, 1002, 1205} & set(after) and {1000, 1105, 0, 1} <= set(after)
            kept = docs
        if name == "near_duplicates":
            groups = near_duplicates(kept, width=5)
            assert set(after) == {r["doc_id"] for r in groups.where("kept").collect()}
            assert len(before) > docs.count()
        if name == "suffix_array_dedup":
            assert docs.count() == len(before)
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
            assert all(r["text"] == "" for i, r in after.items() if i is None)
        if name == "decontamination":
            assert 1000 not in after and len(before) - docs.count() == 1
    pieces = docs.collect()
    assert {r["doc_id"] for r in pieces} == set(seen["decontamination"])
    ran = corpus_pipeline.run(spark, folder_of_planted).collect()
    assert sorted(map(str, ran)) == sorted(map(str, pieces))


def test_stages_on_an_empty_table(spark, folder_of_planted):
    docs = spark.read.parquet(f"{folder_of_planted}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder_of_planted).count() == 0


def test_queries_take_a_session_and_a_folder():
    assert sorted(int(name[2:].split("_")[0]) for name in REGISTRY) == list(range(1, 14))
    assert all(list(inspect.signature(make).parameters) == ["spark", "folder"] for make in REGISTRY.values())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_runs_on_given_tables(spark, folder, name):
    assert REGISTRY[name](spark, folder).count() > 0
