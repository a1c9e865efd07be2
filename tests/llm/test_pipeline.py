"""The pipeline's stages over the smallest table: columns stay, decisions take effect."""

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_stages(spark):
    cp = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    from sieveline.llm import neardup
    from sieveline.session import stash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "pii", "mixing", "bpe"]
    for name, stage in cp.STAGES:
        before, docs = docs, stash(stage(spark, docs, SF), name)
        if name != "bpe":
            assert docs.columns == columns
        if name == "near_dedup":
            assert neardup.near_duplicates(docs).where("not kept").count() == 0
        if name == "pii":
            assert docs.count() == before.count()
    assert docs.where("n_tokens <> size(token_ids)").count() == 0 and docs.count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_run_leaves_its_last_rows_only(spark):
    cp = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    from sieveline.session import shared_dir

    folder = shared_dir(spark)
    before = set(os.listdir(folder))
    out = cp.run(spark, SF)
    assert out.columns == ["doc_id", "source", "lang", "n_tokens", "token_ids"] and out.count() > 0
    assert len(set(os.listdir(folder)) - before) == 1
