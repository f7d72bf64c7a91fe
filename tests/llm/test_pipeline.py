"""The pipeline stage by stage against brute force on a small fixture with clashing column names and nulls."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm.test_operators import brute_components, brute_spans


def test_stages_over_the_smallest_tables(spark, tmp_path):
    docs = corpus_pipeline.documents(spark, DATA)
    # Columns whose names the operators use inside.
    docs = docs.withColumns({"n": F.lit(1), "th": F.lit("x"), "place": F.lit(None).cast("string"), "leak_id": F.lit(3), "kept_id": F.lit(4), "did": F.lit(1), "rest": F.lit("r"), "lists": F.lit(0)})
    nulls = docs.limit(1).withColumns({"doc_id": F.lit(10**6), "text": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")})
    docs = docs.unionByName(nulls)
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, DATA)
        path = str(tmp_path / name)
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if k < 4:
            assert out.columns == columns
            after = {r["doc_id"]: r["text"] for r in out.collect()}
            assert set(after) <= set(before)
        if name == "language_id":
            assert set(after) == set(before) - {10**6}
        elif name == "ngram_jaccard":
            assert set(after) == {i for i, (_, c) in brute_components(list(before.items())).items() if c == i}
        elif name == "suffix_dedup":
            want = brute_spans(list(before.items()))
            assert set(after) == set(before)
            assert all(len(after[i].encode()) <= want[i][0] - want[i][1] for i in before)
            assert all(after[i] == before[i] for i in before if not want[i][1])
            assert {r["doc_id"]: r["n_chars"] for r in out.collect()} == {i: len(t) for i, t in after.items()}
        elif name == "decontamination":
            assert 0 < len(after) <= len(before)
        else:
            assert out.count() == len(before) and out.where("n_tokens <> size(ids)").count() == 0
        docs = out


def test_run_returns_the_last_stage(spark):
    assert "ids" in corpus_pipeline.run(spark, DATA).columns


def test_empty_documents(spark):
    random.seed(0)
    docs = corpus_pipeline.documents(spark, DATA).where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0
