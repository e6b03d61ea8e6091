"""The pipeline's stages against plain versions of what each must do, on rows with clashing names and nulls."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import mixing, toxicity
from tests.llm.test_decontaminate import plain as plain_windows
from tests.llm.test_ngram_join import plain as plain_groups
from tests.llm.test_token_files import plain as plain_tokens


def test_stages_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    (_, s1), (_, s2), (_, s3), (_, s4), (_, s5) = corpus_pipeline.STAGES
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    a = s1(spark, docs, sf)
    m = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), F.lit(False))
    assert a.columns == docs.columns and set(rows(a)) == {r["doc_id"] for r in toxicity.score(docs, m, F.lit(False)).where("score < 0.3").collect()}
    b = s2(spark, a, sf)
    assert set(rows(b)) == {c for _, _, c in plain_groups(list(rows(a).items()))}
    c = s3(spark, b, sf)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(rows(b)) - set(rows(c)) == {d for d, _ in plain_windows(list(rows(b).items()), items)}
    d = s4(spark, c, sf)
    assert d.columns == docs.columns and set(rows(d)) == {r["doc_id"] for r in mixing.mix(c).where("kept").collect()}
    e = s5(spark, d, sf)
    assert sorted(map(tuple, e.collect())) == plain_tokens(list(rows(d).items()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, e.collect()))


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_pass_all_stages(spark, sf, empty):
    rows = [(1, "one text of its own", "en", "s", 19, 1.5), (2, None, None, None, None, None), (3, "", "en", "s", 0, 2.5), (None, "no id", "en", "s", 5, 3.5)]
    docs = spark.createDataFrame([] if empty else rows, "doc_id long, text string, lang string, source string, n_chars long, label double")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "label"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() <= 4
    assert public_tokenizers.path("byte_bpe_50k.json")
