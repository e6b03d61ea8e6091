"""Host rules and mixing: SQL on the tables, plain versions on odd rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.llm import mixing, quality
from gridloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, name, table):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '/root/testdata/{table}/{t}.parquet'")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, f"/root/testdata/{table}").toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    first = [c for c in ("doc_id", "conv_id", "depth", "lang", "rank") if c in cols]  # name a row
    got, want = (x[cols].sort_values(first).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in cols:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).fillna(False).all(), c


def test_measures():
    assert quality.measures("a b c a b c\n\n x# \nx#\n x# ".encode()) == (9, 12, 3, 1, 6)
    assert quality.measures("é ü".encode()) == (2, 2, 0, 0, 0) and quality.measures(b"") == (0, 0, 0, 0, 0)
    assert quality.repeated_words(b"a a a a".split()) == 4 and quality.repeated_words([b"a"]) == 0


def test_host_with_bad_documents(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, good if i % 10 else "bad", "bad.example" if i < 40 and i % 10 == 0 else "good.example") for i in range(200)] + [(900, good, "bad.example"), (901, good, None), (902, None, None), (903, good, "new.example"), (903, good, "new.example")]
    got = quality.host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert len(got) == len(rows) and not kept[900] and kept[901] and not kept[902] and kept[903] and kept[1] and not kept[10]
    assert quality.host_rules(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_raked_shares_have_the_wanted_marginals(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cells = mixing.measured(docs).where("n_tokens > 0").groupBy(*mixing.DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))
    raked = mixing.rake(cells, 0.5, 12).toPandas()
    for d in mixing.DIMENSIONS:
        want = raked.groupby(d)["tokens"].sum() ** 0.5
        assert (raked.groupby(d)["weight"].sum() - want / want.sum()).abs().max() < 2e-3


def test_mix_and_kept_agree(spark):
    rows = [(i, "tok " * (i % 9), ("en", "fr", None)[i % 3], f"s{i % 4}" if i % 11 else None, i) for i in range(300)] + [(7, "dup", "en", "s1", 0), (None, "x y", "en", "s1", 0), (400, None, "xx", "lonely", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, salt long")
    mix = mixing.mix(docs).collect()
    assert len(mix) == len(rows) and all(0 < r["probability"] <= 1 for r in mix)
    a = sorted((r["doc_id"] is None, r["doc_id"]) for r in mix if r["kept"])
    for most in (50_000, 0):
        kept = mixing.kept(docs, most_cells=most)
        assert kept.columns == docs.columns and sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == a
    none = docs.limit(0)
    assert mixing.mix(none).count() == 0 and mixing.kept(none).count() == 0


def test_repeated_documents_reach_the_marginals(spark):
    rows = [(i, "tok " * 8 if i % 50 else "a@b.c " * 8, "en" if i % 20 else "fr", f"s{i % 3}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    tokens = mixing.measured(docs).groupBy("lang", "topic").agg(F.sum("n_tokens").alias("t")).toPandas()
    got = mixing.measured(mixing.kept(docs, 0.3, repeat=True)).groupBy("lang", "topic").agg(F.sum("n_tokens").alias("t")).toPandas()
    assert got["t"].sum() == pytest.approx(0.8 * tokens["t"].sum(), rel=0.05)
    for d in ("lang", "topic"):
        want = tokens.groupby(d)["t"].sum() ** 0.3
        assert (got.groupby(d)["t"].sum() / got["t"].sum() - want / want.sum()).abs().max() < 0.02


def test_probabilities_reach_the_marginals_and_what_is_to_be_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mix = mixing.mix(docs).toPandas()
    mix["got"] = mix["n_tokens"] * mix["probability"]
    goal = 0.8 * mix["n_tokens"].sum()
    assert mix["got"].sum() == pytest.approx(goal, rel=1e-6) and mix["probability"].between(0, 1).all()
    for d in mixing.DIMENSIONS:
        v = mix.groupby(d)[["n_tokens", "got"]].sum()
        v = v[v["n_tokens"] > 0]
        wish, by = v["n_tokens"] ** 0.7, 0.0
        for full in sorted(v["n_tokens"] / wish):  # the last proportion at which what is wanted is there
            if sum((full * wish).clip(upper=v["n_tokens"])) <= goal:
                by = full
        open_ = v["n_tokens"] / wish > by * (1 + 1e-9)
        want = v["n_tokens"].where(~open_, wish * (goal - v["n_tokens"][~open_].sum()) / wish[open_].sum())
        assert (v["got"] / want - 1).abs().max() < 1e-4


def test_stated_shares(spark):
    rows = [(i, "tok " * 8, "en" if i % 4 else "fr", f"s{i % 3}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mix = mixing.mix(docs, keep=0.3, shares={"lang": {"fr": 0.5, "not there": 0.1}, "source": {"s0": 0.2}}).toPandas()
    mix["got"] = mix["n_tokens"] * mix["probability"] / (0.3 * mix["n_tokens"].sum())
    assert mix["got"].sum() == pytest.approx(1, rel=1e-6)
    assert mix.groupby("lang")["got"].sum()["fr"] == pytest.approx(0.5 / 0.9, rel=1e-4)  # of what is there
    assert mix.groupby("source")["got"].sum()["s0"] == pytest.approx(0.2, rel=1e-4)
    with pytest.raises(ValueError):
        mixing.mix(docs, shares={"lang": {"fr": 1.2}})
