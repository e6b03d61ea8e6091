"""Toxicity and language: held-out accuracy, gradients, and defined results for odd rows."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import language, toxicity
from gridloom.llm.common import fold
from gridloom.llm.queries import op2_factorization_toxicity, op5_naive_bayes_language


def test_machine_scores_pairs():
    rng = np.random.default_rng(0)
    m = toxicity.Machine(rng.random(5) + 0.1, 0.3, rng.normal(size=5), rng.normal(size=(5, 3)))
    rows = [[0, 2, 4], [], [1]]
    at, row = np.array([x for r in rows for x in r]), np.repeat([0, 1, 2], [3, 0, 1])
    raw, _ = m.raw(at, row, m.inputs(at, row, 3), 3)
    for r, got in zip(rows, raw, strict=True):
        length = sum(m.value[i] ** 2 for i in r) ** 0.5
        x = {i: m.value[i] / length**0.5 for i in r}
        assert np.isclose(got, 0.3 + sum(m.w[i] * x[i] for i in r) + sum(m.v[i] @ m.v[j] * x[i] * x[j] for i in r for j in r if i < j))


def plain_terms(text):
    out = set()
    for w in re.findall(rb"[a-z0-9\x80-\xff]+", text.encode().lower()):
        out |= {(0, w), *((k, w[:k]) for k in toxicity.PARTS if len(w) >= k)}
    return out


def test_terms_are_words_and_their_starts():
    some = ["Some words, some-thing ÄÖ", "", "a", "numb3rs some"]
    row, at = toxicity.hashed([t.encode() for t in some], 40 - 12)
    terms = [plain_terms(t) for t in some]
    assert np.bincount(row, minlength=4).tolist() == [len(t) for t in terms]
    assert len(set(at.tolist())) == len(set().union(*terms))
    assert set(at[row == 0].tolist()) & set(at[row == 3].tolist()) and not set(at[row == 2].tolist()) & set(at[row == 0].tolist())


def test_query_against_plain_scores(spark, sf):
    """Each document's score by the formula, term by term, from the fitted weights."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held_out = fold(F.col("doc_id"), 4, 2)
    m = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), held_out)
    got = {r["doc_id"]: r for r in op2_factorization_toxicity(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows[:60]:
        _, at = toxicity.hashed([(r["text"] or "").encode()], 18)
        x = m.value[at].astype(float)
        x /= max(float((x * x).sum()), 1e-12) ** 0.25
        v = m.v[at].astype(float) * x[:, None]
        raw = m.w0 + float(m.w[at] @ x) + float(sum(v[i] @ v[i + 1 :].sum(axis=0) for i in range(len(v) - 1)))
        mine = got[r["doc_id"]]
        assert mine["score"] == pytest.approx(1 / (1 + np.exp(-raw)), abs=1e-4) and mine["predicted"] == (mine["score"] >= 0.3)
        assert mine["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


@pytest.mark.parametrize("what", ["both", "one of two"])
def test_fit_learns_what_single_weights_cannot(spark, what):
    rng = np.random.default_rng(1)
    rows = [(i, set(np.flatnonzero(rng.random(2) < 0.5)), " ".join(f"filler{k}" for k in rng.integers(0, 40, 6))) for i in range(2400)]
    label = (lambda s: len(s) == 2) if what == "both" else (lambda s: len(s) == 1)
    docs = spark.createDataFrame([(i, " ".join([*(("alpha", "omega")[j] for j in sorted(s)), t])) for i, s, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(label(s))) for i, s, _ in rows], "doc_id long, toxic int")
    held_out = fold(F.col("doc_id"), 4, 2)
    m = toxicity.fit(docs, labels, held_out)
    got = toxicity.score(docs, m, held_out, 0.5).where("held_out").collect()
    assert np.mean([r["predicted"] == label(rows[r["doc_id"]][1]) for r in got]) > 0.95


@pytest.mark.parametrize(("sf", "recall", "auc_least"), [("sf0.01", 0.6, 0.9), ("sf0.1", 0.85, 0.95)])
def test_toxicity_of_held_out_documents(spark, sf, recall, auc_least):
    """A few hundred labels or a few thousand."""
    sf = f"/root/testdata/{sf}"
    p = op2_factorization_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    y, s = p["toxic"].to_numpy() > 0, p["score"].to_numpy()
    auc = (s[y][:, None] > s[~y][None]).mean() + 0.5 * (s[y][:, None] == s[~y][None]).mean()
    assert auc > auc_least and (p["predicted"] == (s >= 0.3)).all() and ((s >= 0) & (s <= 1)).all()
    assert (s[y] >= 0.3).mean() > recall and (s[~y] >= 0.3).mean() < 0.02


def test_calibration_of_scores_that_part_the_labels():
    y = np.array([0.0] * 30 + [1.0] * 4)
    a, b = toxicity.calibrated(np.where(y > 0, -1.0, -4.0), y)
    assert 0 < a < 50 and a * -1 + b > -0.85 and a * -4 + b < -2
    a, b = toxicity.calibrated(np.zeros(8), np.array([1.0, 0] * 4))
    assert abs(b) < 0.1


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(i, f"you {'awful fool' if i % 2 else 'kind friend'} {i}", 5) for i in range(60)] + [(60, None, 1), (61, "", 1), (61, "", 1), (None, "awful", 1)], "doc_id long, text string, label long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (5, None), (3, 0)], "doc_id long, toxic int")
    m = toxicity.fit(docs, labels, F.lit(False))
    rows = toxicity.score(docs, m, fold(F.col("doc_id"), 4, 2)).collect()
    s = {r["doc_id"]: r["score"] for r in rows}
    assert len(rows) == 64 and min(s[i] for i in range(1, 60, 2)) > max(s[i] for i in range(0, 60, 2)) and s[60] == s[61]
    left = toxicity.clean(docs, m)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} >= set(range(0, 60, 2))


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    r = toxicity.score(docs, toxicity.fit(docs, labels, F.lit(False)), F.lit(False)).first()
    assert r["score"] < 0.3 and r["predicted"] == 0
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, labels, F.lit(False)), F.lit(False)).count() == 0


def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    p = op5_naive_bayes_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(p) > 200 and (p["lang"] == p["lang_pred"]).mean() > 0.99 and p["score"].between(0, 1).all()


def test_language_against_plain_bayes(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("le chat est là", "fr"), ("the cat is here", "en"), ("der hund ist da", "de"), ("un chien et la table", "fr"), ("a dog and the table", "en")] * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, prior, m, bits = language.fit(df)

    def grams(text):
        for _, points, own in language.pieces([text]):
            for at, b in language.hashed(points, bits):
                yield from b[own[at] >= 0].tolist()

    for text in ("the dog", "la table est", "ist"):
        want = prior + np.array([sum(m[j][b] for b in grams(text)) for j in range(len(langs))])
        got = language.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), (langs, prior, m, bits), F.lit(False)).first()
        assert got["lang_pred"] == langs[int(want.argmax())] and got["score"] == pytest.approx(1 / np.exp(want - want.max()).sum())


def test_long_texts_count_every_ngram_once(monkeypatch):
    text = "abcdefghij" * 37
    whole = sorted(b for _, p, own in language.pieces([text]) for at, bs in language.hashed(p, 16) for b in bs[own[at] >= 0].tolist())
    monkeypatch.setattr(language, "PIECE", 16)
    cut = sorted(b for _, p, own in language.pieces([text]) for at, bs in language.hashed(p, 16) for b in bs[own[at] >= 0].tolist())
    assert cut == whole and len(whole) == 370 + 369 + 368


def test_language_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 !", "en"), (4, "word", None), (5, "word", "en"), (5, "word", "en")], "doc_id long, text string, lang string")
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(df, F.lit(False)).collect()]
    assert sorted(got) == [(1, "und", 0), (2, "und", 0), (3, "und", 0), (4, "en", 1), (5, "en", 1), (5, "en", 1)]
    assert language.identify(df.where("doc_id = 4"), F.lit(False)).first()["lang_pred"] == "und"
    assert language.identify(df.limit(0), F.lit(False)).count() == 0


def test_terms_reach_the_driver_packed_and_stay_so():
    """Rows in any order and number of batches come back in order; they take under half on their way and in the fit."""
    rng = np.random.default_rng(3)
    rows = [(i // 2, i % 2, np.flatnonzero(rng.random(1 << 18) < 0.004).astype(np.int32)) for i in range(40)] + [(20, 1, np.zeros(0, np.int32))]
    sent = [toxicity.packed(at) for _, _, at in rows]
    order = rng.permutation(len(rows)).tolist()
    parts = [toxicity.rows_out(toxicity.ROWS, [[rows[i][0] for i in x], [rows[i][1] for i in x], [sent[i] for i in x]]) for x in (order[:9], order[9:])]
    y, got = toxicity.received(pa.Table.from_batches(parts))
    assert y.tolist() == [float(r[1]) for r in rows] and len(got) == len(rows)
    assert all(np.array_equal(a, r[2]) for a, r in zip(got, rows, strict=True))
    assert sum(map(len, got.rows)) < 0.5 * sum(r[2].nbytes for r in rows)
    y, got = toxicity.received(toxicity.ROWS.empty_table())
    assert not len(y) and not len(got)
