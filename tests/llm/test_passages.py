"""Passages planted across documents, chains against all orders, and alignments."""

import itertools
import random

import numpy as np
import pytest

from gridloom.llm import passages
from gridloom.llm.queries import op10_repeated_passages

SCHEMA = "doc_id long, text string"


def words(rng, n, tag=""):
    return [f"{tag}{rng.randrange(10**6)}" for _ in range(n)]


def test_planted_passages_are_found_and_nothing_else(spark):
    rng = random.Random(2)
    hot, pair, fuzzy = words(rng, 70), words(rng, 55), words(rng, 120)
    docs, want = [], {}
    for d in range(90):
        a, b = words(rng, rng.randrange(5, 80)), words(rng, rng.randrange(5, 80))
        if d % 3 == 0:
            docs.append((d, " ".join([*a, *hot, *b])))
            want[d] = (len(a), len(a) + 70)
        elif d in (1, 2):
            docs.append((d, "\n".join([*a, *pair, *b]).upper() if d == 2 else "  ".join([*a, *pair, *b])))
            want[d] = (len(a), len(a) + 55)
        elif d in (4, 5):
            f = list(fuzzy)
            if d == 5:
                f[30] = "changed"
                del f[75]
                f.insert(95, "more")
            docs.append((d, " ".join([*a, *f, *b])))
            want[d] = (len(a), len(a) + len(f))
        elif d in (7, 8):
            docs.append((d, " ".join([*a, *pair[:30], *b])))  # too short to count
        else:
            docs.append((d, " ".join([*a, *b])))
    got = passages.repeated_passages(spark.createDataFrame(docs, SCHEMA).repartition(4)).collect()
    assert {r["doc_id"]: (r["start_word"], r["end_word"]) for r in got} == want
    assert all(r["n_words"] == r["end_word"] - r["start_word"] and r["partner_id"] != r["doc_id"] and r["similarity"] >= 0.8 for r in got)
    assert min(r["similarity"] for r in got) < 1 and {r["similarity"] for r in got if r["doc_id"] % 3 == 0} == {1.0}


def test_exact_copies_and_repeats_inside_one_document(spark):
    rng = random.Random(4)
    text, own = " ".join(words(rng, 300)), words(rng, 60)
    docs = [(i, text) for i in range(25)] + [(50, " ".join([*own, *words(rng, 40), *own]))]
    got = {r["doc_id"]: r for r in passages.repeated_passages(spark.createDataFrame(docs, SCHEMA).repartition(6)).collect()}
    assert set(got) == set(range(25)) and all((r["start_word"], r["end_word"]) == (0, 300) for r in got.values())


def test_odd_rows(spark):
    rng = random.Random(5)
    t = " ".join(words(rng, 60))
    rows = [(1, t), (1, t), (2, None), (3, ""), (None, t), (4, "a b c"), (5, "x " * 40_000), (6, "x " * 500)]
    got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in passages.repeated_passages(spark.createDataFrame([(*r, 0) for r in rows], f"{SCHEMA}, pos long")).collect()}
    assert (6, 0, 500) in got and not {1, 2, 3, 4, None} & {d for d, _, _ in got}
    assert passages.repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_best_chain_against_all_orders(seed):
    rng = np.random.default_rng(seed)
    segs = np.stack([rng.integers(0, 60, 7), rng.integers(0, 60, 7), rng.integers(0, 10, 7)], axis=1)
    segs = segs[np.lexsort((segs[:, 0], segs[:, 1]))]

    def value(c):
        v = float(sum(segs[i][2] + passages.K for i in c))
        for i, j in itertools.pairwise(c):
            gaps = [segs[j][k] - segs[i][k] - segs[i][2] for k in (0, 1)]
            if min(gaps) <= 0:
                return -1.0
            v -= passages.GAP_COST * sum(gaps)
        return v

    best = max(value(c) for n in range(1, 8) for c in itertools.permutations(range(7), n))
    assert value(next(iter(passages.chains(segs)))) == pytest.approx(best)


def test_alignment():
    assert passages.edit_columns(np.array([1, 2, 3]), np.array([1, 3])) == (2, 3)
    assert passages.edit_columns(np.array([]), np.array([1, 2])) == (0, 2)
    assert passages.grown(np.array([True, True, False, True, True, True, True, False, False])) == 7
    assert passages.grown(np.zeros(0, bool)) == 0 and passages.grown(np.zeros(9, bool)) == 0


def test_equal_runs_share_a_seed():
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 1 << 62, 19 - passages.K + 1, dtype=np.uint64)
    for _ in range(200):
        a, b = (np.concatenate([rng.integers(0, 1 << 62, rng.integers(0, 30), dtype=np.uint64), shared, rng.integers(0, 1 << 62, rng.integers(0, 30), dtype=np.uint64)]) for _ in range(2))
        assert set(a[passages.minimizers(a)]) & set(b[passages.minimizers(b)]) & set(shared)


@pytest.mark.parametrize("parts", [1, 3])
def test_a_shorter_copy_comes_before_two_whole_ones(spark, parts):
    rng = random.Random(6)
    want, docs = {}, []
    for n in (50, 51, 54, 60):
        for cuts in ([(0, 45)], [(0, 16), (10, 26), (20, 36), (30, 46), (40, n)]):
            p, base = words(rng, n), 10 * len(docs)
            for i, (a, b) in enumerate(cuts):
                docs.append((base + i, " ".join([*words(rng, 20), *p[a:b], *words(rng, 20)])))
            for d in (base + 7, base + 8):
                docs.append((d, " ".join([*words(rng, 30), *p, *words(rng, 9)])))
                want[d] = (30, 30 + n)
    got = passages.repeated_passages(spark.createDataFrame(docs, SCHEMA).repartition(parts)).collect()
    assert {r["doc_id"]: (r["start_word"], r["end_word"]) for r in got} == want


@pytest.mark.parametrize("changes", [range(5, 60, 7), range(11, 60, 12), [1, 20, 38, 58]])
def test_changed_words(spark, changes):
    rng = random.Random(7)
    docs = []
    for d in range(0, 40, 2):
        p = words(rng, 60)
        q = [f"new{i}" if i in changes else w for i, w in enumerate(p)]
        docs += [(d, " ".join([*words(rng, 20), *p, *words(rng, 20)])), (d + 1, " ".join([*words(rng, 20), *q, *words(rng, 20)]))]
    got = {r["doc_id"]: r for r in passages.repeated_passages(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert set(got) == set(range(40)) and all(r["n_words"] >= 50 and r["similarity"] >= 0.8 for r in got.values())


def test_query_on_the_table_has_exact_copies(spark, sf):
    docs = {r["doc_id"]: (r["text"] or "").lower().split() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {}
    for r in op10_repeated_passages(spark, sf).collect():
        got.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
    runs = {}
    for d, w in docs.items():
        for i in range(len(w) - 49):
            runs.setdefault(tuple(w[i : i + 50]), set()).add((d, i))
    for places in runs.values():
        if len({d for d, _ in places}) > 1:
            for d, i in places:
                assert any(a <= i and i + 50 <= b for a, b in got.get(d, [])), (d, i)


def test_pieces_in_other_documents_hide_no_passage(spark):
    rng = random.Random(8)
    p = words(rng, 120)
    docs = [(i, " ".join([*words(rng, 15), *p[a : a + 24], *words(rng, 15)])) for i, a in enumerate([*range(0, 97, 12), *range(5, 97, 17)])]
    q = [f"new{i}" if i % 20 == 7 else w for i, w in enumerate(p)]
    docs += [(100, " ".join([*words(rng, 20), *p, *words(rng, 20)])), (101, " ".join([*words(rng, 9), *p, *words(rng, 9)])), (102, " ".join([*words(rng, 30), *q, *words(rng, 9)]))]
    got = {r["doc_id"]: (r["start_word"], r["end_word"]) for r in passages.repeated_passages(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == {100: (20, 140), 101: (9, 129), 102: (30, 150)}


def test_several_texts_of_one_id_are_documents_of_their_own(spark):
    rng = random.Random(9)
    p, q = words(rng, 60), words(rng, 60)
    rows = [(1, " ".join([*words(rng, 70), *p])), (1, " ".join(q)), (1, " ".join(q)), (2, " ".join([*p, *words(rng, 7)])), (3, " ".join([*words(rng, 5), *q]))]
    got = {tuple(r)[:5] for r in passages.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 70, 130, 60, 2), (1, 0, 60, 60, 3), (2, 0, 60, 60, 1), (3, 5, 65, 60, 1)}


def test_recall_of_fuzzy_passages_among_partial_copies(spark):
    """300 documents; of each of 20 passages of 60 to 120 words there are copies with 5 to 17 % of the words changed, and pieces. What is wanted comes from comparing all copies word by word."""
    rng = random.Random(10)
    docs, where = [], []
    for g in range(20):
        p = words(rng, rng.randrange(60, 121), f"g{g}x")
        for i in range(15):
            a, b = words(rng, rng.randrange(5, 60)), words(rng, rng.randrange(5, 60))
            if i < 10:
                cut = rng.randrange(0, len(p) - 22)
                q = p[cut : cut + 22]
            else:
                share = 0 if i == 10 else rng.uniform(0.05, 0.17)
                q = [f"n{rng.randrange(10**9)}" if 0 < k < len(p) - 1 and rng.random() < share else w for k, w in enumerate(p)]
            d = len(docs) * 11 % 301
            docs.append((d, " ".join([*a, *q, *b])))
            if i >= 10:
                where.append((g, d, len(a), q))
    wanted = set()
    for g, d, at, q in where:
        for g2, d2, _, q2 in where:
            x, y = (np.array([hash(w) for w in s]) for s in (q, q2))
            if g == g2 and d != d2 and (x == y).mean() >= 0.8:
                wanted.add((d, at, at + len(q)))
    got = {}
    for r in passages.repeated_passages(spark.createDataFrame(docs, SCHEMA).repartition(5)).collect():
        got.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
    hits = [any(min(b, e) - max(a, s) >= 50 for s, e in got.get(d, [])) for d, a, b in wanted]
    assert len(wanted) > 80 and np.mean(hits) >= 0.95
    pieces = {n * 11 % 301 for n in range(300) if n % 15 < 10}
    assert not set(got) & pieces


@pytest.mark.parametrize(("every", "piece", "share"), [(12, 24, 1), (20, 24, 1), (15, 40, 1), (9, 24, 0.9)])
def test_pieces_in_lesser_and_greater_documents_hide_no_changed_passage(spark, every, piece, share):
    """20 passages of 120 words, each in two documents of which one has each `every`-th word changed; lesser and greater documents have pieces of them.

    Which keys are left where each 9th word is changed is a matter of chance, so there a share is asked for.
    """
    rng = random.Random(every)
    docs, want = [], {}
    for g in range(20):
        p = words(rng, 120, f"g{g}x")
        q = [f"n{rng.randrange(10**9)}" if i % every == every // 2 else w for i, w in enumerate(p)]
        for base in (0, 2000):
            docs += [(base + 20 * g + i, " ".join([*words(rng, 15), *p[a : a + piece], *words(rng, 15)])) for i, a in enumerate(range(0, 121 - piece, 8 if piece < 25 else 80))]
        for i, t in enumerate((p, q)):
            docs.append((1000 + 2 * g + i, " ".join([*words(rng, 20), *t, *words(rng, 20)])))
            want[1000 + 2 * g + i] = (20, 140)
    got = {}
    for r in passages.repeated_passages(spark.createDataFrame(docs, SCHEMA).repartition(5)).collect():
        got.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
    assert set(got) <= set(want) and len(got) >= share * len(want)
    assert all(sum(min(y, want[d][1]) - max(x, want[d][0]) for x, y in spans) >= 100 for d, spans in got.items())
