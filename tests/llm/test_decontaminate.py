"""Windows against a plain search, and the index's guarantee."""

import random

import numpy as np
import pytest

from gridloom.llm import decontaminate
from gridloom.llm.common import shingles, words_of
from gridloom.llm.queries import op7_benchmark_decontamination

SCHEMA = "doc_id long, text string"


def plain(docs, items, least=0.8):
    """The best similarity of each item in each document over all windows of its length."""
    out = {}
    for d, text in docs:
        w = words_of((text or "").encode())
        for i, t in items:
            x = words_of((t or "").encode())
            if not len(w) or not len(x):
                continue
            want = shingles(x, 5)
            n = min(len(x), len(w))
            if n >= 5 and np.isin(shingles(w, 5), want).sum() < least * len(want):
                continue  # no window has as many of the item's shingles
            sims = [decontaminate.weighted_similarity(shingles(w[a : a + n], 5), want) for a in range(len(w) - n + 1)]
            if sims and max(sims) >= least:
                out[d, i] = max(sims)
    return out


def corpus():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((1, 3, 5, 8, 20, 20, 40, 90, 300))] + [(20, None), (21, " ")]
    docs = []
    for d in range(60):
        w = [word() for _ in range(rng.randrange(0, 120))]
        i, t = rng.choice(items[:9])
        hit = (t or "").split()
        for _ in range(rng.choice((0, 0, 1, 2))):
            hit[rng.randrange(len(hit))] = word()
        at = rng.randrange(len(w) + 1)
        docs.append((d, " ".join(w[:at] + hit + w[at:]) if d % 4 else " ".join(w)))
    return docs + [(100, None), (101, ""), (102, items[8][1] * 1 + " " + items[8][1])], items


def test_against_all_windows(spark):
    docs, items = corpus()
    got = decontaminate.contaminated(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    rows = got.collect()
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in rows} == pytest.approx(plain(docs, items))
    assert all(r["hamming"] <= 23 for r in rows)
    left = decontaminate.clean(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in plain(docs, items)}


def test_items_in_blocks(spark):
    docs, items = corpus()
    frames = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(decontaminate.contaminated(*frames)) == key(decontaminate.contaminated(*frames, most_mb=0))


def test_index_holds_every_print_within_the_radius():
    rng = np.random.default_rng(0)
    for radius in (3, 7, 15, 23):
        near = [bin(a ^ b).count("1") for a in range(256) for b in (0, 255, 170)]
        assert max(near) == 8
        for _ in range(500):
            flips = rng.choice(64, radius, replace=False)
            assert min(np.bincount(flips // 8, minlength=8)) <= radius // 8


def test_index_of_items_gives_every_window_within_the_radius():
    rng = np.random.default_rng(4)
    items = decontaminate.Items([(i, " ".join(f"w{x}" for x in rng.integers(0, 1 << 30, 30)).encode()) for i in range(20)], 15, 23)
    prints = items.prints[30]
    for _ in range(300):
        i, flips = rng.integers(20), rng.choice(64, 15, replace=False)
        near = prints[i : i + 1] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64))
        assert i in items.near(near, 30)[1]
    windows = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 20_000, dtype=np.uint64)
    blocks = windows.view("<u2").reshape(-1, 4)
    passed = sum(np.bitwise_count(np.bitwise_or.reduce([eight[b][blocks[:, b]] for b in range(4)])).sum() for eight in items.index[30])
    assert 0.03 * 20 * len(windows) < passed < 0.05 * 20 * len(windows)


def test_runs_of_a_filler_word_and_short_texts(spark):
    """A tenth of the item gives way to one repeated word; texts shorter than the item are windows of their own."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(1 << 30)}" for _ in range(300)]
    filled = words[:130] + ["."] * 24 + words[154:]
    items = [(1, " ".join(words)), (2, " ".join(words[:40]))]
    docs = [(1, " ".join(["a"] * 9000 + filled + ["b"] * 9000)), (2, " ".join(words[:38])), (3, " ".join(words[:20])), (4, "w w w w w w w")]
    got = decontaminate.contaminated(spark.createDataFrame(docs, SCHEMA).coalesce(1), spark.createDataFrame(items, "item_id long, text string"))
    rows = {(r["doc_id"], r["item_id"]): (r["start_word"], r["n_words"], r["similarity"]) for r in got.collect()}
    assert {k: v[2] for k, v in rows.items()} == pytest.approx(plain(docs, items))
    assert rows[1, 1][:2] == (9000, 300) and rows[2, 2][:2] == (0, 38) and set(rows) == {(1, 1), (1, 2), (2, 2)}


def test_sums_and_prints():
    h = np.random.default_rng(1).integers(0, 1 << 63, 70, dtype=np.uint64)
    bits = np.array([[(int(x) >> b & 1) * 2 - 1 for b in range(64)] for x in h])
    assert (decontaminate.bit_signs(h) == bits).all()
    assert (decontaminate.running(bits)[1:] == bits.cumsum(axis=0)).all()
    assert (decontaminate.running(bits, np.int8)[1:] == bits.cumsum(axis=0)).all()
    assert decontaminate.packed(bits.sum(axis=0, keepdims=True))[0] == sum(1 << b for b in range(64) if bits[:, b].sum() > 0)


def test_empty_tables_and_more_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contaminated(none, items).count() == 0
    docs = spark.createDataFrame([(1, "x a b c d e f", 9), (None, "A B c d e f", 8), (1, "x a b c d e f", 9), (2, "q", 7)], f"{SCHEMA}, item_id long")
    assert decontaminate.contaminated(docs, items.where("item_id > 5")).count() == 0
    got = decontaminate.contaminated(docs, items)
    assert sorted((r["doc_id"], r["item_id"], r["start_word"]) for r in got.where("doc_id is not null").collect()) == [(1, 1, 1), (1, 1, 1)] and got.count() == 3
    left = decontaminate.clean(docs, items)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, "q", 7)]


def test_query_on_the_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in op7_benchmark_decontamination(spark, sf).collect()}
    some = {d for d, _ in docs}
    assert {k: v for k, v in got.items() if k[0] in some} == pytest.approx(plain(docs, items))
