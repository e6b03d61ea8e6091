"""Packing: the cheapest cuts against all of them, and every id in its place."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridloom.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


def cheapest(at, penalty, size, sequence):
    cost = [0] + [10**9] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            if at[j] - at[i] <= size:
                cost[j] = min(cost[j], cost[i] + packing.padding(at[j] - at[i], size) + penalty[j] + sequence)
    return cost[-1]


@pytest.mark.parametrize("seed", range(40))
def test_cuts_are_the_cheapest(seed):
    rnd = random.Random(seed)
    size = rnd.choice([1, 2, 8, 20, 32])
    steps = [rnd.randint(1, min(size, 9)) for _ in range(rnd.randint(1, 60))]
    at = np.concatenate([[0], np.cumsum(steps)])
    penalty = np.array([0] + [rnd.choice([0, 1, 4]) for _ in steps])
    sequence = rnd.choice([0, 1, 3])
    ends = [0, *packing.cuts(at, penalty, size, sequence)]
    assert ends[-1] == len(at) - 1
    got = sum(packing.padding(int(at[b] - at[a]), size) + int(penalty[b]) + sequence for a, b in zip(ends, ends[1:], strict=False))
    assert all(0 < at[b] - at[a] <= size for a, b in zip(ends, ends[1:], strict=False))
    assert got == cheapest(at.tolist(), penalty.tolist(), size, sequence)


def check(rows, texts, end_id=1, size=2048):
    """Every id of every document once, in order, in sequences without gaps; the share of padding."""
    tok = Tokenizer.from_file(PATH)
    want = sorted(([*tok.encode(t or "", add_special_tokens=False).ids, end_id] for _, t in texts))
    docs, seqs = [], defaultdict(list)
    own = []
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        seqs[r["sequence_id"]].append(r)
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        if r["start"] == 0:
            own = []
            docs.append((r["doc_id"], own))
        assert r["start"] == len(own)
        own += ids
        if len(own) == r["doc_tokens"]:
            assert own[-1] == end_id
    assert sorted(x for _, x in docs) == want
    assert sorted((d is not None, d or 0) for d, _ in docs) == sorted((d is not None, d or 0) for d, _ in texts)
    assert sorted(seqs) == list(range(len(seqs)))
    pad = 0
    for s in seqs.values():
        assert [r["offset"] for r in s] == np.cumsum([0, *(r["length"] for r in s[:-1])]).tolist()
        n = sum(r["length"] for r in s)
        assert n <= size
        pad += packing.padding(n, size)
    return pad / max(1, sum(map(len, want)))


def test_all_ids_once(spark):
    rnd = random.Random(3)
    words = ["alpha", "beta.", "Gamma!", "delta,\n", "  ", "épsilon", "42", "don't", "<|endoftext|>", "中文。"]
    texts = [(rnd.choice([None, *range(90)]), " ".join(rnd.choices(words, k=rnd.choice([0, 1, 30, 900])))) for _ in range(150)]
    texts += [(7, None), (7, ""), (None, None), (5, "x" * 60_000), (6, "word " * 30_000), (91, "same text"), (91, "same text")]
    df = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in texts], "doc_id long, text string, part int, seq long, length long")
    assert check(packing.packed(df, PATH).collect(), texts) < 0.01
    assert check(packing.packed(df, PATH, end_id=9, size=64, parts=3).collect(), texts, 9, 64) < 0.05


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_query(spark, sf):
    rows = queries.op12_packed_sequences(spark, sf).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    tok = Tokenizer.from_file(PATH)
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert set(by) == set(docs)
    for d, pieces in by.items():
        ids = np.array([*tok.encode(docs[d] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert zlib.crc32(ids[at : at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)


def test_sentences_end_where_they_do():
    tok = Tokenizer.from_file(PATH)
    s = packing.Sentences(tok)
    text = 'One is 3.5 "done." Two!\nThree? four'
    e = tok.encode(text, add_special_tokens=False)
    starts = [e.offsets[i][0] for i in s.after(np.array(e.ids))]
    assert [text[a:].lstrip()[:5] for a in starts] == ["Two!\n", "Three", "Three", "four"] or [text[a:].lstrip()[:3] for a in starts] == ["Two", "Thr", "fou"]
