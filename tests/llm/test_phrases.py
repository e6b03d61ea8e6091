"""Collocations against plain counting, whatever the sketch's size."""

import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import phrases

DDL = "doc_id long, text string, lang string, f long, weight long, k int"
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, most=3, least=10, share=50, first=2000):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(A_Z)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    out = []
    for (lang, p), a in cand.items():
        score, _, l, r = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        if not any(g == lang and len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in cand.items()):
            out.append((lang, " ".join(p), a, l, r, n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(x[0], i + 1, *x[1:]) for i, x in enumerate(own[:first])]
    return sorted(ranked)


def result(spark, rows, **how):
    return sorted(map(tuple, phrases.collocations(spark.createDataFrame(rows, DDL), **how).collect()))


def corpus(seed, n=250):
    rnd = random.Random(seed)
    words = ["New", "york", "CITY", "the", "É", "é", "a-b", "x_1", "中", "of"]
    glue = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", " \x0b", "!? "]
    text = lambda: "".join(rnd.choice(words) + rnd.choice(glue) for _ in range(rnd.choice([0, 1, 3, 40])))
    return [(i % 50, rnd.choice([text(), text(), "new york city", None, ""]), rnd.choice(["en", "de", None, "und", ""]), 1, 2, 3) for i in range(n)]


@pytest.mark.parametrize("bits", [8, 12, None])
def test_plain_counting(spark, bits):
    rows = corpus(1)
    want = plain(rows)
    assert want and result(spark, rows, bits=bits) == want


def test_longer_phrases_and_short_lists(spark):
    rows = corpus(2, 120)
    assert result(spark, rows, most=4, least=3, share=80, first=5, salts=3) == plain(rows, 4, 3, 80, 5)
    assert result(spark, rows, least=4, first=None) == plain(rows, 3, 4, 50, 10**9)


def test_edges(spark):
    assert result(spark, []) == []
    assert result(spark, [(1, None, None, 1, 2, 3), (1, "", "en", 1, 2, 3), (1, " \n.", "en", 1, 2, 3)]) == []
    rows = [(1, "a b " * 40_000 + "c", "en", 1, 2, 3), (1, "same same", "de", 1, 2, 3)] + 12 * [(2, "Tied pair. Tied pair", "de", 1, 2, 3)]
    assert result(spark, rows) == plain(rows)


def test_counts_past_64_bits(spark):
    """a a 1000000 passes 2^63 from a = 3,037,000."""
    n = 3_100_000
    rows = [(1, "p q." * n, "en", 1, 2, 3)]
    assert result(spark, rows) == [("en", 1, "p q", n, n, n, 2 * n, 1_000_000)]


def test_runs_that_occur_once_are_not_named(spark, monkeypatch):
    """However many runs a corpus has for the filter's size, few but the frequent ones leave the second pass."""
    left, survivors = spark.sparkContext.accumulator(0), phrases._survivors

    def counting(*how):
        run = survivors(*how)

        def rows(it):
            for batch in run(it):
                left.add(batch.num_rows)
                yield batch

        return rows

    monkeypatch.setattr(phrases, "_survivors", counting)
    rnd = random.Random(3)
    rows = [(i, " ".join(f"{rnd.getrandbits(40):x}" for _ in range(200)) + ". new york", "en", 1, 2, 3) for i in range(150)]
    assert result(spark, rows, bits=8) == plain(rows) == [("en", 1, "new york", 150, 150, 150, 30_300, 1_000_000)]
    assert left.value < 2_000  # of 90,000


@pytest.mark.parametrize("least, text", [(10, 1 << 25), (300, 200)])
def test_tasks_that_hold_little(monkeypatch, least, text):
    """Sketches and numbers that leave a task in many parts, and phrases that are held over several."""
    for name, most in (("HELD", 40), ("NAMED", 64), ("OUT", 30), ("TEXT", text)):
        monkeypatch.setattr(phrases, name, most)
    rows = [("en" if r[2] is None else r[2], r[1]) for r in corpus(5, 600 if least < 100 else 3000)]
    batches = [pa.RecordBatch.from_pylist([{"lang": x, "text": t} for x, t in rows[i : i + 7]], pa.schema([("lang", pa.string()), ("text", pa.string())])) for i in range(0, len(rows), 7)]
    bits, deal = 16, 2
    filter_ = np.zeros((1 << deal, 1 << bits - deal - 3), np.uint8)
    parts = pa.Table.from_batches(phrases._sketched(3, deal, least)(iter(batches)), phrases._SLICE)
    assert parts.num_rows > 8
    for i in set(parts["slice"].to_pylist()):
        for out in phrases._merged(bits - deal, least)((pa.scalar(i),), iter(parts.filter(pa.compute.equal(parts["slice"], i)).to_batches())):
            filter_[i] = np.frombuffer(out["bits"][0].as_py(), np.uint8)
    found, left = Counter(), 0
    for out in phrases._survivors(SimpleNamespace(value=filter_), 3)(iter(batches)):
        for r in out.to_pylist():
            found[r["lang"], r["phrase"].decode()] += r["f"]
        left += 1
    want = Counter()
    for lang, t in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(A_Z)):
            w = re.findall(r"[^\x20\x09]+", piece)
            want[lang, ""] += len(w)
            want.update((lang, " ".join(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    often = {p for p, f in want.items() if f >= least or not p[1]}
    assert left > 2 and often <= found.keys() and len(found) < len(often) + 30
    assert all(found[p] == want[p] for p in found if p in often or " " not in p[1])
