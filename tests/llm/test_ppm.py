"""Scores against a plain model: one trie, walked byte by byte."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.llm import ppm
from gridloom.llm.common import fold
from gridloom.llm.queries import op1_ppm_scores


class Plain:
    def __init__(self, texts):
        self.words, self.next = Counter(), defaultdict(Counter)
        for t in texts:
            self.words.update(t.lower().split())
            self.words[b" "] += 1
            s = bytes(ppm.ORDER) + t.lower().replace(b"\0", b"\1") + b"\0"
            for i in range(ppm.ORDER, len(s)):
                for k in range(ppm.ORDER + 1):
                    self.next[s[i - k : i]][s[i]] += 1

    def base(self, text):
        tokens = [*text.lower().split(), b" "]
        n, v = sum(self.words.values()), len(self.words)
        return len(tokens), sum(t in self.words for t in tokens), n, sum(math.log10((self.words[t] + 1) / (n + v + 1)) for t in tokens)

    def score(self, text):
        s = bytes(ppm.ORDER) + text.lower().replace(b"\0", b"\1") + b"\0"
        total = 0.0
        for i in range(ppm.ORDER, len(s)):
            out = set()
            for k in range(ppm.ORDER, -1, -1):
                seen = {x: n for x, n in self.next.get(s[i - k : i], {}).items() if x not in out}
                if not seen:
                    continue
                t, d = sum(seen.values()), len(seen)
                if s[i] in seen:
                    total += math.log10(seen[s[i]] / (t + d))
                    break
                total += math.log10(d / (t + d))
                out |= set(seen)
            else:
                total -= math.log10(256 - len(out))
        return total


def check(rows, got):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    model = Plain([(t or "").encode() for d, t in rows if not held(d)])
    want = sorted(((d, held(d), *model.base((t or "").encode()), model.score((t or "").encode())) for d, t in rows), key=str)
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_against_a_plain_model(spark):
    rows = [(i, f"The cat {i % 5} sat on THE mat {'é' * (i % 3)}\n{chr(97 + i % 26) * (i % 4)}") for i in range(60)] + [(70, None), (71, ""), (72, " \t"), (73, "a\0b"), (74, "same"), (74, "same"), (None, "no id")]
    check(rows, ppm.model_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), fold(F.col("doc_id"), 7, 2)).collect())


def test_long_texts_and_more_columns(spark, tmp_path):
    rows = [(i, f"word{i % 7} " * (12_000 if i == 3 else 5), i) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, blk long").coalesce(2).write.parquet(f"{tmp_path}/d")
    check([r[:2] for r in rows], ppm.model_scores(spark.read.parquet(f"{tmp_path}/d"), fold(F.col("doc_id"), 7, 2)).collect())


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ppm.model_scores(none, fold(F.col("doc_id"), 7, 2)).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = ppm.model_scores(spark.createDataFrame([(held, "ab")], "doc_id long, text string"), fold(F.col("doc_id"), 7, 2)).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (2, 0, 0, 0.0) and r["score"] == pytest.approx(-3 * math.log10(256))


def test_query_on_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, op1_ppm_scores(spark, sf).collect())
