"""Quality rules by host: failures of text rules are summed by host, shrunk with an empirical beta prior, joined back."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, texts, written

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
RULES = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))])


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    hit = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    inside = np.zeros(len(words), bool)
    for j in range(3):
        inside[j : j + len(hit)] |= hit
    return int(inside.sum())


def measures(b: bytes) -> tuple[int, int, int, int, int]:
    words = b.split()
    lines = [x for x in b.split(b"\n") if x.strip()]
    bare = b.translate(None, SPACES)
    points = len(bare) if bare.isascii() else len(bare.decode())
    return len(words), points, len(b) - len(b.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def _rules(batch: pa.RecordBatch) -> list:
    cols = list(zip(*map(measures, texts(batch)), strict=True))
    return [batch.column("doc_id"), batch.column("host"), *cols]


def rule_measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row of counts per document (columns doc_id, text and `host`). A null text has no words."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text"), F.col(host).cast("string").alias("host")).mapInArrow(batches(_rules, RULES), "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")


def host_rules(docs: DataFrame, host: str = "source", max_rate: float = 0.5, salts: int = 16) -> DataFrame:
    """Counts, rule failures and the verdict of each document and its host.

    A document fails if it has under 50 words, if over half of its words are in repeated 3-word windows, if it has
    more symbols than words, or if over half as many lines as it has words in tens repeat. A host's failure rate is
    shrunk to (failed + a) / (documents + a + b); a and b fit a beta prior to all hosts' rates by their mean and
    variance. Documents of hosts whose shrunk rate is above `max_rate` are not kept. A document without a host is
    judged by its own rules alone. Repeated rows count as often as they occur; an empty table gives no rows.
    Only (host, counts) rows are shuffled; the hosts are dealt in `salts` copies, so one host may hold any share.
    """
    n = F.col("n_words")
    base = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    failed = base | (F.col("n_symbols") > n) | (20 * F.col("n_dup_lines") > n)
    rules = written(rule_measures(docs, host).withColumns({"base_failed": base, "rule_failed": failed}))
    hosts = rules.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(F.col("rule_failed").cast("long")).alias("host_failed"))
    hosts = written(hosts)
    rate = F.col("host_failed") / F.col("host_docs")
    m = hosts.agg(F.sum("host_docs").alias("n"), F.sum("host_failed").alias("f"), F.avg(rate).alias("mean"), F.var_pop(rate).alias("var"), F.avg(1 / F.col("host_docs")).alias("inv")).first()
    a, b = beta_prior(m["mean"], m["var"], m["inv"])
    hosts = hosts.withColumn("host_rate", (F.col("host_failed") + F.lit(a)) / (F.col("host_docs") + F.lit(a + b)))
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    left = rules.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(salts)).cast("int"))
    out = left.join(hosts.withColumn("salt", salt), ["host", "salt"], "left")
    return out.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule_failed", F.round("host_rate", 6).alias("host_rate"), (~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= max_rate)).alias("kept"))


def beta_prior(mean: float | None, var: float | None, inv: float | None) -> tuple[float, float]:
    """(a, b) of the beta distribution with the hosts' mean rate and their variance beyond that of sampling; (1, 1) without hosts or spread."""
    if mean is None or not 0 < mean < 1:
        return 1.0, 1.0
    spread = mean * (1 - mean)
    between = min(max((var or 0.0) - spread * inv, spread / 200), spread / 1.5)
    size = spread / between - 1
    return mean * size, (1 - mean) * size
