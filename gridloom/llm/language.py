"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rows_out

ORDERS = (1, 2, 3)
PIECE = 1 << 19  # characters that are hashed at once
COUNTS = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
_A = np.array([2654435761, 2246822519, 3266489917], np.uint32)


def pieces(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Rows, code points and the row's place of each point, in runs of about PIECE characters.

    A text over PIECE characters is cut; a cut repeats the characters that n-grams across it need, marked -1.
    """
    reach = max(ORDERS) - 1
    rows: list[int] = []
    points: list[np.ndarray] = []
    own: list[np.ndarray] = []
    size = 0
    for i, text in enumerate(texts):
        p = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
        for a in range(0, max(len(p), 1), PIECE):
            part = p[a : a + PIECE + reach]
            mine = np.full(len(part) + reach, -1, np.int32)
            mine[: min(len(part), PIECE)] = len(rows)
            rows.append(i)
            points.append(np.concatenate([part, np.zeros(reach, np.uint32)]))
            own.append(mine)
            size += len(mine)
            if size >= PIECE:
                yield rows, np.concatenate(points), np.concatenate(own)
                rows, points, own, size = [], [], [], 0
    if rows:
        yield rows, np.concatenate(points), np.concatenate(own)


def hashed(points: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the starts of its n-grams and their buckets; none holds the zero that ends a text."""
    n = len(points)
    for k in ORDERS:
        if n < k:
            continue
        h = np.full(n - k + 1, k * 0x9E3779B9 & 0xFFFFFFFF, np.uint32)
        ok = np.ones(n - k + 1, bool)
        for j in range(k):
            part = points[j : n - k + 1 + j]
            h = (h ^ part) * _A[j]
            h ^= h >> np.uint32(15)
            ok &= part != 0
        at = np.flatnonzero(ok)
        yield at, (h[at] * np.uint32(2654435761)) >> np.uint32(32 - bits)


def count_ngrams(bits: int):
    """(lang, text) batches to the counts of the task's n-grams, a row for each language and bucket that occurs."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in it:
            langs, all_texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in set(langs):
                sums = total.setdefault(lang, np.zeros(1 << bits, np.int64))
                for _, points, own in pieces([t for t, x in zip(all_texts, langs, strict=True) if x == lang]):
                    for at, b in hashed(points, bits):
                        sums += np.bincount(b[own[at] >= 0], minlength=1 << bits)
        for lang, sums in total.items():
            at = np.flatnonzero(sums)
            yield rows_out(COUNTS, [pa.array([lang] * len(at), pa.string()), at.astype(np.int32), sums[at]])

    return run


def fit(docs: DataFrame, bits: int = 16, smoothing: float = 0.1, most_mb: int = 256) -> tuple[list[str], np.ndarray, np.ndarray, int]:
    """Languages, log priors and the log-probability matrix (language, bucket), from all rows of (text, lang) with a language.

    The matrix has one row for each language, and as many buckets whatever the number of languages; ValueError if it would
    take more than `most_mb` MB, 512 languages with these parameters, as it is broadcast.
    """
    docs = docs.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    sums = docs.mapInArrow(count_ngrams(bits), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    priors = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    langs = sorted(priors)
    if len(langs) << bits > most_mb << 17:
        raise ValueError(f"the matrix of {len(langs)} languages takes more than {most_mb} MB")
    place = {x: i for i, x in enumerate(langs)}
    m = np.full((max(len(langs), 1), 1 << bits), smoothing)
    got = sums.toPandas()
    m[got["lang"].map(place).to_numpy(int), got["bucket"].to_numpy(int)] += got["n"].to_numpy(float)
    m = np.log(m / m.sum(axis=1, keepdims=True))
    prior = np.log(np.array([priors[x] for x in langs], float) / sum(priors.values())) if langs else np.zeros(1)
    return langs, prior, m, bits


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def predict(docs: DataFrame, model: tuple, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the posterior of that language) of every row of (doc_id, text).

    Texts that are null or without a letter are `und` with score 0, as is every text if no language was learned. Of
    languages that score the same, the first by name is taken. Rows are judged one by one, so repeated rows agree.
    """
    langs, prior, matrix, bits = model
    sent = docs.sparkSession.sparkContext.broadcast(matrix)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in it:
            if not batch.num_rows:
                continue
            all_texts = batch.column("text").to_pylist()
            like = np.zeros((batch.num_rows, len(m)))
            for rows, points, own in pieces(all_texts):
                for at, b in hashed(points, bits):
                    of = own[at]
                    at, b = of[of >= 0], b[of >= 0]
                    first = np.flatnonzero(np.diff(at, prepend=-1))
                    if len(first):
                        for j in range(len(m)):
                            np.add.at(like[:, j], np.array(rows)[at[first]], np.add.reduceat(m[j][b], first))
            like += prior
            best = like.argmax(axis=1)
            score = 1 / np.exp(like - like.max(axis=1, keepdims=True)).sum(axis=1)
            known = [bool(langs) and has_letter(t) for t in all_texts]
            yield rows_out(SCORES, [batch.column("doc_id"), batch.column("held_out"), [langs[x] if k else "und" for x, k in zip(best, known, strict=True)], np.where(known, score, 0.0)])

    return docs.select(F.col("doc_id").cast("long"), "text", held_out.alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, held_out: Column, **params) -> DataFrame:
    """Learn from the rows of (doc_id, text, lang) that are not held out, and predict every row's language."""
    return predict(docs, fit(docs.where(~held_out), **params), held_out)
