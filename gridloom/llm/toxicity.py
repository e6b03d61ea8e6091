"""Toxicity: a factorization machine over hashed terms, so that pairs of terms count beyond their single weights."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, ODD, give_back, mixed, powers, rows_out, texts, written

#: Lower-case ASCII letters; other ASCII characters but digits become spaces.
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256)], np.uint8)
PARTS = (4, 5, 6, 7)  # bytes of the starts of a word that are terms beside the word, so that compounds of an insult share one
ROWS = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("terms", pa.binary())])
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def hashed(some: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct buckets of each text's terms, ascending."""
    n = np.fromiter(map(len, some), np.int64, len(some))
    starts = np.cumsum(n + 1) - (n + 1)
    data = FOLD[np.frombuffer(b" ".join(some), np.uint8)]
    solid = np.r_[False, data != 32, False]
    a, b = np.flatnonzero(solid[1:-1] & ~solid[:-2]), np.flatnonzero(solid[1:-1] & ~solid[2:]) + 1
    up, down = powers(1 << max(CHUNK.bit_length(), len(data).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    row = (np.searchsorted(starts, a, side="right") - 1).astype(np.uint64) << np.uint64(bits)
    out = []
    for k in (0, *PARTS):
        ok = slice(None) if k == 0 else np.flatnonzero(b - a >= k)
        s = a[ok]
        e = s + k if k else b
        h = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * ODD[7] + np.uint64(k))
        out.append(row[ok] | (h >> np.uint64(64 - bits)))
    u = np.unique(np.concatenate(out))
    return (u >> np.uint64(bits)).astype(np.int64), (u & np.uint64((1 << bits) - 1)).astype(np.int32)


def chunks(some: list[bytes]) -> Iterator[tuple[int, int]]:
    """Bounds of texts that have about CHUNK bytes together, or are one."""
    first, size = 0, 0
    for i, t in enumerate(some):
        if i > first and size + len(t) > CHUNK:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(some):
        yield first, len(some)


class Machine:
    """score = sigmoid(w0 + sum of w[i] x[i] + sum over pairs of v[i] . v[j] x[i] x[j]) over the buckets of a text's terms.

    x[i] is value[i], by the share of documents that have the bucket, over the root of the length of the text's vector of values.
    """

    def __init__(self, value: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.value, self.w0, self.w, self.v = value, w0, w, v

    def inputs(self, at: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        x = self.value[at]
        return x / np.maximum(np.bincount(row, x * x, n), 1e-12)[row] ** 0.25

    def raw(self, at: np.ndarray, row: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores of n rows, and the rows' sums of v x. at: buckets, row: their rows, ascending."""
        s = np.zeros((n, self.v.shape[1]))
        q = np.full(n, self.w0)
        if len(at):
            first = np.flatnonzero(np.diff(row, prepend=-1))
            v = self.v[at] * x[:, None]
            s[row[first]] = np.add.reduceat(v, first)
            q[row[first]] += np.add.reduceat(self.w[at] * x - 0.5 * (v * v).sum(axis=1), first)
        return q + 0.5 * (s * s).sum(axis=1), s

    def apart(self, at: np.ndarray) -> float:
        """The raw score of one row that the fit may not have seen."""
        at = at[self.value[at] > 0]
        row = np.zeros(len(at), np.int64)
        return float(self.raw(at, row, self.inputs(at, row, 1), 1)[0][0])

    def fit(self, rows: Sequence[np.ndarray], y: np.ndarray, epochs: int, rate: float, shrink: float, seed: int) -> None:
        """Minibatch AdaGrad on the logistic loss; after each step the weights it has touched shrink towards 0 by `shrink` times their step."""
        rng, m = np.random.default_rng(seed), len(self.w)
        n0, n = 1e-8, np.full((m, 1 + self.v.shape[1]), 1e-5)
        size = int(np.clip(len(rows) // 64, 16, 256))
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for a in range(0, len(rows), size):
                part = order[a : a + size]
                some = [rows[i] for i in part.tolist()]
                row = np.repeat(np.arange(len(part)), [len(r) for r in some])
                at = np.concatenate(some)
                x = self.inputs(at, row, len(part))
                raw, s = self.raw(at, row, x, len(part))
                err = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - y[part]) / len(part)
                e = err[row] * x
                some, back = np.unique(at, return_inverse=True)
                own = np.bincount(back, e * x, len(some))
                for f in range(-1, self.v.shape[1]):
                    old = self.w[some] if f < 0 else self.v[some, f]
                    g = np.bincount(back, e, len(some)) if f < 0 else np.bincount(back, e * s[row, f], len(some)) - own * old
                    n[some, f + 1] += g * g
                    step = rate / np.sqrt(n[some, f + 1])
                    new = old - step * g
                    new = np.sign(new) * np.maximum(np.abs(new) - step * shrink, 0)
                    if f < 0:
                        self.w[some] = new
                    else:
                        self.v[some, f] = new
                d0 = err.sum()
                n0 += d0 * d0
                self.w0 -= rate * d0 / n0**0.5


VISITS = 120_000  # of rows by the last fit, and by the fits that calibrate it, as far as one of each needs no more
FOLDS, LEAST_EPOCHS, MOST_EPOCHS = 5, 6, 100


def calibrated(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) with which 1 / (1 + exp(-(a raw + b))) is likeliest for labels that raw was not learned from, drawn towards (1, 0); a is above 0.

    Targets are smoothed by the numbers of both labels, so scores that part them keep a finite slope.
    """
    n1 = y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    x, pull, loss = np.array([1.0, 0.0]), np.array([1.0, 0.1]), lambda x: np.logaddexp(0, z := np.clip(x[0] * raw + x[1], -500, 500)).sum() - (t * z).sum() + 0.5 * (pull * (x - (1, 0)) ** 2).sum()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x[0] * raw + x[1], -40, 40)))
        w, g = p * (1 - p), np.array([((p - t) * raw).sum(), (p - t).sum()]) + pull * (x - (1, 0))
        step = np.linalg.solve(np.array([[(w * raw * raw).sum(), (w * raw).sum()], [(w * raw).sum(), w.sum()]]) + np.diag(pull), g)
        while np.abs(step).max() > 1e-9 and loss(x - step) > loss(x):
            step = step / 2
        x = x - step
        if np.abs(step).max() < 1e-7:
            break
    return float(np.clip(x[0], 0.05, 50)), float(x[1])


class Some(Sequence):
    """The rows at some places, without a copy."""

    def __init__(self, rows: Sequence, at: list[int]):
        self.rows, self.at = rows, at

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.rows[self.at[i]]


def trained(rows: Sequence[np.ndarray], y: np.ndarray, bits: int, rank: int, rate: float, shrink: float, half: float, seed: int) -> Machine:
    """A machine of the rows (buckets, ascending) and labels, of both kinds, whose scores are calibrated by parts of the rows that were left out of fits of their own.

    A fit goes over its rows 6 to 100 times, about VISITS rows in all. One to FOLDS parts of a fifth of the rows are left out in turn, as far as
    VISITS goes; their raw scores give the slope and shift that the last fit, of all rows, is scaled by.
    """
    epochs = int(np.clip(VISITS // len(rows), LEAST_EPOCHS, MOST_EPOCHS))
    part = np.random.default_rng(seed).permutation(len(rows)) % FOLDS

    def one(keep: np.ndarray) -> Machine:
        some, own = Some(rows, np.flatnonzero(keep).tolist()), y[keep]
        n = np.zeros(1 << bits)
        for at in some:
            n[at] += 1
        value = np.log((len(own) + 1) / (n + 1)) * n / (n + half)
        base = (own.sum() + 0.5) / (len(own) + 1)
        m = Machine(value, float(np.log(base / (1 - base))), np.zeros(1 << bits), np.random.default_rng(seed).normal(0, 0.05, (1 << bits, rank)))
        m.fit(some, own, epochs, rate, shrink, seed)
        m.v[n == 0] = 0
        return m

    raw, own = [], []
    for k in range(int(np.clip(VISITS // (len(rows) * epochs), 1, FOLDS))):
        left = part == k
        if left.any() and not left.all():
            m = one(~left)
            raw += [m.apart(r) for r in Some(rows, np.flatnonzero(left).tolist())]
            own.append(y[left])
    m = one(np.ones(len(rows), bool))
    a, b = calibrated(np.array(raw), np.concatenate(own)) if raw else (1.0, 0.0)
    m.w0, m.w, m.v = a * m.w0 + b, a * m.w, a**0.5 * m.v
    return m


def packed(at: np.ndarray) -> bytes:
    """Ascending buckets as their compressed steps, under half of what they take."""
    return zlib.compress(np.diff(at, prepend=np.int32(0)).astype("<i4").tobytes(), 1)


class Packed(Sequence):
    """Rows of buckets that stay packed until one is asked for."""

    def __init__(self, rows: list[bytes]):
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> np.ndarray:
        return np.cumsum(np.frombuffer(zlib.decompress(self.rows[i]), "<i4"), dtype=np.int32)


def received(got: pa.Table) -> tuple[np.ndarray, Packed]:
    """(labels, buckets) of the rows (doc_id, label, terms) in order of all three, as rows come in any."""
    rows = sorted(zip(*(got[c].to_pylist() for c in ("doc_id", "label", "terms")), strict=True))
    return (np.array([r[1] for r in rows], np.int64) > 0).astype(float), Packed([r[2] for r in rows])


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, bits: int = 18, most_rows: int = 20_000, rank: int = 4, rate: float = 0.1, shrink: float = 1e-3, half: float = 20.0, seed: int = 7) -> Machine:
    """Learn labels.toxic from at most `most_rows` labelled documents, those with the least hash of doc_id and text, that are not held out.

    Of several labels of a doc_id the largest counts; null labels and ids are not learned from, nor are repeated rows of one doc_id and text.
    `most_rows` bounds the rows that reach the driver, with their terms packed. All terms of these rows, hashed to 2^bits buckets, have a weight and a vector;
    none is chosen by its label, and scores are calibrated within these rows (trained()). A bucket's value is the log of the inverse share of documents that have it, times n / (n + half) for n
    documents, so that what few documents have weighs little. Without labels every score is 0; with one label alone, that label's.
    """
    some = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("label"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    known = rows.select("doc_id", "key").join(some, "doc_id").distinct().orderBy(F.xxhash64("doc_id", "key"), "doc_id", "key").limit(most_rows)
    known = written(known)
    known = written(rows.join(F.broadcast(known), ["doc_id", "key"]).select("doc_id", "key", "label", "text").dropDuplicates(["doc_id", "key"]).select("doc_id", "label", "text"))

    def hash_terms(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            some = texts(batch)
            for a, b in chunks(some):
                row, at = hashed(some[a:b], bits)
                ends = np.searchsorted(row, np.arange(b - a + 1)).tolist()
                yield rows_out(ROWS, [batch.column("doc_id").slice(a, b - a), batch.column("label").slice(a, b - a), [packed(at[i:j]) for i, j in zip(ends, ends[1:], strict=False)]])

    y, sent = received(known.mapInArrow(hash_terms, "doc_id long, label int, terms binary").toArrow())
    give_back()
    if not len(y) or y.min() == y.max():
        return Machine(np.zeros(1 << bits), 40.0 if len(y) and y[0] else -40.0, np.zeros(1 << bits), np.zeros((1 << bits, rank)))
    m = trained(sent, y, bits, rank, rate, shrink, half, seed)
    m.value, m.w, m.v = (z.astype(np.float32) for z in (m.value, m.w, m.v))
    del y, sent
    give_back()  # the driver goes on with other steps
    return m


def judge(machine: Machine, some: list[bytes]) -> np.ndarray:
    """The scores of texts."""
    bits, out = len(machine.w).bit_length() - 1, [np.zeros(0)]
    for a, b in chunks(some):
        row, at = hashed(some[a:b], bits)
        seen = machine.value[at] > 0
        row, at = row[seen], at[seen]
        raw, _ = machine.raw(at, row, machine.inputs(at, row, b - a), b - a)
        out.append(1 / (1 + np.exp(-np.clip(raw, -40, 40))))
    return np.concatenate(out)


def score(docs: DataFrame, machine: Machine, held_out: Column, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of (doc_id, text), judged by its whole text; null is as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            s = judge(sent.value, texts(batch))
            yield rows_out(SCORES, [batch.column("doc_id"), batch.column("held_out"), s, (s >= threshold).astype(np.int32)])
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text", held_out.alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores under the threshold; rows of null or empty text are judged as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield batch.filter(pa.array(judge(sent.value, texts(batch)) < threshold))
        give_back()

    return docs.mapInArrow(run, docs.schema)
