"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ODD, WORD, mixed, rows_out, shingles, word_chunks, words_of

K = 5
BITS, BLOCKS = 64, 4
LAGS = 4
HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("hamming", pa.int32()), ("similarity", pa.float64())])
MAYBE_BITS = 20
AT_ONCE = 1 << 16  # windows whose sums are held at once
PRINTS = 1 << 12  # windows whose sums are compared at once, in a core's cache


def bit_signs(h: np.ndarray) -> np.ndarray:
    """(len(h), 64) of +1 and -1 by the hashes' bits."""
    return (np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.int8) << 1) - 1


def once(h: np.ndarray, into: np.ndarray) -> np.ndarray:
    """bit_signs() without (0) those of a shingle that is one of the LAGS before it in its text, so that a run of one word counts once.

    into: how many words of its text are before each shingle.
    """
    again, into = np.zeros(len(h), bool), into[: len(h)]
    for lag in range(1, min(LAGS + 1, len(h))):
        again[lag:] |= (h[lag:] == h[:-lag]) & (into[lag:] >= lag)
    signs = bit_signs(h)
    signs[again] = 0
    return signs


def running(signs: np.ndarray, dtype: type = np.int32) -> np.ndarray:
    """(len(signs) + 1, 64) of the sums of the signs before each place, modulo the type: differences that fit it are exact."""
    out = np.zeros((len(signs) + 1, BITS), dtype)
    out[1:] = signs
    step = 1
    while step < len(out):
        out[step:] += out[:-step].copy()
        step *= 2
    return out


def packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits((sums > 0).ravel(), bitorder="little").view("<u8")


def word_runs(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words, at most K, as shingles() has it for a text of these words alone."""
    n = len(words) - k + 1
    if n < 1:
        return words[:0]
    return shingles(words, K) if k == K else mixed(sum(words[j : j + n] * ODD[j] for j in range(k)) + np.uint64(k))


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the lesser counts over sum of the greater counts of two multisets."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    least = np.minimum(n[i], m[j]).sum()
    return float(least / (len(a) + len(b) - least))


class Items:
    """The fingerprints of some items by their number of words, with an index of their blocks.

    For a radius r and B blocks of a fingerprint, any two fingerprints within r agree within r // B in some block. An index
    is of eight items: [b][v] has the bit of each whose block b is within r // B of v, so the union over the blocks of
    a window's fingerprint holds every item within r. Candidates over `far` bits from the window are not verified.
    """

    def __init__(self, rows: list[tuple[int, bytes]], radius: int, far: int):
        self.radius, self.far, self.sizes = radius, far, {}
        for item_id, text in sorted(rows):
            words = words_of(text)
            if len(words):
                self.sizes.setdefault(len(words), []).append((item_id, word_runs(words, min(len(words), K))))
        self.prints = {size: np.concatenate([packed(once(s, np.arange(len(s))).sum(axis=0, dtype=np.int64)) for _, s in items]) for size, items in self.sizes.items()}
        self.maybe = np.zeros(1 << MAYBE_BITS, bool)
        for items in self.sizes.values():
            for _, s in items:
                self.maybe[self._low(s)] = True

    @staticmethod
    def _low(h: np.ndarray) -> np.ndarray:
        return (h & np.uint64((1 << MAYBE_BITS) - 1)).astype(np.int64)

    @functools.cached_property
    def index(self) -> dict[int, list[np.ndarray]]:
        """(BLOCKS, 65536) bytes for each eight items of a size. Made by each worker, as it is larger than what it is made of."""
        values = np.arange(1 << 16, dtype=np.uint16)
        flips = self.radius // BLOCKS
        out: dict[int, list[np.ndarray]] = {}
        for size, prints in self.prints.items():
            blocks = prints.view("<u2").reshape(-1, BLOCKS).T
            out[size] = [np.packbits(np.bitwise_count(values[None, :, None] ^ blocks[:, None, i : i + 8]) <= flips, axis=2, bitorder="little")[:, :, 0] for i in range(0, len(prints), 8)]
        return out

    def near(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs (place in prints, place among the items of a size, bits apart) that the index gives and that are within `far`."""
        blocks = prints.view("<u2").reshape(-1, BLOCKS)
        pairs = []
        for i, near in enumerate(self.index[size]):
            maybe = near[0].take(blocks[:, 0])
            for b in range(1, BLOCKS):
                maybe |= near[b].take(blocks[:, b])
            at = np.flatnonzero(maybe.view(bool))
            apart = np.bitwise_count(prints[at] ^ self.prints[size][8 * i : 8 * i + 8, None])
            item, win = np.nonzero(apart <= self.far)
            met = maybe[at[win]] >> item.astype(np.uint8) & 1 > 0
            pairs.append((at[win[met]], item[met] + 8 * i, apart[item[met], win[met]]))
        return pairs[0] if len(pairs) == 1 else tuple(np.concatenate(x) for x in zip(*pairs, strict=True))

    def search(self, words: np.ndarray, first: np.ndarray, least: float) -> Iterator[tuple]:
        """(text, item_id, start, length, Hamming distance, similarity) of the best window of each item in each text that is similar enough.

        words: of the texts one after the other; first: each text's first. A text shorter than an item is one window.
        """
        ends = np.r_[first[1:], len(words)].astype(np.int64)
        lengths = ends - first
        text = np.repeat(np.arange(len(first)), lengths)
        into, room = np.arange(len(words)) - first[text], ends[text] - np.arange(len(words))
        best: dict[tuple, tuple] = {}  # by text, size and the item's place

        def verify(h: np.ndarray, known: np.ndarray, at: np.ndarray, n: np.ndarray, item: np.ndarray, apart: np.ndarray, size: int) -> None:
            """Compares the n shingles at places of h with items of a size exactly."""
            items = self.sizes[size]
            # no more shingles are common than are in any item; similarity is common / (n + width - common)
            common = known[at + n] - known[at]
            ok = common * (1 + least) >= least * (n + len(items[0][1])) - 1e-6
            for a, m, i, d in zip(at[ok].tolist(), n[ok].tolist(), item[ok].tolist(), apart[ok].tolist(), strict=True):
                item_id, s = items[i]
                found = (weighted_similarity(h[a : a + m], s), -d, -int(into[a]))
                key = int(text[a]), size, i
                if found[0] >= least and (key not in best or found > best[key][0]):
                    best[key] = found, item_id

        for k in sorted({min(size, K) for size in self.sizes}):
            sizes = [size for size in self.sizes if min(size, K) == k]
            h = word_runs(words, k)
            if not len(h):
                continue
            known = np.r_[0, np.cumsum(self.maybe[self._low(h)])]
            widest = max(sizes) - k + 1
            dtype = np.int8 if widest < 1 << 7 else np.int16 if widest < 1 << 15 else np.int32
            for a in range(0, len(h), AT_ONCE):
                part = slice(a, a + AT_ONCE + widest - 1)
                sums = running(once(h[part], into[part]), dtype)
                for size in sizes:
                    width = size - k + 1
                    m = min(AT_ONCE, len(sums) - width)
                    if m > 0:
                        prints = [packed(sums[i + width : min(i + PRINTS, m) + width] - sums[i : min(i + PRINTS, m)]) for i in range(0, m, PRINTS)]
                        win, item, apart = self.near(np.concatenate(prints), size)
                        whole = room[a + win] >= size
                        verify(h, known, a + win[whole], np.full(whole.sum(), width), item[whole], apart[whole], size)
            short = np.flatnonzero((lengths >= K) & (lengths < max(sizes))) if k == K else first[:0]
            if len(short):
                n = lengths[short] - K + 1
                before = np.cumsum(n) - n
                place = np.repeat(first[short] - before, n) + np.arange(n.sum())
                prints = packed(np.add.reduceat(once(h[place], into[place]), before, axis=0, dtype=np.int32))
                for size in sizes:
                    ok = (lengths[short] < size) & (n >= least * (size - K + 1) - 1e-6)
                    if ok.any():
                        win, item, apart = self.near(prints[ok], size)
                        verify(h, known, first[short[ok][win]], n[ok][win], item, apart, size)
        for (t, size, _), ((sim, d, a), item_id) in best.items():
            yield t, item_id, -a, min(size, int(lengths[t])), -d, sim


def clean(docs: DataFrame, items: DataFrame, least: float = 0.8, radius: int = 15, far: int = 23, most_mb: int = 64) -> DataFrame:
    """The rows of docs, with all their columns, in whose text no item is found as by contaminated()."""
    for block in item_blocks(items, most_mb):
        sent = docs.sparkSession.sparkContext.broadcast(Items(block, radius, far))

        def run(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            found = sent.value
            for batch in it:
                keep = np.ones(batch.num_rows, bool)
                for i, _, words, first in word_chunks(batch):
                    keep[[i + x[0] for x in found.search(words, first, least)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def item_blocks(items: DataFrame, most_mb: int) -> Iterator[list]:
    """The items (item_id, text) in blocks of at most `most_mb` MB of index and text each, as many as that takes, those of a size together."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    rows = rows.withColumn("n_words", F.regexp_count("text", F.lit(WORD))).withColumn("text", F.col("text").cast("binary")).where("n_words > 0")
    block, cost, of_size = [], 0, Counter()
    for r in rows.orderBy("n_words", "item_id").toLocalIterator():
        more = len(r["text"]) + (BLOCKS << 16 if of_size[r["n_words"]] % 8 == 0 else 0)
        if block and cost + more > most_mb << 20:
            yield block
            block, cost, of_size = [], 0, Counter()
            more = len(r["text"]) + (BLOCKS << 16)
        block.append((r["item_id"], bytes(r["text"])))
        cost += more
        of_size[r["n_words"]] += 1
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, least: float = 0.8, radius: int = 15, far: int = 23, most_mb: int = 64) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, hamming, similarity) of the best window of each item in each row of (doc_id, text).

    Words are lower-cased (A-Z) runs of non-space; features are shingles of five words, weighted by their count. A document's
    windows have as many words as the item, or are the whole of a shorter document. Every window of each size that items
    have gets a SimHash, in which a shingle counts once of a run of short period. All windows within `radius` bits
    of the item are candidates by the blocks' index, and most of those within `far`, beyond which none is taken; the exact
    weighted Jaccard similarity, `least` or more, decides. At 0.8 two fingerprints are expected to differ in
    under 10 of 64 bits, and in over 15 for one pair in forty, of which the index gives most: README has the measured
    recall. Items and texts that are null or without words match nothing; of equal windows the nearest and then the
    first counts. Repeated rows and repeated items give repeated matches. Items are broadcast in blocks whose index
    takes at most `most_mb` MB, a pass over the documents each; texts are judged whole, with no shuffle. A task holds 64 to 256
    bytes a word of the widest item beside its batch.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, start_word long, n_words long, hamming int, similarity double"
    out = None
    for block in item_blocks(items, most_mb):
        sent = spark.sparkContext.broadcast(Items(block, radius, far))

        def run(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            found = sent.value
            for batch in it:
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[i + t], *x) for i, _, words, first in word_chunks(batch) for t, *x in found.search(words, first, least)]
                if rows:
                    yield rows_out(HITS, list(zip(*rows, strict=True)))

        part = docs.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out
