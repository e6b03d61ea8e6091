"""Phrases by collocation: a merged count-min sketch says which word runs may be frequent, these are counted exactly, scored and subsumed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK, _LOWER, ODD, attached, give_back, lent, let_go, mixed, powers, rows_out, written

CUTS = b".,;:!?\n\v\f\r"  # between pieces
LEAST_BITS, MOST_BITS = 16, 29  # of the filter that a sketch gives
LEAST_DEAL, DEEP = 6, 24  # a sketch is merged in 2^6 slices or more, each of 2^24 counters, for as many bytes of text
HELD = 1 << 22  # runs that a task adds up before they leave
NAMED = 5 << 19  # the same of those that are counted exactly; three quarters of that many phrases leave
TEXT = 1 << 25  # bytes of words that a task holds for that
OUT = 1 << 20  # bytes of phrases in a batch, or one phrase
_BLANK, _CUT = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[9, 32]] = True
_CUT[list(CUTS)] = True
_SLICE = pa.schema([("slice", pa.int32()), ("counters", pa.binary())])
_FILTER = pa.schema([("slice", pa.int32()), ("bits", pa.binary())])
_FOUND = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("f", pa.int64())])


class Words:
    """The words of some texts of a batch, with A-Z in lower case: hashes, places, and for each the piece that it lies in."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, langs: np.ndarray):
        self.low = low = _LOWER[data]
        cut = _CUT[low]
        solid = np.r_[False, ~(_BLANK[low] | cut), False]
        first, last = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
        edge = starts[(starts > 0) & (starts < len(low))]
        first[edge] |= solid[edge + 1]
        last[edge - 1] |= solid[edge]
        self.a, self.b = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = powers(1 << max(CHUNK.bit_length(), len(low).bit_length()))
        sums = np.zeros(len(low) + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], out=sums[1:])
        self.text = np.searchsorted(starts, self.a, "right") - 1
        self.hash = mixed((sums[self.b] - sums[self.a]) * down[self.a] + (self.b - self.a).astype(np.uint64) * ODD[7])
        self.lang = langs[self.text]
        self.solid = solid[1:-1]
        self.piece = np.cumsum(cut)[self.a] + self.text * (len(low) + 1) if len(self.a) else self.a

    def runs(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1 to `most` words: the first word of each run of so many within a piece, and the run's hash together with its language."""
        h = self.lang.copy()
        at = np.arange(len(self.hash))
        for k in range(1, most + 1):
            at = at[at + k <= len(self.hash)]
            at = at[self.piece[at] == self.piece[at + k - 1]]
            h[at] = h[at] * ODD[0] + self.hash[at + k - 1] * ODD[k % len(ODD)]
            yield at, mixed(h[at] + np.uint64(k))

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all words with one space after each, and where each word begins and ends in them."""
        size = self.b - self.a
        stop = np.cumsum(size + 1) - 1
        out = np.full(int((size + 1).sum()), 32, np.uint8)
        out[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = self.low[self.solid]
        return out, stop - size, stop


def _lang_hash(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[list[str], Words]]:
    """The words of a batch (lang, text), some texts at a time, with the languages of these texts."""
    col = batch.column("text").cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    langs = batch.column("lang").to_pylist()
    known = {x: _lang_hash(x) for x in set(langs)}
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1)
        yield langs[i:j], Words(data[at[i] : at[j]], at[i:j] - at[i], np.array([known[x] for x in langs[i:j]], np.uint64))
        i = j


def _number(least: int) -> type:
    """Of numbers that stop at `least`."""
    return np.uint8 if least < 1 << 8 else np.uint32


def _packed(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Places in order, none twice, and their numbers: the steps between places byte by byte, first bytes first, so that they compress."""
    return np.diff(places, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes() + counts.tobytes()


def _unpacked(x: bytes, number: type) -> tuple[np.ndarray, np.ndarray]:
    n = len(x) // (4 + np.dtype(number).itemsize)
    steps = np.ascontiguousarray(np.frombuffer(x, np.uint8, 4 * n).reshape(4, n).T).view(np.uint32).ravel()
    return np.cumsum(steps, dtype=np.uint32), np.frombuffer(x, number, n, 4 * n)


def _summed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each of the keys in order, and how often it is there."""
    first = np.flatnonzero(np.r_[len(keys) > 0, keys[1:] != keys[:-1]])
    return first, np.diff(np.r_[first, len(keys)])


def _sketched(most: int, deal: int, least: int):
    """A task's sketch of all its runs: the counters that are not 0, in slices; they stop at `least`, as more needs not be known."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, pack = [], 0, zstandard.ZstdCompressor(level=1)

        def leave() -> Iterator[pa.RecordBatch]:
            places = np.concatenate(held)
            held.clear()
            places.sort()
            first, counts = _summed(places)
            places, counts = places[first], np.minimum(counts, least).astype(_number(least))
            edges = np.searchsorted(places, np.arange((1 << deal) + 1, dtype=np.uint64) << np.uint64(DEEP))
            places = (places & np.uint64((1 << DEEP) - 1)).astype(np.uint32)
            for i in np.flatnonzero(np.diff(edges)).tolist():
                own = slice(edges[i], edges[i + 1])
                yield rows_out(_SLICE, [[i], [pack.compress(_packed(places[own], counts[own]))]])

        for batch in it:
            for _, words in chunks(batch):
                for _, h in words.runs(most):
                    held.append(h >> np.uint64(64 - DEEP - deal))
                    n += len(h)
                if n >= HELD:
                    yield from leave()
                    n = 0
        if n:
            yield from leave()
        give_back()

    return run


def slots(places: np.ndarray, each: int) -> list[np.ndarray]:
    """A counter's two bits among the 2^each of its slice, from its place there."""
    return [(p >> np.uint32(s - each)).astype(np.int64) for p, s in ((places, DEEP), (places * np.uint32(0x9E3779B1), 32))]


def _merged(each: int, least: int):
    def run(key: tuple[pa.Scalar, ...], it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, parts = zstandard.ZstdDecompressor(), []
        for batch in it:
            for x in batch.column("counters"):
                places, counts = _unpacked(unpack.decompress(x.as_py()), _number(least))
                parts.append(places.astype(np.uint64) << np.uint64(32) | counts.astype(np.uint64))
        counters = np.concatenate(parts)
        parts.clear()
        counters.sort()
        first, _ = _summed(counters >> np.uint64(32))
        total = np.add.reduceat(counters & np.uint64(0xFFFFFFFF), first)
        places = (counters[first[total >= least]] >> np.uint64(32)).astype(np.uint32)
        out = np.zeros(1 << each, bool)
        for at in slots(places, each):
            out[at] = True
        yield rows_out(_FILTER, [[key[0].as_py()], [np.packbits(out, bitorder="little").tobytes()]])
        del counters, first, total, places, out
        give_back()

    return run


def sketch(texts: DataFrame, most: int, least: int, bits: int, deal: int) -> np.ndarray:
    """A filter of 2^bits bits (64 MB at 29) of the counters that reach `least` in the merged sketches of (lang, text).

    A sketch has 2^24 counters in each of 2^deal slices, so their number grows with the corpus and few runs share one. Only those that are not 0 are kept and sent. They
    are summed by slices on the executors; there each that reaches `least` sets two bits of its slice's part of the filter, and the driver gets these parts, one row a slice.
    """
    out = np.zeros((1 << deal, 1 << bits - deal - 3), np.uint8)
    for r in texts.mapInArrow(_sketched(most, deal, least), "slice int, counters binary").groupBy("slice").applyInArrow(_merged(bits - deal, least), "slice int, bits binary").collect():
        out[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return out


def may_reach(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the sketch allows that a run is frequent: always where it is."""
    deal, each = len(filter_).bit_length() - 1, (8 * filter_.shape[1]).bit_length() - 1
    places = h >> np.uint64(64 - DEEP - deal)
    slice_ = (places >> np.uint64(DEEP)).astype(np.int64) << each
    out, flat = np.ones(len(h), bool), filter_.ravel()
    for at in slots((places & np.uint64((1 << DEEP) - 1)).astype(np.uint32), each):
        at += slice_
        out &= (flat[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    return out


def _survivors(sent, most: int):
    """A task's numbers of all runs that the sketch allows; up to NAMED are told apart by their hashes and added up before they leave. The empty phrase has that of all words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = sent.value
        held, text, n, size = ([], [], [], [], []), [], 0, 0  # hash, start, end, language and number of phrases; their bytes
        total: dict[str, int] = {}
        ids: dict[str, int] = {}

        def hold(*columns: np.ndarray) -> None:
            for parts, x in zip(held, columns, strict=True):
                parts.append(x)

        def taken(parts: list[np.ndarray]) -> np.ndarray:
            out = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
            parts.clear()
            return out

        def pieces(edges: np.ndarray) -> Iterator[tuple[int, int]]:
            i = 0
            while i < len(edges) - 1:
                j = max(i + 1, int(np.searchsorted(edges, edges[i] + OUT, "right")) - 1)
                yield i, j
                i = j

        def fold() -> tuple[int, int]:
            """Holds each phrase once from here on; the number of phrases and of their bytes."""
            h, start, stop, of, f = map(taken, held)
            data = taken(text)
            order = np.argsort(h)
            h = h[order]
            first, _ = _summed(h)
            h, one, f = h[first], order[first], np.add.reduceat(f[order], first) if len(first) else f
            del order, first
            start, size = start[one], stop[one] - start[one]
            edges = np.r_[0, np.cumsum(size)]
            hold(h, edges[:-1], edges[1:], of[one], f)
            for i, j in pieces(edges):
                at = edges[i : j + 1] - edges[i]
                text.append(data[np.arange(at[-1]) + np.repeat(start[i:j] - at[:-1], size[i:j])])
            return len(one), int(edges[-1])

        def leave() -> Iterator[pa.RecordBatch]:
            (_, start, stop, of, f), data = map(taken, held), taken(text)
            names, edges = pa.array(list(ids), pa.string()), np.r_[start, stop[-1:]]
            for i, j in pieces(edges):
                at = (edges[i : j + 1] - edges[i]).astype(np.int32)
                phrases = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(at), pa.py_buffer(data[edges[i] : edges[j]])])
                yield rows_out(_FOUND, [names.take(pa.array(of[i:j])), phrases, f[i:j]])

        for batch in it:
            for langs, words in chunks(batch):
                for lang, x in zip(langs, np.bincount(words.text, minlength=len(langs)).tolist(), strict=True):
                    total[lang] = total.get(lang, 0) + x
                of = np.array([ids.setdefault(x, len(ids)) for x in langs], np.int32)
                joined, begin, end = words.joined()
                alive = np.ones(len(words.hash), bool)
                for k, (at, h) in enumerate(words.runs(most), 1):
                    if k > 1:  # a run is no more frequent than its first and its last words
                        inner = alive[at] & alive[at + 1]
                        at, h = at[inner], h[inner]
                    ok = may_reach(filter_, h)
                    at, h = at[ok], h[ok]
                    alive = np.zeros(len(words.hash), bool)
                    alive[at] = True
                    hold(h, begin[at] + size, end[at + k - 1] + size, of[words.text[at]], np.ones(len(at), np.int64))
                    n += len(at)
                text.append(joined)
                size += len(joined)
                if n >= NAMED or size >= TEXT:
                    n, size = fold()
                    if 4 * n >= 3 * NAMED or 4 * size >= 3 * TEXT:
                        yield from leave()
                        n = size = 0
        if text:
            fold()
            yield from leave()
        if total:
            yield rows_out(_FOUND, [list(total), [b""] * len(total), list(total.values())])
        give_back()

    return run


def counted(docs: DataFrame, most: int = 3, least: int = 10, bits: int | None = None) -> DataFrame:
    """(lang, k, phrase, f): every phrase of 1 to `most` words that occurs `least` times or more in a language, with its exact number; k = 0 has the number of all words.

    Words are runs of other characters than space and tab within pieces, A-Z in lower case; phrases are their words joined by a space.
    The first pass counts every run of every text in a sketch, which never counts too few; the second counts those exactly that the sketch
    allows and whose first and last words it allows. The sketch is sparse: a counter for each byte of text or fewer (2^30 at least), of which
    a task holds those of four million runs. What reaches `least` is a filter with a bit for every 16 bytes of text, between 2^16 and 2^29 bits; one that is too small
    for its corpus lets more through and loses nothing. A task tells two million phrases or so apart by 64-bit hashes, Spark then by their words.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if bits is None:
        bits = min(MOST_BITS, max(LEAST_BITS, (size // 16).bit_length()))
    deal = min(max(LEAST_DEAL, (size >> DEEP).bit_length(), bits - DEEP), bits - 3)
    if deal < 0:
        raise ValueError(f"a filter of 2^{bits} bits is no whole byte")
    filter_ = sketch(texts, most, least, bits, deal)
    let_go(docs.sparkSession)
    with lent(docs.sparkSession, filter_) as sent:
        rows = texts.mapInArrow(_survivors(sent, most), "lang string, phrase binary, f long").withColumn("phrase", F.col("phrase").cast("string"))
        found = rows.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))  # tasks have added up theirs already
        k = F.when(F.col("phrase") == "", 0).otherwise(F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1)
        return written(found.select("lang", k.alias("k"), "phrase", "f").where(f"k = 0 or f >= {least}"))


def collocations(docs: DataFrame, most: int = 3, least: int = 10, share: int = 50, first: int | None = 2000, salts: int = 64, bits: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `first` phrases of 2 to `most` words by score, a (both descending) and phrase.

    a, l and r are the numbers of occurrences of the phrase, of its first k words and of the rest; the score is
    floor(1000000 a a / (l r)), the least of all cuts k, of equal ones the first. A phrase that lies in a longer one with
    at least `share` percent of its occurrences is left out. Null texts are empty, a null language is `und`; equal rows count as often as they
    occur; an empty table gives no rows. Products are decimals of 38 digits, enough for 10^16 occurrences.

    Counts meet by shuffles in which a phrase of a thousandth of all occurrences or more is broadcast instead, fewer than a thousand of them; a
    language's ranks come from its first rows in each of `salts` parts. `first` None ranks all.
    """
    grams = counted(docs, most, least, bits)
    let_go(docs.sparkSession)
    facts = grams.where("k > 0").select("lang", "phrase", "f", F.col("f").alias("weight"))
    cand = grams.where("k > 1").withColumnRenamed("f", "a")
    k = F.col("cut")
    cuts = cand.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", *(F.array_join(F.slice(F.split("phrase", " "), s, n), " ").alias(c) for c, s, n in (("left", F.lit(1), k), ("right", k + 1, F.col("k") - k))))
    for side, name in (("left", "l"), ("right", "r")):
        part = facts.withColumnsRenamed({"phrase": side, "f": name})
        cuts = attached(cuts, part, ["lang", side])
    score = F.expr("(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * cast(1000000 as decimal(7,0))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))")
    cuts = cuts.withColumn("score", score.cast("long"))
    best = F.min_by(F.struct("l", "r", "score"), F.struct("score", "cut")).alias("best")
    scored = cuts.groupBy("lang", "phrase", "k", "a").agg(best).select("lang", "phrase", "k", "a", "best.*")
    scored = written(scored)
    words = F.split("phrase", " ")
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda s: F.array_join(F.slice(words, s, n), " ")))))
    over = scored.where("k > 2").select("lang", inner.alias("phrase"), F.col("a").alias("outer")).groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    kept = scored.join(over, ["lang", "phrase"], "left").where(F.col("outer").isNull() | (100 * F.col("outer") < share * F.col("a"))).drop("outer", "k")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if first is not None:
        kept = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= first).drop("rank", "salt")
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if first is not None:
        kept = kept.where(F.col("rank") <= first)
    total = grams.where("k = 0").select("lang", F.col("f").alias("n"), F.col("f").alias("weight"))
    return attached(kept, total, ["lang"]).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
