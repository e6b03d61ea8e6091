"""N-gram Jaccard self-join: rare-first prefixes, with length, positional and suffix filters, verified once per pair."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, document_words, give_back, lent, marked, rows_out, shingles, written
from .components import components

K = 5
SLICES = 64  # in which the counters of shingle hashes are summed, whose sums give the rare-first order
MOST_BITS = 25  # 32 MB of counters, for a billion words or more
RANGES = 64  # ranges of hashes that the suffix filter compares
ROUNDS = 2  # in which sets are compared with a few others, before what still is apart is compared in full
CHUNK = 8  # sets of a list that share a partner in a round
FEW, FEW_ROUNDS = 8, 4  # sets of a component that meet another in a list, before all do, and how often at most
BACK = 4  # shared shingles before one by which a pair is known to meet earlier
FIRST = pa.schema([("doc_id", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("slice", pa.int32()), ("hits", pa.binary())])
SUMS = pa.schema([("slice", pa.int32()), ("sums", pa.binary())])
PREFIX = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])
SETS = pa.schema([("c", pa.int64()), ("members", pa.list_(pa.int64()))])


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Ascending hashes of the distinct shingles of K words."""
    s = np.sort(shingles(words, K))
    return s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s


def digest(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def signature(s: np.ndarray) -> bytes:
    n = np.bincount((s >> np.uint64(64 - RANGES.bit_length() + 1)).astype(np.int64), minlength=RANGES)
    return np.minimum(n, 65535).astype("<u2").tobytes()


def _first(bits: int):
    """Each document's class, size and signature; at the end the task's counts of shingles by bucket, in slices.

    A count is of one byte, so a bucket that a task meets more than 255 times counts as 255 there.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << bits, np.uint8)
        for batch in it:
            c, n, sig = [], [], []
            for words in document_words(batch):
                s = shingle_set(words)
                at = place(s, bits)
                now = sums[at]
                sums[at] = now + (now < 255)  # a set has few shingles of one bucket; they count once
                c.append(digest(s) if len(s) else None)
                n.append(len(s))
                sig.append(signature(s) if len(s) else None)
            none = [None] * len(c)
            yield rows_out(FIRST, [batch.column("doc_id"), c, n, sig, none, none])
        if sums.any():
            parts = sums.reshape(SLICES, -1)
            none = [None] * SLICES
            yield rows_out(FIRST, [none, none, none, none, list(range(SLICES)), [zlib.compress(p.tobytes(), 1) for p in parts]])
        give_back()

    return run


def _sum_slices(key: tuple[pa.Scalar, ...], it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a slice over all tasks, as they stream in, on a scale of one byte: 16 * log2(1 + count)."""
    total = 0
    for batch in it:
        for x in batch.column("hits").to_pylist():
            total = total + np.frombuffer(zlib.decompress(x), np.uint8).astype(np.int64)
    yield rows_out(SUMS, [[key[0].as_py()], [np.minimum(16 * np.log2(1 + total), 255).astype(np.uint8).tobytes()]])


def place(s: np.ndarray, bits: int) -> np.ndarray:
    return (s & np.uint64((1 << bits) - 1)).astype(np.int64)


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _prefixes(sketch, bits: int, num: int, den: int, shared=None):
    """(h, c, n, pos) of each set's rarest shingles; only those in the filter `shared`, if there is one."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = sketch.value, set()
        for batch in it:
            hs, cs, ns, ps = [], [], [], []
            for words in document_words(batch):
                s = shingle_set(words)
                c = digest(s)
                if not len(s) or c in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(c)
                s_p = s[np.argsort(counts[place(s, bits)], kind="stable")[: prefix_length(len(s), num, den)]]
                pos = np.arange(len(s_p), dtype=np.int32)
                if shared is not None:
                    ok = marked(shared.value, s_p)
                    s_p, pos = s_p[ok], pos[ok]
                hs.append(s_p.view(np.int64))
                cs.append(np.full(len(pos), c))
                ns.append(np.full(len(pos), len(s), np.int32))
                ps.append(pos)
            if hs:
                yield rows_out(PREFIX, [np.concatenate(x) for x in (hs, cs, ns, ps)])
        give_back()

    return run


def _wanted(wanted):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = wanted.value, set()
        for batch in it:
            cs, members = [], []
            for words in document_words(batch):
                s = shingle_set(words)
                c = digest(s)
                if len(s) and c not in seen and marked(bits, np.array([c]))[0]:
                    seen.add(c)
                    cs.append(c)
                    members.append(s.view(np.int64))
                    if len(seen) > 200_000:
                        seen.clear()
            if cs:
                yield rows_out(SETS, [cs, members])
        give_back()

    return run


def _far_suffixes(num: int, den: int):
    """Drops pairs whose sets differ, summed over ranges of hashes, in more elements than linked sets can."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, RANGES).astype(np.int64) for k in ("sig_a", "sig_b"))
            n = np.asarray(batch.column("na")) + np.asarray(batch.column("nb")).astype(np.int64)
            apart = np.where((a == 65535) | (b == 65535), 0, np.abs(a - b)).sum(axis=1)
            # overlap >= num / (num + den) * n, so elements of one set alone <= n * (den - num) / (den + num)
            yield batch.filter(pa.array(apart * (den + num) <= n * (den - num))).select(["a", "b", "na", "nb"])

    return run


def possible(na: Column, nb: Column, pa_: Column, pb: Column, num: int, den: int) -> Column:
    """Length and positional filters for a shared shingle at places pa_ and pb of the rare-first orders."""
    length = den * F.least(na, nb) >= num * F.greatest(na, nb)
    return length & ((num + den) * (F.least(na - pa_, nb - pb)) >= num * (na + nb))


class Join:
    """The steps of one self-join; their tables are in the shared folder."""

    def __init__(self, docs: DataFrame, num: int, den: int):
        self.num, self.den = num, den
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.spark = docs.sparkSession
        size = self.docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.bits = min(MOST_BITS, max(12, (size // 200).bit_length()))  # a counter for about 32 words
        first = written(self.docs.mapInArrow(_first(self.bits), "doc_id long, c long, n long, sig binary, slice int, hits binary"))
        self.rows = first.where("slice is null").select("doc_id", "c", "n")
        self.sigs = written(first.where("c is not null").select("c", "sig").dropDuplicates(["c"]))
        sums = first.where("slice is not null").select("slice", "hits").groupBy("slice").applyInArrow(_sum_slices, "slice int, sums binary").collect()
        sketch = np.zeros((SLICES, (1 << self.bits) // SLICES), np.uint8)
        for r in sums:
            sketch[r["slice"]] = np.frombuffer(r["sums"], np.uint8)
        self.order = self.spark.sparkContext.broadcast(sketch.ravel())

    def prefixes(self, shared=None) -> DataFrame:
        return self.docs.mapInArrow(_prefixes(self.order, self.bits, self.num, self.den, shared), "h long, c long, n int, pos int")

    def shared(self) -> DataFrame:
        """(h, c, n, pos) of prefix shingles that two sets or more have.

        Which these are comes from a partial aggregate; a filter of them is broadcast, so that the second pass over the
        documents deals out little else. No shingle's sets meet in one task.
        """
        several = written(self.prefixes().groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("h"))
        with lent(self.spark, bitmap(several)) as some:
            rows = self.prefixes(some).groupBy("h", "c").agg(F.min("n").alias("n"), F.min("pos").alias("pos"))
            rows = written(rows.join(several, "h", "left_semi"))
        self.order.unpersist()
        return rows

    def pairs(self, p: DataFrame) -> DataFrame:
        """Distinct (a, b, na, nb), a < b, of the rows (ca, na, cb, nb) that pass the suffix filter."""
        turn = F.col("ca") > F.col("cb")
        p = p.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), F.when(turn, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(turn, F.col("na")).otherwise(F.col("nb")).alias("nb")).distinct()
        p = p.join(self.sigs.withColumnsRenamed({"c": "a", "sig": "sig_a"}), "a").join(self.sigs.withColumnsRenamed({"c": "b", "sig": "sig_b"}), "b")
        return written(p.select("a", "b", "na", "nb", "sig_a", "sig_b").mapInArrow(_far_suffixes(self.num, self.den), "a long, b long, na int, nb int"))

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are similar enough, from the sets themselves."""
        with lent(self.spark, bitmap(pairs.select(F.col("a").alias("c")).union(pairs.select("b")))) as some:
            sets = written(self.docs.mapInArrow(_wanted(some), "c long, members array<bigint>")).dropDuplicates(["c"])
        p = pairs.join(sets.select(F.col("c").alias("a"), F.col("members").alias("sa")), "a").join(sets.select(F.col("c").alias("b"), F.col("members").alias("sb")), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        return written(p.select("a", "b", (F.col("na") + F.col("nb")).alias("n"), common.alias("common")).where(self.den * F.col("common") >= self.num * (F.col("n") - F.col("common"))).select("a", "b"))

    def open(self, shared: DataFrame, roots: DataFrame | None) -> DataFrame:
        """The rows of the shared shingles whose sets are of several components, with their root and length band."""
        band = F.floor(F.log(F.col("n").cast("double")) / math.log(self.den / self.num))
        if roots is None:
            return shared.select("h", "c", "n", "pos", F.col("c").alias("root"), band.alias("band"))
        rows = shared.join(roots.withColumnRenamed("node", "c"), "c", "left").select("h", "c", "n", "pos", F.coalesce("root", "c").alias("root"), band.alias("band"))
        several = rows.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h")
        return written(rows.join(several, "h", "left_semi"))

    def stars(self, rows: DataFrame, turn: int) -> DataFrame:
        """Each set with a few of other components, in every list: the heads of its length band and the next, and that of its chunk.

        A head is the set of least hash, another in each turn, and comes from a partial aggregate; so does a list's length,
        which gives the number of its chunks.
        """
        order, one = F.xxhash64("c", F.lit(turn)), F.struct("c", "n", "pos", "root")
        heads = rows.groupBy("h", "band").agg(F.min_by(one, order).alias("o"), F.count("*").alias("k"))
        reach = rows.withColumn("at", F.explode(F.array("band", F.col("band") - 1)))
        first = reach.join(heads.withColumnRenamed("band", "at"), ["h", "at"])
        chunk = F.pmod(F.xxhash64("c", F.lit(turn), F.lit("chunk")), F.ceil(F.col("k") / CHUNK)).alias("chunk")
        long = rows.join(heads.where(F.col("k") > 2).select("h", "band", "k"), ["h", "band"]).select("h", "band", chunk, "c", "n", "pos", "root")
        second = long.join(long.groupBy("h", "band", "chunk").agg(F.min_by(one, order).alias("o")), ["h", "band", "chunk"])
        fits = possible(F.col("n"), F.col("o.n"), F.col("pos"), F.col("o.pos"), self.num, self.den)
        out = [x.where((F.col("root") != F.col("o.root")) & fits).select(F.col("c").alias("ca"), F.col("n").alias("na"), F.col("o.c").alias("cb"), F.col("o.n").alias("nb")) for x in (first, second)]
        return out[0].union(out[1])

    def across(self, rows: DataFrame, few: bool, turn: int) -> tuple[DataFrame, bool]:
        """In each shared shingle's list, the pairs of sets of different components that the length and positional filters let link.

        With m of a set's n shingles left from the shared one on, a partner has at most top = (num + den) * m / num - n
        shingles (and the set at most the partner's top). So of a pair the smaller set's span n..top holds the larger set's n, and the filters are
        part of the key: a set is in the cell of its n, and covers the cells of its span, if that isn't empty. Cells are of sizes within 3 %.
        In a cell, components meet first, each as one row with its least and greatest sizes, so copies in a list make no more
        pairs; then only the sets that fit the other component's sizes are taken. Where one of the BACK shared shingles before this one is common too, a pair has
        met there or before.

        Where a great component would meet others with all of its sets in every list (`few`, and over twice the pairs that follow), only about FEW sets of a component are taken in a list and
        cell, others in each: sets that link with some of it then are of it. This is done again while it finds links, FEW_ROUNDS times at most, before all meet. Returns the pairs and whether these are all.
        """
        by, n, top = Window.partitionBy("c").orderBy("pos"), F.col("n"), F.floor((self.num + self.den) * (F.col("n") - F.col("pos")) / self.num).cast("int") - F.col("n")
        rows = rows.select("h", "root", "c", "n", top.alias("top"), F.array_compact(F.array(*(F.lag("h", i).over(by) for i in range(1, BACK + 1)))).alias("prev"))
        rows = written(rows)
        cell = lambda size: F.floor(F.log(size.cast("double")) / math.log(1.03)).cast("int")
        large = rows.withColumn("cell", cell(n))
        small = rows.where("top >= n").withColumn("cell", F.explode(F.sequence(cell(n), cell(F.col("top")))))
        ends = [F.min("n").alias("least"), F.max("n").alias("most"), F.max("top").alias("reach"), F.count("*").alias("k")]
        a, b = (x.groupBy("h", "cell", "root").agg(*ends).withColumnsRenamed({k: f"{k}_{side}" for k in ("root", "least", "most", "reach", "k")}) for side, x in (("a", large), ("b", small)))
        met = a.join(b, ["h", "cell"]).where("root_a <> root_b and least_a <= reach_b and least_b <= reach_a and least_b <= most_a")
        met = written(met.select("h", "cell", "root_a", "root_b", "least_b", "reach_b", "k_a", "k_b"))
        if few:
            every, some = met.agg(F.sum(F.col("k_a") * F.col("k_b")), F.sum(F.least("k_a", F.lit(FEW)) * F.least("k_b", F.lit(FEW)))).first()
            few = (every or 0) > 2 * (some or 0)
        drawn = lambda side: F.pmod(F.xxhash64(f"c{side}", "h", F.lit(turn)), F.ceil(F.col(f"k_{side}") / FEW)) == 0 if few else F.lit(True)
        left = met.join(large.withColumnsRenamed({"root": "root_a", "c": "ca", "n": "na", "top": "top_a", "prev": "prev_a"}), ["h", "cell", "root_a"]).where(F.expr("na <= reach_b and least_b <= top_a and least_b <= na") & drawn("a"))
        right = small.withColumnsRenamed({"root": "root_b", "c": "cb", "n": "nb", "top": "top_b", "prev": "prev_b"})
        first = F.lit(True) if few else ~F.arrays_overlap("prev_a", "prev_b")  # of a pair's lists only some have both sets where few are taken
        return left.join(right, ["h", "cell", "root_b"]).where(F.expr("nb <= na and na <= top_b and nb <= top_a") & first & drawn("b")).select("ca", "na", "cb", "nb"), not few


def near_duplicates(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of (doc_id, text).

    Two rows link when den * common >= num * united for their sets of shingles of five words (A-Z in lower case; of
    the whole text if it has fewer words). component_id is the least doc_id that links lead to, the row's own
    included. Texts that are null or without words have no shingles and link with nothing. A null doc_id is never a
    component_id unless no other is reachable. Rows with equal sets, so repeated rows too, are one class and are compared once.

    Every set's rarest shingles, as many as leave no similar set without one in common, are dealt by shingle. In a
    shingle's list, sets are compared first with heads drawn by hash, in a few rounds, and with a few of each great component; after those links only sets of
    different components are compared, all with all. Lists of one component, however long, make no more
    pairs. "Rare" is by counts over all documents, in a
    counter for about 32 words of input but 2^25 at most, and any order gives the same links. Shingles and
    sets are compared by 64-bit hashes: a chance agreement can join two of n distinct sets at odds of n * n / 2^65.
    """
    j = Join(docs, num, den)
    shared, roots = j.shared(), None
    turn, last, more = 0, False, True
    while not last:
        rows = j.open(shared, roots)
        if turn and not rows.limit(1).count():
            break
        found, last = (j.stars(rows, turn), False) if turn < ROUNDS else j.across(rows, more and turn < ROUNDS + FEW_ROUNDS, turn)
        found, turn = j.pairs(found), turn + 1
        if more := bool(found.limit(1).count()):
            found = j.linked(found)
            more = bool(found.limit(1).count())
        if more:
            roots = components(found if roots is None else found.union(roots.select("node", "root")))
    if roots is None:
        roots = docs.sparkSession.createDataFrame([], "node long, root long")
    rows = j.rows.join(roots.withColumnRenamed("node", "c"), "c", "left").select("doc_id", "n", F.coalesce("root", "c").alias("root"))
    rows = written(rows)
    least = written(rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return rows.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id is the least of a component of near_duplicates().

    Rows without a doc_id stay, since no id stands for them. Rows that agree in doc_id and text are one document
    and one of them stays; other rows of the same doc_id are told apart by their text.
    """
    found = written(near_duplicates(docs, num, den).where("doc_id is not null"))
    ids = found.groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("stays"), F.count("*").alias("times"))
    some = written(ids.where("stays = 0 or times > 1").select(F.col("doc_id").alias("gridloom_id"), "stays"))
    key = F.col("doc_id").cast("long") == F.col("gridloom_id")
    out = docs.join(some, key, "left_anti")
    again = some.where("stays = 1")
    if again.limit(1).count():
        out = out.union(docs.join(again, key, "left_semi").dropDuplicates(["doc_id", "text"]))
    return out
