"""What the operators share: reading tables, scratch tables, hashing and Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch, written

#: Words are runs of characters other than space and \t \n \v \f \r. bytes.split() cuts at exactly these six.
WORD = r"[^\x20\x09-\x0D]+"


BATCH_BYTES = 4 << 20  # that Spark hands to Python at once, whatever the number of rows; several copies are held


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus. The session's Arrow batches are bounded to BATCH_BYTES from here on, as texts are long; the number of rows stays as set."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextlib.contextmanager
def lent(spark: SparkSession, value) -> Iterator[Broadcast]:
    """A broadcast that executors give up when what needs it has been written."""
    sent = spark.sparkContext.broadcast(value)
    try:
        yield sent
    finally:
        sent.unpersist()


def give_back() -> None:
    """Memory that a task has freed goes back to the system, as Python workers are kept for other tasks and stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems' C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def let_go(spark: SparkSession) -> None:
    """Shuffle files of frames that nothing holds any more are deleted now, not when the driver's JVM happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fold(doc_id: Column, n: int, at: int) -> Column:
    """True where crc32(doc_id as text) mod n is `at`; a null id counts as False."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n) == F.lit(at), F.lit(False))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 of each text, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def rows_out(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


#: Odd multipliers of the hash of a run of words.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0xA24BAED4963EE407
CHUNK = 1 << 18  # bytes that are taken apart at once


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse modulo 2^64. Those of a usual chunk are kept; a longer text's are its own, so that workers don't grow by it."""
    return _kept_powers(size) if size <= 2 * CHUNK else _powers(size)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(size, x, np.uint64)]) for x in (np.uint64(_P), np.uint64(pow(_P, -1, 1 << 64))))


_kept_powers = functools.lru_cache(maxsize=2)(_powers)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts that lie one after the other in data (bytes), and each text's first word.

    starts: the texts' first bytes. A word is hashed as a polynomial of its bytes, from running sums over data.
    """
    n = len(data)
    low = _LOWER[data]
    solid = np.r_[False, ~_SPACE[low], False]
    first, last = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
    cut = starts[(starts > 0) & (starts < n)]
    first[cut] |= solid[cut + 1]
    last[cut - 1] |= solid[cut]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(1 << max(CHUNK.bit_length(), int(n).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * ODD[7]), np.searchsorted(a, starts)


def word_chunks(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, hashes of the words of the texts i to j of a batch, each text's first word among them), A-Z in lower case; null is as empty."""
    col = batch.column(name).cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1)
        yield i, j, *word_hashes(data[at[i] : at[j]], at[i:j] - at[i])
        i = j


def document_words(batch: pa.RecordBatch, name: str = "text") -> Iterator[np.ndarray]:
    """Hashes of the words of each text of a batch."""
    for _, _, h, first in word_chunks(batch, name):
        yield from np.split(h, first[1:])


def words_of(text: bytes) -> np.ndarray:
    """Hashes of one text's words."""
    return word_hashes(np.frombuffer(text, np.uint8), np.zeros(1, np.int64))[0]


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words in order; of the whole sequence if it is shorter; none of no words."""
    n = len(words)
    if n < k:
        return mixed((words * ODD[:n]).sum(keepdims=True) + np.uint64(n)) if n else words
    h = words[: n - k + 1] * ODD[0]
    for j in range(1, k):
        h += words[j : n - k + 1 + j] * ODD[j % len(ODD)] ** np.uint64(1 + 2 * (j // len(ODD)))
    return mixed(h)


def batches(fn, schema: pa.Schema):
    """fn(batch) -> list of columns, as a function for mapInArrow."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                yield rows_out(schema, fn(batch))

    return run


SLICES = 64  # in which a filter's tasks and their sum are dealt
_SLICE = pa.schema([("slice", pa.int32()), ("bits", pa.binary())])


def _marked(bits: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1 << bits, bool)
        for batch in it:
            out[np.asarray(batch.column(0)) & ((1 << bits) - 1)] = True
        if out.any():
            parts = np.packbits(out, bitorder="little").reshape(SLICES, -1)
            yield rows_out(_SLICE, [list(range(SLICES)), [zlib.compress(p.tobytes(), 1) for p in parts]])

    return run


def _joined(key: tuple[pa.Scalar, ...], it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = 0
    for batch in it:
        for x in batch.column("bits").to_pylist():
            out = out | np.frombuffer(zlib.decompress(x), np.uint8)
    yield rows_out(_SLICE, [[key[0].as_py()], [out.tobytes()]])


def bitmap(ids: DataFrame, bits: int = 24) -> np.ndarray:
    """A filter with a bit for the last `bits` bits of each of the one column of longs: 2 MB at 24, whatever their number.

    Each task marks a filter of its own; these are joined by slices, and the driver gets one row a slice.
    """
    out = np.zeros((SLICES, (1 << (bits - 3)) // SLICES), np.uint8)
    rows = ids.mapInArrow(_marked(bits), "slice int, bits binary").groupBy("slice").applyInArrow(_joined, "slice int, bits binary")
    for r in rows.collect():
        out[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def marked(filter_: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of the longs a filter has marked; a few others too."""
    at = ids.view(np.int64) & (8 * len(filter_) - 1)
    return (filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def attached(rows: DataFrame, facts: DataFrame, keys: list[str], most: int = 1000) -> DataFrame:
    """The rows with the columns of the facts of the same keys (none null, unique among facts); rows without facts go.

    facts have a column `weight`, at least the number of rows that they meet. Facts of over a `most`-th of all weights, so fewer
    than `most`, are broadcast; the rows of the others meet them in a shuffle in which no key has more than that share.
    """
    total = facts.agg(F.sum("weight")).first()[0] or 0
    heavy = F.col("weight") * most > total
    hot = facts.where(heavy).drop("weight").withColumn("hot", F.lit(True))
    added = [c for c in facts.columns if c not in (*keys, "weight")]
    first = rows.join(F.broadcast(hot), keys, "left")
    of = [F.col(c) for c in (*rows.columns, *added)]
    return first.where("hot").select(*of).union(first.where("hot is null").select(*rows.columns).join(facts.where(~heavy).drop("weight"), keys).select(*of))


def numbered(rows: DataFrame, order: list, group: str, name: str) -> DataFrame:
    """The rows with their number `name` within their group of one long column, from 1, in an order that begins with the group.

    Rows are sorted by ranges, so a group may lie in many tasks; each task numbers its own rows, and the driver gets
    its first and last group with their numbers of rows, from which it counts those before. Rows of equal order are dealt as they come.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in it:
            ids = batch.column(group).to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            new = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            own = np.arange(1, len(ids) + 1) - np.repeat(new, np.diff(np.r_[new, len(ids)]))
            if ids[0] == last:
                own[: new[1] if len(new) > 1 else len(ids)] += seen
            last, seen = ids[-1], int(own[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64()), pa.array([part] * len(ids), pa.int32())], [*batch.schema.names, name, "part"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    ranged = written(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, f"{fields}, `{name}` long, part int"))
    at = F.struct(group, name)
    parts = ranged.groupBy("part").agg(F.min(group).alias("first"), F.max(at).alias("last")).orderBy("part").collect()
    before, open_, carried = [], (None, 0), 0
    for p in parts:
        carried = open_[1] if p["first"] == open_[0] else 0
        if carried:
            before.append((p["part"], p["first"], carried))
        open_ = (p["last"][0], p["last"][1] + (carried if p["last"][0] == p["first"] else 0))
    if not before:
        return ranged.drop("part")
    more = F.broadcast(spark.createDataFrame(before, f"part int, `{group}` long, more long"))  # one row a task at most
    return ranged.join(more, ["part", group], "left").withColumn(name, F.col(name) + F.coalesce("more", F.lit(0))).select(*rows.columns, name)
