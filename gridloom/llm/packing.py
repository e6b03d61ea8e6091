"""Packing of token ids into sequences: an order-preserving dynamic program chooses where windows over the documents end."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, rows_out, written
from .token_files import Encoder

PIECES = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("offset", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
DDL = "part int, seq long, offset long, doc_id long, start long, length long, doc_tokens long, ids binary"
PART_BYTES = 64 << 20  # of text in a task: the more, the fewer words are new to its encoder
CHUNK_IDS = 1 << 20  # over which one program runs, up to the end of a document


@dataclass(frozen=True)
class Costs:
    """In ids: of a sequence, of a cut at a sentence's end, and of one elsewhere, which is looked at every `stride` ids where no sentence ends for `stretch`. A cut between documents is free."""

    sequence: int = 16
    sentence: int = 4
    elsewhere: int = 32
    stretch: int = 64
    stride: int = 16


def padding(length: int, size: int) -> int:
    """A sequence is padded to `size` unless its length is a power of two."""
    return 0 if length & (length - 1) == 0 else size - length


def cuts(at: np.ndarray, penalty: np.ndarray, size: int, sequence: int) -> list[int]:
    """Which of the places at (ascending, 0 first, no further than `size` apart) windows end at, the last among them, so that padding and penalties are least.

    cost(j) = penalty(j) + sequence + min over i < j with at(j) - at(i) <= size of cost(i) + padding(at(j) - at(i)).
    Padded windows need the least cost(i) + at(i) of a sliding range of places, which a monotone queue keeps; windows of a power
    of two come from the places just so far back. Of equal costs the longer window is taken.
    """
    n = len(at)
    where = np.full(int(at[-1]) + 1, -1, np.int64)
    where[at] = np.arange(n)
    ends, starts = [], []
    for k in range(size.bit_length()):
        back = at - (1 << k)
        if 1 << k <= size and (back >= 0).any():
            j = np.flatnonzero(back >= 0)
            i = where[back[j]]
            ends.append(j[i >= 0])
            starts.append(i[i >= 0])
    ends, starts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ends, starts))
    order = np.lexsort((starts, ends))
    first = np.searchsorted(ends[order], np.arange(n + 1)).tolist()
    exact, place, more = starts[order].tolist(), at.tolist(), (penalty + sequence).tolist()
    cost, lead, back_to = [0] * n, [0] * n, [0] * n  # lead: cost and place
    queue: deque[int] = deque()
    for j in range(1, n):
        v, here = lead[j - 1], place[j]
        while queue and lead[queue[-1]] > v:
            queue.pop()
        queue.append(j - 1)
        far = here - size
        while place[queue[0]] < far:
            queue.popleft()
        i = queue[0]
        best = lead[i] - far
        if first[j] < first[j + 1]:
            for x in exact[first[j] : first[j + 1]]:
                if cost[x] < best or cost[x] == best and x < i:
                    best, i = cost[x], x
        cost[j] = best = best + more[j]
        lead[j], back_to[j] = best + here, i
    out, j = [], n - 1
    while j:
        out.append(j)
        j = back_to[j]
    return out[::-1]


class Sentences:
    """Tells from ids where sentences end: after a token that ends in . ! or ? (and closing marks) before one that begins with white space, or after a line's end."""

    def __init__(self, tok):
        names = [tok.id_to_token(i) or "" for i in range(tok.get_vocab_size())]
        self.line = np.array(["Ċ" in t for t in names])
        self.end = np.array([t.rstrip("\"')]").endswith((".", "!", "?")) for t in names])
        self.space = np.array([t[:1] in ("Ġ", "Ċ", "č", "ĉ") and t != "" for t in names])

    def after(self, ids: np.ndarray) -> np.ndarray:
        """Places within ids before which a sentence ends."""
        a, b = ids[:-1], ids[1:]
        return np.flatnonzero(self.end[a] & self.space[b] | self.line[a] & ~self.line[b]) + 1


def places(ids: np.ndarray, doc_ends: np.ndarray, sentences: Sentences, costs: Costs) -> tuple[np.ndarray, np.ndarray]:
    """Where windows over these ids may end, and what that costs."""
    penalty = np.full(len(ids) + 1, -1, np.int32)
    soft = np.unique(np.concatenate([[0], sentences.after(ids), doc_ends]))
    penalty[soft] = costs.sentence
    gaps = np.flatnonzero(np.diff(soft) > costs.stretch)
    for a, b in zip(soft[gaps].tolist(), soft[gaps + 1].tolist(), strict=True):
        penalty[a + costs.stride : b : costs.stride] = costs.elsewhere
    penalty[doc_ends] = 0
    penalty[0] = 0
    at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


def _packed(tokenizer_path: str, end_id: int, size: int, costs: Costs):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder, seq = TaskContext.get().partitionId(), Encoder(tokenizer_path), 0
        sentences = Sentences(encoder.tok)
        doc_ids: list = []
        docs: list[np.ndarray] = []
        held = 0

        def chunk() -> pa.RecordBatch:
            nonlocal seq, held
            ids = np.concatenate(docs)
            sizes = np.array([len(d) for d in docs], np.int64)
            ends = np.cumsum(sizes)
            at, penalty = places(ids, ends, sentences, costs)
            windows = np.concatenate([[0], at[cuts(at, penalty, size, costs.sequence)]])
            a = np.unique(np.concatenate([windows, ends - sizes]))[:-1]  # where a window or a document begins; no document is empty
            b = np.append(a[1:], len(ids))
            doc, window = np.searchsorted(ends, a, "right"), np.searchsorted(windows, a, "right") - 1
            raw = ids.astype("<u4").tobytes()
            own = [raw[4 * x : 4 * y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            out = [np.full(len(a), part, np.int32), window + seq, a - windows[window], [doc_ids[i] for i in doc.tolist()], a - (ends - sizes)[doc], b - a, sizes[doc], own]
            seq += len(windows) - 1
            docs.clear()
            doc_ids.clear()
            held = 0
            return rows_out(PIECES, out)

        for batch in it:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.of([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                docs.append(np.append(ids, np.uint32(end_id)))
                doc_ids.append(doc_id)
                held += len(docs[-1])
                if held >= CHUNK_IDS:
                    yield chunk()
        if docs:
            yield chunk()
        del encoder, sentences
        give_back()

    return run


def packed(docs: DataFrame, tokenizer_path: str, end_id: int = 1, size: int = 2048, costs: Costs | None = None, parts: int | None = None) -> DataFrame:
    """The pieces (sequence_id, offset, doc_id, start, length, doc_tokens, ids) of all whole documents (doc_id, text) in sequences of at most `size` ids.

    A document's ids are those of its text and then `end_id`; null is an empty text. Documents stay in order of doc_id, null first, of equal ids
    by a hash of their text; rows of the same doc_id are documents of their own. An empty table gives no rows. start counts a document's ids before
    the piece; ids are little-endian 32-bit integers; sequences are numbered in order, and their pieces lie in them without gaps. No document is
    left out or cut off: what a window doesn't hold comes in the next.

    Documents are dealt to tasks by ranges; in a task one program runs over about a million ids at a time (a longer document alone), so a task holds
    one such chunk. Windows don't reach over chunks: a chunk's end costs no more than a document's, as its last ids fill windows of powers of two.
    The driver gets a count of sequences of each task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not parts:
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(12, -(-total // PART_BYTES))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    pieces = written(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_packed(tokenizer_path, end_id, size, costs or Costs()), DDL))
    before, n = [], 0
    for r in pieces.groupBy("part").agg(F.max("seq").alias("last")).orderBy("part").collect():
        before.append((r["part"], n))
        n += r["last"] + 1
    first = F.broadcast(spark.createDataFrame(before, "part int, before long"))  # a row a task
    return pieces.join(first, "part").select((F.col("seq") + F.col("before")).alias("sequence_id"), "offset", "doc_id", "start", "length", "doc_tokens", "ids")
