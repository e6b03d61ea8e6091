"""Substring dedup: shared k-mer seeds, chained in order with gap costs through a Fenwick tree, and aligned to fuzzy passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ODD, bitmap, document_words, lent, marked, mixed, powers, rows_out, shingles, word_chunks, written

K = 5  # words of a seed
W = 15  # of W seeds in a row the one of least hash is taken, so W + K - 1 equal words share one
SHARE = 0.33  # of all seeds, those of least hash, are taken too, whatever is around them
NEAR = 10  # seed places between two matches of a segment
REACHES = ((21, 35), (36, 45))  # words from the first to the second seed of a pair that makes a key too: the pair reaches over more than pieces of half a passage, or of most of one
GAP_COST = 0.1  # of each word between two chained segments, on either side; a change leaves up to K words and the next seed there
MOST_GAP = 50  # words between chained segments
DROP = 12  # of its score that ends the growth of an alignment: four changed words in a row
MARGIN = 64  # words that an alignment may grow at its ends
SEEN = pa.schema([("h", pa.int64()), ("doc", pa.int64())])
SEEDS = pa.schema([("h", pa.int64()), ("rank", pa.int32()), ("doc", pa.int64()), ("pos", pa.int32())])
CHAINS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("a0", pa.int32()), ("a1", pa.int32()), ("b0", pa.int32()), ("b1", pa.int32()), ("segments", pa.list_(pa.int64()))])
WORDS = pa.schema([("doc", pa.int64()), ("words", pa.list_(pa.int32()))])  # half of a word's hash
BYTES = pa.schema([("doc", pa.int64()), ("low", pa.binary())])
STARTS = pa.schema([("doc", pa.int64()), ("at", pa.list_(pa.int32()))])
RUNS = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("start", pa.int32())])
HASHES = pa.schema([("h", pa.int64()), ("doc", pa.int64())])
FOUND = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("partner_id", pa.int64()), ("similarity", pa.float64())])


def minimizers(h: np.ndarray) -> np.ndarray:
    """Places of the least hash of each W in a row and of hashes that are small, ascending; of a run of equal seeds each W-th. The greatest hash stands for no seed."""
    if not len(h):
        return np.zeros(0, np.int64)
    h = np.r_[h, np.full(W - 1, -1, np.int64).view(np.uint64)] if len(h) < W else h
    least = h[: len(h) - W + 1].copy()
    for j in range(1, W):
        np.minimum(least, h[j : len(h) - W + 1 + j], out=least)
    own = h < np.uint64(int(SHARE * 2**64))
    for j in range(W):
        own[j : len(h) - W + 1 + j] |= h[j : len(h) - W + 1 + j] == least
    at = np.flatnonzero(own & (h != np.uint64(0xFFFFFFFFFFFFFFFF)))
    same = np.r_[False, (h[at[1:]] == h[at[:-1]]) & (at[1:] - at[:-1] == 1)][: len(at)]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))
    return at[(np.arange(len(at)) - head) % W == 0]


def seeds_of(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first word in its text) of the seeds of texts whose words follow each other; no window of W goes over a text's end."""
    n = np.maximum(np.diff(np.r_[first, len(words)]) - K + 1, 0)
    text = np.repeat(np.arange(len(first)), n)
    pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    padded = np.full(len(text) + W * len(first), -1, np.int64).view(np.uint64)
    place = np.arange(len(text)) + W * text
    if len(text):
        padded[place] = shingles(words, K)[first[text] + pos]
    at = minimizers(padded)
    own = np.searchsorted(place, at)
    return padded[at], text[own], pos[own]


def _seen(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The seeds of each document."""
    for batch in it:
        docs = np.asarray(batch.column("doc_id"))
        for i, _, words, first in word_chunks(batch):
            h, text, _ = seeds_of(words, first)
            yield rows_out(SEEN, [h.view(np.int64), docs[i + text]])


def pairs_of(h: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, index) of pairs of seeds, by ascending places, whatever is between them: a seed with the least hash of those within its reach after it.

    The distance is no part of the key, so words may have been put in or left out. A bit of the first seed's hash says which reach
    it has, a bit of the key which seed of the pair stands for it.
    """
    keys, at = [], []
    padded = np.r_[h, np.full(1, -1, np.int64).view(np.uint64)]
    for which, (near, far) in enumerate(REACHES):
        first = np.flatnonzero((h >> np.uint64(9)) & np.uint64(1) == which)
        i, j = np.searchsorted(place, place[first] + near), np.searchsorted(place, place[first] + far, "right")
        first, i, j = (x[i < j] for x in (first, i, j))
        if len(first):
            least = np.minimum.reduceat(padded, np.stack([i, j], axis=1).ravel())[::2]
            key = mixed(h[first] * ODD[0] + least + np.uint64(which))
            width = int((j - i).max())
            second = i.copy()  # the first of the least
            for k in range(1, width):
                second = np.where((padded[second] != least) & (i + k < j), i + k, second)
            keys.append(key)
            at.append(np.where(key & np.uint64(1) == 0, first, second))
    return (np.concatenate(keys), np.concatenate(at)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def keys_of(h: np.ndarray, text: np.ndarray, pos: np.ndarray, known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, rank, index) of the seeds h of texts: each known seed with its rank of occurrence in its text, and pairs of known seeds."""
    at = np.flatnonzero(known)
    order = at[np.lexsort((at, h[at], text[at]))]
    n = np.arange(len(order))
    start = np.r_[True, (h[order[1:]] != h[order[:-1]]) | (text[order[1:]] != text[order[:-1]])][: len(order)]
    yield h[order], n - np.maximum.accumulate(np.where(start, n, 0)), order
    key, own = pairs_of(h[at], (text[at].astype(np.int64) << 32) + pos[at])
    yield key, np.zeros(len(key), np.int64), at[own]


def _seeds(shared):
    """Keys of the seeds that the filter has, with their documents and first words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in it:
            docs = np.asarray(batch.column("doc_id"))
            for i, _, words, first in word_chunks(batch):
                h, text, pos = seeds_of(words, first)
                for key, rank, at in keys_of(h, text, pos, marked(bits, h)):
                    yield rows_out(SEEDS, [key.view(np.int64), rank.astype(np.int32), docs[i + text[at]], pos[at].astype(np.int32)])

    return run


class Fenwick:
    """Greatest value, and whose it is, over the places up to one."""

    def __init__(self, n: int):
        self.best = [(-1e18, -1)] * (n + 1)

    def put(self, i: int, v: float, who: int) -> None:
        i += 1
        while i < len(self.best):
            if v > self.best[i][0]:
                self.best[i] = (v, who)
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        """Over places before i."""
        out = (-1e18, -1)
        while i > 0:
            if self.best[i][0] > out[0]:
                out = self.best[i]
            i -= i & -i
        return out


def segments_of(pa_: np.ndarray, pb: np.ndarray) -> np.ndarray:
    """Rows (a, b, length in seed places) of matches on one diagonal that are at most NEAR apart, by start."""
    order = np.lexsort((pb, pb - pa_))
    x, y = pa_[order], pb[order]
    cut = np.flatnonzero((np.diff(y - x) != 0) | (np.diff(y) > NEAR))
    a, b = np.r_[0, cut + 1], np.r_[cut, len(x) - 1]
    out = np.stack([x[a], y[a], x[b] - x[a]], axis=1)
    return out[np.lexsort((out[:, 0], out[:, 1]))]


def chains(segs: np.ndarray) -> Iterator[list[int]]:
    """Places of segments that form a chain, best first, each segment in one. segs: rows of segments_of().

    A segment follows another if it starts after its end on both sides. A chain's value is its segments' words less
    GAP_COST for each word between them on either side: as that is a sum of ends and starts, the best chain
    before a segment is a prefix maximum over ends on one side, in the order of the other.
    """
    n = len(segs)
    if n == 1:
        yield [0]
        return
    a0, b0, length = (segs[:, i].tolist() for i in range(3))
    ends = sorted({a + s for a, s in zip(a0, length, strict=True)})
    place = {v: i for i, v in enumerate(ends)}
    starts_at = np.searchsorted(ends, segs[:, 0]).tolist()
    tree = Fenwick(len(ends))
    value, before = [0.0] * n, [-1] * n
    waiting = sorted(range(n), key=lambda i: b0[i] + length[i])
    apart = lambda i, j: max(a0[j] - a0[i], b0[j] - b0[i]) - length[i]
    w = 0
    for j in range(n):
        while w < n and b0[waiting[w]] + length[waiting[w]] < b0[j]:
            i = waiting[w]
            tree.put(place[a0[i] + length[i]], value[i] + GAP_COST * (a0[i] + b0[i] + 2 * length[i]), i)
            w += 1
        got, i = tree.upto(starts_at[j])
        value[j] = length[j] + K
        if i >= 0 and apart(i, j) > MOST_GAP + K:  # the best is out of reach: the best of those that aren't
            got, i = -1e18, -1
            for r in range(w - 1, -1, -1):
                k = waiting[r]
                if b0[j] - b0[k] - length[k] > MOST_GAP + K:
                    break
                v = value[k] + GAP_COST * (a0[k] + b0[k] + 2 * length[k])
                if v > got and a0[k] + length[k] < a0[j] and apart(k, j) <= MOST_GAP + K:
                    got, i = v, k
        if i >= 0 and (gain := got - GAP_COST * (a0[j] + b0[j])) > 0:
            value[j] += gain
            before[j] = i
    used = [False] * n
    for j in sorted(range(n), key=lambda i: -value[i]):
        out = []
        while j >= 0 and not used[j]:
            used[j] = True
            out.append(j)
            j = before[j]
        if out:
            yield out[::-1]


def _chained(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        a, b, lists = np.asarray(batch.column("a")), np.asarray(batch.column("b")), batch.column("matches")
        n = lists.value_lengths().to_numpy()
        flat, ends = lists.flatten().to_numpy(), np.cumsum(n)
        one = n == 1  # a chain of one seed each
        m = flat[ends[one] - 1]
        x, y = m >> 32, m & 0xFFFFFFFF
        segs = pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * 3, np.stack([x, y, np.zeros(len(m), np.int64)], axis=1).ravel())
        yield rows_out(CHAINS, [a[one], b[one], *(z.astype(np.int32) for z in (x, x + K, y, y + K)), segs])
        rows = []
        for i in np.flatnonzero(~one).tolist():
            m = np.unique(flat[ends[i] - n[i] : ends[i]])
            segs = segments_of(m >> 32, m & 0xFFFFFFFF)
            for c in chains(segs):
                s = segs[c]
                rows.append((a[i], b[i], int(s[0, 0]), int(s[-1, 0] + s[-1, 2] + K), int(s[0, 1]), int(s[-1, 1] + s[-1, 2] + K), s.ravel().tolist()))
        if rows:
            yield rows_out(CHAINS, list(zip(*rows, strict=True)))


def reach(equal: np.ndarray) -> int:
    """Before how many words the search of grown() stops; not fewer where more words are equal."""
    s = np.cumsum(np.where(equal, 1, -3))
    stop = np.flatnonzero(np.maximum.accumulate(np.maximum(s, 0)) - s >= DROP)
    return int(stop[0]) if len(stop) else len(s)


def _possible(least: int):
    """Chains that can grow to `least` words, judged by a byte of each word's hash: equal words have equal ones, so none is lost."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            at = [batch.column(c).to_pylist() for c in ("a0", "a1", "b0", "b1", "x", "y")]
            keep = []
            for a0, a1, b0, b1, x, y in zip(*at, strict=True):
                n = min(a1 - a0, b1 - b0)
                if n < least:
                    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                    i, j = min(a0, MARGIN), min(b0, MARGIN)
                    m = min(i, j)
                    n += reach((x[i - m : i] == y[j - m : j])[::-1])
                    x, y = x[i + a1 - a0 :], y[j + b1 - b0 :]
                    m = min(len(x), len(y))
                    n += reach(x[:m] == y[:m])
                keep.append(n >= least)
            some = batch.select(CHAINS.names).filter(pa.array(keep, pa.bool_()))
            if some.num_rows:
                yield rows_out(CHAINS, [some.column(f.name).cast(f.type) for f in CHAINS])

    return run


def edit_columns(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """(equal words, columns) of a least-edit alignment of two short runs."""
    n = min(len(x), len(y))
    same = x[:n] == y[:n]
    head = n if same.all() else int(same.argmin())
    x, y = x[head:], y[head:]
    n = min(len(x), len(y))
    same = x[len(x) - n :][::-1] == y[len(y) - n :][::-1]
    tail = n if same.all() else int(same.argmin())
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    if not len(x) or not len(y):
        return head + tail, head + tail + max(len(x), len(y))
    row = [(j, 0) for j in range(len(y) + 1)]  # edits, minus equal words
    for i in range(1, len(x) + 1):
        new = [(i, 0)]
        for j in range(1, len(y) + 1):
            e, m = row[j - 1]
            step = (e, m - 1) if x[i - 1] == y[j - 1] else (e + 1, m)
            new.append(min(step, (row[j][0] + 1, row[j][1]), (new[-1][0] + 1, new[-1][1])))
        row = new
    edits, equal = row[-1]
    return head + tail - equal, head + tail + edits - equal


def grown(equal: np.ndarray) -> int:
    """How many words to add at an end: up to the best sum of 1 for an equal word and -3 for another, before it falls by DROP."""
    if not len(equal):
        return 0
    s = np.cumsum(np.where(equal, 1, -3))
    stop = np.flatnonzero(np.maximum.accumulate(np.maximum(s, 0)) - s >= DROP)
    s = s[: stop[0]] if len(stop) else s
    return int(s.argmax()) + 1 if len(s) and s.max() > 0 else 0


def aligned(x: np.ndarray, y: np.ndarray, segs: np.ndarray) -> tuple[int, int, int, int, int, int]:
    """(start, end in x, start, end in y, equal words, columns) of a chain's segments aligned in the words x and y."""
    a, b = int(segs[0, 0]), int(segs[0, 1])
    n = min(a, b)
    left = grown((x[a - n : a] == y[b - n : b])[::-1])
    equal = int((x[a - left : a] == y[b - left : b]).sum())
    columns = left
    i, j = a, b
    for p, q, length in segs.tolist():
        skip = max(i - p, j - q, 0)  # words of this segment's first seed that the last segment's last one has taken
        p, q, n = p + skip, q + skip, length + K - skip
        if n <= 0:
            continue
        e, c = edit_columns(x[i:p], y[j:q])
        equal += e + int((x[p : p + n] == y[q : q + n]).sum())
        columns += c + n
        i, j = p + n, q + n
    n = min(len(x) - i, len(y) - j)
    right = grown(x[i : i + n] == y[j : j + n])
    equal += int((x[i : i + right] == y[j : j + right]).sum())
    return a - left, i + right, b - left, j + right, equal, columns + right


def lengthened(x: np.ndarray, y: np.ndarray, found: tuple[int, int, int, int, int, int], least: int, similarity: float) -> tuple[int, int, int, int, int, int]:
    """An alignment under `least` words that is `least` with some more columns at its ends, the outermost of equal words, and still similar enough; else as it is."""
    a0, a1, b0, b1, equal, columns = found
    short = least - min(a1 - a0, b1 - b0)
    if short <= 0:
        return found
    n, m = min(a0, b0, MARGIN), min(len(x) - a1, len(y) - b1, MARGIN)
    left, right = (x[a0 - n : a0] == y[b0 - n : b0])[::-1], x[a1 : a1 + m] == y[b1 : b1 + m]
    i, j = (np.r_[0, np.flatnonzero(e) + 1] for e in (left, right))
    share = (equal + np.arange(len(i))[:, None] + np.arange(len(j))) / (columns + i[:, None] + j)
    share[i[:, None] + j < short] = 0
    p, q = np.unravel_index(share.argmax(), share.shape)
    if share[p, q] < similarity:
        return found
    return int(a0 - i[p]), int(a1 + j[q]), int(b0 - i[p]), int(b1 + j[q]), equal + int(p + q), columns + int(i[p] + j[q])


def best_run(x: np.ndarray, y: np.ndarray, segs: np.ndarray, weight: float) -> tuple[int, int]:
    """First and last of the segments in a row whose equal words, less `weight` for each other column of their alignment, are most."""
    best, at, value, first, ends = -np.inf, (0, 0), -np.inf, 0, (0, 0)
    for j, (p, q, length) in enumerate(segs.tolist()):
        between = 0.0
        if j:
            skip = max(ends[0] - p, ends[1] - q, 0)
            p, q, length = p + skip, q + skip, length - skip
            e, c = edit_columns(x[ends[0] : p], y[ends[1] : q])
            between = e - weight * (c - e)
        n = max(length + K, 0)
        e = int((x[p : p + n] == y[q : q + n]).sum())
        own = e - weight * (n - e)
        if value + between > 0:
            value += between + own
        else:
            value, first = own, j
        if value > best:
            best, at = value, (first, j)
        ends = (p + n, q + n)
    return at


def similar_parts(x: np.ndarray, y: np.ndarray, segs: np.ndarray, similarity: float, least: int = 0) -> Iterator[tuple[int, int, int, int, float]]:
    """Start and end in x and y, and share of equal words, of the aligned chain, or, where that isn't similar enough, of its most similar run of segments,
    and so on for what is left on either side. Those of half of `least` words and more are lengthened to `least` where that can be."""
    found = aligned(x, y, segs)
    if found[4] >= similarity * found[5]:
        if 2 * min(found[1] - found[0], found[3] - found[2]) >= least - 1:
            found = lengthened(x, y, found, least, similarity)
        yield *found[:4], found[4] / found[5]
    elif len(segs) > 1:
        i, j = best_run(x, y, segs, similarity / max(1 - similarity, 1e-9))
        if j - i + 1 == len(segs):  # only its ends spoil it
            j -= 1
        for part in (segs[:i], segs[i : j + 1], segs[j + 1 :]):
            if len(part):
                yield from similar_parts(x, y, part, similarity, least)


def together(rows: list[tuple]) -> list[tuple]:
    """Spans (doc, start, end, partner, similarity) of a document that overlap or touch as one, with the least partner and the best similarity."""
    out: list[list] = []
    for doc, start, end, partner, sim in sorted(rows):
        if out and out[-1][0] == doc and start <= out[-1][2]:
            last = out[-1]
            last[2:] = max(last[2], end), min(last[3], partner), max(last[4], sim)
        else:
            out.append([doc, start, end, partner, sim])
    return out


def _aligned(piece: int, similarity: float, least: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            cols = [batch.column(c) for c in ("segments", "x", "y")]
            for i, (a, b, ax, by) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ax", "by")), strict=True)):
                s, x, y = (c[i].values.to_numpy() for c in cols)
                for a0, a1, b0, b1, sim in similar_parts(x, y, s.reshape(-1, 3) - np.array([ax, by, 0]), similarity, least):
                    if min(a1 - a0, b1 - b0) >= piece:
                        rows += [(a, ax + a0, ax + a1, b, sim), (b, by + b0, by + b1, a, sim)]
            if rows:
                yield rows_out(FOUND, list(zip(*together(rows), strict=True)))

    return run


def run_starts(places: np.ndarray, spans: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all runs of `least` words that can be another document's too, and which of them lie in none of the spans (start, end).

    places: rows (first, last) of places of seeds that other documents have. Each W places in a row of an equal run have one.
    """
    top = int(places[:, 1].max()) + W + 1
    steps = np.zeros(top + 1, np.int64)
    np.add.at(steps, np.maximum(places[:, 0] - W + 1, 0), 1)
    np.add.at(steps, places[:, 1] + 1, -1)
    has = np.r_[0, np.cumsum(np.cumsum(steps) > 0)]  # of windows of W places, how many before each have one
    n = max(least - K + 1 - W + 1, 1)
    at = np.flatnonzero(has[n:] - has[:-n] == n)
    steps = np.zeros(top + least + 2, np.int64)
    whole = spans[spans[:, 1] - spans[:, 0] >= least]
    np.add.at(steps, np.minimum(whole[:, 0], top), 1)
    np.add.at(steps, np.minimum(whole[:, 1] - least + 1, top), -1)
    return at, np.cumsum(steps)[at] == 0


def _starts(least: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for doc, places, spans in zip(*(batch.column(c).to_pylist() for c in ("doc", "places", "spans")), strict=True):
                at, free = run_starts(*(np.array([(r["p"], r["q"]) for r in x or []], np.int64).reshape(-1, 2) for x in (places, spans)), least)
                if free.any():
                    rows.append((doc, at[free]))
            if rows:
                yield rows_out(STARTS, list(zip(*rows, strict=True)))

    return run


def _runs(least: int):
    """Hashes of the runs of run_starts()."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for doc, words, at in zip(batch.column("doc").to_pylist(), *(batch.column(c) for c in ("words", "at")), strict=True):
                w = halves(words.values.to_numpy().view(np.uint32))
                if len(w) < least:
                    continue
                h, at = run_hashes(w, least).view(np.int64), at.values.to_numpy()
                at = at[at < len(h)]
                if len(at):
                    yield rows_out(RUNS, [h[at], np.full(len(at), doc), at])

    return run


def _same_runs(wanted, least: int):
    """Hashes of the runs of `least` words that the filter has marked."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in it:
            hs, docs = [], []
            for doc, w in zip(batch.column("doc_id").to_pylist(), document_words(batch), strict=True):
                if len(w) >= least:
                    h = run_hashes(halves(w), least).view(np.int64)
                    h = np.unique(h[marked(bits, h)])
                    hs.append(h)
                    docs.append(np.full(len(h), doc))
            if hs:
                yield rows_out(HASHES, [np.concatenate(hs), np.concatenate(docs)])

    return run


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words, a polynomial from running sums."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    up, down = powers(1 << max(16, len(words).bit_length()))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * down[: len(words) - k + 1])


def halves(words: np.ndarray) -> np.ndarray:
    return words.astype(np.uint64) & np.uint64(0xFFFFFFFF)


def _low_bytes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        yield rows_out(BYTES, [batch.column("doc"), [w.values.to_numpy().astype(np.uint8).tobytes() for w in batch.column("words")]])


def _wanted(wanted):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in it:
            some = batch.filter(pa.array(marked(bits, np.asarray(batch.column("doc_id")))))
            if some.num_rows:
                yield rows_out(WORDS, [some.column("doc_id"), [halves(w).astype(np.uint32).view(np.int32) for w in document_words(some)]])

    return run


def _of(wanted):
    """The rows of the documents that the filter has marked."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in it:
            some = batch.filter(pa.array(marked(bits, np.asarray(batch.column("doc")))))
            if some.num_rows:
                yield some

    return run


def matches(docs: DataFrame) -> DataFrame:
    """(a, b, pa, pb) with a < b: every seed's occurrence with one of the same in another document, or with a few.

    Which seeds two documents or more have comes from a partial aggregate; a filter of them is broadcast, so that few others are dealt
    out. An occurrence is matched with those of the least and of the greatest document that have its key. Keys
    are the seed with its rank among its document's own, and pairs of seeds that are further apart than pieces reach: so a document
    that has a long passage too, with changed words as well, is a partner though lesser and greater ones have pieces of it. An occurrence whose rank no other document has is matched with
    the seed's first. So a key makes at most two matches for each occurrence, in however many documents it is, and heads are aggregates
    joined back: no key's rows meet in a task.
    """
    seen = docs.mapInArrow(_seen, "h long, doc long").groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    several = written(seen.where("lo <> hi").select("h"))
    bits = min(26, max(20, (8 * several.count()).bit_length()))
    with lent(docs.sparkSession, bitmap(several, bits)) as shared:
        rows = written(docs.mapInArrow(_seeds(shared), "h long, rank int, doc long, pos int"))
    one = F.struct("doc", "pos")
    heads = written(rows.groupBy("h", "rank").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).where("lo.doc <> hi.doc"))
    found = rows.join(heads, ["h", "rank"]).select("doc", "pos", "lo", "hi")
    lone = rows.where("rank > 0").join(heads.where("rank > 0"), ["h", "rank"], "left_anti")
    found = found.union(lone.join(heads.where("rank = 0").drop("rank"), "h").select("doc", "pos", "lo", "hi"))
    found = found.select("doc", "pos", F.explode(F.array("lo", "hi")).alias("m")).where("m.doc <> doc")
    turn = F.col("m.doc") < F.col("doc")
    return found.select(F.least("doc", "m.doc").alias("a"), F.greatest("doc", "m.doc").alias("b"), F.when(turn, F.col("m.pos")).otherwise(F.col("pos")).alias("pa"), F.when(turn, F.col("pos")).otherwise(F.col("m.pos")).alias("pb"))


def repeated_passages(docs: DataFrame, least: int = 50, similarity: float = 0.8) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, partner_id, similarity) of passages that other documents have too.

    Words are lower-cased (A-Z) runs of non-space of (doc_id, text). A passage has `least` words or more, each of
    which lies in an alignment, with at least `similarity` of its columns equal, with a passage of another document; partner_id is the
    least such document, similarity the best share. Passages of a document that overlap or touch are one. Each document
    that has a passage gets its row, the first too; keeping the first is for the caller. Rows without doc_id, text or words have
    none; rows that agree in doc_id and text are one document. Where a doc_id has several texts, each text is a document of its own, with the
    doc_id in its rows, and partner_id is any of the partners. Each run of W + K - 1 = 19 equal words shares a seed.
    Runs of `least` equal words are all found (exact_runs()); of passages with changes, those of which a key of seeds is matched with a partner that has the whole.
    The longest chain of each document is aligned first; chains that can't grow out of what that gives, on both sides, add no word to a
    passage and are left out, so partner_id and similarity are the least and best of those aligned. Pieces of half the length count where they touch others, since parts of a passage can have different partners. A run of
    one word over and over is matched once with a partner's, so as far as that one is long.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    own = F.xxhash64("text")
    twice = written(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not twice.limit(1).count() or not docs.join(twice, "doc_id").groupBy("doc_id").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).where("lo <> hi").limit(1).count():
        return _passages(docs, least, similarity)
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text", "doc_id")
    names = written(keyed.select("key", "doc_id").distinct())
    found = _passages(keyed.select(F.col("key").alias("doc_id"), "text"), least, similarity).withColumnsRenamed({"doc_id": "key", "partner_id": "other"})
    found = found.join(names, "key").join(names.withColumnsRenamed({"key": "other", "doc_id": "partner_id"}), "other")
    return found.select("doc_id", "start_word", "end_word", "n_words", "partner_id", "similarity")


def _passages(docs: DataFrame, least: int, similarity: float) -> DataFrame:
    piece = least // 2
    spark = docs.sparkSession
    marks = lambda pairs: lent(spark, bitmap(pairs.select(F.col("a").alias("d")).union(pairs.select("b"))))
    pairs = matches(docs).groupBy("a", "b").agg(F.collect_list(F.shiftleft(F.col("pa").cast("long"), 32).bitwiseOR(F.col("pb").cast("long"))).alias("matches"))
    schema = "a long, b long, a0 int, a1 int, b0 int, b1 int, segments array<bigint>"
    every = written(pairs.mapInArrow(_chained, schema))
    with marks(every) as some:
        words = written(docs.mapInArrow(_wanted(some), "doc long, words array<int>"))
    first = compared(longest(every, least), words, piece, similarity, least)
    at = F.struct(F.col("start_word").alias("p"), F.col("end_word").alias("q"))
    known = islands(first).groupBy(F.col("doc_id").alias("doc")).agg(F.collect_list(at).alias("known"))
    low = words.mapInArrow(_low_bytes, "doc long, low binary").dropDuplicates(["doc"]).join(known, "doc", "left")
    part = lambda a, b: F.expr(f"substring(low, greatest({a} - {MARGIN}, 0) + 1, {b} + {MARGIN} - greatest({a} - {MARGIN}, 0))")
    inside = lambda a, b: F.expr(f"coalesce(exists(known, s -> s.p <= greatest({a} - {MARGIN}, 0) and s.q >= least({b} + {MARGIN}, length(low))), false)")
    near = every.join(low.withColumnRenamed("doc", "a"), "a").select(*CHAINS.names, part("a0", "a1").alias("x"), inside("a0", "a1").alias("in_a"))
    near = near.join(low.withColumnRenamed("doc", "b"), "b").where(~(F.col("in_a") & inside("b0", "b1"))).select(*CHAINS.names, "x", part("b0", "b1").alias("y"))
    found = near.mapInArrow(_possible(max(piece, 1)), schema)
    spans = written(best_spans(first.union(compared(found, words, piece, similarity, least))))
    if least >= W + K - 1:
        spans = spans.union(exact_runs(docs, every, islands(spans), least))
    out = islands(spans)
    n = F.col("end_word") - F.col("start_word")
    return out.where(n >= least).select("doc_id", "start_word", "end_word", n.alias("n_words"), "partner_id", "similarity")


def longest(chains_: DataFrame, least: int) -> DataFrame:
    """The longest chain of each document on either side, of those of `least` words or more."""
    n = F.least(F.expr("a1 - a0"), F.expr("b1 - b0"))
    long = chains_.where(n >= least)
    one = F.max_by(F.struct(*CHAINS.names), F.struct(n.alias("n"), *CHAINS.names[:6])).alias("c")
    return long.groupBy("a").agg(one).select("c.*").union(long.groupBy("b").agg(one).select("c.*")).dropDuplicates(["a", "b", "a0", "b0"])


def compared(found: DataFrame, words: DataFrame, piece: int, similarity: float, least: int) -> DataFrame:
    """Spans of `piece` words or more of the chains, aligned in the words of their documents; written. Documents without a chain are left out before they are dealt."""
    lo = lambda c: F.greatest(F.col(c) - MARGIN, F.lit(0))
    part = lambda a, b: F.slice("words", a + 1, F.col(b) + MARGIN - a)
    found = written(found)
    with lent(found.sparkSession, bitmap(found.select(F.col("a").alias("d")).union(found.select("b")))) as some:
        words = words.mapInArrow(_of(some), "doc long, words array<int>").dropDuplicates(["doc"])
        cut = found.join(words.withColumnRenamed("doc", "a"), "a").select("a", "b", "b0", "b1", "segments", lo("a0").alias("ax"), part(lo("a0"), "a1").alias("x"))
        cut = cut.join(words.withColumnRenamed("doc", "b"), "b").select("a", "b", "segments", "ax", "x", lo("b0").alias("by"), part(lo("b0"), "b1").alias("y"))
        return written(best_spans(cut.mapInArrow(_aligned(piece, similarity, least), "doc_id long, start_word int, end_word int, partner_id long, similarity double")))


def best_spans(spans: DataFrame) -> DataFrame:
    """The longest span of each start."""
    return spans.groupBy("doc_id", "start_word").agg(F.max("end_word").alias("end_word"), F.min("partner_id").alias("partner_id"), F.max("similarity").alias("similarity"))


def islands(spans: DataFrame) -> DataFrame:
    """Spans of a document that overlap or touch as one."""
    by = Window.partitionBy("doc_id").orderBy("start_word")
    before = F.max("end_word").over(by.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", (F.coalesce(before, F.lit(-1)) < F.col("start_word")).cast("int")).withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("doc_id", "island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("partner_id").alias("partner_id"), F.round(F.max("similarity"), 6).alias("similarity"))


def exact_runs(docs: DataFrame, every: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """Spans of all runs of `least` equal words of two documents that lie in no known span, whichever partners their seeds were matched with.

    Runs whose seeds are all shared are compared by their hashes with the runs of all documents, through the least and the greatest document of each.
    """
    places = None
    for side, i in (("a", 0), ("b", 1)):
        s = F.expr(f"explode(transform(sequence(0, int(size(segments) / 3) - 1), i -> struct(int(segments[3 * i + {i}]) as p, int(segments[3 * i + 2]) as n)))")
        some = every.select(F.col(side).alias("doc"), s.alias("s")).select("doc", "s.*")
        places = some if places is None else places.union(some)
    places = places.groupBy("doc", "p").agg(F.max(F.col("p") + F.col("n")).alias("q")).groupBy("doc").agg(F.collect_list(F.struct("p", "q")).alias("places"))
    known = known.groupBy(F.col("doc_id").alias("doc")).agg(F.collect_list(F.struct(F.col("start_word").alias("p"), F.col("end_word").alias("q"))).alias("spans"))
    starts = written(places.join(known, "doc", "left").mapInArrow(_starts(least), "doc long, at array<int>"))
    with lent(docs.sparkSession, bitmap(starts.select("doc"))) as some:
        words = docs.mapInArrow(_wanted(some), "doc long, words array<int>").dropDuplicates(["doc"])
        runs = written(words.join(starts, "doc").mapInArrow(_runs(least), "h long, doc long, start int"))
    with lent(docs.sparkSession, bitmap(runs.select("h"), 26)) as some:
        same = written(docs.mapInArrow(_same_runs(some, least), "h long, doc long").groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")))
    ends = same.where("lo <> hi")
    other = F.when(F.col("lo") == F.col("doc"), F.col("hi")).otherwise(F.col("lo"))
    return runs.join(ends, "h").select(F.col("doc").alias("doc_id"), F.col("start").alias("start_word"), (F.col("start") + least).alias("end_word"), other.alias("partner_id"), F.lit(1.0).alias("similarity"))
