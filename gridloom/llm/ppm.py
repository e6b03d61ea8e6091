"""Language-model scores by prediction by partial matching (PPM) over bytes, beside add-one scores of words.

The model is a trie of byte contexts of up to ORDER bytes with the counts of what follows them in all training texts.
A byte's probability is found by going from the longest context to the shortest. A context that has not seen the
byte escapes with probability d / (t + d), one that has gives n / (t + d): t and d are the count and the number of its
symbols without those of the longer contexts gone through (symbol exclusion, escape method C). After the empty context,
all symbols not yet excluded are alike. So the probability depends on the last ORDER bytes and the symbol alone, and
is worked out once for each distinct run of ORDER + 1 bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rows_out, texts, written

ORDER = 4
ROWS = 8192  # rows of a file that make a block
LONG = 1 << 16  # bytes of a text that is a block of its own
CHUNK = 1 << 21  # bytes that are taken apart at once
END = b" "  # the end of a text among words; no word has a space
FEATURES = pa.schema([("blk", pa.int64()), ("tok", pa.binary()), ("gram", pa.int64()), ("n", pa.int64())])
PROBS = pa.schema([("gram", pa.int64()), ("val", pa.float64())])
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((n, pa.int64()) for n in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())])


def grams(all_texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, runs of ORDER + 1 bytes, ascending starts of the texts among them) for a few texts at a time.

    A text is preceded by ORDER zero bytes and followed by one, its end symbol; a zero in a text counts as a one.
    """
    first = 0
    while first < len(all_texts):
        last, size = first, 0
        while last < len(all_texts) and (last == first or size + len(all_texts[last]) < CHUNK):
            size += len(all_texts[last])
            last += 1
        part = [t.replace(b"\0", b"\1") for t in all_texts[first:last]]
        pad = bytes(ORDER)
        flat = np.frombuffer(pad + pad.join(part) + pad, np.uint8)
        n = np.fromiter(map(len, part), np.int64, len(part))
        keep = np.ones(len(flat) - ORDER, bool)
        ends = np.cumsum(n + ORDER) - ORDER
        for j in range(1, ORDER):
            at = ends + j
            keep[at[at < len(keep)]] = False
        g = np.zeros(len(flat) - ORDER, np.int64)
        for j in range(ORDER + 1):
            g = (g << 8) | flat[j : j + len(g)]
        yield first, g[keep], np.cumsum(n + 1) - (n + 1)
        first = last


def block_features(blk: int, train: list[bytes], other: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The distinct words and runs of bytes of a block, with their counts in its training texts."""
    words: Counter[bytes] = Counter()
    for t in train:
        words.update(t.split())
    words[END] += len(train)
    for t in other:
        for w in t.split():
            words.setdefault(w, 0)
    runs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for some, one in ((train, 1), (other, 0)):
        for _, g, _ in grams(some):
            u, n = np.unique(g, return_counts=True)
            merged, back = np.unique(np.concatenate([runs, u]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, n * one]), len(merged)).astype(np.int64)
            runs = merged
    items = list(words.items())
    for a in range(0, len(items), 20_000):
        part = items[a : a + 20_000]
        yield rows_out(FEATURES, [[blk] * len(part), [w for w, _ in part], pa.nulls(len(part), pa.int64()), [n for _, n in part]])
    for a in range(0, len(runs), 100_000):
        part = runs[a : a + 100_000]
        yield rows_out(FEATURES, [np.full(len(part), blk), pa.nulls(len(part), pa.binary()), part, counts[a : a + 100_000]])


def _features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's rows follow each other but for long texts between them; what one task has of a block is its own part."""
    now, parts = None, ([], [])
    for batch in it:
        for blk, held_out, t in zip(batch.column("blk").to_pylist(), batch.column("held_out").to_pylist(), texts(batch), strict=True):
            t = t.lower()
            if len(t) > LONG:
                yield from block_features(blk, *([], [t]) if held_out else ([t], []))
                continue
            if blk != now:
                if now is not None:
                    yield from block_features(now, *parts)
                now, parts = blk, ([], [])
            parts[held_out].append(t)
    if now is not None:
        yield from block_features(now, *parts)


class Level:
    """Counts of (context of k bytes, symbol): ascending keys, and by context the count t, number d, and overlap x.

    x is the count that the context one byte shorter has of this context's symbols.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, mask: int, shorter: Level | None):
        self.keys, self.n, self.mask = keys, n, mask
        seen = n > 0
        ctx, first = np.unique(keys >> 8, return_index=True)
        self.ctx = ctx
        add = lambda v: np.add.reduceat(v, first) if len(first) else np.zeros(0, np.int64)
        self.t, self.d = add(n), add(seen.astype(np.int64))
        if shorter is None:
            self.x = np.zeros(len(ctx), np.int64)
        else:
            self.x = add(np.where(seen, shorter.n[np.searchsorted(shorter.keys, keys & shorter.mask)], 0))


def levels(g: np.ndarray, n: np.ndarray, low: tuple[np.ndarray, np.ndarray]) -> list[Level]:
    """Levels 0 to ORDER. low: keys and counts of one byte and its symbol over the whole model; the rest is of g and n."""
    out = []
    for k in range(ORDER + 1):
        mask = (1 << 8 * (k + 1)) - 1
        keys, counts = (g, n) if k >= 2 else low
        u, back = np.unique(keys & mask, return_inverse=True)
        out.append(Level(u, np.bincount(back, counts, len(u)).astype(np.int64), mask, out[-1] if out else None))
    return out


def log_probabilities(g: np.ndarray, n: np.ndarray, low: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 of each symbol's probability after its context, for distinct runs g with training counts n.

    g must hold every run of the model whose last two context bytes some run of g has.
    """
    total, found = np.zeros(len(g)), np.zeros(len(g), bool)
    out_t, out_d = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)  # excluded by the longer context
    for lv in reversed(levels(g, n, low)):
        key = g & lv.mask
        ctx = np.searchsorted(lv.ctx, key >> 8)
        count = lv.n[np.searchsorted(lv.keys, key)]
        t, d = lv.t[ctx] - out_t, lv.d[ctx] - out_d
        live = (d > 0) & ~found
        hit = live & (count > 0)
        miss = live & (count == 0)
        total[hit] += np.log10(count[hit] / (t[hit] + d[hit]))
        total[miss] += np.log10(d[miss] / (t[miss] + d[miss]))
        found |= hit
        out_t, out_d = lv.x[ctx], lv.d[ctx]
    total[~found] -= np.log10(256 - out_d[~found])
    return total


def blocked(docs: DataFrame, held_out: Column) -> DataFrame:
    """(blk, doc_id, held_out, text) of docs: ROWS rows that follow each other in a file make a block, so do long texts alone."""
    rows = [F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text")]
    at = ["_metadata.file_path as gridloom_file", "_metadata.row_index as gridloom_row"]
    try:
        docs = docs.select("*", *map(F.expr, at))
    except AnalysisException:
        docs = written(docs.select("doc_id", "text", held_out.alias("gridloom_out")))
        rows[1] = F.col("gridloom_out").alias("held_out")
        docs = docs.select("*", *map(F.expr, at))
    long = F.coalesce(F.octet_length("text") > LONG, F.lit(False))
    blk = F.xxhash64("gridloom_file", long, F.when(long, F.col("gridloom_row")).otherwise(F.floor(F.col("gridloom_row") / ROWS)))
    return docs.select(blk.alias("blk"), *rows)


def _scores(tokens: int, distinct: int):
    base = np.log10(tokens + distinct + 1)

    def run(docs: pa.Table, model: pa.Table) -> pa.Table:
        is_word = np.asarray(model.column("tok").is_valid())
        val = np.asarray(model.column("val"))
        counts = dict(zip(model.column("tok").filter(pa.array(is_word)).to_pylist(), val[is_word].tolist(), strict=True))
        runs, prob = np.asarray(model.column("gram").filter(pa.array(~is_word))).astype(np.int64), val[~is_word]
        order = np.argsort(runs)
        runs, prob = runs[order], prob[order]
        out = []
        for batch in docs.to_batches():
            some = [t.lower() for t in texts(batch)]
            n, known, score = [], [], []
            for t in some:
                c = np.fromiter(map(counts.__getitem__, [*t.split(), END]), float)
                n.append(len(c))
                known.append(int((c > 0).sum()))
                score.append(float(np.log10(c + 1).sum() - len(c) * base))
            full = np.zeros(len(some))
            for first, g, starts in grams(some):
                full[first : first + len(starts)] = np.add.reduceat(prob[np.searchsorted(runs, g)], starts)
            out.append(rows_out(SCORES, [batch.column("doc_id"), batch.column("held_out"), n, known, [tokens] * len(n), score, full]))
        return pa.Table.from_batches(out, SCORES)

    return run


def model_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of (doc_id, text).

    Texts, A-Z in lower case, null as empty, are learned from whole where not held out. base_score is the log10 probability of a
    text's words and its end under add-one smoothed counts, score that of its bytes and its end under the PPM model; an
    empty text has the end alone. Without training texts every word and byte is unknown. Repeated rows count as often
    as they occur.

    Documents stay in blocks. A block's distinct words and runs of bytes are counted over the corpus by shuffles on
    the word or run, and their counts and probabilities go back to the block, which so needs memory for what it has itself and
    never for the model. Only counts of pairs of bytes (65,536 at most) and two totals reach the driver.
    """
    spark = docs.sparkSession
    rows = blocked(docs, held_out)
    features = written(rows.select("blk", "held_out", "text").mapInArrow(_features, "blk long, tok binary, gram long, n long"))
    words, runs = features.where("tok is not null").select("blk", "tok", "n"), features.where("gram is not null").select("blk", "gram", "n")
    counts = written(words.groupBy("tok").agg(F.sum("n").cast("double").alias("val")))
    t = counts.agg(F.coalesce(F.sum("val"), F.lit(0)).cast("long").alias("n"), F.count_if(F.col("val") > 0).alias("v")).first()
    model = written(runs.groupBy("gram").agg(F.sum("n").alias("n")))
    pairs = model.groupBy(F.expr("gram & 65535").alias("gram")).agg(F.sum("n").alias("n")).toPandas()
    low = spark.sparkContext.broadcast((pairs["gram"].to_numpy(np.int64), pairs["n"].to_numpy(np.int64)))

    def probabilities(group: pa.Table) -> pa.Table:
        g, n = (np.asarray(group.column(c)).astype(np.int64) for c in ("gram", "n"))
        return pa.Table.from_batches([rows_out(PROBS, [g, log_probabilities(g, n, low.value)])])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = F.pmod(F.xxhash64(F.expr("shiftright(gram, 8) & 65535")), F.lit(parts)).alias("part")
    probs = written(model.select(by, "gram", "n").groupBy("part").applyInArrow(probabilities, "gram long, val double"))
    none = {"tok": F.lit(None).cast("binary"), "gram": F.lit(None).cast("long")}
    back = words.select("blk", "tok").join(counts, "tok").select("blk", "tok", none["gram"].alias("gram"), "val")
    back = back.unionByName(runs.select("blk", "gram").join(probs, "gram").select("blk", none["tok"].alias("tok"), "gram", "val"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("blk").cogroup(back.groupBy("blk")).applyInArrow(_scores(t["n"], t["v"]), schema)
