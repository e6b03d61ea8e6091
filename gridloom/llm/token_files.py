"""Token-ID files: documents' token ids in zstandard frames of their own, with a seek table and checksums at the end.

A shard file is

    frame of document 0 | frame of document 1 | ... | seek table | footer

A frame is one zstandard frame (with its content checksum) of one document's ids, little-endian unsigned integers of
`width` bytes. The seek table is a zstandard skippable frame (magic 0x184D2A5E, size) of one 40-byte entry a document:
offset, compressed size, document id, first id's place in the shard (unsigned 64-bit; the document id is signed),
number of ids and CRC-32 of the ids as 32-bit integers (unsigned 32-bit). The footer is the last 32 bytes of that
skippable frame: number of documents, number of ids, offset of the seek table (unsigned 64-bit), width, and "GLTK".
zstd decompresses a whole shard to the ids of all its documents in order.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, rows_out, scratch

ENTRY = struct.Struct("<QQqQII")
FOOTER = struct.Struct("<QQQI4s")
SKIP = struct.Struct("<II")
SHARD_BYTES = 256 << 20  # of text in a file
NONE_ID = -(1 << 63)  # stands for a null document id
SHARDS = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])
ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


class Writer:
    def __init__(self, out, width: int = 2, level: int = 3):
        self.out, self.width, self.at, self.ids, self.table = out, width, 0, 0, []
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> (8 * self.width):
            raise ValueError(f"document {doc_id} has ids of more than {self.width} bytes")
        frame = self.pack.compress(ids.astype(f"<u{self.width}").tobytes())
        self.table.append(ENTRY.pack(self.at, len(frame), NONE_ID if doc_id is None else doc_id, self.ids, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        self.out.write(frame)
        self.at += len(frame)
        self.ids += len(ids)

    def close(self) -> None:
        body = b"".join(self.table) + FOOTER.pack(len(self.table), self.ids, self.at, self.width, b"GLTK")
        self.out.write(SKIP.pack(0x184D2A5E, len(body)) + body)


class Reader:
    """Reads the seek table, and then only the frames that are asked for. source: a file that can seek."""

    def __init__(self, source):
        self.source, size = source, source.seek(0, 2)
        n, self.ids, table, self.width, mark = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if mark != b"GLTK":
            raise ValueError("not a token file")
        raw = self._read(table + SKIP.size, n * ENTRY.size)
        self.entries = [(o, s, None if d == NONE_ID else d, a, k, c) for o, s, d, a, k, c in ENTRY.iter_unpack(raw)]
        self.unpack = zstandard.ZstdDecompressor()

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def document(self, i: int) -> np.ndarray:
        """The ids of the shard's i-th document; ValueError if they don't agree with their checksum."""
        at, size, _, _, n, crc = self.entries[i]
        ids = np.frombuffer(self.unpack.decompress(self._read(at, size), max_output_size=n * self.width), f"<u{self.width}").astype("<u4")
        if len(ids) != n or zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"document {i} is damaged")
        return ids

    def find(self, doc_ids: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        wanted = set(doc_ids)
        for i, e in enumerate(self.entries):
            if e[2] in wanted:
                yield e[2], self.document(i)


def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_L = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"
_WORD = rf"(?: |(?<![\w'])(?<!\s\s)){_L}+(?![\w'])"
#: A Latin word with the space before it, if no letter, digit, apostrophe or run of white space touches it; or what lies between two such words.
PIECES = re.compile(rf"{_WORD}|(?:(?!{_WORD}).)+", re.DOTALL)


def is_word(piece: str) -> bool:
    return piece.isalpha() or (piece[0] == " " and piece[1:].isalpha())


class Encoder:
    """Ids of texts under a byte-level vocabulary that splits texts before merging by the public pattern.

    That pattern makes a token boundary before a Latin word, its one space included, and after it, unless another
    letter, a digit, an apostrophe or more white space touches it; merges never cross a boundary. So a text is cut there, and each
    distinct piece of a task is encoded once and remembered while there are at most `most`. A word is all of one part of the pattern, so the
    vocabulary's merges are run on it alone. A text that holds the name of a special token is one piece.
    """

    most = 400_000

    def __init__(self, path: str):
        self.tok, self.known = tokenizer(path), {}
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        form = json.loads(self.tok.pre_tokenizer.__getstate__()) if self.tok.pre_tokenizer else None
        if not form or form.get("type") != "ByteLevel" or form.get("add_prefix_space") or not form.get("use_regex", True) or self.tok.normalizer:
            raise ValueError("this vocabulary doesn't split texts by the byte-level pattern alone")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in a byte-level vocabulary; the others follow from 256 on
        self.letters = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)).difference(shown)))}

    def ids(self, some: list[str]) -> list[bytes]:
        """Each text's ids as 32-bit integers."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(some, add_special_tokens=False)]

    def words(self, some: list[str]) -> list[bytes]:
        """Each word's ids, by the vocabulary's merges."""
        merge, letters, space = self.tok.model.tokenize, self.letters, chr(self.letters[32])
        shown = ((space + w[1:] if w[0] == " " else w) if w.isascii() else w.encode().decode("latin-1").translate(letters) for w in some)
        return [array("I", [t.id for t in merge(w)]).tobytes() for w in shown]

    def learn(self, new: set[str]) -> None:
        words = list(filter(is_word, new))
        self.known.update(zip(words, self.words(words), strict=True))
        rest = list(new.difference(words)) if len(words) < len(new) else []
        self.known.update(zip(rest, self.ids(rest), strict=True))

    def of(self, all_texts: list[str]) -> Iterator[np.ndarray]:
        for a in range(0, len(all_texts), 256):
            parts = [[t] if any(x in t for x in self.special) else PIECES.findall(t) for t in all_texts[a : a + 256]]
            found = [list(map(self.known.get, p)) for p in parts]
            gaps = [[i for i, v in enumerate(f) if v is None] if None in f else () for f in found]
            self.learn({p[i] for p, gap in zip(parts, gaps, strict=True) for i in gap})
            for p, f, gap in zip(parts, found, gaps, strict=True):
                for i in gap:
                    f[i] = self.known[p[i]]
                yield np.frombuffer(b"".join(f), "<u4")
            if len(self.known) > self.most:  # what these texts have is likely to come again
                self.known = {x: self.known[x] for x in set().union(*parts)}


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, shards: int, width: int = 2) -> DataFrame:
    """(shard, path, docs, ids) of the shards written: documents by ascending doc_id, null first, equal ids by a hash of their text.

    A task writes under a name of its own attempt and then renames, so a task that runs again leaves the same file.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, top = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(top, recursive=True)
        path = f"{top}/shard-{task.partitionId():06d}.tok"
        encoder = Encoder(tokenizer_path)  # the task's own: a worker that is kept for other stages is to hold no vocabulary
        with fs.open_output_stream(part := f"{path}.{task.taskAttemptId()}") as out:
            w = Writer(out, width)
            for batch in it:
                ids = encoder.of([t or "" for t in batch.column("text").to_pylist()])
                for doc_id, own in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                    w.add(doc_id, np.append(own, np.uint32(end_id)))
            w.close()
        fs.move(part, path)
        del encoder
        give_back()
        yield rows_out(SHARDS, [[task.partitionId()], [path], [len(w.table)], [w.ids]])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    return rows.repartitionByRange(shards, *keys).sortWithinPartitions(*keys).mapInArrow(run, "shard int, path string, docs long, ids long")


def read_back(spark, folder: str, shards: list) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shard files, from their frames.

    shards: (path, ids before it) by shard; one entry a file, whatever the number of documents.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in it:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with fs.open_input_file(path) as f:
                    r = Reader(f)
                    for a in range(0, len(r.entries), 10_000):
                        some = r.entries[a : a + 10_000]
                        crc = [zlib.crc32(r.document(i).tobytes()) for i in range(a, a + len(some))]
                        yield rows_out(ROWS, [[e[2] for e in some], [before + e[3] for e in some], [e[4] for e in some], crc])

    rows = spark.createDataFrame(shards, "path string, before long").repartition(max(len(shards), 1))
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, shards: int | None = None, folder: str | None = None, width: int = 2) -> DataFrame:
    """Write every whole text of (doc_id, text) as token ids, read the files back, one row per document.

    A null text is empty and leaves the end id alone. Rows with the same doc_id are documents of their own. An empty
    table gives no rows. The documents are range-partitioned by doc_id, one file a partition of SHARD_BYTES of text at
    most (one document at least, and as far as ranges come out even); the driver gets one row a file, from which it counts
    the ids before each. An id that doesn't fit `width` bytes is an error.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark)
    if not shards:
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    found = sorted(write_shards(docs, folder, tokenizer_path, end_id, shards, width).collect(), key=lambda r: r["shard"])
    before, rows = 0, []
    for r in found:
        if r["docs"]:
            rows.append((r["path"], before))
        before += r["ids"]
    return read_back(spark, folder, rows)
