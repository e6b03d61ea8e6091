"""Ids against the tokenizer's own of whole texts, and exact round trips of the files."""

import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm import token_files
from gridloom.llm.queries import op8_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
ENCODER = token_files.Encoder(PATH)


def own(texts):
    return [e.ids for e in WHOLE.encode_batch(list(texts), add_special_tokens=False)]


def plain(rows, end=2):
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*own([t or ""])[0], end], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t'abzABé1.?!ßñ’́жи中 　<|>_-")), max_size=60))
def test_pieces_agree_with_whole_texts(text):
    assert next(ENCODER.of([text])).tolist() == own([text])[0]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    assert next(ENCODER.of([text])).tolist() == own([text])[0]


@pytest.mark.parametrize("text", ["", "I'll  we're don't 'tis", "a\n\nb \n c", " lead", "trail ", "<|endoftext|> x <|endoftext|>", "a<|endoftext|b", "x" * 5000, "naïve café\r\nÀ", "l'été d’hiver", "éa ́b"])
def test_hard_texts(text):
    assert next(ENCODER.of([text])).tolist() == own([text])[0]


def test_memory_is_bounded():
    e = token_files.Encoder(PATH)
    e.most = 50
    texts = [f"word{'abcdefgh'[i % 8] * (i % 11 + 1)} plus {i} more" for i in range(900)]
    assert [x.tolist() for x in e.of(texts)] == own(texts) and len(e.known) < 5000


def test_shard_format():
    out = io.BytesIO()
    w = token_files.Writer(out)
    docs = [(5, [1, 2, 3]), (None, [2]), (9, list(range(3000)))]
    for d, ids in docs:
        w.add(d, np.array(ids, "<u4"))
    w.close()
    r = token_files.Reader(out)
    assert [(e[2], r.document(i).tolist()) for i, e in enumerate(r.entries)] == docs
    assert [(d, x.tolist()) for d, x in r.find([9])] == [docs[2]]
    whole = b"".join(zstandard.ZstdDecompressor().decompress(out.getvalue()[e[0] : e[0] + e[1]], max_output_size=1 << 20) for e in r.entries)
    assert np.frombuffer(whole, "<u2").tolist() == [i for _, ids in docs for i in ids]
    raw = bytearray(out.getvalue())
    raw[r.entries[2][0] + 30] ^= 255
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.Reader(io.BytesIO(bytes(raw))).document(2)
    with pytest.raises(ValueError):
        token_files.Reader(io.BytesIO(bytes(64)))


def test_reading_one_document_reads_only_its_frame():
    out = io.BytesIO()
    w = token_files.Writer(out)
    for d in range(50):
        w.add(d, np.random.default_rng(d).integers(0, 50_000, 400).astype("<u4"))
    w.close()
    r = token_files.Reader(out)
    got = []
    r._read = lambda at, n, read=r._read: got.append(n) or read(at, n)
    r.document(7)
    assert got == [r.entries[7][1]]


def test_odd_rows(spark):
    long = "word and " * 30_000
    rows = [(3, "b"), (1, None), (2, ""), (3, "b"), (None, "no id"), (-4, "minus"), (7, long)]
    got = [tuple(r) for r in token_files.token_files(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, start long"), PATH, shards=3).collect()]
    assert sorted(got, key=lambda r: r[1]) == plain(rows)
    assert token_files.token_files(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_query_on_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op8_token_files(spark, sf).collect())) == plain(rows)
