"""Spans against a plain reading of the contract."""

import hashlib
import random
import re

import public_tokenizers
import pytest

from gridloom.llm import secrets
from gridloom.llm.queries import op4_token_efficiency_secrets

KINDS = ["assign", "access", "hex", "random"]


def plain(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return found


def digest(found):
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)).encode()).hexdigest()


def scan(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r for r in secrets.scan(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()}


def test_base_spans_of_random_texts(spark):
    rng = random.Random(5)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "ſecret", "toKen", '"', "'", " ", " ", ":", "=", "AKIA", "AKIAAKIA", "ABCDEFGH12345678", "deadbeef" * 4, "0123456789abcdef", "é", "Ω", "\n", ".", "-x", "abc", "A1B2C3D4", "==", "zz"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 40)))) for i in range(400)] + [(1000, None), (1001, "")]
    got = scan(spark, rows)
    for i, text in rows:
        want = plain(text)
        r = got[i]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [[k for _, k, _ in want].count(j) for j in range(3)]
        assert r["base_sha256"] == digest(want)
        assert set(f"{KINDS[k]}:{a}:{b}" for a, k, b in want) <= set(r["spans"].split(",")) | {""}


def test_random_strings_and_what_is_not_one(spark):
    key = "q7Zp2XvK9mTjR4wB8nLc5HdF1sGyU3eA"
    rows = [(1, f"use {key} here"), (2, "550e8400-e29b-41d4-a716-446655440000 and D41D8CD98F00B204E9800998ECF8427E"), (3, "internationalization of_the_configuration_2024 characteristically"), (4, "1234567890-2024-01-01-99999999999"), (5, f"token={key}"), (6, f"é {key} {key}")]
    got = scan(spark, rows)
    assert got[1]["spans"] == "random:4:36" and got[1]["n_random"] == 1
    assert [got[i]["spans"] for i in (2, 3, 4)] == ["", "", ""]
    assert got[5]["spans"] == "assign:0:38"
    assert got[6]["spans"] == "random:2:34,random:35:67"


def test_letters_alone_known_digests_and_rests_of_runs(spark):
    rng = random.Random(3)
    letters = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=32)) for _ in range(200)]
    got = scan(spark, list(enumerate(letters)))
    assert sum(r["spans"] == "random:0:32" for r in got.values()) >= 190
    key = "q7Zp2XvK9mTjR4wB8nLc5HdF1sGyU3eA"
    names = "the internationalizationconfiguration of counterrevolutionaries and some/path/of/many-parts_and/names"
    rows = [(1, "0123456789abcdef" * 2 + "+" + key), (2, names), (3, f"see {key}"), (4, "z" * 4000)]
    got = scan(spark, rows)
    assert got[1]["spans"] == "hex:0:32,random:32:65" and got[2]["spans"] == "" and got[4]["spans"] == ""
    known = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=frozenset([key.lower()]))
    assert {r["doc_id"]: r["spans"] for r in known.collect()}[3] == ""


def test_empty_table_and_repeats(spark):
    assert scan(spark, []) == {}
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "x")], "doc_id long, text string, spans string")
    assert secrets.scan(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 2


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_query_on_the_table(spark, table):
    path = f"/root/testdata/{table}"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = op4_token_efficiency_secrets(spark, path).collect()
    assert len(rows) == len(texts) and all(r["base_sha256"] == digest(plain(texts[r["doc_id"]])) for r in rows)
