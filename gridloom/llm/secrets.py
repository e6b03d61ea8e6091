"""Secrets: assignments, access keys, hex digests, and random strings found by how badly a tokenizer's vocabulary covers them."""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")  # every access key, digest and candidate lies in one
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Known digests (MD5 to SHA-512 in hex or base64 length) and identifiers (UUID, dates, numbers) are not secrets.
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
IDENTIFIER = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|[0-9+/_=-]+")
LETTERS = re.compile(r"[A-Za-z]+")  # one word, or none: names of several parts have separators or digits
SPANS = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_random", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


@functools.cache
def vocabulary(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[re.Match]]:
    """(start, kind, end) of the three pattern kinds, and the runs in which random strings can lie."""
    found = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(n in low for n in NAMES):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    runs = list(RUN.finditer(text))
    for r in runs:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, r.start(), r.end())]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, r.start(), r.end())]
    return found, runs


def gaps(a: int, b: int, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What ascending spans `taken` leave of the characters a to b."""
    out = []
    for s, _, e in taken:
        if s < b and a < e:
            out.append((a, s))
            a = max(a, e)
    return [(x, y) for x, y in [*out, (a, b)] if x < y]


def random_spans(text: str, runs: list[re.Match], taken: list[tuple[int, int, int]], vocab: tiktoken.Encoding, least: int, ratio: float, digests: frozenset[str]) -> list[tuple[int, int, int]]:
    """What `taken` leaves of runs, `least` characters or more, apart from digests and identifiers, with under `ratio` characters a token."""
    out, taken = [], sorted(taken)
    for r in runs:
        if r.end() - r.start() < least:
            continue
        for a, b in gaps(r.start(), r.end(), taken):
            s = text[a:b].strip("=-_/+")
            if len(s) < least or s.lower() in digests or DIGEST.fullmatch(s) or IDENTIFIER.fullmatch(s):
                continue
            if not any(map(str.isdigit, s)) and not LETTERS.fullmatch(s):
                continue
            if len(s) < ratio * len(vocab.encode_ordinary(s)):
                out.append((a, 3, b))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, vocab_path: str, pattern: str, least: int = 20, ratio: float = 2.0, digests: frozenset[str] = frozenset()) -> DataFrame:
    """Spans of secrets of every row of (doc_id, text), as kind:start:end in code points, end exclusive.

    A null or empty text has none. Texts are scanned whole, row by row: nothing is shuffled, and repeated rows give
    repeated results. `random` spans are runs of the characters of base64 and of identifiers, or what the pattern kinds leave
    of them, `least` or more, whose ratio of characters to tokens is under `ratio`. They have a letter, and a digit unless they
    are letters throughout. Not among them are UUIDs, strings of a digest's form, and `digests` (known ones, in lower case).
    """

    def find(batch: pa.RecordBatch) -> list:
        vocab = vocabulary(vocab_path, pattern)
        rows = []
        for text in batch.column("text").to_pylist():
            base, runs = base_spans(text or "")
            more = random_spans(text or "", runs, base, vocab, least, ratio, digests)
            kinds = [k for _, k, _ in base]
            rows.append((*map(kinds.count, range(3)), len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
        return [batch.column("doc_id"), *zip(*rows, strict=True)]

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(batches(find, SPANS), "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")
