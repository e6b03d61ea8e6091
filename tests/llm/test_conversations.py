"""The trie against a plain one, and what it does with odd rows."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from gridloom.llm import common, conversations, queries

DDL = "conv_id long, turn long, role string, text string, key string, n long, part int"


def plain(rows):
    """The contract read row by row: {(conv_id, depth): (parent, members, children, leaves, saved, hash)}."""
    own = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), (r, x)))
    own = {c: [s[3] for s in sorted(v, key=lambda s: s[:3])] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = {}

    def walk(p):
        below = [walk(k) for k in kids[p]]
        leaves = sum(b[0] for b in below) or 1
        saved = sum(b[1] for b in below) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(built[c]) == len(p))))
        out[min(members[p]), len(p)] = (min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
        return leaves, saved

    if members:
        walk(())
    return out


def result(spark, rows):
    df = conversations.conversation_trie(spark.createDataFrame(rows, DDL))
    return {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect()}


def row(c, t, r="user", x="a"):
    return (c, t, r, x, "clash", 1, 2)


def test_random_conversations(spark):
    rnd = random.Random(7)
    rows = [row(c, t, rnd.choice(["user", "bot"]), rnd.choice(["é", "bb", "ccc"])) for c in rnd.sample(range(420), 150) for t in range(rnd.choice([1, 2, 5, 6, 7, 9]))]
    assert result(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [row(1, None), row(1, 0, None, None), row(1, 0, "", ""), row(1, 0), row(1, 0), row(None, 3), row(-5, 1), row(-5, 2, "user", ""), row(205, 0), row(100, 1, None, "x" * 5000), row(7, 1, "a", "b"), row(8, 1, "ab", "")]
    rows += [row(300 + i, t, "user", "same") for i in range(8) for t in range(7)]
    assert result(spark, rows) == plain(rows)


def test_one_conversation_and_none(spark):
    assert result(spark, []) == {}
    rows = [row(3, t, "u", str(t)) for t in range(9)]
    assert result(spark, rows) == plain(rows)


def test_a_conversation_over_many_tasks_and_a_hot_class(spark):
    """Numbers run on over tasks; long lists of members are hashed in pieces."""
    rows = [row(5, i // 3, "u", str(i % 2)) for i in range(3000)]
    got = {(r["conv_id"], r["at"]) for r in conversations.turns(spark.createDataFrame(rows, DDL)).collect()}
    assert got == {(5, i + 1) for i in range(3000)}
    rows = [row(c, t, "u", "hot") for c in range(0, 40_000, 100) for t in range(2)]
    old, conversations.PIECE = conversations.PIECE, 50
    try:
        assert result(spark, rows) == plain(rows)
    finally:
        conversations.PIECE = old


def test_query_is_the_sql(spark, sf):
    got = queries.op11_conversation_trie(spark, sf).toPandas()
    want = duckdb.sql(queries.OP11_SQL.replace("from conversations where", f"from '{sf}/conversations.parquet' where")).df()
    key = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist()))
    assert len(got) and [tuple(map(str, x)) for x in key(got.astype({"parent_conv_id": "Int64"}))] == [tuple(map(str, x)) for x in key(want.astype({"parent_conv_id": "Int64"}))]


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_heavy_facts_are_broadcast_and_the_rest_joined(spark, most):
    rows = spark.createDataFrame([(i % 7 if i % 2 else 9, i) for i in range(200)], "k long, v long")
    facts = spark.createDataFrame([(k, f"f{k}", 100 if k == 9 else 20) for k in (0, 1, 2, 3, 9)], "k long, name string, weight long")
    got = {(r["v"], r["name"]) for r in common.attached(rows, facts, ["k"], most).collect()}
    assert got == {(v, f"f{k}") for k, v in ((i % 7 if i % 2 else 9, i) for i in range(200)) if k in (0, 1, 2, 3, 9)}
