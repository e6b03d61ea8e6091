"""Links and components against all pairs, and the contract's cases."""

import random

import pytest

from gridloom.llm import ngram_join
from gridloom.llm.components import components
from gridloom.llm.queries import op6_ngram_jaccard_join


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def corpus(seed, n=160):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    base = [[word() for _ in range(rng.choice((3, 6, 30, 60, 200)))] for _ in range(8)]
    hot = [word() for _ in range(80)]
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(n):
        w = list(hot if i % 3 == 0 else rng.choice(base))
        if i % 7 == 0:
            w = passage + [word() for _ in range(rng.randrange(1, 25))]
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
            w[rng.randrange(len(w))] = word()
        rows.append((i * 3 + 1, (" " if i % 2 else "\n").join(w).title() if i % 5 == 0 else " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {tuple(r) for r in ngram_join.near_duplicates(df).collect()}
    assert got == plain(rows)


def test_the_last_step_finds_what_rounds_do_not(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    rows = corpus(4, 90)
    got = {tuple(r) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == plain(rows)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(40_000))
    rows = [(5, None), (6, ""), (7, " \n\t"), (8, "a b"), (9, "A  b"), (9, "A  b"), (10, "b a"), (None, "a b"), (11, long), (12, long + " y"), (13, "é É a b c"), (14, "É É a b c")]
    got = sorted(map(tuple, ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, 8), (9, 1, 8), (9, 1, 8), (10, 1, 10), (None, 1, 8), (11, 39996, 11), (12, 39997, 11), (13, 1, 13), (14, 1, 14)], key=str)


def test_empty_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.near_duplicates(none).count() == 0 and ngram_join.one_of_each(none).count() == 0
    rows = [(1, "a b c d e f", 1, "p"), (2, "a b c d e f", 2, "q"), (2, "z", 3, "r"), (None, "a b c d e f", 4, None), (1, "a b c d e f", 5, "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, c long, h string")
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.where("doc_id is not null").collect())[0] == (1, "a b c d e f")
    assert kept.where("doc_id is null").count() == 1


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 130), 100)}


def test_query_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert {tuple(r) for r in op6_ngram_jaccard_join(spark, sf).collect()} == plain([tuple(r) for r in docs.collect()])


def test_great_component_meets_the_rest_with_a_few_sets_first(spark, monkeypatch):
    """Near copies of one text, many not linked with each other: few of a component are taken first, then all, and the components are those of all pairs."""
    import random

    from gridloom.llm import ngram_join

    rnd, calls, across = random.Random(5), [], ngram_join.Join.across

    def seen(self, rows, few, turn):
        out = across(self, rows, few, turn)
        calls.append(out[1])
        return out

    monkeypatch.setattr(ngram_join, "FEW", 1)
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    monkeypatch.setattr(ngram_join.Join, "across", seen)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(160):
        words = list(base)
        for _ in range(i % 6):
            words[rnd.randrange(120)] = f"x{rnd.random()}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[j : j + 5]) for j in range(116)} for _, t in rows]
    least = list(range(160))
    for _ in range(160):
        new = [min(least[b] for b in range(160) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])) for a in range(160)]
        if new == least:
            break
        least = new
    assert got == dict(enumerate(least))
    assert calls[-1:] == [True] and (len(calls) == 1 or not calls[0])


def test_a_small_graph_needs_one_table(spark, monkeypatch):
    from gridloom.llm import components as module

    tables = []
    monkeypatch.setattr(module, "written", lambda df, write=module.written: tables.append(1) or write(df))
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 130)]
    random.Random(2).shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 130), 100)} and len(tables) == 1


def test_components_of_more_than_one_run(spark, monkeypatch):
    from gridloom.llm import components as module

    rng = random.Random(3)
    edges = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(70)] + [(i, i + 1) for i in range(100, 130)]
    rng.shuffle(edges)
    least = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in least:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    monkeypatch.setattr(module, "RUN", 8)
    for given in (edges, []):
        got = {r["node"]: r["root"] for r in components(spark.createDataFrame(given, "a long, b long").repartition(3)).collect()}
        assert got == (least if given else {})
