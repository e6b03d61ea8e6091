"""Mixing sources to target weights: token weights raked to marginals, and documents sampled by the calibrated probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

DIMENSIONS = ("source", "lang", "topic")
#: Kinds of text by plain marks, in the order in which they are tried; other texts are prose.
TOPICS = {"table": r"\|[^|\n]*\|", "code": r"[{};]\s*\n|\b(?:def|return|import)\b", "contact": r"@[A-Za-z0-9-]+\.", "legal": r"(?i)licen[sc]e|copyright", "shout": r"[!#$%&*]{2}", "list": r"(?:^|\n)\s*(?:[-*+]|[0-9]+[.)])\s", "figures": r"[0-9]+[.,][0-9]", "question": r"\?"}
ROUNDS = 8


def topic(text: Column) -> Column:
    out = None
    for name, pattern in TOPICS.items():
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise("prose")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """A number of [0, 1) that depends on the id alone."""
    h = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 13)
    return F.conv(h, 16, 10).cast("double") / F.lit(float(1 << 52))


def wanted(cells: DataFrame, d: str, power: float, goal: float, shares: dict[str, float], capped: bool) -> DataFrame:
    """(d, want, full): the tokens that each value of a dimension is to get, `goal` in all, and whether that is all that it has.

    Values named in `shares` get those shares; the rest goes to the others as their tokens to the `power`. With `capped` no
    value gets more than it has, and the others, in the same proportions, get what that leaves over.
    """
    if sum(shares.values()) > 1 + 1e-9 or any(x < 0 for x in shares.values()):
        raise ValueError(f"shares of {d} are negative or over 1")
    values = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("all"))
    named = F.lit(None).cast("double")
    if shares:
        named = F.try_element_at(F.create_map(*(F.lit(x) for kv in shares.items() for x in (kv[0], float(kv[1])))), F.col(d))
    values = written(values.withColumn("named", named))
    rest = values.where("named is null").agg(F.sum(F.pow("all", F.lit(power)))).first()[0] or 1.0
    values = values.withColumn("wish", F.coalesce("named", F.lit(1 - sum(shares.values())) * F.pow("all", F.lit(power)) / F.lit(rest)))
    if not capped:
        whole = values.agg(F.sum("wish")).first()[0] or 1.0
        return values.select(d, (F.lit(goal / whole) * F.col("wish")).alias("want"), F.lit(False).alias("full"))
    by = goal
    while True:  # each turn fills values that the turns before left open, so it ends
        full = F.lit(by) * F.col("wish") >= F.col("all")
        has, open_ = values.agg(F.sum(F.when(full, F.col("all")).otherwise(0.0)), F.sum(F.when(~full, F.col("wish")).otherwise(0.0))).first()
        if not open_ or (goal - has) / open_ <= by * (1 + 1e-12):
            return values.select(d, F.least(F.lit(by) * F.col("wish"), "all").alias("want"), full.alias("full"))
        by = (goal - has) / open_


#: Bounds of a cell's factor, so that it stays finite where targets can't be met together.
LEAST, MOST = 1e-9, 1e6
#: Rounds end when none has changed by as much.
SETTLED = 1e-13


def rake(cells: DataFrame, power: float, rounds: int = ROUNDS, keep: float = 1.0, shares: dict[str, dict[str, float]] | None = None, capped: bool = False) -> DataFrame:
    """cells (the dimensions, tokens > 0) with `p`, what is to be taken of a cell's tokens, and `weight`, its share of what is taken.

    `keep` of all tokens are taken, with the marginals of `wanted`. Each round scales the cells to one dimension's marginals after the other.
    With `capped` p is at most 1: a cell counts with min(1, p), and what a value lacks is got from its cells below 1. A step is
    one partial aggregate by value, joined to the cells, and a round is written; there is one cell for each combination of values that occurs.
    Rounds end early when probabilities have settled.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 1.0)
    for d in DIMENSIONS:
        cells = cells.join(wanted(cells.select(*DIMENSIONS, "tokens"), d, power, keep * total, (shares or {}).get(d, {}), capped).withColumnsRenamed({"want": f"want_{d}", "full": f"full_{d}"}), d)
    cells = written(cells.withColumn("p", F.lit(float(keep))))
    below = F.col("p") < 1 if capped else F.lit(True)
    for _ in range(rounds):
        cells = cells.withColumn("before", F.col("p"))
        for d in DIMENSIONS:
            part = cells.groupBy(d).agg(F.sum(F.when(below, F.col("tokens") * F.col("p")).otherwise(0.0)).alias("open"), F.sum(F.when(~below, F.col("tokens")).otherwise(0)).cast("double").alias("whole"))
            want = F.col(f"want_{d}")
            by = F.when(want < F.col("whole"), want / (F.col("whole") + F.col("open"))).when(F.col("open") > 0, (want - F.col("whole")) / F.col("open")).otherwise(1.0)
            new = F.when(F.col(f"full_{d}"), F.lit(MOST)).otherwise(F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.col("p") * by)))
            cells = cells.join(part, d).withColumn("p", new).drop("open", "whole")
        cells = written(cells)
        if (cells.agg(F.max(F.abs(F.least(F.lit(1.0), "p") - F.least(F.lit(1.0), "before")) if capped else F.abs(F.col("p") - F.col("before")))).first()[0] or 0.0) < SETTLED:
            break
        cells = cells.drop("before")
    p = F.least(F.lit(1.0), "p") if capped else F.col("p")
    return cells.select(*DIMENSIONS, "tokens", p.alias("p"), (p * F.col("tokens") / F.lit(keep * total)).alias("weight"))


def mix(docs: DataFrame, power: float = 0.7, keep: float = 0.8, seed: int = 17, rounds: int = ROUNDS, salts: int = 32, shares: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Every row of (doc_id, text, lang, source) with its topic, words, inclusion probability, and whether it is kept.

    Cells of source, language and topic are raked to marginals that go as tokens to the `power`, or have the shares stated in
    `shares` (by dimension and value), with `keep` of the tokens in all. No value and no cell can be kept more than whole: what
    it lacks goes to the others of its dimension. A cell's documents are kept with its raked probability. A null source or language is a value of its own (an empty string).
    Documents without words have their cell's probability, 1 if none of the cell has words. A document is kept if a hash of its doc_id and the seed, in [0, 1), is
    below its probability; so rows with one doc_id share their draw. An empty table gives no rows. Cells join the
    documents by shuffle in `salts` copies, since one cell may hold any share of them.
    """
    rows = written(measured(docs))
    cells = rows.where("n_tokens > 0").groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))
    return sampled(rows, probabilities(written(cells), power, keep, rounds, shares), seed, salts)


def measured(docs: DataFrame) -> DataFrame:
    some = [F.coalesce(F.col(d).cast("string"), F.lit("")).alias(d) for d in ("source", "lang")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *some, topic(F.coalesce("text", F.lit(""))).alias("topic"), n_words(F.col("text")).alias("n_tokens"))


def probabilities(cells: DataFrame, power: float, keep: float, rounds: int, shares: dict[str, dict[str, float]] | None = None, capped: bool = True) -> DataFrame:
    """The dimensions and the raked `p` of each cell, to nine digits."""
    return written(rake(cells, power, rounds, keep, shares, capped).select(*DIMENSIONS, F.round("p", 9).alias("p")))


def sampled(rows: DataFrame, cells: DataFrame, seed: int, salts: int) -> DataFrame:
    copies = cells.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    out = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(copies, [*DIMENSIONS, "salt"], "left")
    p = F.coalesce("p", F.lit(1.0))
    return out.select("doc_id", *DIMENSIONS, "n_tokens", p.alias("probability"), (draw(F.col("doc_id"), seed) < p).alias("kept"))


def kept(docs: DataFrame, power: float = 0.7, keep: float = 0.8, seed: int = 17, rounds: int = ROUNDS, salts: int = 32, most_cells: int = 50_000, repeat: bool = False, shares: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that mix() keeps. Up to `most_cells` cells are broadcast, so that texts stay where they are.

    With `repeat` a probability may exceed 1: a row comes once for each whole unit and once more if its draw is below
    the rest, so that `keep` of the tokens are expected, with the wanted marginal shares.
    """
    dims = [F.coalesce(F.col(f"doc.{d}").cast("string"), F.lit("")).alias(d) for d in ("source", "lang")]
    rows = docs.select(F.struct(*docs.columns).alias("doc")).select("doc", F.col("doc.doc_id").cast("long").alias("doc_id"), *dims, topic(F.coalesce("doc.text", F.lit(""))).alias("topic"))
    sums = measured(docs).where("n_tokens > 0").groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))
    cells = probabilities(written(sums), power, keep, rounds, shares, not repeat)
    if cells.count() <= most_cells:
        out = rows.join(F.broadcast(cells), [*DIMENSIONS], "left")
    else:
        copies = cells.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        out = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(copies, [*DIMENSIONS, "salt"], "left")
    p = F.coalesce("p", F.lit(1.0))
    if repeat:
        copies = (F.floor(p) + (draw(F.col("doc_id"), seed) < p - F.floor(p)).cast("int")).cast("int")
        return out.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).select("doc.*")
    return out.where(draw(F.col("doc_id"), seed) < p).select("doc.*")


def mixing_sql(rounds: int = ROUNDS, power: float = 0.7, keep: float = 0.8, seed: int = 17, docs: str = "documents") -> str:
    """The same rows as mix() in DuckDB's SQL."""
    case = " ".join(f"when regexp_matches(coalesce(text, ''), '{p}') then '{n}'" for n, p in TOPICS.items())
    steps, last = [], "c0"
    for i in range(rounds):
        for j, d in enumerate(DIMENSIONS):
            n = f"{i}_{j}"
            part = f"sum(case when p < 1 then tokens * p else 0 end) over (partition by {d}) part_open, sum(case when p < 1 then 0 else tokens end) over (partition by {d})::double part_whole"
            by = f"case when want_{d} < part_whole then want_{d} / (part_whole + part_open) when part_open > 0 then (want_{d} - part_whole) / part_open else 1.0 end"
            steps.append(f"s{n} as (select *, {part} from {last})")
            steps.append(f"w{n} as materialized (select * exclude (part_open, part_whole) replace (case when full_{d} then {MOST} else greatest({LEAST}, least({MOST}, p * {by})) end as p) from s{n})")
            last = f"w{n}"
    wants = []
    for d in DIMENSIONS:
        wants.append(f"v_{d} as materialized (select {d}, a, pow(a, {power}) / sum(pow(a, {power})) over () wish from (select {d}, sum(tokens)::double a from cell group by 1))")
        ahead = f"over (order by a / wish, {d} rows between unbounded preceding and 1 preceding)"
        wants.append(f"o_{d} as (select *, ({keep} * (select sum(tokens) from cell) - coalesce(sum(a) {ahead}, 0)) / (1 - coalesce(sum(wish) {ahead}, 0)) c from v_{d})")
        wants.append(f"b_{d} as materialized (select coalesce(arg_min(c, a / wish), 1e300) c from o_{d} where c * wish < a)")
        wants.append(f"t_{d} as materialized (select {d}, least(a, c * wish) want_{d}, c * wish >= a full_{d} from v_{d}, b_{d})")
    return f"""
with m as (select doc_id, coalesce(source, '') source, coalesce(lang, '') lang, case {case} else 'prose' end topic,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::bigint n_tokens from {docs}),
cell as materialized (select source, lang, topic, sum(n_tokens)::bigint tokens from m where n_tokens > 0 group by all),
{", ".join(wants)},
c0 as materialized (select *, {keep}::double p from cell join t_source using (source) join t_lang using (lang) join t_topic using (topic)),
{", ".join(steps)},
f as (select source, lang, topic, round(least(1.0, p), 9) p from {last})
select doc_id, source, lang, topic, n_tokens, coalesce(p, 1.0) probability,
  ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':{seed}'), 1, 13))::bigint / 4503599627370496.0 < coalesce(p, 1.0) kept
from m left join f using (source, lang, topic)"""
