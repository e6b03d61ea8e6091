"""Unit maps, hierarchies, max-flow, connectedness and registration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms
from ..operators import combine, flow, hierarchy, maps, registration, stencils
from ..operators.hierarchy import LabelGraph
from ..operators.maps import UnitMap
from ..sources import fixtures as fx
from . import apps
from .rounding import rounded, rounded_sql

CHANNELS = ["f0", "f1"]
#: A map of three by two units over the first two components.
UNITS = UnitMap(3, np.array([0.1, 0.2, 0.15, 0.25, 0.2, 0.1]), np.array([[-0.15, -0.1], [0.0, -0.12], [0.14, -0.08], [-0.12, 0.1], [0.02, 0.11], [0.16, 0.09]]), np.array([[0.01, 0.02], [0.015, 0.01], [0.02, 0.02], [0.01, 0.01], [0.03, 0.02], [0.02, 0.015]]))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors with their labels, in one pass."""
    return fx.vectors(spark, sf_dir, 2, "label")


def bmu_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.best_units(fx.vectors(spark, sf_dir, 2), "pid", CHANNELS, UNITS)


def ksom_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(maps.probability(fx.vectors(spark, sf_dir, 2), "pid", CHANNELS, UNITS))


def ksom_responsibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(maps.responsibilities(_vectors(spark, sf_dir), "label", CHANNELS, UNITS))


def ksom_label_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(maps.label_costs(_vectors(spark, sf_dir), "label", CHANNELS, UNITS))


def pagmm_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(maps.agreed_costs(_vectors(spark, sf_dir), "label", CHANNELS, UNITS))


def ksom_reproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = bmu_assign(spark, sf_dir).select("pid", (F.col("ux") + 0.25).alias("px"), (F.col("uy") + 0.5).alias("py"))
    return rounded(maps.reprojected(at, "px", "py", UNITS).select("pid", "m0", "m1"))


def _rows(units: UnitMap) -> list[tuple]:
    return [(i % units.nx, i // units.nx, float(units.weight[i]), *map(float, units.mean[i]), *map(float, units.var[i])) for i in range(len(units.weight))]


def _as_table(spark: SparkSession, units: UnitMap) -> DataFrame:
    n = units.mean.shape[1]
    cols = ["weight", *(f"mean{k}" for k in range(n)), *(f"var{k}" for k in range(n))]
    return spark.createDataFrame(_rows(units), ", ".join(["ux long", "uy long", *(f"{c} double" for c in cols)]))


def batch_som_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_as_table(spark, maps.epoch(fx.vectors(spark, sf_dir, 2), "pid", CHANNELS, UNITS, 0.5, 0.8)))


def ksom_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = maps.train(fx.vectors(spark, sf_dir, 4), "pid", [f"f{i}" for i in range(4)], 2, 2, 4, [(0, 0.8), (3, 0.3)], [(0, 0.5), (3, 0.2)], doublings=1)
    return rounded(_as_table(spark, units), 4)


_UNIT = f"unit as (select * from (values {', '.join('(' + ', '.join(f'{v!r}::double' if isinstance(v, float) else f'{v}::bigint' for v in r) + ')' for r in _rows(UNITS))}) v(ux, uy, w, m0, m1, v0, v1))"
_COST = f"with {fx.vectors_sql(2)}, {_UNIT}, c as (select pid, ux, uy, (pow(f0 - m0, 2) / v0 + pow(f1 - m1, 2) / v1) / 2 + ln(v0 * v1) / 2 - ln(w) cost, f0, f1 from vec, unit)"
_BEST = "b as (select pid, ux, uy, f0, f1 from (select *, row_number() over (partition by pid order by cost, uy desc, ux desc) k from c) where k = 1)"
BMU = f"{_COST}, {_BEST} select pid, ux, uy from b"
PROBABILITY = rounded_sql(f"{_COST}, m as (select pid, min(cost) m from c group by 1), t as (select pid, any_value(m) - ln(sum(exp(m - cost))) + ln(2 * pi()) p from c join m using (pid) group by 1)", "p", "pid")
_SHARES = f"{_COST}, e as (select *, exp(-cost) / sum(exp(-cost)) over (partition by pid) r from c), l as (select label::bigint as label, ux, uy, r from e join embeddings on vec_id = pid)"
RESPONSIBILITY = rounded_sql(f"{_SHARES}, t as (select label, ux, uy, sum(r) responsibility from l group by all)", "responsibility", "label ux uy")
LABEL_COST = rounded_sql(f"{_SHARES}, t as (select label, ux + 3 * uy as unit, ln(count(*)) - ln(sum(r) + 0.1::double) cost from l group by all)", "cost", "label unit")
PAGMM = rounded_sql(f"{_SHARES}, g as (select label, ux + 3 * uy as unit, sum(ln(r)) / count(*) v from l group by all), t as (select label, unit, exp(v) / sum(exp(v)) over (partition by label) p from g)", "p", "label unit")
_share = lambda d: "greatest(0, 1 - abs({0} - {1}))".format(*d)
REPROJECT = rounded_sql(f"{_COST}, {_BEST}, q as (select pid, least(ux + 0.25::double, 2) px, least(uy + 0.5::double, 1) py from b), t as (select pid, sum(m0 * w) m0, sum(m1 * w) m1 from (select pid, m0, m1, {_share(('px', 'ux'))} * {_share(('py', 'uy'))} w from q, unit) group by 1)", "m0 m1", "pid")
EPOCH = rounded_sql(f"""{_COST}, {_BEST}, n as (select ux, uy, count(*) n, sum(f0) s0, sum(f1) s1, sum(f0 * f0) q0, sum(f1 * f1) q1 from b group by 1, 2),
h as (select u.ux, u.uy, any_value(w) w, any_value(m0) m0, any_value(m1) m1, any_value(v0) v0, any_value(v1) v1, {", ".join(f"sum({c} * exp(-(pow(u.ux - n.ux, 2) + pow(u.uy - n.uy, 2)) / (2 * 0.8 * 0.8::double))) {c}" for c in ("n", "s0", "s1", "q0", "q1"))} from unit u, n group by 1, 2),
i as (select *, w + 0.5 * (greatest(n / (select sum(n) from h), 1e-9) - w) weight from h),
t as (select ux, uy, weight / (select sum(weight) from i) weight, {", ".join(f"m{k} + 0.5 * (s{k} / n - m{k}) mean{k}, greatest(1e-3, v{k} + 0.5 * (greatest(q{k} / n - s{k} / n * s{k} / n, 1e-3) - v{k})) var{k}" for k in (0, 1))} from i)""", "weight mean0 mean1 var0 var1", "ux uy")

#: Three classes below one root.
POTTS = LabelGraph((("root", "low", 1.0), ("root", "mid", 1.0), ("root", "high", 1.0)))
#: Air, and three classes in groups that overlap in one of them.
OVERLAPS = LabelGraph((("body", "air", 1.0), ("body", "soft", 1.0), ("body", "firm", 1.0), ("soft", "fat", 1.0), ("soft", "muscle", 0.25), ("body", "muscle", 0.5), ("firm", "muscle", 0.25), ("firm", "bone", 1.0)))
CENTERS = {"low": 20.0, "mid": 38.0, "high": 56.0}
ALPHA = 0.5


def _start(spark: SparkSession, sf_dir: str) -> DataFrame:
    data: dict[str, Column] = {k: terms.gaussian(F.col("v"), 12, c, True) for k, c in CENTERS.items()}
    return flow.start(fx.grid(spark, sf_dir), POTTS, data, {k: F.lit(ALPHA) for k in CENTERS})


def _state(df: DataFrame) -> DataFrame:
    nodes = POTTS.order[1:]
    at = F.array(*(F.struct(F.lit(k).alias("node"), *(F.col(c)[i].alias(c) for c in ("fx", "fy", "fz", "div", "sink", "label"))) for i, k in enumerate(nodes)))
    return rounded(df.select("x", "y", "z", F.col("source")[0].alias("source"), F.inline(at)))


def maxflow_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(_start(spark, sf_dir))


def maxflow_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(flow.run(_start(spark, sf_dir), POTTS, flow.Knobs(iterations=1)))


def maxflow_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmentation by overlapping groups: the winning class of each voxel after twelve iterations."""
    v = F.col("v")
    data = {"air": terms.gaussian(v, 8, 5, True), "fat": terms.gaussian(v, 12, 20, True), "muscle": terms.gaussian(v, 12, 38, True), "bone": terms.gaussian(v, 12, 56, True)}
    smooth = {k: F.lit(0.2 if k in OVERLAPS.leaves else 0.1) for k in OVERLAPS.order[1:]}
    state = flow.run(flow.start(fx.grid(spark, sf_dir), OVERLAPS, data, smooth), OVERLAPS, flow.Knobs(iterations=12, per_round=6))
    won = combine.vote(flow.leaf_labels(state, OVERLAPS))
    return rounded(won.select("voxel.*", F.col("slot").cast("long").alias("class"), "value"), 4)


_D = ", ".join(f"pow((v - {c}) / 12, 2) / 2 d{i}" for i, c in enumerate(CENTERS.values()))
_INIT = f"""with {fx.GRID}, d as (select x, y, z, {_D} from g3), m as (select *, least(d0, d1, d2) m from d), i as (select *, m source, 1.0::double / ((d0 = m)::int + (d1 = m)::int + (d2 = m)::int) share from m),
u as (select x, y, z, m, source, d, node, case when d = m then share else 0.0::double end u from (select x, y, z, m, source, share, unnest([{", ".join(f"{{'node': '{k}', 'd': d{i}}}" for i, k in enumerate(CENTERS))}], recursive := true) from i))"""
INIT = rounded_sql(f"{_INIT}, t as (select x, y, z, source, node, 0.0::double fx, 0.0::double fy, 0.0::double fz, 0.0::double div, m sink, u as label from u)", "source fx fy fz div sink label", "x y z node")
_by = lambda c, k, f: f"{f}({c}) over (partition by node, {', '.join(a for a in 'xyz' if a != k)} order by {k})"
STEP = rounded_sql(f"""{_INIT}, e as (select *, -0.1::double * u / 0.25 e from u),
f as (select *, {", ".join(f"coalesce(-(e - {_by('e', k, 'lag')}), 0) g{k}" for k in "xyz")} from e),
s as (select *, sqrt(0.5::double * ({" + ".join(f"g{k} * g{k} + coalesce(pow({_by(f'g{k}', k, 'lead')}, 2), 0)" for k in "xyz")})) size from f),
c as (select *, case when size > {ALPHA} then {ALPHA} / size else 1.0 end scale from s),
p as (select *, {", ".join(f"g{k} * 0.5::double * (scale + coalesce({_by('scale', k, 'lag')}, scale)) f{k}" for k in "xyz")} from c),
v as (select *, {" + ".join(f"f{k} - coalesce({_by(f'f{k}', k, 'lead')}, 0)" for k in "xyz")} div from p),
w as (select *, least(d, source - div + u / 0.25) sink from v),
t as (select x, y, z, node, (1 / 0.25 + sum(div + sink - u / 0.25) over (partition by x, y, z)) / 3 source, fx, fy, fz, div, sink, u - 0.25 * (sink + div - source) as label from w)""", "source fx fy fz div sink label", "x y z node")


def seeded_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three classes from seeds at the cheap, middle and dear end of the image."""
    image = fx.grid(spark, sf_dir).select("x", "y", "z", "v")
    ends = F.when(F.col("x") < 8, 0).when(F.col("x").between(21, 28), 1).when(F.col("x") > 41, 2)
    seeds = image.where("y = 3").select(*(F.col(c).cast("double").alias(f"p{c}") for c in "xyz"), ends.alias("label")).where("label is not null")
    return rounded(apps.segmented_from_seeds(image, seeds, 3, 24, 0.05, flow.Knobs(iterations=16, per_round=8)), 4)


def flow_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flow.data_energy(_start(spark, sf_dir), POTTS), 4)


def flow_smoothness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flow.smoothness_energy(_start(spark, sf_dir), POTTS), 4)


_half = lambda k: f"(coalesce({_by('u', k, 'lead')}, u) - coalesce({_by('u', k, 'lag')}, u))"
ENERGY = rounded_sql(f"{_INIT}, t as (select sum(u * d) energy from u)", "energy", digits=4)
SMOOTHNESS = rounded_sql(f"{_INIT}, g as (select node, {ALPHA} * 0.5::double * sqrt({' + '.join(f'pow({_half(k)}, 2)' for k in 'xyz')}) e from u), t as (select node, sum(e) energy from g group by 1)", "energy", "node", 4)


def dag_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.levels(fx.hierarchy(spark, sf_dir))


def dag_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.table(spark, sf_dir, "customer")
    return rounded(hierarchy.roll_up(fx.hierarchy(spark, sf_dir), c.select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.col("c_acctbal").alias("value"))), 3)


LEVELS = f"with recursive {fx.HIERARCHY}, walk as (select 'root' node, 0::bigint l union all select dst, l + 1 from walk join edge on src = node) select node, max(l) up, min(l) down from walk group by 1"
ROLLUP = rounded_sql(f"with recursive {fx.HIERARCHY}, walk as (select 'c' || c_custkey node, c_acctbal v from customer union all select src, v * weight from walk join edge on dst = node), t as (select node, sum(v) total from walk group by 1)", "total", "node", 3)


def fuzzy_connect(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fx.grid(spark, sf_dir).select("x", "y", "z", "v")
    near = stencils.affinity(g, 0.0, 0.02)
    seeds = (F.col("x") == 25) & (F.col("y") == 3) & (F.col("z") == 1)
    return rounded(flow.connectedness(near.withColumn("seed", seeds.cast("double"))))


def powell_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image against itself moved by two along x: found from a start half way."""
    g = fx.grid(spark, sf_dir).select("x", "y", "z", "v")
    return registration.register_shift(g, g.withColumn("x", F.col("x") - 2), [(0.0, 3.0), (0.0, 0.0), (0.0, 0.0)], tolerance=0.3)


QUERIES = {f.__name__: f for f in (bmu_assign, ksom_probability, ksom_responsibility, ksom_label_cost, pagmm_shares, ksom_reproject, batch_som_epoch, ksom_train, maxflow_init, maxflow_step, maxflow_run, seeded_segmentation, flow_energy, flow_smoothness, dag_levels, dag_rollup, fuzzy_connect, powell_register)}
ORACLES = {"bmu_assign": BMU, "ksom_probability": PROBABILITY, "ksom_responsibility": RESPONSIBILITY, "ksom_label_cost": LABEL_COST, "pagmm_shares": PAGMM, "ksom_reproject": REPROJECT, "batch_som_epoch": EPOCH, "maxflow_init": INIT, "maxflow_step": STEP, "flow_energy": ENERGY, "flow_smoothness": SMOOTHNESS, "dag_levels": LEVELS, "dag_rollup": ROLLUP}
