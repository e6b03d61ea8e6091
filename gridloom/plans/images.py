"""Stencils, transfer functions, rays and seeds over the dense image of the line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import clipped
from ..operators import combine, rays, rendering, stencils, stereo, transfer
from ..operators.transfer import Polygon
from ..sources import fixtures as fx
from .rounding import rounded, rounded_sql

SIZE = (fx.NX, fx.NY, fx.NZ)


def _image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.grid(spark, sf_dir).select("x", "y", "z", "v")


def affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stencils.affinity(_image(spark, sf_dir), 0.5, 0.01, (1.0, 0.5, 2.0)))


def gradient_mag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stencils.gradient_magnitude(_image(spark, sf_dir)))


def blur1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stencils.blur(_image(spark, sf_dir), (2, 0, 0)))


def box_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stencils.box_filter(_image(spark, sf_dir), 2))


def median_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stencils.median_filter(_image(spark, sf_dir), 1))


def xgradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stencils.x_gradient(_image(spark, sf_dir)))


def pattern_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stencils.pattern_intensity(fx.grid_pair(spark, sf_dir)))


def retinex_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = _image(spark, sf_dir).withColumn("v", F.col("v") + 1)
    means = [stencils.box_filter(image, r).withColumnRenamed("v", f"b{r}") for r in (1, 3)]
    rows = image.join(means[0], ["x", "y", "z"]).join(means[1], ["x", "y", "z"])
    from ..functions.arithmetic import retinex

    return rounded(rows.select("x", "y", "z", retinex(F.col("v"), [F.col("b1"), F.col("b3")]).alias("v")))


def retinex_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stencils.retinex(_image(spark, sf_dir).withColumn("v", F.col("v") + 1), (1.0, 3.0)))


def vesselness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stencils.vesselness(_image(spark, sf_dir), structure=50.0))


def shape_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencils.shape_interpolation(_image(spark, sf_dir).withColumn("v", (F.col("v") > 38).cast("int")), 2)


def frangi_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets, lines and balls of the image."""
    return rounded(stencils.structures(_image(spark, sf_dir), (0.5, 1.0, 2.0), structure=50.0), 4)


def shape_interp_grey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two new slices between the image's, by its grey levels."""
    return rounded(stencils.grey_interpolation(_image(spark, sf_dir), 2, 12, (0.0, 110.0)))


def _lag(c: str, by: str, f: str = "lag") -> str:
    rest = ", ".join(k for k in "xyz" if k != by)
    return f"{f}({c}) over (partition by {rest} order by {by})"


def _both(c: str, by: str) -> str:
    return f"(coalesce({_lag(c, by, 'lead')}, {c}) - coalesce({_lag(c, by)}, {c}))"


AFFINITY = rounded_sql("with " + fx.GRID + ", t as (select x, y, z, " + ", ".join(f"coalesce(exp(-(0.5::double * {h} * {h} + 0.01::double * pow({_lag('v', k, 'lead')} - v, 2))), 0.0) a{k}" for k, h in (("x", "1.0::double"), ("y", "0.5::double"), ("z", "2.0::double"))) + " from g3)", "ax ay az", "x y z")
GRADIENT = rounded_sql(f"with {fx.GRID}, t as (select x, y, z, 0.5::double * sqrt({' + '.join(f'pow({_both("v", k)}, 2)' for k in 'xyz')}) v from g3)", "v", "x y z")
_BLUR = "0.1065::double * coalesce(" + _lag("v", "x") + ", v) + 0.7866::double * v + 0.1065::double * coalesce(" + _lag("v", "x", "lead") + ", v)"
BLUR = rounded_sql(f"with {fx.GRID}, p as (select x, y, z, {_BLUR} v from g3), t as (select x, y, z, {_BLUR} v from p)", "v", "x y z")
_WINDOW = "g3 a join g3 b on a.z = b.z and abs(a.x - b.x) <= {r} and abs(a.y - b.y) <= {r}"
BOX = rounded_sql(f"with {fx.GRID}, t as (select a.x, a.y, a.z, avg(b.v) v from {_WINDOW.format(r=2)} group by 1, 2, 3)", "v", "x y z")
MEDIAN = rounded_sql(f"with {fx.GRID}, t as (select a.x, a.y, a.z, list(b.v order by b.v)[count(*) // 2 + 1] v from {_WINDOW.format(r=1)} group by 1, 2, 3)", "v", "x y z")
XGRADIENT = rounded_sql(f"with {fx.GRID}, p as (select x, y, z, v, {_lag('v', 'x')} a, {_lag('v', 'x', 'lead')} b from g3), t as (select x, y, z, case when a is not null and b is not null then (b - a) / 2 else coalesce(b - v, v - a, 0.0) end v from p)", "v", "x y z")
PATTERN = rounded_sql(f"""with {fx.GRID_PAIR}, d as (select x, y, z, a - b d from gp), o as (select i, j, k from range(-3, 4) i(i), range(-3, 4) j(j), range(-3, 4) k(k) where i * i + j * j + k * k <= 9),
t as (select sum(100 / (100 + pow(p.d - coalesce(q.d, 0), 2))) intensity from d p cross join o left join d q on q.x = p.x + i and q.y = p.y + j and q.z = p.z + k)""", "intensity")
RETINEX = rounded_sql(f"""with {fx.GRID}, m as (select a.x, a.y, a.z, any_value(a.v) + 1 v, avg(b.v + 1) filter (abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1) b1, avg(b.v + 1) b3 from {_WINDOW.format(r=3)} group by 1, 2, 3),
t as (select x, y, z, (2 * ln(v) - ln(b1) - ln(b3)) / 2 v from m)""", "v", "x y z")

#: Colours by price and number of lines.
LOW, HIGH, STEPS = (0.0, 0.0), (80.0, 100.0), (32, 24)
POLYGONS = [Polygon((1.0, 0.0, 0.0, 0.4), ((0.0, 0.0), (40.0, 0.0), (40.0, 90.0), (0.0, 60.0)), 1), Polygon((0.0, 1.0, 0.0, 0.7), ((30.0, 10.0), (75.0, 20.0), (50.0, 95.0)), 2), Polygon((0.2, 0.2, 1.0, 0.9), ((35.0, 35.0), (60.0, 40.0), (45.0, 65.0)), 3)]
INNER = [Polygon((1.0, 1.0, 1.0, 1.0), ((10.0, 5.0), (70.0, 5.0), (70.0, 80.0), (10.0, 80.0)), 7)]
CLIP = [(1.0, 0.0, 0.0, -3.0), (-1.0, -1.0, 0.0, 50.0)]
HOLE = [(1.0, 0.0, 0.0, -20.0), (-1.0, 0.0, 0.0, 35.0)]


def lut_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table alone: the transfer function has no input but its polygons."""
    return rounded(transfer.lookup_table(spark, POLYGONS, STEPS, LOW, HIGH))


def clip_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = [transfer.lookup_table(spark, p, STEPS, LOW, HIGH) for p in (POLYGONS, INNER)]
    image = fx.grid(spark, sf_dir).withColumn("gradient", F.col("n") % 100)
    return transfer.classify_in_keyhole(image, *tables, STEPS, LOW, HIGH, CLIP, HOLE).select("x", "y", "z", F.col("class").cast("long"))


def _lut_sql(polygons: list[Polygon], name: str) -> str:
    edges = [(k, x0, y0, x1, y1) for k, p in enumerate(polygons) for (x0, y0), (x1, y1) in zip(p.vertices, p.vertices[1:] + p.vertices[:1], strict=True)]
    colors = ", ".join(f"({k}, {', '.join(f'{c}::double' for c in p.color)}, {p.label}::bigint)" for k, p in enumerate(polygons))
    sx, sy = (f"({(h - lo)!r}::double / {n - 1})" for lo, h, n in zip(LOW, HIGH, STEPS, strict=True))
    return f"""{name}_e as (select * from (values {", ".join(f"({k}, {a}::double, {b}::double, {c}::double, {d}::double)" for k, a, b, c, d in edges)}) v(k, x0, y0, x1, y1)), {name}_c as (select * from (values {colors}) v(k, r, green, b, a, class)),
{name}_p as (select i, g, i * {sx} x, g * {sy} y from range({STEPS[0]}) i(i), range({STEPS[1]}) g(g)),
{name}_h as (select i, g, k from {name}_p, {name}_e where (y0 > y) <> (y1 > y) and x < x0 + (y - y0) * ((x1 - x0) / (y1 - y0)) group by 1, 2, 3 having count(*) % 2 = 1),
{name} as (select i, g, coalesce(r, 0) r, coalesce(green, 0) green, coalesce(b, 0) b, coalesce(a, 0) a, coalesce(class, 0) class from {name}_p left join (select i, g, max(k) k from {name}_h group by 1, 2) using (i, g) left join {name}_c using (k))"""


LUT = rounded_sql(f"with {_lut_sql(POLYGONS, 'lut')}, t as (select * from lut)", "r green b a", "i g class")
_at = lambda v, k: f"greatest(0, least({STEPS[k] - 1}, floor(({v} - {LOW[k]!r}::double) / {(HIGH[k] - LOW[k]) / (STEPS[k] - 1)!r}::double + 0.5::double)))::bigint"
_cut = lambda planes: " or ".join(f"-({n[0]} * x + {n[1]} * y + {n[2]} * z + {n[3]}) > 0" for n in planes)
CLASSIFY = f"with {fx.GRID}, {_lut_sql(POLYGONS, 'lut')}, {_lut_sql(INNER, 'lin')}, p as (select x, y, z, {_at('v', 0)} i, {_at('(n % 100)', 1)} g from g3) select x, y, z, case when {_cut(CLIP)} then 0 when not ({_cut(HOLE)}) then -lin.class else lut.class end class from p join lut using (i, g) join lin using (i, g)"


def seed_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.points(spark, sf_dir).select(*((F.col(c) * 4).alias(f"p{c}") for c in "xyz"), (F.col("pid") % 3).alias("label"))
    return combine.seeds(p, 3)


SEEDS = f"with {fx.POINTS} select floor(x * 4 + 0.5::double)::bigint x, floor(y * 4 + 0.5::double)::bigint y, floor(z * 4 + 0.5::double)::bigint z, max((pid % 3 = 0)::int) m0, max((pid % 3 = 1)::int) m1, max((pid % 3 = 2)::int) m2 from pt group by all"


def _rays(spark: SparkSession) -> DataFrame:
    """A ray along x for each half line number and flag."""
    r = spark.range(26).select(F.col("id").alias("ray"), (F.col("id") % 13 / 2).alias("sy"), F.floor(F.col("id") / 13).cast("double").alias("sz"))
    return r.select("ray", F.lit(0.0).alias("sx"), "sy", "sz", F.lit(0.5).alias("ix"), F.lit(0.0).alias("iy"), F.lit(0.0).alias("iz"))


def drr_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rays.radiograph(_rays(spark), _image(spark, sf_dir), SIZE, -0.001, -0.02))


DRR = rounded_sql(f"""with {fx.GRID}, r as (select id ray, (id % 13) / 2 sy, id // 13 sz from range(26) i(id)), k as (select ray, k, k * 0.5::double px, sy, sz from r, range(99) k(k)),
c as (select ray, k, floor(px) + dx x, floor(sy) + dy y, sz z, (case dx when 1 then px - floor(px) else 1 - px + floor(px) end) * (case dy when 1 then sy - floor(sy) else 1 - sy + floor(sy) end) w from k, range(2) a(dx), range(2) b(dy)),
t as (select ray, greatest(0, 256 - exp(sum(e))) v from (select ray, k, 0.5::double * (0.001::double * sum(w * coalesce(v, 0)) + 0.02::double) e from c left join g3 using (x, y, z) where w > 0 group by 1, 2) group by 1)""", "v", "ray")


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v") / 100
    return _image(spark, sf_dir).select((F.col("y") + 7 * F.col("z")).alias("ray"), F.col("x").alias("k"), v.alias("r"), (1 - v).alias("g"), F.lit(0.5).alias("b"), (F.col("v") / 400).alias("a"))


def alpha_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rays.composited(_steps(spark, sf_dir)))


COMPOSITE = rounded_sql(f"""with {fx.GRID}, s as (select y + 7 * z ray, x k, v / 100 r, 1 - v / 100 g, 0.5::double b, v / 400 a from g3),
l as (select *, exp(coalesce(sum(ln(1 - a)) over (partition by ray order by k rows between unbounded preceding and 1 preceding), 0)) w from s),
t as (select ray, sum(w * a * r) r, sum(w * a * g) g, sum(w * a * b) b, sum(w * a) a from l where w >= 1 / 64.0::double group by 1)""", "r g b a", "ray")


def volume_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image along x with the price and line number tables, a keyhole, and rays that end in class 3."""
    tables = [transfer.lookup_table(spark, p, STEPS, LOW, HIGH) for p in (POLYGONS, INNER)]
    image = fx.grid(spark, sf_dir).withColumn("gradient", F.col("n") % 100)
    return rounded(rays.rendered(_rays(spark), image, SIZE, tables[0], STEPS, LOW, HIGH, HOLE, tables[1], 3), 5)


#: A view along x, somewhat aslant, of voxels that lie denser in y and z.
VIEW, PIXELS, STEP, LIGHT = ((0.0, 0.0, 49.0, 0.0), (0.0, 5.5, 0.4, 0.2), (1.7, 0.0, 0.15, 0.1), (0.0, 0.0, 0.0, 1.0)), (6, 12), 0.7, (0.3, 0.6, 0.2, 8.0)


def dual_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of finished and of other lines in one march along the rays of a view, moved by a share of a step, with clip planes, a keyhole's own table, light and depth."""
    tables = [transfer.lookup_table(spark, p, STEPS, LOW, HIGH) for p in (POLYGONS, INNER)]
    pair = fx.grid_pair(spark, sf_dir).select("x", "y", "z", F.col("a").alias("v"), F.col("b").alias("w"))
    view = rendering.jittered(rendering.view_rays(spark, VIEW, *PIXELS, STEP), 5)
    picture = rendering.rendered(view, pair, SIZE, tables[0], STEPS, LOW, HIGH, CLIP, HOLE, tables[1], LIGHT)
    return rounded(rendering.cel_shaded(picture, (0.6, 0.05, 4.0), (0.5, 0.2, 1.0)), 5)


def _beams(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = {k: stencil for k, stencil in zip("xyz", ("gx", "gy", "gz"), strict=True)}
    rows = fx.grid(spark, sf_dir).select("x", "y", "z", (F.col("v") + 100).alias("v"))
    from pyspark.sql import Window

    for k, g in by.items():
        w = Window.partitionBy(*(c for c in "xyz" if c != k)).orderBy(k)
        rows = rows.withColumn(g, F.coalesce(F.lead("v").over(w), F.col("v")) - F.coalesce(F.lag("v").over(w), F.col("v")))
    return rows.select((F.col("y") + 7 * F.col("z")).alias("beam"), F.col("x").alias("k"), "v", "gx", "gy", "gz", F.lit(1.0).alias("ix"), F.lit(0.0).alias("iy"), F.lit(0.0).alias("iz"))


def ct2us_transmission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rays.ultrasound(_beams(spark, sf_dir), 40.0, 20.0))


def ct2us_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = rays.ultrasound(_beams(spark, sf_dir), 40.0, 20.0)
    return rounded(rays.ultrasound_fit(us.withColumn("seen", 3 * F.col("density") - 2 * F.col("reflection") + F.col("transmission"))), 4)


_US = f"""with {fx.GRID}, w as (select x, y, z, v + 100 v from g3), b as (select y + 7 * z beam, x k, v, {", ".join(f"{_both('v', k)} g{k}" for k in "xyz")} from w),
m as (select *, gx * gx + gy * gy + gz * gz g2 from b),
k as (select *, case when sqrt(g2) < 40 then greatest(0, least(1, 1 - g2 * 2 / (4 * v * v))) else 0 end kept, gx * sqrt(g2) / (4 * v * v) echo from m),
s as (select *, sum(case when kept > 0 then ln(kept) else 0 end) over p lp, coalesce(sum((kept <= 0)::int) over q, 0) sq, sum((kept <= 0)::int) over p sp, coalesce(sum(case when kept > 0 then ln(kept) else 0 end) over q, 0) lq from k
  window p as (partition by beam order by k rows between unbounded preceding and current row), q as (partition by beam order by k rows between unbounded preceding and 1 preceding)),
r as (select *, case when sq > 0 then 0 else exp(lq) end reach, case when sp > 0 then 0 else exp(lp) end transmission from s),
u as (select beam, k, transmission, greatest(0, least(1, ln(1 + greatest(-1 + 1e-12, 20 * reach * echo)) / ln(21.0::double))) reflection, case when reach > 0 then 0.5 * 0.00025 * v + 512.0 * 0.00025 else 0 end density from r)"""
TRANSMISSION = rounded_sql(f"{_US}, t as (select * from u)", "transmission reflection density", "beam k")
FIT = rounded_sql(f"""{_US}, o as (select density d, reflection r, 3 * density - 2 * reflection + transmission u from u),
c as (select covar_pop(d, d) dd, covar_pop(r, r) rr, covar_pop(d, r) dr, covar_pop(d, u) du, covar_pop(r, u) ru, avg(d) d, avg(r) r, avg(u) u from o),
f as (select *, (du * rr - ru * dr) / (dd * rr - dr * dr) alpha, (ru * dd - du * dr) / (dd * rr - dr * dr) beta from c), t as (select alpha, beta, u - alpha * d - beta * r bias from f)""", "alpha beta bias", digits=4)


_ends = lambda n, depth: ", ".join(f"{a}::double * (px / {PIXELS[0]}.0::double) + {b}::double * (py / {PIXELS[1]}.0::double) + {c * depth + d!r}::double {n}{k}" for (a, b, c, d), k in zip(VIEW, "xyz", strict=False))
_inside = lambda planes: " and ".join(f"{a}::double * px3 + {b}::double * py3 + {c}::double * pz3 + {d}::double >= -1e-9" for a, b, c, d in planes)
_pick = lambda c: f"case when {_inside(HOLE)} then lin.{c} else lut.{c} end"
_shine = lambda c: f"greatest(0, least(1, ({LIGHT[0]}::double + {LIGHT[1]}::double * f) * {c} + {LIGHT[2]}::double * pow(f, {LIGHT[3]}::double)))"
#: Every step of every ray is made here, and those outside of the box or of the planes are left out one by one.
DUAL = rounded_sql(f"""with {fx.GRID_PAIR}, {_lut_sql(POLYGONS, 'lut')}, {_lut_sql(INNER, 'lin')}, vol as (select x, y, z, a v, b w, {", ".join(f"{_both('a', k)} g{k}" for k in "xyz")} from gp),
pix as (select id ray, id % {PIXELS[0]} px, id // {PIXELS[0]} py from range({PIXELS[0] * PIXELS[1]}) r(id)), en as (select *, {_ends('s', 0.0)}, {_ends('e', 1.0)} from pix),
ln as (select *, greatest(1, ceil(sqrt(pow(ex - sx, 2) + pow(ey - sy, 2) + pow(ez - sz, 2)) / {STEP}::double))::bigint n, ('0x' || substr(md5((px % 16) || ':' || (py % 16) || ':5'), 1, 13))::bigint / 4503599627370496.0::double o from en),
ra as (select ray, px, py, n, (ex - sx) / n ix, (ey - sy) / n iy, (ez - sz) / n iz, sx + o * (ex - sx) / n sx, sy + o * (ey - sy) / n sy, sz + o * (ez - sz) / n sz from ln),
st as (select *, sx + k * ix px3, sy + k * iy py3, sz + k * iz pz3 from ra, range(100) k(k) where k <= n - 1),
pt as (select *, min(k) over (partition by ray) k0 from st where {_inside([(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (-1, 0, 0, SIZE[0] - 1), (0, -1, 0, SIZE[1] - 1), (0, 0, -1, SIZE[2] - 1), *CLIP])}),
co as (select *, floor(px3)::bigint + dx x, floor(py3)::bigint + dy y, floor(pz3)::bigint + dz z, {" * ".join(f"(case d{c} when 1 then p{c}3 - floor(p{c}3) else 1 - (p{c}3 - floor(p{c}3)) end)" for c in "xyz")} wt from pt, range(2) a(dx), range(2) b(dy), range(2) c(dz)),
sm as (select ray, px, py, k, k0, ix, iy, iz, px3, py3, pz3, {", ".join(f"round(sum(wt * coalesce({c}, 0)), 9) {c}" for c in ("v", "w", "gx", "gy", "gz"))} from co left join vol using (x, y, z) where wt > 0 group by all),
cl as (select *, {_at('v', 0)} i, {_at('w', 1)} g, case when gx * gx + gy * gy + gz * gz > 0 then least(1, abs(gx * ix + gy * iy + gz * iz) / (sqrt(gx * gx + gy * gy + gz * gz) * sqrt(ix * ix + iy * iy + iz * iz))) else 0 end f from sm),
tc as (select ray, px, py, k, k0, f, {", ".join(f"{_pick(c)} {c}" for c in ("r", "green", "b", "a"))} from cl join lut using (i, g) join lin using (i, g)),
lf as (select *, coalesce(sum(case when a >= 1 then -1e9 else ln(1 - a) end) over (partition by ray order by k rows between unbounded preceding and 1 preceding), 0) l from tc),
fo as (select ray, px, py, {", ".join(f"sum(exp(l) * a * {_shine(c)}) {n}" for c, n in (("r", "r"), ("green", "g"), ("b", "b")))}, sum(exp(l) * a) a, max(k - k0 + 1) steps from lf where exp(l) >= 1 / 64.0::double group by all),
de as (select *, steps / (max(steps) over ())::double depth from fo),
nx as (select p.*, coalesce(q.depth - p.depth, 0) du, coalesce(s.depth - p.depth, 0) dv from de p left join de q on q.px = p.px + 1 and q.py = p.py left join de s on s.px = p.px and s.py = p.py + 1),
sh as (select *, (1 - 0.6::double * greatest(0, least(1, (sqrt(du * du + dv * dv) - 0.05::double) * 4))) * (1 - 0.5::double * greatest(0, least(1, depth - 0.2::double))) m from nx),
t as (select ray, px, py, r * m r, g * m g, b * m b, a, depth from sh)""", "r g b a depth", "ray px py", 5)


def disparity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v") / 100
    g = fx.grid(spark, sf_dir).select("x", "y", "z", F.array(v, v * v, 1 - v).alias("l"))
    pair = g.join(g.select((F.col("x") - 2).alias("x"), "y", "z", F.col("l").alias("r")), ["x", "y", "z"], "left").withColumn("r", F.coalesce("r", "l"))
    return stereo.disparity(pair, 5, radius=2)


def clip_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fx.grid(spark, sf_dir)
    return g.where(~clipped((F.col("x"), F.col("y"), F.col("z")), CLIP)).select("x", "y", "z", "n")


_MIXED = ", ".join(f"({_both(f'g{i}', j)} + {_both(f'g{j}', i)}) / 2 {i}{j}" for i, j in ("xy", "xz", "yz"))
#: Eigenvalues of the symmetric 3 x 3 matrix by cosines, and ratios of them.
_EIGEN = f"""with {fx.GRID}, g1 as (select x, y, z, {', '.join(f'{_both("v", k)} g{k}' for k in 'xyz')} from g3),
h as (select x, y, z, gx, gy, gz, {', '.join(f'{_both(f"g{k}", k)} {k}{k}' for k in 'xyz')}, {_MIXED} from g1),
h1 as (select *, (xx + yy + zz) / 3 q from h), h2 as (select *, sqrt((pow(xx - q, 2) + pow(yy - q, 2) + pow(zz - q, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) p from h1),
h3 as (select *, case when p = 0 then 0 else greatest(-1, least(1, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p * p * p))) end r from h2),
e as (select *, list_sort(list_transform(range(3), lambda k: [abs(q + 2 * p * cos(acos(r) / 3 + 2 * pi() * k / 3)), q + 2 * p * cos(acos(r) / 3 + 2 * pi() * k / 3)])) e from h3),
l as (select x, y, z, e[1][2] l1, e[2][2] l2, e[3][2] l3, sqrt(gx * gx + gy * gy + gz * gz) g from e),
m as (select *, case when abs(l3) > 1e-12 then l2 / l3 else 0 end / 0.5::double ra, case when sqrt(abs(l2 * l3)) > 1e-12 then l1 / sqrt(abs(l2 * l3)) else 0 end / 0.5::double rb, case when abs(l3) > 1e-12 then g / abs(l3) else 0 end rl, 1 - exp(-(l1 * l1 + l2 * l2 + l3 * l3) / 5000) s from l)"""
FRANGI = rounded_sql(f"""{_EIGEN}, f as (select x, y, z, (1 - exp(-rl * rl / 2)) * exp(-ra * ra / 2) * exp(-rb * rb / 2) * s sheet, (1 - exp(-ra * ra / 2)) * exp(-rb * rb / 2) * s line, exp(-rl * rl / 2) * (1 - exp(-rb * rb / 2)) * s blob from m),
t as (select *, 0.5::double * sheet + line + 2 * blob v from f)""", "sheet line blob v", "x y z", 4)
VESSELS = rounded_sql(f"{_EIGEN}, t as (select x, y, z, case when l2 < 0 and l3 < 0 then (1 - exp(-ra * ra / 2)) * exp(-rb * rb / 2) * s else 0 end v from m)", "v", "x y z")
#: The chamfer distance of an offset is 1000 times its greatest part and 314 times the others.
GREY = rounded_sql(f"""with {fx.GRID}, own as (select x, y, z, greatest(0, least(11, floor(11 / 110.0::double * v)))::bigint b from g3),
lift as (select own.*, g from own, range(-1, 13) l(g)),
far as (select l.x, l.y, l.z, l.g, any_value(l.g <= l.b) inside, min(686 * greatest(abs(l.x - o.x), abs(l.y - o.y), up) + 314 * (abs(l.x - o.x) + abs(l.y - o.y) + up)) d
  from lift l join (select *, unnest(range(-1, 13)) g from own) o on o.z = l.z and o.g = l.g, lateral (select case when l.g <= l.b then greatest(0, o.b + 1 - l.g) else greatest(0, l.g - o.b) end up) group by all),
sd as (select x, y, z, g, case when inside then d else -d end d from far),
mid as (select p.x, p.y, p.z * 3 + k z, greatest(count(*) filter (p.d * (3 - k) + n.d * k > 0) - 1, 0) b from sd p join sd n on n.x = p.x and n.y = p.y and n.g = p.g and n.z = p.z + 1, range(1, 3) t(k) where p.g >= 0 group by all),
t as (select x, y, z, b * 110.0::double / 11 v from (select x, y, z * 3 z, b from own union all select * from mid))""", "v", "x y z")

QUERIES = {f.__name__: f for f in (affinity, gradient_mag, blur1d, box_filter, median_filter, xgradient, pattern_intensity, retinex_mix, retinex_gaussian, vesselness, frangi_structures, shape_interp, shape_interp_grey, lut_polygon, clip_classify, clip_planes, seed_raster, drr_projection, alpha_composite, volume_render, dual_render, ct2us_transmission, ct2us_fit, disparity)}
ORACLES = {"dual_render": DUAL, "frangi_structures": FRANGI, "vesselness": VESSELS, "shape_interp_grey": GREY, "affinity": AFFINITY, "gradient_mag": GRADIENT, "blur1d": BLUR, "box_filter": BOX, "median_filter": MEDIAN, "xgradient": XGRADIENT, "pattern_intensity": PATTERN, "retinex_mix": RETINEX, "lut_polygon": LUT, "clip_classify": CLASSIFY, "clip_planes": f"with {fx.GRID} select x, y, z, n from g3 where not ({_cut(CLIP)})", "seed_raster": SEEDS, "drr_projection": DRR, "alpha_composite": COMPOSITE, "ct2us_transmission": TRANSMISSION, "ct2us_fit": FIT}
