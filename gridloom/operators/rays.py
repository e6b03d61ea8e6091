"""Queries of a volume along rays: radiographs, compositing with transfer functions, and ultrasound from attenuation."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arithmetic import saturate


def clipped_to_box(rays: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """The rays (sx, sy, sz start; ix, iy, iz step) with `k0` and `k1`, the first and last whole step inside 0 .. size - 1; rays that miss it go."""
    lo, hi = F.lit(0.0), F.lit(1e9)
    hit = F.lit(True)
    for c, n in zip("xyz", size, strict=True):
        s, i = F.col(f"s{c}").cast("double"), F.col(f"i{c}").cast("double")
        a, b = F.try_divide(-s, i), F.try_divide(F.lit(n - 1.0) - s, i)
        still = F.abs(i) < 1e-12
        lo = F.greatest(lo, F.when(still, 0.0).otherwise(F.least(a, b)))
        hi = F.least(hi, F.when(still, 1e9).otherwise(F.greatest(a, b)))
        hit = hit & (~still | s.between(0, n - 1))
    eps = 1e-9
    return rays.withColumns({"k0": F.ceil(lo - eps), "k1": F.floor(hi + eps)}).where(hit & (F.col("k0") <= F.col("k1")))


def samples(rays: DataFrame, most: int = 10_000) -> DataFrame:
    """(the rays' other columns, k, px, py, pz): a row for each step k0 .. k1 of each ray; over `most` steps are an error."""
    steps = F.col("k1") - F.col("k0")
    rows = rays.select("*", F.explode(F.sequence("k0", F.when(steps < most, F.col("k1")).otherwise(F.raise_error(F.lit("a ray has too many steps"))))).alias("k"))
    return rows.withColumns({f"p{c}": F.col(f"s{c}") + F.col("k") * F.col(f"i{c}") for c in "xyz"}).drop("k0", "k1")


def sampled(points: DataFrame, volume: DataFrame, keys: list[str], values: list[str] | None = None) -> DataFrame:
    """(keys, px, py, pz, values): a volume (x, y, z, values; v alone if None) between its voxels, by trilinear weights; a missing voxel counts as 0.

    A point asks for the up to eight voxels around it that have a weight: one join on (x, y, z), one sum by point.
    """
    values = values or ["v"]
    f = {c: F.col(f"p{c}") - F.floor(f"p{c}") for c in "xyz"}
    corner = lambda o: F.struct(*((F.floor(f"p{c}") + d).alias(c) for c, d in zip("xyz", o, strict=True)), math_product([f[c] if d else 1 - f[c] for c, d in zip("xyz", o, strict=True)]).alias("_w"))
    asked = points.select(*keys, "px", "py", "pz", F.inline(F.array(*map(corner, product((0, 1), repeat=3))))).where("_w > 0")
    got = asked.join(volume.select("x", "y", "z", *values), ["x", "y", "z"], "left")
    return got.groupBy(*keys, "px", "py", "pz").agg(*(F.sum(F.col("_w") * F.coalesce(c, F.lit(0.0))).alias(c) for c in values))


def math_product(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out * c
    return out


def radiograph(rays: DataFrame, volume: DataFrame, size: tuple[int, int, int], slope: float, intercept: float) -> DataFrame:
    """(ray, v): max(0, 256 - exp(e)) of the line integral e of -(slope v + intercept) over each ray's steps, by their length."""
    points = samples(clipped_to_box(rays, size)).select("ray", "k", F.sqrt(F.col("ix") ** 2 + F.col("iy") ** 2 + F.col("iz") ** 2).alias("step"), "px", "py", "pz")
    got = sampled(points, volume, ["ray", "k", "step"])
    e = F.sum(-F.col("step") * (F.lit(float(slope)) * F.col("v") + F.lit(float(intercept))))
    return got.groupBy("ray").agg(F.greatest(F.lit(0.0), 256 - F.exp(e)).alias("v"))


#: Fixed value: a ray ends when less than this share of the light is left.
DARK = 1 / 64


def composited(points: DataFrame) -> DataFrame:
    """(ray, r, g, b, a): front-to-back blend of the steps (ray, k, r, g, b, a) of each ray.

    A step adds its colour by its opacity and by what the steps before it let through; steps behind which less than DARK is
    left don't count. What is let through is a running sum of ln(1 - a) by ray; a ray has a bounded number of steps.
    """
    by = Window.partitionBy("ray").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    clear = F.when(F.col("a") >= 1, F.lit(-1e9)).otherwise(F.log1p(-F.col("a")))
    rows = points.withColumn("left", F.exp(F.coalesce(F.sum(clear).over(by), F.lit(0.0)))).where(F.col("left") >= DARK)
    w = F.col("left") * F.col("a")
    return rows.groupBy("ray").agg(*(F.sum(w * F.col(c)).alias(c) for c in "rgb"), F.sum(w).alias("a"))


def shaded(points: DataFrame, ambient: float, diffuse: float, specular: float, power: float) -> DataFrame:
    """The steps (r, g, b, gx, gy, gz, vx, vy, vz) with colours lit from the eye: ambient + diffuse |n.v| + specular |n.v|^power."""
    size = F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2 + F.col("gz") ** 2) * F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2)
    facing = F.coalesce(F.abs(F.try_divide(F.col("gx") * F.col("vx") + F.col("gy") * F.col("vy") + F.col("gz") * F.col("vz"), size)), F.lit(0.0))
    light = F.lit(float(ambient)) + F.lit(float(diffuse)) * facing + F.lit(float(specular)) * F.pow(facing, F.lit(float(power)))
    return points.withColumns({c: saturate(F.col(c) * light) for c in "rgb"})


def depth_shaded(depths: DataFrame, darkness: float) -> DataFrame:
    """(px, py, v): 1 / (1 + darkness times the slope of the depth) of an image (px, py, depth), differences one-sided at its ends."""
    slopes = []
    for c, o in (("px", "py"), ("py", "px")):
        by = Window.partitionBy(o).orderBy(c)
        slopes.append((F.coalesce(F.lead("depth").over(by), F.col("depth")) - F.coalesce(F.lag("depth").over(by), F.col("depth"))) / 2)
    return depths.withColumns({"dx": slopes[0], "dy": slopes[1]}).select("px", "py", (1 / (1 + F.lit(float(darkness)) * F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2))).alias("v"))


#: Density of a Hounsfield number.
DENSITY = (0.5 * 0.00025, 512.0 * 0.00025)


def ultrasound(points: DataFrame, threshold: float, a: float) -> DataFrame:
    """(beam, k, transmission, reflection, density) of the steps (beam, k, v, gx, gy, gz, ix, iy, iz) of each beam.

    v: attenuation; g: its gradient; i: the step. A step loses (g^2 length) / (4 v^2) of what reaches it, everything where the
    gradient is `threshold` or more; it reflects what reaches it by (i . g) |g| / (4 v^2 |i|), log-compressed by `a`. The
    running product is a running sum of logarithms and a count of steps that let nothing through.
    """
    g2 = F.col("gx") ** 2 + F.col("gy") ** 2 + F.col("gz") ** 2
    i2 = F.sqrt(F.col("ix") ** 2 + F.col("iy") ** 2 + F.col("iz") ** 2)
    v2 = 4 * F.col("v") * F.col("v")
    kept = F.when(F.sqrt(g2) < threshold, saturate(1 - F.coalesce(F.try_divide(g2 * 2 * i2, v2), F.lit(0.0)))).otherwise(F.lit(0.0))
    echo = F.coalesce(F.try_divide((F.col("ix") * F.col("gx") + F.col("iy") * F.col("gy") + F.col("iz") * F.col("gz")) * F.sqrt(g2), v2 * i2), F.lit(0.0))
    by = Window.partitionBy("beam").orderBy("k")
    upto, ahead = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    rows = points.withColumns({"kept": kept, "echo": echo})
    ln, shut = F.when(F.col("kept") > 0, F.ln("kept")).otherwise(F.lit(0.0)), (F.col("kept") <= 0).cast("int")
    through = lambda w: F.when(F.coalesce(F.sum(shut).over(w), F.lit(0)) > 0, 0.0).otherwise(F.exp(F.coalesce(F.sum(ln).over(w), F.lit(0.0))))
    rows = rows.withColumns({"reach": through(ahead), "transmission": through(upto)})
    heard = saturate(F.log1p(F.greatest(F.lit(-1 + 1e-12), F.lit(float(a)) * F.col("reach") * F.col("echo"))) / F.lit(math.log1p(a)))
    return rows.select("beam", "k", "transmission", heard.alias("reflection"), F.when(F.col("reach") > 0, F.lit(DENSITY[0]) * F.col("v") + F.lit(DENSITY[1])).otherwise(0.0).alias("density"))


def ultrasound_fit(samples_: DataFrame) -> DataFrame:
    """One row (alpha, beta, bias): the least squares fit of `seen` by alpha density + beta reflection + bias; nulls if it isn't unique."""
    from ..functions.arithmetic import solve3

    d, r, u = F.col("density"), F.col("reflection"), F.col("seen")
    s = samples_.agg(*(F.sum(e).alias(n) for n, e in (("d", d), ("r", r), ("u", u), ("dd", d * d), ("rr", r * r), ("dr", d * r), ("du", d * u), ("ru", r * u))), F.count("*").cast("double").alias("n"))
    c = F.col
    alpha, beta, bias = solve3([[c("dd"), c("dr"), c("d")], [c("dr"), c("rr"), c("r")], [c("d"), c("r"), c("n")]], [c("du"), c("ru"), c("u")])
    return s.select(alpha.alias("alpha"), beta.alias("beta"), bias.alias("bias"))


def keyhole(first: DataFrame, second: DataFrame, x0: float, y0: float, radius: float, mode: int, soft: float = 1.0) -> DataFrame:
    """(px, py, v) of two images of the same pixels: the second inside a circle, the first outside.

    mode 0: a hard edge; 1: linear over the outer `soft` share of the radius; 2: the greater inside; 3: their mean inside.
    """
    both = first.select("px", "py", F.col("v").alias("f")).join(second.select("px", "py", F.col("v").alias("s")), ["px", "py"])
    d = F.sqrt((F.col("px") - F.lit(x0)) ** 2 + (F.col("py") - F.lit(y0)) ** 2) / F.lit(float(radius))
    f, s = F.col("f"), F.col("s")
    w = saturate((1 - d) / F.lit(float(soft)))
    return both.select("px", "py", (F.when(d <= 1, s).otherwise(f), s * w + f * (1 - w), F.when(d <= 1, F.greatest(f, s)).otherwise(f), F.when(d <= 1, (f + s) / 2).otherwise(f))[mode].alias("v"))


def until_inside(points: DataFrame) -> DataFrame:
    """The steps (ray, k, inside, ...) of each ray up to its first one that is inside, that one included."""
    first = points.where("inside").groupBy("ray").agg(F.min("k").alias("last"))
    return points.join(first, "ray", "left").where(F.col("last").isNull() | (F.col("k") <= F.col("last"))).drop("last")


def rendered(rays: DataFrame, image: DataFrame, size: tuple[int, int, int], table: DataFrame, steps: tuple[int, int], low: tuple[float, float], high: tuple[float, float], hole: list | None = None, inner: DataFrame | None = None, stop: int | None = None) -> DataFrame:
    """(ray, r, g, b, a) of an image (x, y, z, v, gradient) along rays, coloured by a transfer function's table.

    Inside the planes of a keyhole `hole` the table `inner` counts. `stop`: a class at whose first step a ray ends.
    """
    from ..functions.terms import clipped
    from .transfer import classify

    points = samples(clipped_to_box(rays, size)).select("ray", "k", "px", "py", "pz")
    v = sampled(points, image, ["ray", "k"])
    g = sampled(points, image.withColumn("v", F.col("gradient").cast("double")), ["ray", "k"]).select("ray", "k", F.col("v").alias("gradient"))
    rows = classify(v.join(g, ["ray", "k"]), table, steps, low, high)
    if hole and inner is not None:
        other = inner.select("i", "g", *(F.col(c).alias(f"in_{c}") for c in ("r", "green", "b", "a", "class")))
        cut = clipped((F.col("px"), F.col("py"), F.col("pz")), hole)
        rows = classify(rows, other, steps, low, high).withColumns({c: F.when(cut, F.col(c)).otherwise(F.col(f"in_{c}")) for c in ("r", "green", "b", "a", "class")})
    if stop is not None:
        rows = until_inside(rows.withColumn("inside", F.col("class") == stop))
    return composited(rows.select("ray", "k", "r", F.col("green").alias("g"), "b", "a"))
