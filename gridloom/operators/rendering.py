"""Pictures of volumes: rays of a view, their intervals between planes, light by gradients, depths, and two volumes in one march.

A picture is made of sums: rays are cut to intervals before they have samples, samples ask for the voxels around them by
one join, and a ray, which has a bounded number of steps, is folded by running sums over its steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arithmetic import saturate
from ..scratch import written
from .rays import DARK, sampled
from .tiles import Arrays, after, before, tiled
from .transfer import classify

Plane = tuple[float, float, float, float]
#: What a step may be off an interval's end by, in steps.
NEAR = 1e-9


def view_rays(spark: SparkSession, matrix: Sequence[Sequence[float]], width: int, height: int, step: float) -> DataFrame:
    """(ray, px, py, sx, sy, sz, ix, iy, iz, last): a ray for each pixel of a view, from depth 0 to depth 1.

    matrix: four rows that map (px / width, py / height, depth, 1) to homogeneous coordinates of the voxels. A ray has steps
    0 .. last of equal length, at most `step` voxels.
    """
    i = F.col("id")
    rays = spark.range(width * height).select(i.alias("ray"), (i % width).alias("px"), F.floor(i / width).alias("py"))
    u, v = F.col("px") / F.lit(float(width)), F.col("py") / F.lit(float(height))

    def ends(depth: float) -> list[Column]:
        h = [F.lit(float(a)) * u + F.lit(float(b)) * v + F.lit(c * depth + d) for a, b, c, d in matrix]
        return [k / h[3] for k in h[:3]]

    rays = rays.withColumns({n + c: k for n, depth in (("s", 0.0), ("e", 1.0)) for c, k in zip("xyz", ends(depth), strict=True)})
    length = F.sqrt(sum(((F.col(f"e{c}") - F.col(f"s{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    rays = rays.withColumn("last", F.greatest(F.lit(1), F.ceil(length / F.lit(float(step)))))
    # written, a row a pixel, so that the matrix's expressions aren't copied into each of those that use them
    return written(rays.withColumns({f"i{c}": (F.col(f"e{c}") - F.col(f"s{c}")) / F.col("last") for c in "xyz"}).drop("ex", "ey", "ez"))


def jittered(rays: DataFrame, seed: int, tile: int = 16) -> DataFrame:
    """The rays moved on by a share of a step that depends on the seed and on the pixel's place in a tile, and so one step shorter."""
    at = F.concat_ws(":", F.col("px") % tile, F.col("py") % tile, F.lit(str(seed)))
    share = F.conv(F.substring(F.md5(at), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    return rays.withColumn("share", share).withColumns({f"s{c}": F.col(f"s{c}") + F.col("share") * F.col(f"i{c}") for c in "xyz"}).withColumn("last", F.col("last") - 1).drop("share")


def between(lo: Column, hi: Column, planes: Sequence[Plane]) -> tuple[Column, Column]:
    """What is left of the steps lo .. hi of a ray where n . p + d >= 0 for all planes; hi is below lo where nothing is."""
    for *n, d in planes:
        at = sum((F.lit(float(k)) * F.col(f"s{c}") for k, c in zip(n, "xyz", strict=True)), F.lit(0.0)) + F.lit(float(d))
        slope = sum((F.lit(float(k)) * F.col(f"i{c}") for k, c in zip(n, "xyz", strict=True)), F.lit(0.0))
        cross = F.try_divide(-at, slope)
        lo = F.greatest(lo, F.when(slope > 0, cross))  # nulls don't count
        hi = F.least(hi, F.when(slope < 0, cross).when((slope == 0) & (at < 0), F.lit(-1.0)))
    return lo, hi


def intervals(rays: DataFrame, size: tuple[int, int, int], planes: Sequence[Plane] = (), hole: Sequence[Plane] = ()) -> DataFrame:
    """The rays with their first and last step `k0`, `k1` in the box and inside all planes, and `h0`, `h1` inside the keyhole, h1 < h0 without one; rays with no step go. Written, a row a pixel."""
    unit = [tuple(float(i == k) for i in range(3)) for k in range(3)]
    box = [(*u, 0.0) for u in unit] + [(*(-x for x in u), n - 1.0) for u, n in zip(unit, size, strict=True)]
    whole = (F.lit(0.0), F.col("last").cast("double"))
    lo, hi = between(*whole, [*box, *planes])
    first, end = between(*whole, hole) if hole else (F.lit(0.0), F.lit(-1.0))
    ks = {"k0": F.ceil(lo - NEAR), "k1": F.floor(hi + NEAR), "h0": F.ceil(first - NEAR), "h1": F.floor(end + NEAR)}
    return written(rays.withColumns(ks).where("k0 <= k1"))


def steps(rays: DataFrame, skip: bool, most: int = 10_000) -> DataFrame:
    """The rays by their steps (k, px, py, pz, inside): whether in the keyhole; with `skip` steps there aren't made. Over `most` steps are an error."""

    def run(a: Column, b: Column) -> Column:
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))

    k0, k1, h0, h1 = (F.col(c) for c in ("k0", "k1", "h0", "h1"))
    ks = run(k0, k1)
    if skip:
        ks = F.when(h0 <= h1, F.concat(run(k0, F.least(k1, h0 - 1)), run(F.greatest(k0, h1 + 1), k1))).otherwise(ks)
    fits = F.when(k1 - k0 < most, ks).otherwise(F.raise_error(F.lit("a ray has too many steps")).cast("array<bigint>"))
    rows = rays.withColumn("k", F.explode(fits)).withColumn("inside", F.col("k").between(h0, h1))
    return rows.withColumns({f"p{c}": F.col(f"s{c}") + F.col("k") * F.col(f"i{c}") for c in "xyz"})


def gradients(volume: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), side: int = 32) -> DataFrame:
    """(x, y, z, v, w, gx, gy, gz): a volume (x, y, z, v, w) with the differences of v's neighbours on either side over the spacing; a missing one is the voxel itself."""

    def kernel(a: Arrays) -> Arrays:
        return {"v": a["v"], "w": a["w"], **{f"g{c}": (after(a["v"], k) - before(a["v"], k)) / spacing[k] for k, c in enumerate("xyz")}}

    return tiled(volume, kernel, ["v", "w"], dict.fromkeys(("v", "w", "gx", "gy", "gz"), "double"), 1, side)


def lit(points: DataFrame, light: tuple[float, float, float, float] | None, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """The steps (r, green, b, gx, gy, gz, ix, iy, iz) with colours in light from the eye: (ambient + diffuse f) colour + specular f^power.

    f: the cosine between gradient and ray, 0 without a gradient. light: (ambient, diffuse, specular, power); None takes each step's from columns of these names.
    """
    way = [F.col(f"i{c}") * F.lit(float(k)) for c, k in zip("xyz", spacing, strict=True)]
    g = [F.col(f"g{c}") for c in "xyz"]
    size = F.sqrt(sum((a * a for a in g), F.lit(0.0))) * F.sqrt(sum((a * a for a in way), F.lit(0.0)))
    f = saturate(F.coalesce(F.abs(F.try_divide(sum((a * b for a, b in zip(g, way, strict=True)), F.lit(0.0)), size)), F.lit(0.0)))
    ambient, diffuse, specular, power = (F.col(c) for c in ("ambient", "diffuse", "specular", "power")) if light is None else (F.lit(float(x)) for x in light)
    return points.withColumn("f", f).withColumns({c: saturate((ambient + diffuse * F.col("f")) * F.col(c) + specular * F.pow("f", power)) for c in ("r", "green", "b")}).drop("f")


def folded(points: DataFrame, dark: float = DARK) -> DataFrame:
    """(ray, px, py, r, g, b, a, depth): front-to-back blend of the steps (ray, px, py, k, k0, r, green, b, a).

    Steps behind which less than `dark` of the light is left don't count. depth: the number of steps to the last one that counts, that one included.
    """
    ahead = Window.partitionBy("ray").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    clear = F.when(F.col("a") >= 1, F.lit(-1e9)).otherwise(F.log1p(-F.col("a")))
    rows = points.withColumn("left", F.exp(F.coalesce(F.sum(clear).over(ahead), F.lit(0.0)))).where(F.col("left") >= dark)
    w = F.col("left") * F.col("a")
    colors = [F.sum(w * F.col(c)).alias(n) for c, n in (("r", "r"), ("green", "g"), ("b", "b"))]
    return rows.groupBy("ray", "px", "py").agg(*colors, F.sum(w).alias("a"), F.max(F.col("k") - F.col("k0") + 1).alias("depth"))


def rendered(rays: DataFrame, volume: DataFrame, size: tuple[int, int, int], table: DataFrame, shape: tuple[int, int], low: tuple[float, float], high: tuple[float, float], planes: Sequence[Plane] = (), hole: Sequence[Plane] = (), inner: DataFrame | None = None, light: tuple[float, float, float, float] | None = (1.0, 0.0, 0.0, 1.0), spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), dark: float = DARK, side: int = 32) -> DataFrame:
    """(ray, px, py, r, g, b, a, depth) of two aligned volumes (x, y, z, v, w) along the rays of a view, in one march.

    table: colours by v and w (`transfer.lookup_table`); w may be another image, or the first one's gradient. Clip planes and
    the keyhole cut the rays before samples are made: inside the keyhole the table `inner` counts, or nothing. Light falls by v's gradient.
    Samples are taken by trilinear weights to nine digits, so that the order of a sum moves none to another entry of the table. A missing voxel counts as 0; rays that miss the volume have no row.
    """
    lights = ["ambient", "diffuse", "specular", "power"] if light is None else []
    colors = ["r", "green", "b", "a", *lights]
    points = steps(intervals(rays, size, planes, hole), bool(hole) and inner is None)
    own = ["ray", "k", "k0", "inside", "ix", "iy", "iz"]
    values = ["v", "w", "gx", "gy", "gz"]
    pixels = rays.select("ray", "px", "py")
    got = sampled(points.select(*own, *(F.col(f"p{c}") for c in "xyz")), gradients(volume, spacing, side), own, values)
    got = got.select(*own, *(F.round(c, 9).alias(c) for c in values)).withColumnRenamed("w", "gradient")
    rows = classify(got, table.select("i", "g", *colors), shape, low, high)
    if hole and inner is not None:
        rows = classify(rows, inner.select("i", "g", *(F.col(c).alias(f"in_{c}") for c in colors)), shape, low, high)
        rows = rows.withColumns({c: F.when(F.col("inside"), F.col(f"in_{c}")).otherwise(F.col(c)) for c in colors})
    shown = lit(rows, light, spacing).select("ray", "k", "k0", "r", "green", "b", "a")
    return folded(shown.join(pixels, "ray"), dark)


def cel_shaded(picture: DataFrame, cel: tuple[float, float, float], distance: tuple[float, float, float]) -> DataFrame:
    """The picture with r, g and b darkened where its depth rises, and with its depth; `depth` becomes a share of the greatest.

    cel, distance: (darkness, from, slope): a colour is multiplied by 1 - darkness saturate((x - from) slope), x being the length of the
    depth's differences to the next pixels, and the depth. A next pixel that isn't there has the same depth. Windows hold a line of pixels.
    """
    picture = written(picture)
    most = picture.agg(F.max("depth").cast("double")).first()[0] or 1.0
    rows = picture.withColumn("depth", F.col("depth") / F.lit(most))
    rise = F.lit(0.0)
    for c, o in (("px", "py"), ("py", "px")):
        by = Window.partitionBy(o).orderBy(c)
        rows = rows.withColumn(f"d{c}", F.when(F.lead(c).over(by) == F.col(c) + 1, F.lead("depth").over(by) - F.col("depth")).otherwise(0.0))
        rise = rise + F.col(f"d{c}") ** 2
    shade = F.lit(1.0)
    for x, (darkness, start, slope) in ((F.sqrt(rise), cel), (F.col("depth"), distance)):
        shade = shade * (1 - F.lit(float(darkness)) * saturate((x - F.lit(float(start))) * F.lit(float(slope))))
    return rows.withColumn("shade", shade).withColumns({c: F.col(c) * F.col("shade") for c in "rgb"}).drop("shade", "dpx", "dpy")
