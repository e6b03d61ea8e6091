"""How alike two aligned images are: information measures of their joint histogram, differences, and shifted forms of both."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .statistics import bin_of, extremes


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """(x, y, z, a, b) of two images (x, y, z, v), over the voxels that both have."""
    return a.select("x", "y", "z", F.col("v").alias("a")).join(b.select("x", "y", "z", F.col("v").alias("b")), ["x", "y", "z"])


def rounded_bin(v: Column, most: float, bins: int) -> Column:
    """The nearest of `bins` bins from 0 to `most`, clamped."""
    if most <= 0:
        return F.lit(0).cast("long")
    return F.greatest(F.lit(0), F.least(F.floor(v / F.lit(most / (bins - 1)) + F.lit(0.5)), F.lit(bins - 1))).cast("long")


def joint_histogram(pair: DataFrame, bins: int, rounded: bool = False) -> DataFrame:
    """(s, t, c): counts of the bins of the columns a and b of the rows in which neither is null."""
    pair = pair.select(F.col("a").cast("double"), F.col("b").cast("double")).dropna()
    (a0, a1), (b0, b1) = extremes(pair, "a", "b")
    s, t = (rounded_bin(F.col("a"), a1, bins), rounded_bin(F.col("b"), b1, bins)) if rounded else (bin_of(F.col("a"), a0, a1, bins), bin_of(F.col("b"), b0, b1, bins))
    return pair.groupBy(s.alias("s"), t.alias("t")).agg(F.count("*").alias("c"))


def information(joint: DataFrame, q: float = 2.0) -> DataFrame:
    """One row of measures of a joint histogram (s, t, c): entropies in nats and what follows from them.

    hs, ht, hst; mi; nmi, half of (hs + ht) / hst, 1 if hst is 0; ecr, the root of hst / (hs + ht), 1 if that is 0 / 0;
    ecr_smi, the root of 2 (1 - hst / (hs + ht)), 0 if that is 0 / 0; rmi and tmi of Renyi's and Tsallis' entropies of
    order q. An empty histogram gives nulls. One shuffle over the histogram gives both marginals and the whole.
    """
    c = F.col("c").cast("double")
    parts = joint.groupingSets([["s", "t"], ["s"], ["t"]], "s", "t").agg(F.grouping_id().alias("of"), F.sum("c").cast("double").alias("c"))
    sums = parts.groupBy("of").agg(F.sum(c).alias("n"), F.sum(c * F.ln(c)).alias("cl"), F.sum(F.pow(c, F.lit(q))).alias("cq"))
    one = sums.agg(*(F.max(F.when(F.col("of") == k, F.col(v))).alias(f"{v}_{name}") for k, name in ((0, "st"), (1, "s"), (2, "t")) for v in ("n", "cl", "cq")))
    h = lambda x: F.ln(f"n_{x}") - F.col(f"cl_{x}") / F.col(f"n_{x}")
    r = lambda x: (F.ln(f"cq_{x}") - q * F.ln(f"n_{x}")) / (1 - q)
    t = lambda x: (F.col(f"cq_{x}") / F.pow(F.col(f"n_{x}"), F.lit(q)) - 1) / (1 - q)
    out = one.select(*(f(x).alias(f"{k}{x}") for k, f in (("h", h), ("r", r), ("t", t)) for x in ("s", "t", "st")))
    both = F.col("hs") + F.col("ht")
    some = both > 1e-12
    return out.select("hs", "ht", "hst", (both - F.col("hst")).alias("mi"), F.when(F.col("hst") > 1e-12, both / F.col("hst") / 2).otherwise(F.when(both.isNotNull(), 1.0)).alias("nmi"), F.when(some, F.sqrt(F.col("hst") / both)).otherwise(F.when(both.isNotNull(), 1.0)).alias("ecr"), F.when(some, F.sqrt(F.greatest(F.lit(0.0), 2 * (1 - F.col("hst") / both)))).otherwise(F.when(both.isNotNull(), 0.0)).alias("ecr_smi"), (F.col("rs") + F.col("rt") - F.col("rst")).alias("rmi"), (F.col("ts") + F.col("tt") + (1 - q) * F.col("ts") * F.col("tt") - F.col("tst")).alias("tmi"))


def differences(pair: DataFrame) -> DataFrame:
    """One row (sad, ssd, ncc) of the columns a and b: sums of absolute and squared differences, uncentred correlation.

    Rows with a null don't count. ncc is null if an image is 0 everywhere.
    """
    a, b = F.col("a"), F.col("b")
    norm = F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(b * b))
    return pair.dropna(subset=["a", "b"]).agg(F.sum(F.abs(a - b)).alias("sad"), F.sum((a - b) * (a - b)).alias("ssd"), F.try_divide(F.sum(a * b), norm).alias("ncc"))


def corner_weights(shift: tuple[float, float, float]) -> list[tuple[int, int, int, float]]:
    """The corners (dx, dy, dz) of the cell in which a point moved by `shift` lies, with their trilinear weights above 0."""
    axes = [[(math.floor(s), 1 - (s - math.floor(s))), (math.floor(s) + 1, s - math.floor(s))] for s in shift]
    return [(x, y, z, a * b * c) for (x, a), (y, b), (z, c) in product(*axes) if a * b * c > 0]


def shifted(image: DataFrame, shift: tuple[float, float, float]) -> DataFrame:
    """(x, y, z, v): the image (x, y, z, v) as seen from voxels moved by `shift`, where all corners are in the image.

    A voxel deals its value to the up to eight voxels that see it, so one shuffle on (x, y, z) does for all corners, and a
    whole shift needs none.
    """
    corners = corner_weights(shift)
    if len(corners) == 1:
        x, y, z, _ = corners[0]
        return image.select((F.col("x") - x).alias("x"), (F.col("y") - y).alias("y"), (F.col("z") - z).alias("z"), "v")
    dealt = F.explode(F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy"), F.lit(z).alias("dz"), F.lit(w).alias("w")) for x, y, z, w in corners)))
    rows = image.select("x", "y", "z", "v", dealt.alias("d"))
    rows = rows.groupBy((F.col("x") - F.col("d.dx")).alias("x"), (F.col("y") - F.col("d.dy")).alias("y"), (F.col("z") - F.col("d.dz")).alias("z")).agg(F.sum(F.col("v") * F.col("d.w")).alias("v"), F.count("*").alias("k"))
    return rows.where(F.col("k") == len(corners)).drop("k")


def shifted_differences(moving: DataFrame, fixed: DataFrame, shift: tuple[float, float, float]) -> DataFrame:
    """differences() of the shifted moving image and the fixed one, over the voxels in which both are known, and their number."""
    pair = aligned(shifted(moving, shift), fixed)
    a, b = F.col("a"), F.col("b")
    return pair.agg(F.count("*").alias("n"), F.sum(F.abs(a - b)).alias("sad"), F.sum((a - b) * (a - b)).alias("ssd"), F.try_divide(F.sum(a * b), F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(b * b))).alias("ncc"))


def partial_volume_joint(moving: DataFrame, fixed: DataFrame, shift: tuple[float, float, float], bins: int) -> DataFrame:
    """(s, t, w): the joint histogram to which each fixed voxel gives the trilinear weights of the moving corners' bins.

    A voxel counts if all its corners are in the moving image.
    """
    (a0, a1), (b0, b1) = extremes(moving, "v")[0], extremes(fixed, "v")[0]
    corners = corner_weights(shift)
    dealt = F.explode(F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy"), F.lit(z).alias("dz"), F.lit(w).alias("w")) for x, y, z, w in corners)))
    rows = moving.select("x", "y", "z", bin_of(F.col("v"), a0, a1, bins).alias("s"), dealt.alias("d"))
    rows = rows.groupBy((F.col("x") - F.col("d.dx")).alias("x"), (F.col("y") - F.col("d.dy")).alias("y"), (F.col("z") - F.col("d.dz")).alias("z")).agg(F.collect_list(F.struct("s", "d.w")).alias("parts"))
    rows = rows.where(F.size("parts") == len(corners)).join(fixed.select("x", "y", "z", bin_of(F.col("v"), b0, b1, bins).alias("t")), ["x", "y", "z"])
    rows = rows.select("t", F.inline("parts"))
    return rows.groupBy("s", "t").agg(F.sum("w").alias("w"))
