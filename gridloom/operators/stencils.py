"""Gradients, affinities, blurs, medians, vesselness and pattern intensity of dense images (x, y, z, v)."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .statistics import extremes
from .tiles import Arrays, after, before, fixpoint, tiled


def gradient_magnitude(image: DataFrame, side: int = 32) -> DataFrame:
    """(x, y, z, v): half the root of the squared differences of the neighbours on either side; a missing one is the voxel itself."""

    def kernel(a: Arrays) -> Arrays:
        v = a["v"]
        return {"v": 0.5 * np.sqrt(sum((after(v, k) - before(v, k)) ** 2 for k in range(3)))}

    return tiled(image, kernel, ["v"], {"v": "double"}, 1, side)


def affinity(image: DataFrame, distance: float, intensity: float, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), side: int = 32) -> DataFrame:
    """(x, y, z, ax, ay, az): exp(-(distance h^2 + intensity dv^2)) to the next voxel along each axis; 0 where there is none."""

    def kernel(a: Arrays) -> Arrays:
        v, out = a["v"], {}
        for k, (name, h) in enumerate(zip(("ax", "ay", "az"), spacing, strict=True)):
            nxt = after(v, k, np.inf)
            out[name] = np.where(np.isinf(nxt), 0.0, np.exp(-(distance * h * h + intensity * (np.where(np.isinf(nxt), v, nxt) - v) ** 2)))
        return out

    return tiled(image, kernel, ["v"], {"ax": "double", "ay": "double", "az": "double"}, 1, side)


#: The side and middle weights of the blur.
BLUR = (0.1065, 0.7866, 0.1065)


def blur(image: DataFrame, passes: tuple[int, int, int], side: int = 32) -> DataFrame:
    """(x, y, z, v) after so many passes of BLUR along each axis; a missing neighbour is the voxel itself."""

    def kernel(a: Arrays) -> Arrays:
        v = a["v"]
        for k, n in enumerate(passes):
            for _ in range(n):
                v = BLUR[0] * before(v, k) + BLUR[1] * v + BLUR[2] * after(v, k)
        return {"v": v}

    return tiled(image, kernel, ["v"], {"v": "double"}, passes, max(side, *passes))


def gaussian(image: DataFrame, sigma: float, side: int = 64) -> DataFrame:
    """(x, y, z, v): Gaussian blur of each z slice with mirrored edges, cut off at four sigma.

    The edge voxel is repeated in the mirror, the boundary rule of a cosine transform of the whole slice.
    """
    r = math.ceil(4 * sigma)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()

    def kernel(a: Arrays) -> Arrays:
        v = np.nan_to_num(a["v"])
        for k in (0, 1):
            p = np.pad(v, [(r, r) if j == k else (0, 0) for j in range(3)], mode="symmetric")
            v = sum(w[i] * np.take(p, np.arange(i, i + v.shape[k]), axis=k) for i in range(2 * r + 1))
        return {"v": v}

    return tiled(image, kernel, ["v"], {"v": "double"}, (r, r, 0), max(side, r))


def retinex(image: DataFrame, sigmas: tuple[float, ...]) -> DataFrame:
    """(x, y, z, v): mean over the scales of ln v - ln of v blurred; v is above 0."""
    out = image.select("x", "y", "z", F.ln("v").alias("l"))
    for i, s in enumerate(sigmas):
        out = out.join(gaussian(image, s).select("x", "y", "z", F.ln("v").alias(f"b{i}")), ["x", "y", "z"])
    return out.select("x", "y", "z", sum((F.col("l") - F.col(f"b{i}") for i in range(len(sigmas))), F.lit(0.0)).alias("v")).withColumn("v", F.col("v") / len(sigmas))


def x_gradient(image: DataFrame) -> DataFrame:
    """(x, y, z, v): half the difference of the neighbours along x; at an end the whole one to the only neighbour, 0 without any."""
    by = Window.partitionBy("y", "z").orderBy("x")
    prev, nxt, v = F.lag("v").over(by), F.lead("v").over(by), F.col("v")
    both = prev.isNotNull() & nxt.isNotNull()
    return image.select("x", "y", "z", F.when(both, (nxt - prev) / 2).otherwise(F.coalesce(nxt - v, v - prev, F.lit(0.0))).alias("v"))


def box_mean(v: np.ndarray, r: int) -> np.ndarray:
    """Means over the square windows of radius r of the first two axes, cut at the ends, from running sums."""
    known = ~np.isnan(v)
    s = [np.nan_to_num(v), known.astype(float)]
    for k in (0, 1):
        n = v.shape[k]
        hi, lo = np.minimum(np.arange(n) + r + 1, n), np.maximum(np.arange(n) - r, 0)
        for i in range(2):
            c = np.concatenate([np.zeros_like(np.take(s[i], [0], axis=k)), np.cumsum(s[i], axis=k)], axis=k)
            s[i] = np.take(c, hi, axis=k) - np.take(c, lo, axis=k)
    return s[0] / np.maximum(s[1], 1)


def box_filter(image: DataFrame, r: int, side: int = 64) -> DataFrame:
    """(x, y, z, v): means over the (2 r + 1)^2 window in the slice, over the voxels that are there."""
    return tiled(image, lambda a: {"v": box_mean(a["v"], r)}, ["v"], {"v": "double"}, (r, r, 0), max(side, r))


def windows(v: np.ndarray, r: int) -> np.ndarray:
    """The (2 r + 1)^2 neighbours of each voxel in its slice, along a new last axis; NaN outside."""
    p = np.pad(v, [(r, r), (r, r), (0, 0)], constant_values=np.nan)
    return np.stack([p[i : i + v.shape[0], j : j + v.shape[1]] for i, j in product(range(2 * r + 1), repeat=2)], axis=-1)


def median_filter(image: DataFrame, r: int, side: int = 64) -> DataFrame:
    """(x, y, z, v): the upper median, the value at place n // 2 of the n sorted ones, of the window in the slice."""

    def kernel(a: Arrays) -> Arrays:
        w = np.sort(windows(a["v"], r), axis=-1)  # NaN goes last
        n = (~np.isnan(w)).sum(axis=-1)
        return {"v": np.take_along_axis(w, np.minimum(n // 2, w.shape[-1] - 1)[..., None], axis=-1)[..., 0]}

    return tiled(image, kernel, ["v"], {"v": "double"}, (r, r, 0), max(side, r))


def weighted_median_filter(image: DataFrame, r: int, sigma_space: float, sigma_value: float, side: int = 64) -> DataFrame:
    """(x, y, z, v): where `bad` is set, the least value of the window whose weight and that of lesser ones is half of the whole or more.

    Weights fall with the distance and with the difference of the `guide`. image: (x, y, z, v, guide, bad).
    """
    space = np.array([math.exp(-(i * i + j * j) / (2 * sigma_space**2)) for i, j in product(range(-r, r + 1), repeat=2)])

    def kernel(a: Arrays) -> Arrays:
        w, g = windows(a["v"], r), windows(a["guide"], r)
        weight = np.nan_to_num(space * np.exp(-((g - a["guide"][..., None]) ** 2) / (2 * sigma_value**2)))
        weight[np.isnan(w)] = 0
        order = np.argsort(w, axis=-1, kind="stable")
        c = np.cumsum(np.take_along_axis(weight, order, axis=-1), axis=-1)
        k = (c >= c[..., -1:] / 2).argmax(axis=-1)[..., None]
        mid = np.take_along_axis(np.take_along_axis(w, order, axis=-1), k, axis=-1)[..., 0]
        return {"v": np.where(a["bad"] > 0, mid, a["v"])}

    return tiled(image, kernel, ["v", "guide", "bad"], {"v": "double"}, (r, r, 0), max(side, r))


#: The radius of pattern intensity and the variance at which a difference counts half.
PATTERN = (3, 100.0)


def pattern_intensity(pair: DataFrame, side: int = 32) -> DataFrame:
    """One row (intensity): sum over the voxels of d = a - b, and over the neighbours within 3, of 100 / (100 + (d - d')^2).

    d' is 0 outside the image. The sums of a tile are one row each.
    """
    r, s = PATTERN
    near = [o for o in product(range(-r, r + 1), repeat=3) if sum(k * k for k in o) <= r * r]

    def kernel(a: Arrays) -> Arrays:
        d = a["d"]
        p = np.pad(np.nan_to_num(d), r)
        total = np.zeros_like(d)
        for i, j, k in near:
            q = p[r + i : r + i + d.shape[0], r + j : r + j + d.shape[1], r + k : r + k + d.shape[2]]
            total += s / (s + (d - q) ** 2)
        return {"v": total}

    d = pair.select("x", "y", "z", (F.col("a") - F.col("b")).alias("d"))
    return tiled(d, kernel, ["d"], {"v": "double"}, r, side).agg(F.sum("v").alias("intensity"))


def vesselness(image: DataFrame, sheet: float = 0.5, blob: float = 0.5, structure: float = 5.0, bright: bool = True, side: int = 32) -> DataFrame:
    """(x, y, z, v): how much the second derivatives look like a bright (or dark) line, 0 to 1, by Frangi's measure.

    Derivatives are differences of neighbours, not halved. With eigenvalues of the Hessian by size l1, l2, l3:
    (1 - exp(-(l2 / l3)^2 / 2 sheet^2)) exp(-l1^2 / |l2 l3| / 2 blob^2) (1 - exp(-(l1^2 + l2^2 + l3^2) / 2 structure^2)).
    """

    def kernel(a: Arrays) -> Arrays:
        v = a["v"]
        g = [after(v, k) - before(v, k) for k in range(3)]
        h = np.empty((*v.shape, 3, 3))
        for i, j in product(range(3), repeat=2):
            h[..., i, j] = (after(g[i], j) - before(g[i], j) + after(g[j], i) - before(g[j], i)) / 2
        e = np.linalg.eigvalsh(np.nan_to_num(h))
        e = np.take_along_axis(e, np.abs(e).argsort(axis=-1), axis=-1)
        l1, l2, l3 = (e[..., k] for k in range(3))
        l3s = np.where(l3 == 0, 1.0, np.abs(l3))
        l2s = np.where(l2 == 0, 1.0, np.abs(l2))
        out = (1 - np.exp(-((l2 / l3s) ** 2) / (2 * sheet**2))) * np.exp(-(l1**2 / (l2s * l3s)) / (2 * blob**2)) * (1 - np.exp(-(e**2).sum(axis=-1) / (2 * structure**2)))
        line = (l2 < 0) & (l3 < 0) if bright else (l2 > 0) & (l3 > 0)
        return {"v": np.where(line, out, 0.0)}

    return tiled(image, kernel, ["v"], {"v": "double"}, 2, side)


def structures(image: DataFrame, weights: tuple[float, float, float] = (0.0, 1.0, 0.0), asymmetry: float = 0.5, blobness: float = 0.5, structure: float = 5.0, gradient: float = 1.0, side: int = 32) -> DataFrame:
    """(x, y, z, sheet, line, blob, v): how much the image looks like a sheet, a line and a ball at each voxel, and their sum by `weights`.

    With eigenvalues of the Hessian by size l1, l2, l3, A = l2 / l3 / asymmetry, B = l1 / sqrt |l2 l3| / blobness, S the root of their squares' sum over
    `structure` and L the gradient's length over |l3| gradient, and e(t) = exp(-t^2 / 2):

        sheet (1 - e(L)) e(A) e(B), line (1 - e(A)) e(B), blob e(L) (1 - e(B)), each times 1 - e(S).

    Differences of neighbours aren't halved, and are one-sided at the image's ends; what is divided by 0 counts as 0.
    """

    def kernel(a: Arrays) -> Arrays:
        v = a["v"]
        g = [after(v, k) - before(v, k) for k in range(3)]
        h = np.empty((*v.shape, 3, 3))
        for i, j in product(range(3), repeat=2):
            h[..., i, j] = (after(g[i], j) - before(g[i], j) + after(g[j], i) - before(g[j], i)) / 2
        e = np.linalg.eigvalsh(np.nan_to_num(h))
        e = np.take_along_axis(e, np.abs(e).argsort(axis=-1), axis=-1)
        l1, l2, l3 = (e[..., k] for k in range(3))
        over = lambda x, y: np.divide(x, y, out=np.zeros_like(x), where=np.abs(y) > 1e-12)
        fall = lambda t: np.exp(-t * t / 2)
        ra, rb = over(l2, l3) / asymmetry, over(l1, np.sqrt(np.abs(l2 * l3))) / blobness
        rl = over(np.sqrt(np.nan_to_num(sum(x * x for x in g))), np.abs(l3)) / gradient
        some = 1 - fall(np.sqrt((e * e).sum(axis=-1)) / structure)
        out = {"sheet": (1 - fall(rl)) * fall(ra) * fall(rb) * some, "line": (1 - fall(ra)) * fall(rb) * some, "blob": fall(rl) * (1 - fall(rb)) * some}
        return {**out, "v": sum(w * x for w, x in zip(weights, out.values(), strict=True))}

    return tiled(image, kernel, ["v"], dict.fromkeys(("sheet", "line", "blob", "v"), "double"), 2, side)


#: Lengths of chamfer steps to neighbours that share a face, an edge and a corner, in thousandths.
CHAMFER3 = (1000, 1314, 1628)


def grey_interpolation(image: DataFrame, between: int, bins: int = 16, ends: tuple[float, float] | None = None, side: int = 32) -> DataFrame:
    """(x, y, z, v): the slices of a grey image with `between` new ones after each but the last, by the shapes of their grey levels.

    A slice's values, in `bins` levels between `ends` (the image's extremes if None), are lifted: a voxel is inside at the levels up to its own and outside above. Each lifted voxel
    has its signed chamfer distance from the other side within its slice's levels; distances of slices that follow each other are interpolated,
    and a new voxel has the highest level at which that is above 0. New slices have z in units of 1 / (between + 1): z (between + 1) + k; those that are
    there keep their values, by levels. An image of one value keeps it; null values are errors.

    No way to the other side has more than bins + 1 steps, as it may go straight up or down; so tiles with a halo of that width are enough, with one shuffle.
    Distances are whole thousandths, so ties don't depend on rounding.
    """
    lo, hi = ends or extremes(image, "v")[0]
    if not hi > lo:
        lo, hi = (lo or 0.0), (lo or 0.0) + 1.0
    reach, far, n = bins + 1, np.int32(1 << 28), between + 1
    level = np.arange(-1, bins + 1).reshape(-1, 1, 1, 1)
    steps = [(o, CHAMFER3[sum(map(abs, o)) - 1]) for o in product((-1, 0, 1), repeat=3) if any(o)]

    def distance(source: np.ndarray) -> np.ndarray:
        d = np.where(source, np.int32(0), far)
        for _ in range(reach):
            p = np.pad(d, [(1, 1), (1, 1), (1, 1), (0, 0)], constant_values=far)
            new = d
            for (i, j, k), w in steps:
                new = np.minimum(new, p[1 + i : 1 + i + d.shape[0], 1 + j : 1 + j + d.shape[1], 1 + k : 1 + k + d.shape[2]] + np.int32(w))
            if (new == d).all():
                break
            d = new
        return d

    def kernel(a: Arrays) -> Arrays:
        v = a["v"]
        there = ~np.isnan(v)
        own = np.clip(np.floor((bins - 1) / (hi - lo) * (np.nan_to_num(v) - lo)), 0, bins - 1)
        inside = level <= own
        d = np.where(inside, distance(~inside & there), -distance(inside & there)).astype(np.int64)
        top = d[1:-1]
        out = [own]
        for k in range(1, n):
            new = np.full(v.shape, np.nan)
            both = there[..., :-1] & there[..., 1:]
            new[..., :-1] = np.where(both, np.maximum((top[..., :-1] * (n - k) + top[..., 1:] * k > 0).sum(axis=0) - 1, 0), np.nan)
            out.append(new)
        return {"vs": lo + np.stack(out) * (hi - lo) / (bins - 1)}

    rows = tiled(image, kernel, ["v"], {"vs": "array<double>"}, (reach, reach, 1), max(side, reach))
    return rows.select("x", "y", "z", F.posexplode("vs").alias("k", "v")).where(~F.isnan("v")).select("x", "y", (F.col("z") * n + F.col("k")).alias("z"), "v")


#: Lengths of chamfer steps to neighbours that share a face and an edge.
CHAMFER = (1.0, 1.314)
FAR = 1e9


def slice_distances(image: DataFrame, side: int = 64) -> DataFrame:
    """(x, y, z, v): signed chamfer distance of each voxel from the other side of the boundary of v > 0 in its slice, positive inside.

    FAR where a slice is all inside or all outside. Shortest ways are relaxed in tiles until nothing changes.
    """

    def relaxed(d: np.ndarray) -> np.ndarray:
        p = np.pad(d, [(1, 1), (1, 1), (0, 0)], constant_values=FAR)
        n0, n1 = d.shape[:2]
        for i, j in product((-1, 0, 1), repeat=2):
            if i or j:
                d = np.fmin(d, p[1 + i : 1 + i + n0, 1 + j : 1 + j + n1] + CHAMFER[abs(i) + abs(j) - 1])
        return d

    inside = F.col("v") > 0
    rows = image.select("x", "y", "z", *(F.when(c, 0.0).otherwise(FAR).alias(k) for k, c in (("di", ~inside), ("do", inside))))
    rows = fixpoint(rows, lambda a: relaxed(a["di"]), "di", ["do"], inner=16, side=side, flat=True)
    rows = fixpoint(rows, lambda a: relaxed(a["do"]), "do", ["di"], inner=16, side=side, flat=True)
    return rows.select("x", "y", "z", F.least(F.lit(FAR), F.when(F.col("di") > 0, F.col("di")).otherwise(-F.col("do"))).alias("v"))


def shape_interpolation(image: DataFrame, between: int) -> DataFrame:
    """(x, y, z, v): the slices of a binary image with `between` new ones after each but the last; 1 where the distance, interpolated, is above 0.

    New slices have z in units of 1 / (between + 1): z * (between + 1) + k.
    """
    d = slice_distances(image)
    nxt = d.select("x", "y", (F.col("z") - 1).alias("z"), F.col("v").alias("w"))
    n = between + 1
    rows = d.join(nxt, ["x", "y", "z"], "left").select("x", "y", "z", "v", "w", F.explode(F.when(F.col("w").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(between)))).alias("k"))
    v = F.when(F.col("k") == 0, F.col("v")).otherwise(F.col("v") + (F.col("w") - F.col("v")) * F.col("k") / n)
    return rows.select("x", "y", (F.col("z") * n + F.col("k")).alias("z"), (v > 0).cast("long").alias("v"))
