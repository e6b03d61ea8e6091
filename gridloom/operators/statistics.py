"""Moments, histograms and entropies of the channels of an image, and principal axes of small covariances."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written

MOST_CHANNELS = 20


def extremes(df: DataFrame, *cols: str) -> list[tuple[float, float]]:
    """(least, greatest) of each column, (0, 0) where it has no value; one aggregate, one row to the driver."""
    r = df.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in cols for f in (F.min, F.max))).first()
    return [(float(r[2 * i] or 0), float(r[2 * i + 1] or 0)) for i in range(len(cols))]


def bin_of(v: Column, lo: float, hi: float, bins: int) -> Column:
    """The bin of v among `bins` of equal width from lo to hi; hi is in the top bin; an empty range is one bin."""
    if hi <= lo:
        return F.lit(0).cast("long")
    return F.least(F.floor(F.lit(float(bins)) * (v - F.lit(lo)) / F.lit(hi - lo)), F.lit(bins - 1)).cast("long")


def multi_statistics(df: DataFrame, cols: list[str], mask: Column | None = None) -> DataFrame:
    """(i, j, n, mean_i, mean_j, square, covariance) of each pair i <= j of channels, over the rows where the mask holds.

    Means, mean products and population covariances come from one pass. Rows with a null in any channel are left out;
    without rows there are rows with n = 0 and nulls.
    """
    if len(cols) > MOST_CHANNELS:
        raise ValueError(f"over {MOST_CHANNELS} channels")
    df = (df if mask is None else df.where(mask)).select(*cols).dropna()
    pairs = list(combinations_with_replacement(range(len(cols)), 2))
    aggs = [F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(cols))]
    aggs += [f(a, b).alias(f"{k}{i}_{j}") for i, j in pairs for k, f, a, b in (("s", lambda a, b: F.avg(F.col(a) * F.col(b)), cols[i], cols[j]), ("v", F.covar_pop, cols[i], cols[j]))]
    rows = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), "n", F.col(f"m{i}").alias("mean_i"), F.col(f"m{j}").alias("mean_j"), F.col(f"s{i}_{j}").alias("square"), F.col(f"v{i}_{j}").alias("covariance")) for i, j in pairs))
    return df.agg(*aggs).select(F.inline(rows))


def binned(df: DataFrame, cols: list[str], bins: int) -> DataFrame:
    """The rows with a column b0, b1, ... for each channel's bin between its extremes; rows with nulls are left out."""
    df = df.dropna(subset=cols)
    return df.withColumns({f"b{i}": bin_of(F.col(c).cast("double"), lo, hi, bins) for i, (c, (lo, hi)) in enumerate(zip(cols, extremes(df, *cols), strict=True))})


def histogram(df: DataFrame, cols: list[str], bins: int) -> DataFrame:
    """(b0, b1, ..., c): counts of the bins that occur, over any number of channels."""
    return binned(df, cols, bins).groupBy(*(f"b{i}" for i in range(len(cols)))).agg(F.count("*").alias("c"))


def dense_histogram(df: DataFrame, cols: list[str], bins: int) -> DataFrame:
    """As histogram(), with a row of 0 for each bin that doesn't occur."""
    keys = [f"b{i}" for i in range(len(cols))]
    every = df.sparkSession.range(bins ** len(cols)).select(*(F.floor(F.col("id") / bins**i % bins).alias(k) for i, k in enumerate(keys)))
    return every.join(histogram(df, cols, bins), keys, "left").withColumn("c", F.coalesce("c", F.lit(0)))


def entropy_of(c: Column, base: float | None = None) -> Column:
    """Entropy of the counts c as an aggregate: ln n - sum(c ln c) / n, in nats or by `base`; null without counts."""
    n = F.sum(c).cast("double")
    h = F.ln(n) - F.sum(c * F.ln(c.cast("double"))) / n
    return h if base is None else h / F.lit(float(np.log(base)))


def entropy(df: DataFrame, cols: list[str], bins: int, base: float = 2.0) -> DataFrame:
    """One row (entropy): of the joint histogram of the channels, in bits."""
    return histogram(df, cols, bins).agg(entropy_of(F.col("c"), base).alias("entropy"))


def principal_axes(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, variances in descending order and axes (rows) of the covariance of at most MOST_CHANNELS channels."""
    n = len(cols)
    cov, mean = np.zeros((n, n)), np.zeros(n)
    for r in multi_statistics(df, cols).collect():
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["covariance"] or 0.0
        mean[r["i"]] = r["mean_i"] or 0.0
    variance, axes = np.linalg.eigh(cov)
    axes = axes.T[::-1]
    axes = axes * np.where(axes[np.arange(n), np.abs(axes).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]  # the largest entry is positive
    return mean, variance[::-1], axes


def project(df: DataFrame, cols: list[str], mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """The rows with p0, p1, ...: their channels, centred, along the axes."""
    at = lambda axis: sum((F.col(c) - F.lit(float(m))) * F.lit(float(a)) for c, m, a in zip(cols, mean, axis, strict=True))
    return df.withColumns({f"p{k}": at(axis) for k, axis in enumerate(axes)})


def gram(images: DataFrame) -> DataFrame:
    """(a, b, dot) for each pair a <= b of images (image, voxel, v) of the same voxels, each centred by its mean voxel image.

    At most MOST_IMAGES images: a voxel's values, one of each image, are gathered, and their products summed. So the
    voxels are shuffled once and the partial sums are of as many rows as there are pairs.
    """
    rows = images.groupBy("voxel").agg(F.array_sort(F.collect_list(F.struct("image", "v"))).alias("vs"), F.avg("v").alias("m"))
    rows = rows.select("m", F.posexplode("vs").alias("at", "l"), "vs")
    rows = rows.select("m", "l", F.explode(F.expr("slice(vs, at + 1, size(vs))")).alias("r"))
    return rows.groupBy(F.col("l.image").alias("a"), F.col("r.image").alias("b")).agg(F.sum((F.col("l.v") - F.col("m")) * (F.col("r.v") - F.col("m"))).alias("dot"))


MOST_IMAGES = 40


def image_modes(images: DataFrame, modes: int) -> DataFrame:
    """(image, mode, weight, eigenvalue): the images' coordinates along the first modes of their common variation.

    The Gram matrix, of at most MOST_IMAGES images, is taken apart on the driver.
    """
    found = gram(images).limit(MOST_IMAGES * (MOST_IMAGES + 1) // 2 + 1).collect()
    ids = sorted({r["a"] for r in found})
    if len(ids) > MOST_IMAGES:
        raise ValueError(f"over {MOST_IMAGES} images")
    place = {x: i for i, x in enumerate(ids)}
    g = np.zeros((len(ids), len(ids)))
    for r in found:
        g[place[r["a"]], place[r["b"]]] = g[place[r["b"]], place[r["a"]]] = r["dot"]
    value, vector = np.linalg.eigh(g)
    rows = []
    for k in range(min(modes, len(ids))):
        v, e = vector[:, -1 - k], max(float(value[-1 - k]), 0.0)
        v = v * (-1 if v[np.abs(v).argmax()] < 0 else 1)
        rows += [(x, k, float(v[i] * e**0.5), e) for x, i in place.items()]
    return images.sparkSession.createDataFrame(rows, f"image {images.schema['image'].dataType.simpleString()}, mode int, weight double, eigenvalue double")


def stretch(df: DataFrame, v: str, left: float, right: float, top: float = 255.0) -> DataFrame:
    """The rows with `stretched`: v spread linearly between its values at the `left` and `right` per cent ranks, clamped to 0 .. top.

    The ranks are counted over the distinct values, so no sort of the whole column goes through one task: counts by value
    are pre-aggregated, ranges of them are summed, and the two cuts are found from sums of ranges and one range each.
    """
    values = written(df.where(F.col(v).isNotNull()).groupBy(F.col(v).cast("double").alias("val")).agg(F.count("*").alias("c")))
    n = values.agg(F.sum("c")).first()[0] or 0
    lo, hi = (quantile_cut(values, int(n * p / 100), n) for p in (left, 100 - right))
    span = hi - lo
    out = F.lit(0.0) if span <= 0 else F.greatest(F.lit(0.0), F.least(F.lit(top), F.lit(top) * (F.col(v) - F.lit(lo)) / F.lit(span)))
    return df.withColumn("stretched", F.when(F.col(v).isNotNull(), out))


def quantile_cut(values: DataFrame, rank: int, n: int, pieces: int = 4096) -> float:
    """The value at place `rank` (from 0) of the sorted column whose counts by value are (val, c)."""
    rank = max(0, min(rank, n - 1))
    (lo, hi), before = extremes(values, "val")[0], 0
    while lo < hi:
        width = (hi - lo) / pieces
        if not lo + width > lo:
            break
        part = F.least(F.floor((F.col("val") - F.lit(lo)) / F.lit(width)), F.lit(pieces - 1))
        inside = values.where(F.col("val").between(lo, hi))
        sums = sorted((r["part"], r["c"], r["lo"], r["hi"]) for r in inside.groupBy(part.alias("part")).agg(F.sum("c").alias("c"), F.min("val").alias("lo"), F.max("val").alias("hi")).collect())
        for _, c, a, b in sums:
            if before + c > rank:
                lo, hi = a, b
                break
            before += c
    return lo


def reconstructed(images: DataFrame, modes: int) -> DataFrame:
    """(voxel, image, v): the images (image, voxel, v) from their first modes alone, and their mean.

    A mode is a mix of the images, and so is what it gives back: a matrix of as many rows and columns as there are images
    goes to the voxels, whose values are gathered once.
    """
    weights = image_modes(images, modes).toPandas()
    ids = sorted(weights["image"].unique().tolist())
    w = weights.pivot(index="image", columns="mode", values="weight").loc[ids].to_numpy()
    unit = w / np.maximum(np.linalg.norm(w, axis=0), 1e-300)
    mix = unit @ unit.T
    rows = images.groupBy("voxel").agg(F.map_from_entries(F.collect_list(F.struct("image", "v"))).alias("vs"), F.avg("v").alias("m"))
    back = [F.struct(F.lit(b).alias("image"), (F.col("m") + sum(((F.col("vs")[a] - F.col("m")) * F.lit(float(mix[i, j])) for i, a in enumerate(ids)), F.lit(0.0))).alias("v")) for j, b in enumerate(ids)]
    return rows.select("voxel", F.inline(F.array(*back)))
