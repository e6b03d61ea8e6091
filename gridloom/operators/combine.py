"""Aligned label maps: votes, agreement, overlap, entropy planes and what the agreed voxels say of their intensities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .statistics import bin_of, extremes


def vote(maps: DataFrame) -> DataFrame:
    """(voxel, slot, value): the slot of the greatest value of (voxel, slot, value); of equal values the lowest slot.

    Nulls don't vote. Partial maxima are taken before the one shuffle, on voxel.
    """
    best = F.max_by(F.struct("slot", "value"), F.struct("value", (-F.col("slot")).alias("turn")))
    return maps.where("value is not null").groupBy("voxel").agg(best.alias("b")).select("voxel", "b.slot", "b.value")


def dice(pair: DataFrame, label: int) -> DataFrame:
    """One row (dice) of the label in the columns a and b: twice the common voxels over those of both; null if neither has any."""
    a, b = F.col("a") == label, F.col("b") == label
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("double")
    return pair.agg(F.try_divide(2 * n(a & b), n(a) + n(b)).alias("dice"))


def agreement(maps: DataFrame, label: int) -> DataFrame:
    """(voxel, k, n): of the n maps (voxel, slot, label) that know a voxel, k give it the label."""
    return maps.where("label is not null").groupBy("voxel").agg(F.sum((F.col("label") == label).cast("long")).alias("k"), F.count("*").alias("n"))


def atlas_probability(maps: DataFrame, label: int, entropy: bool = False, most: float | None = None, scaled: bool = False) -> DataFrame:
    """(voxel, p): the share of the maps that agree, or -ln of it, at most `most`, over `most` if scaled.

    Without agreement the cost is `most`, null if there is none.
    """
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    if not entropy:
        return agreement(maps, label).select("voxel", (k / n).alias("p"))
    cost = F.when(k > 0, F.ln(n) - F.ln(k))
    if most is not None:
        cost = F.least(F.coalesce(cost, F.lit(float(most))), F.lit(float(most))) / F.lit(float(most) if scaled else 1.0)
    return agreement(maps, label).select("voxel", cost.alias("p"))


def entropy_planes(maps: DataFrame) -> DataFrame:
    """(axis, slice, entropy): sums over each slice of the voxels' entropies over their label maps (x, y, z, slot, value).

    A voxel's values are shares of their sum; if they sum to 0 its entropy is ln of their number.
    """
    v = F.col("value").cast("double")
    s = maps.where("value is not null").groupBy("x", "y", "z").agg(F.sum(v).alias("s"), F.sum(F.when(v > 0, v * F.ln(v)).otherwise(0.0)).alias("l"), F.count("*").alias("n"))
    e = F.when(F.col("s") > 0, F.ln("s") - F.col("l") / F.col("s")).otherwise(F.ln(F.col("n").cast("double")))
    parts = s.withColumn("e", e).groupingSets([["x"], ["y"], ["z"]], "x", "y", "z").agg(F.grouping_id().alias("of"), F.sum("e").alias("entropy"))
    axis = F.when(F.col("of") == 3, "x").when(F.col("of") == 5, "y").otherwise("z")
    return parts.select(axis.alias("axis"), F.coalesce("x", "y", "z").alias("slice"), "entropy")


def best_planes(maps: DataFrame) -> DataFrame:
    """(axis, slice, entropy) of the slice of most entropy of each axis; of equal ones the first."""
    b = F.max_by(F.struct("slice", "entropy"), F.struct(F.round("entropy", 9).alias("e"), (-F.col("slice")).alias("turn")))
    return entropy_planes(maps).groupBy("axis").agg(b.alias("b")).select("axis", "b.slice", "b.entropy")


FLOOR = 1e-10  # added to a share before its ln


def log_likelihood(image: DataFrame, agreed: Column, cols: list[str], bins: int, scaled: bool = False) -> DataFrame:
    """The rows of the image with `term`: -ln of the share of the agreed voxels that lie in the bin of a voxel's channels.

    FLOOR is added to shares. Scaled terms are over -ln FLOOR. Without agreed voxels all terms are 1. The histogram has
    bins ** len(cols) rows at most and is joined by bin.
    """
    lo_hi = extremes(image, *cols)
    keys = [f"b{i}" for i in range(len(cols))]
    rows = image.withColumns({k: bin_of(F.col(c).cast("double"), lo, hi, bins) for k, c, (lo, hi) in zip(keys, cols, lo_hi, strict=True)})
    some = rows.where(agreed).dropna(subset=cols).groupBy(*keys).agg(F.count("*").alias("h"))
    n = some.agg(F.sum("h")).first()[0]
    if not n:
        return rows.drop(*keys).withColumn("term", F.lit(1.0))
    if bins ** len(cols) <= 1 << 16:
        some = F.broadcast(some)
    share = F.coalesce(F.col("h"), F.lit(0)) / F.lit(float(n))
    return rows.join(some, keys, "left").withColumn("term", -F.ln(share + F.lit(FLOOR)) / F.lit(-math.log(FLOOR) if scaled else 1.0)).drop("h", *keys)


def seeds(points: DataFrame, labels: int) -> DataFrame:
    """(x, y, z, m0, m1, ...): voxels that hold a point (px, py, pz, label), 1 in the channel of each label found there."""
    near = lambda c: F.floor(F.col(c) + F.lit(0.5)).alias(c[1:])
    return points.groupBy(near("px"), near("py"), near("pz")).agg(*(F.max((F.col("label") == k).cast("int")).alias(f"m{k}") for k in range(labels)))


#: The share of the range that is added on either side of the rounded histogram, and its most bins.
PADDING, MOST_BINS = 0.0125, 512


def rounded_log_likelihood(image: DataFrame, agreed: Column, v: str, bins: int) -> DataFrame:
    """The rows with `term`: ln of the share of the agreed voxels in a voxel's bin over ln FLOOR, cut to 0 .. 1.

    Bins are the nearest of at most MOST_BINS between the extremes, which are moved apart by PADDING. Without agreed voxels all terms are 1.
    """
    lo, hi = extremes(image, v)[0]
    pad, n = (hi - lo) * PADDING, min(bins, MOST_BINS)
    lo, hi = lo - pad, hi + pad
    place = F.floor((n - 1) * ((F.col(v) - F.lit(lo)) / F.lit(hi - lo if hi > lo else 1.0)) + F.lit(0.5)).cast("long")
    rows = image.withColumn("b0", place)
    some = rows.where(agreed).where("b0 is not null").groupBy("b0").agg(F.count("*").alias("h"))
    total = some.agg(F.sum("h")).first()[0]
    if not total:
        return rows.drop("b0").withColumn("term", F.lit(1.0))
    cost = F.when(F.col("h") > 0, F.ln(F.col("h") / F.lit(float(total))) / F.lit(math.log(FLOOR)))
    return rows.join(F.broadcast(some), "b0", "left").withColumn("term", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cost, F.lit(1.0))))).drop("h", "b0")


def within_spans(image: DataFrame, spans: DataFrame, reverse: bool = False) -> DataFrame:
    """The voxels (x, y, z, ...) in one of the spans (y, z, x0, x1), ends included; or, reversed, in none."""
    s = spans.select(F.col("y").alias("sy"), F.col("z").alias("sz"), "x0", "x1")
    inside = (F.col("y") == F.col("sy")) & (F.col("z") == F.col("sz")) & F.col("x").between(F.col("x0"), F.col("x1"))
    return image.join(s, inside, "left_anti" if reverse else "left_semi")


def branch_labels(maps: DataFrame, edges: DataFrame) -> DataFrame:
    """(voxel, node, value): the leaves' values (voxel, node, value) and, for each inner node of the edges (src, dst, weight), their sums by weights.

    The few ways from a node to its leaves are rolled up first and broadcast, so the voxels are shuffled once.
    """
    from .hierarchy import read_graph

    graph = read_graph(edges)
    ways: dict[tuple[str, str], float] = {(k, k): 1.0 for k in graph.leaves}
    for n in reversed(graph.order):
        for p, w in graph.parents(n):
            for (a, leaf), v in list(ways.items()):
                if a == n:
                    ways[p, leaf] = ways.get((p, leaf), 0.0) + w * v
    table = maps.sparkSession.createDataFrame([(leaf, n, w) for (n, leaf), w in ways.items()], "node string, up string, w double")
    return maps.join(F.broadcast(table), "node").groupBy("voxel", F.col("up").alias("node")).agg(F.sum(F.col("value") * F.col("w")).alias("value"))
