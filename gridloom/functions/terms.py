"""Per-voxel terms of a segmentation: what it costs, or how likely it is, that a value belongs to a label."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.statistics import extremes


def constant(c: float, entropy: bool = False) -> Column:
    """The probability c, or its cost -ln c."""
    return F.lit(-math.log(c) if entropy else float(c))


def logistic(v: Column, k: float, c: float, entropy: bool = False) -> Column:
    """1 / (1 + exp(-k (v - c))), or its -ln, which doesn't overflow for values far below c."""
    e = -F.lit(float(k)) * (v - F.lit(float(c)))
    cost = F.greatest(e, F.lit(0.0)) + F.log1p(F.exp(-F.abs(e)))
    return cost if entropy else F.exp(-cost)


def gaussian(v: Column, k: float, c: float, entropy: bool = False) -> Column:
    """exp(-((v - c) / k)^2 / 2), or its -ln."""
    d = (v - F.lit(float(c))) / F.lit(float(k))
    return d * d / 2 if entropy else F.exp(-d * d / 2)


def spike(v: Column, at: float, inside: float, outside: float, entropy: bool = False) -> Column:
    """`inside` where v is `at`, else `outside`; -ln of these as costs."""
    a, b = (-math.log(x) if entropy else float(x) for x in (inside, outside))
    return F.when(v == F.lit(float(at)), F.lit(a)).otherwise(F.lit(b))


def combined(*terms: Column, entropy: bool = False) -> Column:
    """The terms of several inputs as one: probabilities multiply, costs add."""
    out = terms[0]
    for t in terms[1:]:
        out = out + t if entropy else out * t
    return out


def normalized(df: DataFrame, v: str, term) -> DataFrame:
    """The rows with `term`: term(v) scaled to 0 .. 1 over the range of v pushed through a monotone or single-peaked term.

    The least and greatest of the term over all rows are aggregated; where they agree the term is 0.
    """
    df = df.withColumn("term", term(F.col(v)))
    lo, hi = extremes(df, "term")[0]
    return df.withColumn("term", (F.col("term") - F.lit(lo)) / F.lit(hi - lo) if hi > lo else F.col("term") * 0.0)


def threshold(v: Column, lo: float, hi: float, inside: float, outside: float) -> Column:
    return F.when(v.between(lo, hi), F.lit(float(inside))).when(v.isNotNull(), F.lit(float(outside)))


def luminance(channels: list[Column], weights: tuple[float, ...] = (0.30, 0.59, 0.11)) -> Column:
    return sum((c * F.lit(float(w)) for c, w in zip(channels[1:], weights[1:], strict=True)), channels[0] * F.lit(float(weights[0])))


def clipped(point: tuple[Column, Column, Column], planes: list[tuple[float, float, float, float]]) -> Column:
    """True where -(n . p + d) > 0 for a plane (nx, ny, nz, d); False without planes."""
    out = F.lit(False)
    for *n, d in planes:
        out = out | (-(sum((p * F.lit(float(k)) for p, k in zip(point, n, strict=True)), F.lit(0.0)) + F.lit(float(d))) > 0)
    return out


def inside_polygon(x: Column, y: Column, vertices: list[tuple[float, float]]) -> Column:
    """Even-odd rule: whether an odd number of edges cross the ray from (x, y) to greater x. Under three vertices: False."""
    crossed = F.lit(0)
    if len(vertices) < 3:
        return F.lit(False)
    for (x0, y0), (x1, y1) in zip(vertices, vertices[1:] + vertices[:1], strict=True):
        if y0 != y1:
            straddles = (F.lit(float(y0)) > y) != (F.lit(float(y1)) > y)
            at = F.lit(float(x0)) + (y - F.lit(float(y0))) * F.lit((x1 - x0) / (y1 - y0))
            crossed = crossed + (straddles & (x < at)).cast("int")
    return crossed % 2 == 1
