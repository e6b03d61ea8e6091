"""Buffer arithmetic, fuzzy norms, radial bases, colour and small matrices, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled(v: Column, scale: float = 1.0, shift: float = 0.0) -> Column:
    return v * F.lit(float(scale)) + F.lit(float(shift))


def without_nan(v: Column, value: float) -> Column:
    return F.nanvl(v, F.lit(float(value)))


def safe_log(v: Column) -> Column:
    """ln v; null for what isn't above 0."""
    return F.when(v > 0, F.ln(v))


def log_sum_exp(v: Column, most: Column) -> Column:
    """As an aggregate: ln of the sum of exp v, where `most` is the group's greatest v."""
    return F.max(most) + F.ln(F.sum(F.exp(v - most)))


def nearest(v: Column) -> Column:
    """The nearest whole number, halves up."""
    return F.floor(v + F.lit(0.5))


def t_norm(a: Column, b: Column, kind: int = 0) -> Column:
    """Fuzzy and: 0 the least, 1 the product, 2 Hamacher's product (0 of two zeros)."""
    both = a * b
    return (F.least(a, b), both, F.coalesce(F.try_divide(both, a + b - both), F.lit(0.0)))[kind]


def s_norm(a: Column, b: Column, kind: int = 0) -> Column:
    """Fuzzy or: 0 the greatest, 1 the probabilistic sum, 2 the bounded sum."""
    return (F.greatest(a, b), a + b - a * b, F.least(F.lit(1.0), a + b))[kind]


#: Compactly supported bases of r in 0 .. 1, smoother from one to the next; 0 beyond.
def radial_basis(r: Column, order: int = 1) -> Column:
    left = F.lit(1.0) - r
    inner = (left * left, F.pow(left, F.lit(4)) * (4 * r + 1), F.pow(left, F.lit(6)) * (35 * r * r + 18 * r + 3))[order]
    return F.when(r < 1, inner).otherwise(F.lit(0.0))


def radial_slope(r: Column, order: int = 1) -> Column:
    """The derivative of radial_basis() by r."""
    left = F.lit(1.0) - r
    inner = (-2 * left, -20 * r * F.pow(left, F.lit(3)), -56 * r * F.pow(left, F.lit(5)) * (5 * r + 1))[order]
    return F.when(r < 1, inner).otherwise(F.lit(0.0))


def log_axis(v: Column, offset: float) -> Column:
    """A magnitude on the logarithmic axis of a transfer function."""
    return (F.ln(v * v + F.lit(float(offset))) - F.lit(math.log(offset))) / F.lit(math.log(2.0))


def from_log_axis(u: Column, offset: float) -> Column:
    return F.sqrt(F.lit(float(offset)) * (F.exp(u * F.lit(math.log(2.0))) - 1))


def saturate(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def color_restored(out: Column, channel: Column, gray: Column) -> Column:
    """A Retinex channel weighted by its share of the grey level."""
    return out * (F.ln(125 * channel) - F.ln(3 * gray))


def retinex(image: Column, blurs: list[Column]) -> Column:
    """Mean over the scales of ln image - ln blurred image."""
    return sum((F.ln(image) - F.ln(b) for b in blurs[1:]), F.ln(image) - F.ln(blurs[0])) / len(blurs)


def bending_energy(second: dict[str, Column], spacing: tuple[float, float, float]) -> Column:
    """Squared second derivatives over the spacing, the mixed ones twice: xx, yy, zz, xy, xz, yz in voxel units."""
    h = dict(zip("xyz", spacing, strict=True))
    out = F.lit(0.0)
    for k, c in second.items():
        d = c / F.lit(h[k[0]] * h[k[1]])
        out = out + (1 if k[0] == k[1] else 2) * d * d
    return out


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: list[Column]) -> Column:
    return F.sqrt(dot(a, a))


def moved(matrix: list[float] | Column, p: list[Column]) -> list[Column]:
    """The point p under a 3 x 4 matrix by rows: numbers, or an array column of twelve."""
    m = [matrix[i] for i in range(12)]
    return [m[4 * r] * p[0] + m[4 * r + 1] * p[1] + m[4 * r + 2] * p[2] + m[4 * r + 3] for r in range(3)]


def solve3(m: list[list[Column]], v: list[Column]) -> list[Column]:
    """The solution of a 3 x 3 system by cofactors, null if it is singular."""
    det = dot(m[0], cross(m[1], m[2]))
    cols = [[m[r][c] for r in range(3)] for c in range(3)]
    swapped = lambda k: [v if c == k else cols[c] for c in range(3)]
    return [F.try_divide(dot(s[0], cross(s[1], s[2])), det) for s in map(swapped, range(3))]


def same_text(a: Column, b: Column) -> Column:
    """Equal but for case."""
    return F.lower(a) == F.lower(b)
