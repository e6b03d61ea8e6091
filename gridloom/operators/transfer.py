"""Transfer functions: polygons over intensity and gradient, drawn into tables of colours and classes that classify voxels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import clipped, inside_polygon


@dataclass(frozen=True)
class Polygon:
    color: tuple[float, float, float, float]
    vertices: tuple[tuple[float, float], ...]
    label: int = 0
    light: tuple[float, float, float, float] = (1.0, 0.0, 0.0, 1.0)  # ambient, diffuse, specular, power

    @classmethod
    def cleaned(cls, polygons: list[Polygon]) -> list[Polygon]:
        """The polygons without repeats, in order."""
        return list(dict.fromkeys(polygons))


def lookup_table(spark: SparkSession, polygons: list[Polygon], size: tuple[int, int], low: tuple[float, float], high: tuple[float, float], lights: bool = False) -> DataFrame:
    """(i, g, r, green, b, a, class): the last polygon that holds each of the table's points; zeros and class 0 where none does.

    A table has size[0] x size[1] points from `low` to `high`. With `lights` it has ambient, diffuse, specular and power of the polygon besides; 1, 0, 0, 1 where there is none.
    """
    shine = lambda p: [F.lit(float(c)).alias(k) for k, c in zip(("ambient", "diffuse", "specular", "power"), p, strict=True)] if lights else []
    n, m = size
    step = [(h - lo) / max(k - 1, 1) for lo, h, k in zip(low, high, size, strict=True)]
    at = spark.range(n * m).select((F.col("id") % n).alias("i"), F.floor(F.col("id") / n).alias("g"))
    x, y = F.lit(float(low[0])) + F.col("i") * F.lit(step[0]), F.lit(float(low[1])) + F.col("g") * F.lit(step[1])
    out: Column | None = None
    for p in reversed(polygons):
        value = F.struct(*(F.lit(float(c)).alias(k) for k, c in zip(("r", "green", "b", "a"), p.color, strict=True)), F.lit(p.label).cast("long").alias("class"), *shine(p.light))
        held = inside_polygon(x, y, list(p.vertices))
        out = F.when(held, value) if out is None else out.when(held, value)
    none = F.struct(*(F.lit(0.0).alias(k) for k in ("r", "green", "b", "a")), F.lit(0).cast("long").alias("class"), *shine((1.0, 0.0, 0.0, 1.0)))
    return at.select("i", "g", (none if out is None else out.otherwise(none)).alias("c")).select("i", "g", "c.*")


def place(v: Column, low: float, high: float, n: int) -> Column:
    """The nearest of n points of a table's axis, clamped."""
    k = F.floor((v - F.lit(low)) / F.lit((high - low) / max(n - 1, 1)) + F.lit(0.5))
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), k))


def classify(image: DataFrame, table: DataFrame, size: tuple[int, int], low: tuple[float, float], high: tuple[float, float]) -> DataFrame:
    """The rows (v, gradient) with r, green, b, a and class of the nearest point of a table, whose size is bounded and which is broadcast."""
    if size[0] * size[1] > 1 << 20:
        raise ValueError("the table is too large")
    rows = image.withColumns({"i": place(F.col("v"), low[0], high[0], size[0]), "g": place(F.col("gradient"), low[1], high[1], size[1])})
    return rows.join(F.broadcast(table), ["i", "g"], "left").drop("i", "g")


def classify_in_keyhole(image: DataFrame, primary: DataFrame, inner: DataFrame, size: tuple[int, int], low: tuple[float, float], high: tuple[float, float], planes: list, hole: list) -> DataFrame:
    """The rows (x, y, z, v, gradient) with `class`: of the primary table, of the inner one and negative where no plane of the keyhole cuts off; 0 where a clip plane does."""
    rows = classify(image, primary.select("i", "g", "class"), size, low, high)
    rows = classify(rows, inner.select("i", "g", F.col("class").alias("inner")), size, low, high)
    at = (F.col("x").cast("double"), F.col("y").cast("double"), F.col("z").cast("double"))
    inside = ~clipped(at, hole) if hole else F.lit(False)
    return rows.withColumn("class", F.when(clipped(at, planes), 0).when(inside, -F.col("inner")).otherwise(F.col("class"))).drop("inner")
