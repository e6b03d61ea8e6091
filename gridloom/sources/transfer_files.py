"""Transfer functions as text: a number of polygons, then for each its colour, light, class and vertices, between white space."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.transfer import Polygon


def parse(text: str) -> list[Polygon]:
    """n, then n times: r g b a, ambient diffuse specular power, class, number of vertices, and as many pairs."""
    words = iter(text.split())
    some = lambda k: tuple([float(next(words)) for _ in range(k)])
    out = []
    try:
        for _ in range(int(next(words))):
            color, light, label = some(4), some(4), int(float(next(words)))
            out.append(Polygon(color, tuple([some(2) for _ in range(int(next(words)))]), label, light))
    except StopIteration:
        raise ValueError("the file ends early") from None
    return out


def unparse(polygons: list[Polygon]) -> str:
    """The same text; repeated polygons are written once."""
    line = lambda v: " ".join(map(repr, v))
    some = Polygon.cleaned(polygons)
    parts = [str(len(some))]
    for p in some:
        parts += [line(p.color), line(p.light), str(p.label), str(len(p.vertices)), *map(line, p.vertices)]
    return "\n".join(parts) + "\n"


def read_polygons(spark: SparkSession, path: str) -> list[Polygon]:
    """The polygons of one file, read by Spark from wherever it can read."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("not one file")
    return parse(rows[0]["value"])


def write_polygons(spark: SparkSession, polygons: list[Polygon], path: str) -> None:
    spark.createDataFrame([(unparse(polygons),)], "value string").coalesce(1).write.text(path)
