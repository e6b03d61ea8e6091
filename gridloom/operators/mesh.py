"""Triangle meshes: areas, quality, curvatures and normals, from points (pid, x, y, z) and cells (cid, p0, p1, p2)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arithmetic import cross, dot, norm
from ..scratch import written


def corners(cells: DataFrame, points: DataFrame) -> DataFrame:
    """(cid, p0, p1, p2, a, b, c): the cells with their corners as structs (x, y, z); cells with a corner that isn't there are left out.

    Corners are joined as rows and put together by cell: one join for all three.
    """
    at = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"p{k}").alias("pid")) for k in range(3)))
    rows = cells.select("cid", "p0", "p1", "p2", F.inline(at)).join(points.select("pid", F.struct(*(F.col(c).cast("double").alias(c) for c in "xyz")).alias("at")), "pid")
    out = rows.groupBy("cid", "p0", "p1", "p2").agg(*(F.max(F.when(F.col("k") == k, F.col("at"))).alias(n) for k, n in enumerate("abc")))
    return out.where("a is not null and b is not null and c is not null")


def _edge(p: str, q: str) -> list[Column]:
    return [F.col(f"{q}.{k}") - F.col(f"{p}.{k}") for k in "xyz"]


def _sides() -> list[Column]:
    """Lengths of the sides opposite a, b and c."""
    return [norm(_edge(*e)) for e in (("b", "c"), ("c", "a"), ("a", "b"))]


def area() -> Column:
    """By Heron's formula, from the corners a, b, c."""
    a, b, c = _sides()
    s = (a + b + c) / 2
    return F.sqrt(F.greatest(F.lit(0.0), s * (s - a) * (s - b) * (s - c)))


def quality() -> Column:
    """Radius of the outer circle over twice that of the inner one: 1 for equal sides; null for a triangle without area."""
    a, b, c = _sides()
    return F.try_divide(a * b * c * (a + b + c), 16 * area() * area())


def surface(cells: DataFrame, points: DataFrame) -> DataFrame:
    """One row (cells, area, quality): the number of triangles, the sum of their areas, and their mean quality."""
    return corners(cells, points).agg(F.count("*").alias("cells"), F.sum(area()).alias("area"), F.avg(quality()).alias("quality"))


def _angle(p: str, q: str, r: str) -> Column:
    """At corner p."""
    u, v = _edge(p, q), _edge(p, r)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(u, v), norm(u) * norm(v)))))


def gauss_curvature(cells: DataFrame, points: DataFrame) -> DataFrame:
    """(pid, curvature): three times what the angles around a point lack to a full turn, over the area of its triangles.

    Points of no triangle with an area don't occur.
    """
    around = F.array(*(F.struct(F.col(f"p{k}").alias("pid"), _angle(*c).alias("angle"), F.col("area")) for k, c in enumerate((("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b")))))
    rows = corners(cells, points).withColumn("area", area()).where("area > 0").select(F.inline(around))
    return rows.groupBy("pid").agg(((F.lit(2 * math.pi) - F.sum("angle")) * 3 / F.sum("area")).alias("curvature"))


def face_normals(cells: DataFrame, points: DataFrame) -> DataFrame:
    """corners() with nx, ny, nz, the unit normal, and the area; cells without area are left out."""
    n = cross(_edge("a", "b"), _edge("a", "c"))
    rows = corners(cells, points).withColumns({f"n{k}": v for k, v in zip("xyz", n, strict=True)}).withColumn("size", norm([F.col(f"n{k}") for k in "xyz"])).where("size > 0")
    return rows.withColumns({f"n{k}": F.col(f"n{k}") / F.col("size") for k in "xyz"}).withColumn("area", F.col("size") / 2).drop("size")


def sides(faces: DataFrame) -> DataFrame:
    """(lo, hi, cid, along, ...) for each side of each face; along: whether the face goes from lo to hi."""
    at = F.array(*(F.struct(F.least(f"p{i}", f"p{j}").alias("lo"), F.greatest(f"p{i}", f"p{j}").alias("hi"), (F.col(f"p{i}") < F.col(f"p{j}")).alias("along")) for i, j in ((0, 1), (1, 2), (2, 0))))
    return faces.select("*", F.inline(at))


def neighbours(faces: DataFrame) -> DataFrame:
    """(lo, hi, f, g): the sides that exactly two faces share, and these as structs of their columns, f the one of lesser cid."""
    rows = sides(faces).select("lo", "hi", F.struct("cid", "along", "nx", "ny", "nz", "area").alias("f"))
    return rows.groupBy("lo", "hi").agg(F.count("*").alias("n"), F.min("f").alias("f"), F.max("f").alias("g")).where("n = 2").drop("n")


def mean_curvature(cells: DataFrame, points: DataFrame) -> DataFrame:
    """(pid, curvature): half the mean, over a point's shared sides, of three times length and dihedral angle over the area of both faces.

    Faces that go the same way around count as turned towards each other. Points without shared sides don't occur.
    """
    n, m = ([F.col(f"{s}.n{k}") for k in "xyz"] for s in "fg")
    ends = points.select("pid", F.struct(*(F.col(c).cast("double").alias(c) for c in "xyz")).alias("at"))
    rows = neighbours(face_normals(cells, points)).join(ends.withColumnsRenamed({"pid": "lo", "at": "a"}), "lo").join(ends.withColumnsRenamed({"pid": "hi", "at": "b"}), "hi")
    e = _edge("a", "b")
    size = norm(e)
    turn = F.when(F.col("f.along"), 1.0).otherwise(-1.0)
    angle = F.atan2(turn * dot(e, cross(n, m)) / size, dot(n, m))
    h = 3 * size * angle / (F.col("f.area") + F.col("g.area"))
    return rows.where(size > 0).select(F.explode(F.array("lo", "hi")).alias("pid"), h.alias("h")).groupBy("pid").agg((F.avg("h") / 2).alias("curvature"))


def _ends(hooks: DataFrame) -> DataFrame:
    """(node, root, flip) with chains of hooks, each to a lesser node, followed to their ends: half of what is left each round."""
    while True:
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"), F.col("flip").alias("more"))
        hooks = written(hooks.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), (F.col("flip") != F.coalesce("more", F.lit(False))).alias("flip"), F.col("above").isNotNull().alias("moved")))
        if not hooks.where("moved").limit(1).count():
            return hooks.drop("moved")


def oriented(cells: DataFrame, points: DataFrame) -> DataFrame:
    """(cid, flip): whether a face has to be turned to go around as the face of least cid that sides lead to.

    Each round every part of the mesh that is known to agree hooks to its least neighbour, and chains of hooks are
    shortened by half, so the rounds grow with the logarithm of the mesh. On a one-sided surface one of the two ways wins.
    """
    pairs = neighbours(face_normals(cells, points)).select(F.col("f.cid").alias("a"), F.col("g.cid").alias("b"), (F.col("f.along") == F.col("g.along")).alias("turned"))
    edges = written(pairs)
    now = cells.select("cid", F.col("cid").alias("root"), F.lit(False).alias("flip"))
    while edges.limit(1).count():
        hooks = _ends(edges.groupBy(F.col("b").alias("node")).agg(F.min(F.struct(F.col("a").alias("root"), F.col("turned").alias("flip"))).alias("h")).select("node", "h.root", "h.flip"))
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"), F.col("flip").alias("more"))
        now = written(now.join(up, "root", "left").select("cid", F.coalesce("above", "root").alias("root"), (F.col("flip") != F.coalesce("more", F.lit(False))).alias("flip")))
        for end in "ab":
            up = hooks.select(F.col("node").alias(end), F.col("root").alias("above"), F.col("flip").alias("more"))
            edges = edges.join(up, end, "left").withColumns({end: F.coalesce("above", end), "turned": F.col("turned") != F.coalesce("more", F.lit(False))}).drop("above", "more")
        edges = written(edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("turned").alias("turned")))
    return now.select("cid", "flip")


def _joined_corners(edges: DataFrame) -> DataFrame:
    """(pid, cid, fan) of the corners that edges (pid, a, b), cells with a < b that meet at a point, lead to from the least cell `fan`.

    Corners hook to their least neighbour, chains of hooks are shortened by half a round, and what still is apart hooks again: rounds grow with
    the logarithm of the faces around a point, and no point's faces are gathered.
    """
    edges = written(edges)
    now = edges.select("pid", F.col("a").alias("cid")).union(edges.select("pid", "b")).distinct().withColumn("fan", F.col("cid"))
    while edges.limit(1).count():
        hooks = edges.groupBy("pid", F.col("b").alias("node")).agg(F.min("a").alias("root"))
        while True:
            up = hooks.select("pid", F.col("node").alias("root"), F.col("root").alias("above"))
            hooks = written(hooks.join(up, ["pid", "root"], "left").select("pid", "node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
            if not hooks.where("moved").limit(1).count():
                break
        now = written(now.join(hooks.select("pid", F.col("node").alias("fan"), "root"), ["pid", "fan"], "left").select("pid", "cid", F.coalesce("root", "fan").alias("fan")))
        for end in "ab":
            edges = edges.join(hooks.select("pid", F.col("node").alias(end), "root"), ["pid", end], "left").withColumn(end, F.coalesce("root", end)).drop("root")
        edges = written(edges.where("a <> b").select("pid", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return now


def fans(cells: DataFrame, points: DataFrame, feature: float = 30.0) -> DataFrame:
    """(cid, pid, fan, nx, ny, nz): each corner of a mesh with its smooth fan, named by its face of least cid, and the fan's unit normal.

    Faces are turned to agree first. Two faces around a point belong to one fan if sides at that point lead from one to the other, each shared by exactly
    two faces whose normals are at most `feature` degrees apart. A fan's normal is that of its faces by their area (null where these cancel). A point with several fans lies on
    a sharp edge: (pid, fan) are the points of the mesh split along it. The work is linear in the corners.
    """
    faces = face_normals(cells, points).join(oriented(cells, points), "cid").withColumns({f"n{k}": F.when(F.col("flip"), -F.col(f"n{k}")).otherwise(F.col(f"n{k}")) for k in "xyz"})
    faces = written(faces.select("cid", "p0", "p1", "p2", "nx", "ny", "nz", "area"))
    like = sum((F.col(f"f.n{k}") * F.col(f"g.n{k}") for k in "xyz"), F.lit(0.0)) >= math.cos(math.radians(feature)) - 1e-12
    edges = neighbours(faces).where(like).select(F.explode(F.array("lo", "hi")).alias("pid"), F.least("f.cid", "g.cid").alias("a"), F.greatest("f.cid", "g.cid").alias("b"))
    rows = faces.select("cid", "nx", "ny", "nz", "area", F.explode(F.array("p0", "p1", "p2")).alias("pid"))
    rows = written(rows.join(_joined_corners(edges), ["pid", "cid"], "left").withColumn("fan", F.coalesce("fan", "cid")))
    total = rows.groupBy("pid", "fan").agg(*(F.sum(F.col("area") * F.col(f"n{k}")).alias(f"s{k}") for k in "xyz"))
    size = norm([F.col(f"s{k}") for k in "xyz"])
    return rows.select("cid", "pid", "fan").join(total, ["pid", "fan"]).select("cid", "pid", "fan", *(F.try_divide(F.col(f"s{k}"), size).alias(f"n{k}") for k in "xyz"))


def point_normals(cells: DataFrame, points: DataFrame, feature: float = 30.0) -> DataFrame:
    """(cid, pid, nx, ny, nz): the unit normal of each face at each of its points, that of its fan there."""
    return fans(cells, points, feature).drop("fan")
