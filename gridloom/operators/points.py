"""Nearest points, statistics of correspondences, and warps by compactly supported radial bases."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arithmetic import radial_basis
from ..scratch import written
from .ordered import numbered


def thinned(points: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Of points that agree in x, y, z and `also`, the two of least pid: one may be the point that is asked for."""
    keys = ["x", "y", "z", *also]
    first = written(points.groupBy(*keys).agg(F.min("pid").alias("pid")))
    second = points.join(first.select("pid"), "pid", "left_anti").groupBy(*keys).agg(F.min("pid").alias("pid"))
    return first.unionByName(second)


IN_LEAF = 64  # points at most
FAN = 3  # bits of a node's number that tell its children apart
SMALL = 4096  # nodes of a level that are broadcast
XYZ = ("x", "y", "z")


@dataclass(frozen=True)
class Tree:
    """Points in leaves of at most IN_LEAF, and the boxes of the nodes above by level: a node's parent is its number without the last FAN bits."""

    points: DataFrame  # leaf, pid, p_...
    levels: list[DataFrame]  # node, lo_..., hi_... from the leaves up to one of at most 2^FAN nodes
    bits: int  # of a leaf's number


def tree(points: DataFrame, columns: tuple[str, ...], split: tuple[str, ...] = XYZ) -> Tree:
    """The tree of points (pid, columns...), cut by counts along `split`, one column after the other: into slabs, those into columns, those into leaves.

    So leaves have as many points wherever points are close or alone. Each cut numbers the points of all slabs in one sort by ranges.
    """
    rows, n = points.select("pid", *columns).withColumn("leaf", F.lit(0).cast("long")), max(points.count(), 1)
    parts = max(1, math.ceil(round((n / IN_LEAF) ** (1 / len(split)), 9)))
    bits, held = max(1, parts.bit_length()), n
    for c in split:
        held = -(-held // parts)
        rows = numbered(rows, "leaf", [c, "pid"], "at").withColumn("leaf", F.shiftleft("leaf", bits) + F.floor((F.col("at") - 1) / held)).drop("at")
    rows = written(rows.select("leaf", "pid", *(F.col(c).alias(f"p_{c}") for c in columns)))
    box = [f(F.col(f"{k}_{c}")).alias(f"{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))]
    level = written(rows.select(F.col("leaf").alias("node"), *(F.col(f"p_{c}").alias(f"{k}_{c}") for c in columns for k in ("lo", "hi"))).groupBy("node").agg(*box))
    levels = [level]
    for _ in range(0, bits * len(split) - FAN, FAN):
        level = written(level.withColumn("node", F.shiftright("node", FAN)).groupBy("node").agg(*box))
        levels.append(level)
    return Tree(rows, levels, bits * len(split))


def _below(front: DataFrame, t: Tree, level: int, floor: Column) -> DataFrame:
    """The queries' nodes one level down with `least`, which no point there can cost less than; a level of few nodes is broadcast."""
    nodes = t.levels[level].withColumn("parent", F.shiftright("node", FAN))
    if t.bits - FAN * level <= SMALL.bit_length() - 1:
        nodes = F.broadcast(nodes)
    off = [F.greatest(F.col(f"lo_{c}") - F.col(f"q_{c}"), F.col(f"q_{c}") - F.col(f"hi_{c}"), F.lit(0.0)) for c in XYZ]
    least = F.sqrt(sum((o * o for o in off), F.lit(0.0))) + F.greatest(F.lit(0.0), F.coalesce(floor, F.lit(0.0)))
    return front.withColumnRenamed("node", "parent").join(nodes, "parent").withColumn("least", least).drop("parent", *(c for c in nodes.columns if c[:3] in ("lo_", "hi_")))


def meetings(queries: DataFrame, points: DataFrame, penalty: Column | None = None, also: tuple[str, ...] = (), floor: Column | None = None, split: tuple[str, ...] = XYZ) -> DataFrame:
    """(qid, pid, distance, cost) of the pairs that nearest() has to look at: every query's point of least cost is among them.

    A query goes down the tree with its two best nodes to a first cost; then with all nodes whose `least` isn't above that.
    """
    also = tuple(also)
    points = written(thinned(points.select("pid", *XYZ, *also).dropna(subset=list(XYZ)), also))
    asked = queries.select("qid", *XYZ, *also).dropna(subset=list(XYZ)).select("qid", *(F.col(c).cast("double").alias(f"q_{c}") for c in (*XYZ, *also)))
    t = tree(points.select("pid", *(F.col(c).cast("double").alias(c) for c in (*XYZ, *also))), (*XYZ, *also), split)
    floor = F.lit(0.0) if floor is None else floor
    distance = F.sqrt(sum((F.pow(F.col(f"q_{c}") - F.col(f"p_{c}"), F.lit(2)) for c in XYZ), F.lit(0.0)))

    def met(front: DataFrame) -> DataFrame:
        pairs = front.withColumnRenamed("node", "leaf").join(t.points, "leaf").where(F.col("pid") != F.col("qid"))
        return pairs.select("qid", "pid", distance.alias("distance"), (distance + (F.lit(0.0) if penalty is None else penalty)).alias("cost")).where("cost is not null")

    q = [c for c in asked.columns if c != "qid"]
    front = asked.withColumn("node", F.lit(0).cast("long"))
    for level in reversed(range(len(t.levels))):
        two = F.slice(F.sort_array(F.collect_list(F.struct("least", "node"))), 1, 2)  # of at most 2^(FAN + 1)
        front = _below(front, t, level, floor).groupBy("qid", *q).agg(F.transform(two, lambda x: x["node"]).alias("nodes")).select("qid", *q, F.explode("nodes").alias("node"))
        front = written(front)
    first = met(front).groupBy("qid").agg(F.min("cost").alias("bound"))
    front = written(asked.join(first, "qid", "left")).withColumn("node", F.lit(0).cast("long"))
    for level in reversed(range(len(t.levels))):
        front = written(_below(front, t, level, floor).where(F.col("bound").isNull() | (F.col("least") <= F.col("bound") * (1 + 1e-9))).drop("least"))
    return met(front)


def nearest(queries: DataFrame, points: DataFrame, penalty: Column | None = None, also: tuple[str, ...] = (), floor: Column | None = None, split: tuple[str, ...] = XYZ) -> DataFrame:
    """(qid, pid, distance, cost) of the point of least cost of each query (qid, x, y, z, also...); of equal ones the least pid.

    The cost is the distance plus a penalty that is never negative: an expression of the columns `also` of the query (q_...)
    and of the point (p_...); a point whose penalty is null isn't taken. A point of the query's own id doesn't count. Queries with a null coordinate, or without
    any other point, get nulls. Exact for any points: they lie in a tree whose leaves have equal counts, a query takes a first cost from its two best leaves, and then
    looks into all leaves that may have a lesser one. `floor` is what the penalty is at least in a node, an expression of q_... and of the ends lo_..., hi_...
    of the points' columns there; with it, and with leaves that are cut along those columns too (`split`), penalties that exceed all distances bound the search as well.
    """
    best = meetings(queries, points, penalty, also, floor, split).groupBy("qid").agg(F.min(F.struct("cost", "pid", "distance")).alias("b"))
    return queries.select("qid").join(best.select("qid", "b.pid", "b.distance", "b.cost"), "qid", "left")


def normal_floor(weight: float) -> Column:
    """What normal_penalty() is at least for normals within lo_n., hi_n.."""
    most = sum((F.greatest(F.col(f"q_n{c}") * F.col(f"lo_n{c}"), F.col(f"q_n{c}") * F.col(f"hi_n{c}")) for c in "xyz"), F.lit(0.0))
    return F.lit(float(weight)) * F.greatest(F.lit(0.0), 1 - most)


def normal_penalty(weight: float) -> Column:
    """weight (1 - n . n') of unit normals nx, ny, nz."""
    return F.lit(float(weight)) * F.greatest(F.lit(0.0), 1 - sum((F.col(f"q_n{c}") * F.col(f"p_n{c}") for c in "xyz"), F.lit(0.0)))


def shape_penalty(shape: float, curved: float) -> Column:
    """Differences of the shape indices and curvednesses of mean curvature h and Gaussian curvature k."""
    index = lambda s: F.lit(2 / np.pi) * F.atan2(-F.col(f"{s}_h"), F.sqrt(F.greatest(F.lit(0.0), F.col(f"{s}_h") ** 2 - F.col(f"{s}_k"))))
    curvedness = lambda s: F.sqrt(F.greatest(F.lit(0.0), 2 * F.col(f"{s}_h") ** 2 - F.col(f"{s}_k")))
    return F.lit(float(shape)) * F.abs(index("q") - index("p")) + F.lit(float(curved)) * F.abs(curvedness("q") - curvedness("p"))


def distance_statistics(found: DataFrame, far: float = 3.0) -> DataFrame:
    """One row of the distances: n, mean, sample standard deviation, least, greatest, root mean square, and how many are over `far`."""
    d = F.col("distance")
    return found.agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("std"), F.min(d).alias("least"), F.max(d).alias("most"), F.sqrt(F.avg(d * d)).alias("rms"), F.count_if(d > far).alias("far"))


MOST_LANDMARKS = 2000


#: Of the distance in units of sigma, on the driver: of an order of radial_basis().
BASES: tuple[Callable[[np.ndarray], np.ndarray], ...] = (lambda r: np.maximum(1 - r, 0) ** 2, lambda r: np.maximum(1 - r, 0) ** 4 * (4 * r + 1), lambda r: np.maximum(1 - r, 0) ** 6 * (35 * r**2 + 18 * r + 3))


def radial_warp(points: DataFrame, landmarks: DataFrame, sigma: float, order: int = 1, basis: tuple[Callable[[np.ndarray], np.ndarray], Callable[[Column], Column]] | None = None) -> DataFrame:
    """The points (x, y, z, ...) moved so that landmarks (sx, sy, sz) come to (tx, ty, tz), with wx, wy, wz for where they go.

    The weights of the at most MOST_LANDMARKS landmarks are solved for on the driver by least squares. A basis is 0 beyond
    sigma, so landmarks are listed by cells of that width, and a point takes those of its cell: the list is broadcast,
    and points aren't shuffled. `basis` replaces the basis of that order by a caller's own: the same function of the distance over sigma, of an
    array for the solution and of a Column for the points; what it gives from 1 on counts as 0.
    """
    rows = landmarks.select("sx", "sy", "sz", "tx", "ty", "tz").dropna().limit(MOST_LANDMARKS + 1).collect()
    if len(rows) > MOST_LANDMARKS:
        raise ValueError(f"over {MOST_LANDMARKS} landmarks")
    if not rows:
        return points.withColumns({f"w{c}": F.col(c) for c in "xyz"})
    m = np.array([tuple(r) for r in rows], float)
    src, move = m[:, :3], m[:, 3:] - m[:, :3]
    r = np.linalg.norm(src[:, None] - src[None], axis=2) / sigma
    solved, shown = basis or (BASES[order], lambda x: radial_basis(x, order))
    phi = np.where(r < 1, solved(r), 0.0)
    weights = np.linalg.lstsq(phi, move, rcond=1e-12)[0]
    lists: dict[tuple[int, ...], list] = {}
    for p, w in zip(src, weights, strict=True):
        for o in product((-1, 0, 1), repeat=3):
            lists.setdefault(tuple((np.floor(p / sigma) + o).astype(int).tolist()), []).append((*p.tolist(), *w.tolist()))
    near = points.sparkSession.createDataFrame([(*k, v) for k, v in lists.items()], "kx long, ky long, kz long, near array<struct<x: double, y: double, z: double, wx: double, wy: double, wz: double>>")
    out = points.withColumns({f"k{c}": F.floor(F.col(c) / F.lit(float(sigma))) for c in "xyz"}).join(F.broadcast(near), ["kx", "ky", "kz"], "left")

    def pushed(c: str) -> Column:
        far = lambda p: F.sqrt(sum(((F.col(k) - p[k]) * (F.col(k) - p[k]) for k in "xyz"), F.lit(0.0))) / F.lit(float(sigma))
        return F.col(c) + F.aggregate(F.coalesce("near", F.array().cast(near.schema["near"].dataType)), F.lit(0.0), lambda acc, p: acc + F.when(far(p) < 1, shown(far(p))).otherwise(0.0) * p[f"w{c}"])

    return out.withColumns({f"w{c}": pushed(c) for c in "xyz"}).drop("kx", "ky", "kz", "near")


def ring_tangents(rings: DataFrame) -> DataFrame:
    """The points (ring, at, x, y, ...) with tx, ty: the unit direction from the point before to the one after; the ends of a ring meet.

    A ring of one point, or one whose neighbours agree, has none (null).
    """
    by, whole = Window.partitionBy("ring").orderBy("at"), Window.partitionBy("ring").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = {c: F.coalesce(F.lead(c).over(by), F.first(c).over(whole)) - F.coalesce(F.lag(c).over(by), F.last(c).over(whole)) for c in "xy"}
    size = F.sqrt(F.col("tx") ** 2 + F.col("ty") ** 2)
    rows = rings.withColumns({f"t{c}": v for c, v in d.items()}).withColumn("size", size)
    return rows.withColumns({f"t{c}": F.try_divide(F.col(f"t{c}"), F.col("size")) for c in "xy"}).drop("size")


def tangent_penalty(weight: float) -> Column:
    """weight (1 - t . t' / 2) of unit tangents tx, ty."""
    return F.lit(float(weight)) * (1 - (F.col("q_tx") * F.col("p_tx") + F.col("q_ty") * F.col("p_ty")) / 2)
