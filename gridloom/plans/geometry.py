"""Correspondences, meshes and warps over the embeddings' first components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mesh, points
from ..sources import fixtures as fx
from .rounding import rounded, rounded_sql


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point whose id is divisible by 20, against all points but itself."""
    p = fx.points(spark, sf_dir)
    return points.nearest(p.where("pid % 20 = 0").withColumnRenamed("pid", "qid"), p)


def nn_correspondence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_found(spark, sf_dir).select("qid", "pid", "distance"))


def corr_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(points.distance_statistics(_found(spark, sf_dir), far=0.02))


def nn_with_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correspondence that also asks for like directions: here the points' own, as from the centre."""
    p = fx.points(spark, sf_dir)
    size = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    p = p.withColumns({f"n{c}": F.col(c) / size for c in "xyz"})
    found = points.nearest(p.where("pid % 20 = 0").withColumnRenamed("pid", "qid"), p, points.normal_penalty(0.25), ("nx", "ny", "nz"), points.normal_floor(0.25))
    return rounded(found.select("qid", "pid", "cost"))


_NEAR = f"""with {fx.POINTS}, d as (select q.pid qid, p.pid, sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2) + pow(q.z - p.z, 2)) distance, 1 - (q.x * p.x + q.y * p.y + q.z * p.z) / (sqrt(q.x * q.x + q.y * q.y + q.z * q.z) * sqrt(p.x * p.x + p.y * p.y + p.z * p.z)) turn
  from pt q join pt p on p.pid <> q.pid where q.pid % 20 = 0)"""
_FOUND = "n as (select qid, pid, distance from (select *, row_number() over (partition by qid order by distance, pid) k from d) where k = 1)"
NN = rounded_sql(f"{_NEAR}, {_FOUND}, t as (select * from n)", "distance", "qid pid")
STATS = rounded_sql(f"{_NEAR}, {_FOUND}, t as (select count(*) n, avg(distance) mean, stddev_samp(distance) std, min(distance) least, max(distance) most, sqrt(avg(distance * distance)) rms, count(*) filter (distance > 0.02) far from n)", "mean std least most rms", "n far")
NORMALS = rounded_sql(f"{_NEAR}, t as (select qid, pid, cost from (select *, row_number() over (partition by qid order by cost, pid) k from (select *, distance + 0.25::double * greatest(0, turn) cost from d)) where k = 1)", "cost", "qid pid")


def mesh_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mesh.surface(fx.strip(spark, sf_dir), fx.points(spark, sf_dir)).select("cells", "area"))


def mesh_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mesh.corners(fx.strip(spark, sf_dir), fx.points(spark, sf_dir)).select("cid", mesh.quality().alias("quality")), 2)


def gauss_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mesh.gauss_curvature(fx.strip(spark, sf_dir), fx.points(spark, sf_dir)), 1)


def mean_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mesh.mean_curvature(fx.strip(spark, sf_dir), fx.points(spark, sf_dir)), 3)


def point_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mesh.point_normals(fx.strip(spark, sf_dir), fx.points(spark, sf_dir)), 4)


_len = lambda p, q: f"sqrt(pow({p}.x - {q}.x, 2) + pow({p}.y - {q}.y, 2) + pow({p}.z - {q}.z, 2))"
_CELLS = f"""with {fx.POINTS}, {fx.STRIP}, s as (select cid, p0, p1, p2, {_len("b", "c")} u, {_len("c", "a")} v, {_len("a", "b")} w from tri join pt a on a.pid = p0 join pt b on b.pid = p1 join pt c on c.pid = p2),
h as (select *, sqrt(greatest(0, (u + v + w) / 2 * ((u + v + w) / 2 - u) * ((u + v + w) / 2 - v) * ((u + v + w) / 2 - w))) area from s)"""
AREA = rounded_sql(f"{_CELLS}, t as (select count(*) cells, sum(area) area from h)", "area", "cells")
QUALITY = rounded_sql(f"{_CELLS}, t as (select cid, u * v * w / (4 * area) / (2 * area / ((u + v + w) / 2)) quality from h)", "quality", "cid", 2)
_cosine = lambda o, p, q: f"acos(greatest(-1, least(1, ({p} * {p} + {q} * {q} - {o} * {o}) / (2 * {p} * {q}))))"
GAUSS = rounded_sql(f"""{_CELLS}, g as (select p0 pid, {_cosine("u", "v", "w")} angle, area from h union all select p1, {_cosine("v", "w", "u")}, area from h union all select p2, {_cosine("w", "u", "v")}, area from h),
t as (select pid, (2 * pi() - sum(angle)) * 3 / sum(area) curvature from g where area > 0 group by 1)""", "curvature", "pid", 1)


#: The strip's faces lie side by side, each turned the other way than the one before it.
_FACES = f"""with {fx.POINTS}, {fx.STRIP}, c as (select cid, p0, p1, p2, (b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y) cx, (b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z) cy, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) cz,
  b.x lx, b.y ly, b.z lz, c.x hx, c.y hy, c.z hz from tri join pt a on a.pid = p0 join pt b on b.pid = p1 join pt c on c.pid = p2),
fc as (select *, sqrt(cx * cx + cy * cy + cz * cz) s from c)"""
FANS = rounded_sql(f"""{_FACES}, fo as (select cid, s / 2 area, (1 - 2 * (cid % 2)) * cx / s nx, (1 - 2 * (cid % 2)) * cy / s ny, (1 - 2 * (cid % 2)) * cz / s nz, p0, p1, p2 from fc where s > 0),
co as (select cid, area, nx, ny, nz, unnest([p0, p1, p2]) pid from fo),
br as (select *, case when lag(cid) over w = cid - 1 and lag(nx) over w * nx + lag(ny) over w * ny + lag(nz) over w * nz >= cos(radians(30)) - 1e-12 then 0 else 1 end brk from co window w as (partition by pid order by cid)),
fn as (select *, sum(brk) over (partition by pid order by cid) fan from br),
su as (select cid, pid, sum(area * nx) over f sx, sum(area * ny) over f sy, sum(area * nz) over f sz from fn window f as (partition by pid, fan)),
t as (select cid, pid, sx / sqrt(sx * sx + sy * sy + sz * sz) nx, sy / sqrt(sx * sx + sy * sy + sz * sz) ny, sz / sqrt(sx * sx + sy * sy + sz * sz) nz from su)""", "nx ny nz", "cid pid", 4)
MEAN = rounded_sql(f"""{_FACES}, pr as (select f.cid, g.p0 lo, g.p1 hi, (f.s + g.s) / 2 area, f.hx - f.lx ex, f.hy - f.ly ey, f.hz - f.lz ez, f.cx / f.s nx, f.cy / f.s ny, f.cz / f.s nz, g.cx / g.s mx, g.cy / g.s my, g.cz / g.s mz from fc f join fc g on g.cid = f.cid + 1 and g.p0 = f.p1 where f.s > 0 and g.s > 0),
an as (select lo, hi, area, sqrt(ex * ex + ey * ey + ez * ez) e, (ex * (ny * mz - nz * my) + ey * (nz * mx - nx * mz) + ez * (nx * my - ny * mx)) d, nx * mx + ny * my + nz * mz c from pr),
hh as (select unnest([lo, hi]) pid, 3 * e * atan2(d / e, c) / area h from an where e > 0),
t as (select pid, avg(h) / 2 curvature from hh group by 1)""", "curvature", "pid", 3)


def ring_tangents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of fifty points each."""
    p = fx.points(spark, sf_dir).select(F.floor(F.col("pid") / 50).alias("ring"), F.col("pid").alias("at"), "x", "y")
    return rounded(points.ring_tangents(p).select(F.col("at").alias("place"), "tx", "ty"), 5)


_next = lambda c, f, e: f"coalesce({f}({c}) over w, {e}({c}) over (partition by pid // 50 order by pid rows between unbounded preceding and unbounded following))"
TANGENTS = rounded_sql(f"with {fx.POINTS}, d as (select pid as place, {_next('x', 'lead', 'first')} - {_next('x', 'lag', 'last')} dx, {_next('y', 'lead', 'first')} - {_next('y', 'lag', 'last')} dy from pt window w as (partition by pid // 50 order by pid)), t as (select place, dx / sqrt(dx * dx + dy * dy) tx, dy / sqrt(dx * dx + dy * dy) ty from d)", "tx ty", "place", 5)


def rbf_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points moved by ten landmarks, of which each goes a tenth of the way to the next one."""
    p = fx.points(spark, sf_dir)
    marks = p.where("pid < 10").select("pid", *(F.col(c).alias(f"s{c}") for c in "xyz"))
    to = p.where("pid between 1 and 10").select((F.col("pid") - 1).alias("pid"), *(F.col(c).alias(f"e{c}") for c in "xyz"))
    marks = marks.join(to, "pid").withColumns({f"t{c}": F.col(f"s{c}") + (F.col(f"e{c}") - F.col(f"s{c}")) / 10 for c in "xyz"})
    return rounded(points.radial_warp(p, marks, 0.5).select("pid", "wx", "wy", "wz"))


QUERIES = {f.__name__: f for f in (nn_correspondence, corr_stats, nn_with_normals, mesh_area, mesh_quality, gauss_curvature, mean_curvature, point_normals, ring_tangents, rbf_warp)}
ORACLES = {"point_normals": FANS, "mean_curvature": MEAN, "nn_correspondence": NN, "corr_stats": STATS, "nn_with_normals": NORMALS, "mesh_area": AREA, "mesh_quality": QUALITY, "gauss_curvature": GAUSS, "ring_tangents": TANGENTS}
