"""Operators on small inputs: known values, plain versions, laws, and independence of how an image is cut into tiles."""

import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import arithmetic, terms
from gridloom.operators import combine, flow, hierarchy, maps, mesh, points, rays, registration, similarity, statistics, stencils, stereo, tiles, transfer
from gridloom.operators.hierarchy import LabelGraph


def image(spark, a, name="v"):
    rows = [(*i, float(v)) for i, v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, f"x long, y long, z long, {name} double")


def array(df, shape, name="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["x"], r["y"], r["z"]] = r[name]
    return out


@pytest.fixture(scope="module")
def cube():
    return np.random.default_rng(3).normal(10, 3, (9, 7, 5))


def test_dice_half_and_empty(spark):
    pair = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "a int, b int")
    assert combine.dice(pair, 1).first()[0] == 0.5
    assert combine.dice(pair, 9).first()[0] is None


@pytest.mark.parametrize(("other", "mi", "nmi"), [([0, 0, 1, 1], math.log(2), 1.0), ([0, 1, 0, 1], 0.0, 0.5)])
def test_information_known(spark, other, mi, nmi):
    pair = spark.createDataFrame(list(zip([0.0, 0.0, 1.0, 1.0], map(float, other), strict=True)), "a double, b double")
    r = similarity.information(similarity.joint_histogram(pair, 2)).first()
    assert r["mi"] == pytest.approx(mi) and r["nmi"] == pytest.approx(nmi)


def test_information_of_constants_and_of_nothing(spark):
    r = similarity.information(similarity.joint_histogram(spark.createDataFrame([(3.0, 4.0)] * 3, "a double, b double"), 8)).first()
    assert (r["mi"], r["nmi"], r["ecr"], r["ecr_smi"]) == (0, 1, 1, 0)
    assert similarity.information(similarity.joint_histogram(spark.createDataFrame([], "a double, b double"), 8)).first()["mi"] is None


def test_ncc_is_not_centred(spark):
    one = lambda rows: similarity.differences(spark.createDataFrame(rows, "a double, b double")).first()["ncc"]
    assert one([(1.0, 2.0), (2.0, 4.0)]) == pytest.approx(1)
    assert one([(1.0, 0.0), (0.0, 1.0)]) == 0
    assert one([(0.0, 0.0)]) is None


def test_statistics_leave_nulls_out(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 6.0), (None, 5.0)], "a double, b double")
    r = {(r["i"], r["j"]): r for r in statistics.multi_statistics(df, ["a", "b"]).collect()}
    assert r[0, 1]["n"] == 2 and r[0, 1]["covariance"] == pytest.approx(2) and r[1, 1]["covariance"] == pytest.approx(4)
    assert statistics.multi_statistics(df.where("a > 9"), ["a"]).first()["n"] == 0


def test_principal_axes(spark):
    x = np.random.default_rng(0).normal(size=(200, 3)) @ np.array([[3, 0, 0], [1, 1, 0], [0, 0, 0.2]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    mean, variance, axes = statistics.principal_axes(df, ["a", "b", "c"])
    assert np.allclose(variance.sum(), x.var(axis=0).sum()) and np.allclose(axes @ axes.T, np.eye(3))
    p = statistics.project(df, ["a", "b", "c"], mean, axes).select("p0").toPandas()["p0"]
    assert p.var(ddof=0) == pytest.approx(variance[0])


@pytest.mark.parametrize("rank", [0, 7, 50, 99])
def test_quantile_cut(spark, rank):
    v = np.round(np.random.default_rng(rank).lognormal(0, 3, 100), 3)
    counts = spark.createDataFrame([(float(x),) for x in v], "val double").groupBy("val").agg(F.count("*").alias("c"))
    assert statistics.quantile_cut(counts, rank, 100, pieces=3) == np.sort(v)[rank]


@pytest.mark.parametrize("side", [3, 32])
def test_stencils_do_not_depend_on_tiles(spark, cube, side):
    df = image(spark, cube)
    edge = np.pad(cube, 1, mode="edge")
    core = (slice(1, -1),) * 3
    g = [np.roll(edge, -1, k)[core] - np.roll(edge, 1, k)[core] for k in range(3)]
    assert np.allclose(array(stencils.gradient_magnitude(df, side), cube.shape), 0.5 * np.sqrt(sum(x * x for x in g)))
    v = cube.copy()
    for _ in range(2):
        p = np.pad(v, [(1, 1), (0, 0), (0, 0)], mode="edge")
        v = 0.1065 * p[:-2] + 0.7866 * v + 0.1065 * p[2:]
    assert np.allclose(array(stencils.blur(df, (2, 0, 0), side), cube.shape), v)


def test_vesselness_and_median_do_not_depend_on_tiles(spark, cube):
    df = image(spark, cube)
    for f in (lambda s: stencils.vesselness(df, side=s), lambda s: stencils.median_filter(df, 1, s), lambda s: stencils.box_filter(df, 2, s)):
        assert np.allclose(array(f(3), cube.shape), array(f(32), cube.shape))


def test_gaussian_keeps_constants_and_sums(spark):
    a = np.zeros((12, 10, 1))
    a[5, 4, 0] = 1
    assert np.allclose(array(stencils.gaussian(image(spark, a + 3), 1.5, side=8), a.shape).sum(), 3 * a.size + 1)


def test_weighted_median_fills_bad_pixels(spark):
    a = np.full((5, 5, 1), 2.0)
    a[2, 2, 0] = 90
    df = image(spark, a).withColumns({"guide": F.lit(1.0), "bad": (F.col("v") > 50).cast("double")})
    assert (array(stencils.weighted_median_filter(df, 1, 1.0, 1.0), a.shape) == 2).all()


def test_empty_image(spark):
    none = spark.createDataFrame([], "x long, y long, z long, v double")
    assert stencils.gradient_magnitude(none).count() == 0
    assert stencils.slice_distances(none).count() == 0


def test_slice_distances_against_shortest_ways(spark):
    a = (np.random.default_rng(5).random((13, 11, 2)) > 0.2).astype(float)
    got = array(stencils.slice_distances(image(spark, a), side=4), a.shape)
    for z in range(2):
        for x, y in product(range(13), range(11)):
            other = np.argwhere(a[:, :, z] != a[x, y, z])
            d = np.abs(other - [x, y])
            want = (d.max(axis=1) - d.min(axis=1) + 1.314 * d.min(axis=1)).min()
            assert got[x, y, z] == pytest.approx(want if a[x, y, z] else -want)


def test_shape_interpolation_between_squares(spark):
    a = np.zeros((9, 9, 2))
    a[2:5, 2:5, 0] = a[4:7, 4:7, 1] = 1
    got = array(stencils.shape_interpolation(image(spark, a), 1), (9, 9, 3))
    assert (got[:, :, 0] == a[:, :, 0]).all() and (got[:, :, 2] == a[:, :, 1]).all()
    assert got[4, 4, 1] == 1 and got[0, 0, 1] == 0 and 0 < got[:, :, 1].sum() <= 9


def test_pattern_intensity_of_equal_images(spark, cube):
    pair = image(spark, cube, "a").withColumn("b", F.col("a"))
    near = sum(1 for o in product(range(-3, 4), repeat=3) if sum(k * k for k in o) <= 9)
    assert stencils.pattern_intensity(pair, side=4).first()[0] == pytest.approx(near * cube.size)


def test_shift_by_whole_and_half(spark):
    a = np.arange(24.0).reshape(4, 3, 2)
    assert array(similarity.shifted(image(spark, a), (1, 0, 0)), a.shape)[:3].tolist() == a[1:].tolist()
    assert np.allclose(array(similarity.shifted(image(spark, a), (0.5, 0, 0)), a.shape)[:3], (a[1:] + a[:-1]) / 2)


def test_partial_volume_weights_sum_to_voxels(spark, cube):
    df = image(spark, cube)
    total = similarity.partial_volume_joint(df, df, (0.3, 0.6, 0.1), 6).agg(F.sum("w")).first()[0]
    assert total == pytest.approx(8 * 6 * 4)


def test_vote_prefers_the_first_of_equals(spark):
    rows = [(1, 0, 0.5), (1, 1, 0.5), (2, 0, None), (2, 1, 0.1), (3, 0, None)]
    got = {r["voxel"]: r["slot"] for r in combine.vote(spark.createDataFrame(rows, "voxel long, slot int, value double")).collect()}
    assert got == {1: 0, 2: 1}


def test_atlas(spark):
    m = spark.createDataFrame([(1, s, int(s < 3)) for s in range(4)] + [(2, 0, 0)], "voxel long, slot int, label int")
    assert {r["voxel"]: r["p"] for r in combine.atlas_probability(m, 1).collect()} == {1: 0.75, 2: 0.0}
    cost = {r["voxel"]: r["p"] for r in combine.atlas_probability(m, 1, entropy=True, most=2.0).collect()}
    assert cost[1] == pytest.approx(math.log(4) - math.log(3)) and cost[2] == 2.0


def test_log_likelihood_without_samples(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert [r["term"] for r in combine.log_likelihood(df, F.col("v") > 5, ["v"], 4).collect()] == [1.0, 1.0]


def test_terms(spark):
    r = spark.createDataFrame([(2.0,)], "v double").select(terms.logistic(F.col("v"), 1e3, 50.0, True).alias("far"), terms.gaussian(F.col("v"), 2, 0).alias("g"), terms.threshold(F.col("v"), 1, 3, 9, 0).alias("t"), terms.luminance([F.col("v")] * 3, (0.2, 0.3, 0.5)).alias("l"), terms.inside_polygon(F.col("v"), F.lit(1.0), [(0, 0), (4, 0), (4, 4), (0, 4)]).alias("in"), terms.inside_polygon(F.col("v"), F.lit(9.0), [(0, 0), (4, 0), (4, 4)]).alias("out")).first()
    assert r["far"] == pytest.approx(48_000) and r["g"] == pytest.approx(math.exp(-0.5)) and r["t"] == 9 and r["l"] == pytest.approx(2) and r["in"] and not r["out"]


def test_arithmetic(spark):
    v = F.col("v")
    cols = [arithmetic.nearest(F.lit(-2.5)), arithmetic.t_norm(F.lit(0.0), F.lit(0.0), 2), arithmetic.s_norm(F.lit(0.7), F.lit(0.6), 2), arithmetic.without_nan(F.lit(float("nan")), 3), arithmetic.from_log_axis(arithmetic.log_axis(v, 5.0), 5.0), arithmetic.radial_basis(F.lit(1.5)), arithmetic.safe_log(F.lit(-1.0)), arithmetic.same_text(F.lit("Ab"), F.lit("aB"))]
    got = spark.createDataFrame([(2.0,)], "v double").select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()
    assert got[0] == -2 and got[1] == 0 and got[2] == 1 and got[3] == 3 and got[4] == pytest.approx(2) and got[5] == 0 and got[6] is None and got[7]
    slope = spark.range(1).select(*(((arithmetic.radial_basis(F.lit(0.4001), k) - arithmetic.radial_basis(F.lit(0.3999), k)) / 0.0002 - arithmetic.radial_slope(F.lit(0.4), k)).alias(f"s{k}") for k in range(3))).first()
    assert max(map(abs, slope)) < 1e-5


def test_solve3(spark):
    m = [[2.0, 1, 0], [1, 3, 1], [0, 1, 4]]
    x = np.linalg.solve(m, [1, 2, 3])
    got = spark.range(1).select(*(c.alias(f"x{i}") for i, c in enumerate(arithmetic.solve3([[F.lit(float(v)) for v in r] for r in m], [F.lit(1.0), F.lit(2.0), F.lit(3.0)])))).first()
    assert np.allclose(got, x)


def test_nearest_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.normal(size=(150, 3)), rng.normal(size=(20, 3)) * 0.001 + 5, np.zeros((30, 3)), [[80.0, 0, 0]]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)] + [(999, None, 0.0, 0.0)], "pid long, x double, y double, z double")
    got = {r["qid"]: (r["pid"], r["distance"]) for r in points.nearest(df.withColumnRenamed("pid", "qid"), df).collect()}
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    np.fill_diagonal(d, np.inf)
    assert got.pop(999) == (None, None)
    for i in range(len(p)):
        assert got[i][0] == d[i].argmin() and got[i][1] == pytest.approx(d[i].min())


def cost_of(q, p, weight):
    """All costs of unit normals in columns 3 to 5."""
    far = np.linalg.norm(q[:, None, :3] - p[None, :, :3], axis=2)
    return far + weight * np.maximum(0, 1 - q[:, 3:] @ p[:, 3:].T)


def test_nearest_of_close_points_and_lone_queries_meets_few(spark):
    """A cluster and queries far from it and each other: as by all pairs, with a small share of the pairs."""
    rng = np.random.default_rng(6)
    n = 6000
    p = np.concatenate([rng.uniform(size=(n, 3)), rng.normal(size=(60, 3)) * 5000])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "pid long, x double, y double, z double")
    q = df.withColumnRenamed("pid", "qid")
    got = {r["qid"]: r["pid"] for r in points.nearest(q, df).collect()}
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    np.fill_diagonal(d, np.inf)
    assert got == {i: int(d[i].argmin()) for i in range(len(p))}
    lone, close = points.meetings(q.where(f"qid >= {n}"), df).count(), points.meetings(q.where(f"qid < {n}"), df).count()
    assert lone < 60 * n / 3 and close < n * 900  # of 6,060 a query
    leaves = points.tree(df, points.XYZ).points.groupBy("leaf").count()
    assert leaves.agg(F.max("count")).first()[0] <= points.IN_LEAF and leaves.count() < 3 * len(p) / points.IN_LEAF


def test_nearest_with_penalties_over_the_box(spark):
    """Normals that count twenty times the box: only the leaves of like normals are looked into."""
    rng = np.random.default_rng(8)
    n = 4000
    v = rng.normal(size=(n, 3))
    p = np.concatenate([rng.uniform(size=(n, 3)), v / np.linalg.norm(v, axis=1, keepdims=True)], axis=1)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "pid long, x double, y double, z double, nx double, ny double, nz double")
    q, also = df.where("pid % 10 = 0").withColumnRenamed("pid", "qid"), ("nx", "ny", "nz")
    how = (points.normal_penalty(20), also, points.normal_floor(20), (*also, *points.XYZ))
    got = {r["qid"]: (r["pid"], r["cost"]) for r in points.nearest(q, df, *how).collect()}
    c = cost_of(p[::10], p, 20)
    c[np.arange(len(c)), np.arange(0, n, 10)] = np.inf
    for i, row in enumerate(c):
        assert got[10 * i][0] == row.argmin() and got[10 * i][1] == pytest.approx(row.min())
    assert points.meetings(q, df, *how).count() < len(c) * n / 4
    plain = {r["qid"]: r["pid"] for r in points.nearest(q, df, how[0], also).collect()}
    assert plain == {k: v[0] for k, v in got.items()}


def test_nearest_without_other_points(spark):
    one = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "pid long, x double, y double, z double")
    assert points.nearest(one.withColumnRenamed("pid", "qid"), one).first()["pid"] is None


def test_warp_with_an_own_basis(spark):
    """The basis of order 1, given as a caller's function, and another that isn't 0 at 1."""
    rng = np.random.default_rng(4)
    marks = rng.uniform(0, 3, (9, 3))
    lm = spark.createDataFrame([tuple(map(float, [*a, *(a + 0.1 * rng.normal(size=3))])) for a in marks], "sx double, sy double, sz double, tx double, ty double, tz double")
    at = spark.createDataFrame([tuple(map(float, r)) for r in rng.uniform(-1, 4, (50, 3))], "x double, y double, z double")
    rows = lambda **how: np.array(sorted(map(tuple, points.radial_warp(at, lm, 1.5, **how).collect())))
    own = (lambda r: np.maximum(1 - r, 0) ** 4 * (4 * r + 1), lambda r: F.pow(1 - r, F.lit(4)) * (4 * r + 1))
    assert np.allclose(rows(order=1), rows(basis=own))
    steep = (lambda r: np.exp(-3 * r), lambda r: F.exp(-3 * r))
    moved = points.radial_warp(lm.select(F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sz").alias("z"), "tx", "ty", "tz"), lm, 1.5, basis=steep).collect()
    assert all(abs(r[f"w{c}"] - r[f"t{c}"]) < 1e-6 for r in moved for c in "xyz")
    assert not np.allclose(rows(order=1), rows(basis=steep))


@pytest.mark.parametrize("order", [0, 1, 2])
def test_warp_moves_landmarks_to_their_places(spark, order):
    marks = np.random.default_rng(2).uniform(0, 3, (12, 3))
    to = marks + np.random.default_rng(3).normal(0, 0.1, marks.shape)
    lm = spark.createDataFrame([tuple(map(float, [*a, *b])) for a, b in zip(marks, to, strict=True)], "sx double, sy double, sz double, tx double, ty double, tz double")
    got = points.radial_warp(lm.select(F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sz").alias("z"), "tx", "ty", "tz").union(spark.createDataFrame([(50.0, 50.0, 50.0, 50.0, 50.0, 50.0)], "a double, b double, c double, d double, e double, f double")), lm, 1.2, order).collect()
    assert all(abs(r[f"w{c}"] - r[f"t{c}"]) < 1e-6 for r in got for c in "xyz") and len(got) == 13


def _solid(spark):
    """A tetrahedron whose faces don't all turn the same way."""
    p = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 1.0)], "pid long, x double, y double, z double")
    c = spark.createDataFrame([(0, 0, 2, 1), (1, 1, 0, 3), (2, 1, 2, 3), (3, 0, 3, 2)], "cid long, p0 long, p1 long, p2 long")
    return c, p


def test_mesh_measures(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 3.0, 0.0, 0.0), (2, 0.0, 4.0, 0.0), (3, 9.0, 9.0, 9.0)], "pid long, x double, y double, z double")
    c = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 1, 7)], "cid long, p0 long, p1 long, p2 long")
    r = mesh.surface(c, p).first()
    assert (r["cells"], r["area"], r["quality"]) == (1, pytest.approx(6), pytest.approx(1.25))


def test_gauss_curvature_of_a_closed_surface_and_of_a_plane(spark):
    c, p = _solid(spark)
    total = mesh.corners(c, p).select(mesh.area().alias("area"), F.explode(F.array("p0", "p1", "p2")).alias("pid")).groupBy("pid").agg(F.sum("area").alias("area"))
    whole = mesh.gauss_curvature(c, p).join(total, "pid").agg(F.sum(F.col("curvature") * F.col("area") / 3)).first()[0]
    assert whole == pytest.approx(4 * math.pi)
    ring = [(0, 0.0, 0.0, 0.0)] + [(k, math.cos(k), math.sin(k), 0.0) for k in (1, 3, 5)]
    flat = mesh.gauss_curvature(spark.createDataFrame([(0, 0, 1, 3), (1, 0, 3, 5), (2, 0, 5, 1)], "cid long, p0 long, p1 long, p2 long"), spark.createDataFrame(ring, "pid long, x double, y double, z double"))
    assert flat.where("pid = 0").first()["curvature"] == pytest.approx(0, abs=1e-9)


def test_faces_are_turned_alike(spark):
    c, p = _solid(spark)
    flips = {r["cid"]: r["flip"] for r in mesh.oriented(c, p).collect()}
    ids = {r["cid"]: [r["p0"], r["p1"], r["p2"]] for r in c.collect()}
    going = [((v if not flips[k] else v[::-1])[i], (v if not flips[k] else v[::-1])[(i + 1) % 3]) for k, v in ids.items() for i in range(3)]
    assert len(set(going)) == 12
    n = mesh.point_normals(c, p).collect()
    assert len(n) == 12 and all(abs(r["nx"] ** 2 + r["ny"] ** 2 + r["nz"] ** 2 - 1) < 1e-9 for r in n)
    assert mesh.mean_curvature(c, p).count() == 4


def test_normals_of_a_cube(spark):
    """Eight points, twelve faces of mixed turns: three fans a point, 24 in all."""
    at = list(np.ndindex(2, 2, 2))
    p = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(at)], "pid long, x double, y double, z double")
    quads = [[i for i, c in enumerate(at) if c[k] == v] for k in range(3) for v in range(2)]
    faces = [t for a, b, c, d in quads for t in ((a, b, c), (d, b, c))]
    c = spark.createDataFrame([(i, *(t if i % 3 else t[::-1])) for i, t in enumerate(faces)], "cid long, p0 long, p1 long, p2 long")
    rows = mesh.fans(c, p).collect()
    assert len(rows) == 36 and len({(r["pid"], r["fan"]) for r in rows}) == 24
    for r in rows:
        n = np.array([r["nx"], r["ny"], r["nz"]])
        k, v = divmod(r["cid"] // 2, 2)
        assert abs(n[k]) == pytest.approx(1) and abs(n).sum() == pytest.approx(1)
    ways = {r["cid"] // 2: (np.array([r["nx"], r["ny"], r["nz"]]) @ (np.eye(3)[r["cid"] // 4] * (2 * (r["cid"] // 2 % 2) - 1))) for r in rows}
    assert len({round(w) for w in ways.values()}) == 1  # all outwards, or all inwards


def test_normals_at_a_cone_of_many_faces(spark):
    """One fan of all 2,000 faces at the tip of a flat cone; a steep one's base points keep theirs."""
    n = 2000
    rim = [(i + 1, float(np.cos(2 * np.pi * i / n)), float(np.sin(2 * np.pi * i / n)), 0.0) for i in range(n)]
    p = spark.createDataFrame([(0, 0.0, 0.0, 0.1), *rim], "pid long, x double, y double, z double")
    c = spark.createDataFrame([(i, 0, i + 1, (i + 1) % n + 1) for i in range(n)], "cid long, p0 long, p1 long, p2 long")
    rows = mesh.fans(c, p).where("pid = 0").collect()
    assert len(rows) == n and {r["fan"] for r in rows} == {0}
    assert all(abs(r["nz"]) == pytest.approx(1, abs=1e-9) for r in rows)


def test_sheets_lines_and_balls_are_told_apart(spark):
    at = np.array(list(np.ndindex(13, 13, 13))) - 6.0
    for name, far in (("sheet", np.abs(at[:, 0])), ("line", np.hypot(at[:, 0], at[:, 1])), ("blob", np.linalg.norm(at, axis=1))):
        v = 100 * np.exp(-(far**2) / 8)
        df = spark.createDataFrame([(*map(int, p + 6), float(x)) for p, x in zip(at, v, strict=True)], "x long, y long, z long, v double")
        near = {(r["x"], r["y"], r["z"]): r for r in stencils.structures(df, (1.0, 1.0, 1.0), gradient=0.2, side=8).collect()}
        r = near[7, 6, 6] if name == "sheet" else near[6, 6, 6]
        assert max(("sheet", "line", "blob"), key=lambda k: r[k]) == name, (name, r)
        assert r["v"] == pytest.approx(r["sheet"] + r["line"] + r["blob"]) and r[name] > 0.3


def test_grey_slices_between(spark):
    """As by the chamfer distance's closed form over whole slices, over several tiles; and a step that moves."""
    rng = np.random.default_rng(5)
    smooth = np.add.outer(np.arange(26), np.arange(21))
    v = np.stack([(smooth * 2.0) % 40, np.clip(smooth * 1.5 - 10, 0, 60), rng.integers(0, 60, smooth.shape)], axis=2).astype(float)
    df = spark.createDataFrame([(*map(int, i), float(x)) for i, x in np.ndenumerate(v)], "x long, y long, z long, v double")
    bins, n = 6, 3
    got = {(r["x"], r["y"], r["z"]): r["v"] for r in stencils.grey_interpolation(df, n - 1, bins, (0.0, 60.0), side=8).collect()}
    own = np.clip(np.floor((bins - 1) / 60 * v), 0, bins - 1).astype(int)
    gx, gy = np.indices(smooth.shape)
    dx, dy = np.abs(gx.ravel()[:, None] - gx.ravel()), np.abs(gy.ravel()[:, None] - gy.ravel())
    d = []
    for z in range(3):
        b = own[..., z].ravel()
        level = []
        for g in range(bins + 1):
            up = np.where((g <= b)[:, None], np.maximum(0, b[None] + 1 - g), np.maximum(0, g - b[None]))
            far = (686 * np.maximum(np.maximum(dx, dy), up) + 314 * (dx + dy + up)).min(axis=1)
            level.append(np.where(g <= b, far, -far))
        d.append(np.array(level))
    assert len(got) == v.shape[0] * v.shape[1] * (1 + 2 * n)
    for z in range(2):
        for k in range(n):
            top = own[..., z].ravel() if k == 0 else np.maximum((d[z] * (n - k) + d[z + 1] * k > 0).sum(axis=0) - 1, 0)
            assert [got[x, y, z * n + k] for x, y in zip(gx.ravel().tolist(), gy.ravel().tolist(), strict=True)] == pytest.approx((top * 60 / (bins - 1)).tolist())
    step = spark.createDataFrame([(x, y, z, 9.0 if x < 4 + 6 * z else 0.0) for x in range(16) for y in range(5) for z in range(2)], "x long, y long, z long, v double")
    mid = {r["x"]: r["v"] for r in stencils.grey_interpolation(step, 1, 40).where("y = 2 and z = 1").collect()}
    assert [x for x, value in mid.items() if value > 4.5] and 5 <= max(x for x, value in mid.items() if value > 4.5) <= 8


BODY = LabelGraph((("body", "air", 1.0), ("body", "soft", 1.0), ("body", "firm", 1.0), ("soft", "fat", 1.0), ("soft", "muscle", 0.25), ("body", "muscle", 0.5), ("firm", "muscle", 0.25), ("firm", "bone", 1.0)))


def test_levels_of_a_graph(spark):
    up, down = BODY.up_levels(), BODY.down_levels()
    assert (up["body"], up["air"], up["soft"], up["muscle"], up["bone"]) == (0, 1, 1, 2, 2) and (down["muscle"], down["bone"]) == (1, 2)
    edges = spark.createDataFrame(list(BODY.edges), "src string, dst string, weight double")
    got = {r["node"]: (r["up"], r["down"]) for r in hierarchy.levels(edges).collect()}
    assert got == {k: (up[k], down[k]) for k in up}
    assert hierarchy.read_graph(edges).up_levels() == up
    total = {r["node"]: r["total"] for r in hierarchy.roll_up(edges, spark.createDataFrame([("fat", 2.0), ("muscle", 8.0), ("bone", 4.0)], "node string, value double")).collect()}
    assert total["soft"] == 2 + 0.25 * 8 and total["firm"] == 4 + 0.25 * 8 and total["body"] == 4 + 6 + 0.5 * 8


def test_bad_graphs():
    for edges in ((("a", "b", 1.0), ("c", "b", 1.0)), (("r", "a", 1.0), ("a", "b", 1.0), ("b", "a", 1.0))):
        with pytest.raises(ValueError):
            LabelGraph(edges)


def _segmented(spark, a, per_round, side, iterations=30, alpha=0.3):
    costs = {"air": 4.0, "fat": 0.5, "muscle": 1.5, "bone": 2.5}
    data = {k: (F.col("v") - F.lit(c)) * (F.col("v") - F.lit(c)) for k, c in costs.items()}
    state = flow.start(image(spark, a), BODY, data, {k: F.lit(alpha) for k in BODY.order[1:]})
    return flow.run(state, BODY, flow.Knobs(iterations=iterations, per_round=per_round), side)


def test_flow_does_not_depend_on_tiles(spark):
    a = np.random.default_rng(7).uniform(0, 3, (9, 8, 3))
    one, cut = _segmented(spark, a, 6, 64, 6), _segmented(spark, a, 2, 4, 6)
    key = lambda df: {(r["x"], r["y"], r["z"]): np.array([*r["label"], *r["sink"], *r["fx"]]) for r in df.collect()}
    one, cut = key(one), key(cut)
    assert set(one) == set(cut) and all(np.allclose(one[k], cut[k]) for k in one)


def test_flow_smooths_noise_away(spark):
    rng = np.random.default_rng(8)
    truth = np.where(np.arange(16)[:, None, None] < 8, 0.5, 2.5) * np.ones((16, 8, 1))
    a = truth + rng.normal(0, 0.7, truth.shape)
    state = _segmented(spark, a, 30, 64, 60, 0.3)
    won = {(r["voxel"]["x"], r["voxel"]["y"]): r["slot"] for r in combine.vote(flow.leaf_labels(state, BODY)).collect()}
    want = {0.5: BODY.leaves.index("fat"), 2.5: BODY.leaves.index("bone")}
    right = np.mean([won[x, y] == want[truth[x, y, 0]] for x in range(16) for y in range(8)])
    plain = np.mean(np.array([1, 2, 3, 0])[np.abs(a[..., None] - np.array([0.5, 1.5, 2.5, 4.0])).argmin(axis=-1)] == np.where(truth > 1, 3, 1))
    assert right > 0.97 and right > plain
    assert flow.data_energy(state, BODY).first()[0] > 0 and flow.smoothness_energy(state, BODY).count() == 6


def test_connectedness_is_the_strongest_way(spark):
    rng = np.random.default_rng(4)
    shape = (6, 5, 3)
    aff = rng.random((3, *shape))
    rows = [(*i, float(i == (0, 0, 0)), *(float(aff[(k, *i)]) if i[k] + 1 < shape[k] else 0.0 for k in range(3))) for i in np.ndindex(shape)]
    got = array(flow.connectedness(spark.createDataFrame(rows, "x long, y long, z long, seed double, ax double, ay double, az double"), side=3, inner=3), shape)
    want = np.zeros(shape)
    want[0, 0, 0] = 1
    for _ in range(200):
        for i in np.ndindex(shape):
            for k in range(3):
                j = tuple(v + (n == k) for n, v in enumerate(i))
                if j[k] < shape[k]:
                    w = aff[(k, *i)]
                    want[j], want[i] = max(want[j], min(w, want[i])), max(want[i], min(w, want[j]))
    assert np.allclose(got, want)


def _units():
    return maps.UnitMap(2, np.array([0.4, 0.3, 0.2, 0.1]), np.array([[0.0, 0], [2, 0], [0, 2], [2, 2]]), np.full((4, 2), 0.5))


def test_units(spark):
    u = _units()
    x = np.random.default_rng(6).normal(1, 1, (50, 2))
    df = spark.createDataFrame([(i, *map(float, r), i % 2) for i, r in enumerate(x)] + [(99, None, 1.0, 0)], "k long, a double, b double, l long")
    density = (u.weight * np.exp(-((x[:, None] - u.mean) ** 2 / u.var / 2).sum(axis=2)) / np.sqrt((2 * np.pi) ** 2 * u.var.prod(axis=1)))
    p = {r["k"]: r["p"] for r in maps.probability(df, "k", ["a", "b"], u, entropy=False).collect()}
    assert len(p) == 50 and np.allclose([p[i] for i in range(50)], density.sum(axis=1))
    best = {r["k"]: r["ux"] + 2 * r["uy"] for r in maps.best_units(df, "k", ["a", "b"], u).collect()}
    assert [best[i] for i in range(50)] == density.argmax(axis=1).tolist()
    share = density / density.sum(axis=1, keepdims=True)
    got = {(r["label"], r["ux"] + 2 * r["uy"]): r["responsibility"] for r in maps.responsibilities(df, "l", ["a", "b"], u).collect()}
    assert got[1, 2] == pytest.approx(share[1::2, 2].sum())


def test_training_finds_clusters(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(c, 0.1, (60, 2)) for c in ((0, 0), (5, 0), (0, 5), (5, 5))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k long, a double, b double")
    u = maps.train(df, "k", ["a", "b"], 2, 2, 6, [(0, 0.9), (5, 0.9)], [(0, 0.5), (5, 0.1)])
    assert all(np.abs(u.mean - c).max(axis=1).min() < 0.5 for c in ((0, 0), (5, 0), (0, 5), (5, 5)))
    assert maps.doubled(u).nx == 4 and maps.doubled(u).weight.sum() == pytest.approx(1)


def test_radiograph_of_a_constant(spark):
    df = image(spark, np.full((5, 4, 3), 2.0))
    r = spark.createDataFrame([(1, 0.0, 1.0, 1.0, 1.0, 0.0, 0.0), (2, 0.0, 9.0, 1.0, 1.0, 0.0, 0.0)], "ray long, sx double, sy double, sz double, ix double, iy double, iz double")
    got = rays.radiograph(r, df, (5, 4, 3), -0.1, 0.0).collect()
    assert [(x["ray"], x["v"]) for x in got] == [(1, pytest.approx(256 - math.exp(5 * 0.2)))]


def test_composite(spark):
    s = spark.createDataFrame([(1, 0, 1.0, 0.0, 0.0, 0.5), (1, 1, 0.0, 1.0, 0.0, 0.5), (2, 0, 0.0, 0.0, 1.0, 1.0), (2, 1, 1.0, 1.0, 1.0, 1.0)], "ray long, k long, r double, g double, b double, a double")
    got = {r["ray"]: r for r in rays.composited(s).collect()}
    assert (got[1]["r"], got[1]["g"], got[1]["a"]) == (0.5, 0.25, 0.75) and got[2]["b"] == 1 and got[2]["r"] == 0


def test_sampled_between_voxels(spark):
    a = np.arange(8.0).reshape(2, 2, 2)
    p = spark.createDataFrame([(1, 0.5, 0.5, 0.5), (2, 1.0, 0.0, 1.0)], "k long, px double, py double, pz double")
    assert {r["k"]: r["v"] for r in rays.sampled(p, image(spark, a), ["k"]).collect()} == {1: 3.5, 2: 5.0}


def test_keyhole_and_shading(spark):
    px = spark.range(9).select((F.col("id") % 3).alias("px"), F.floor(F.col("id") / 3).alias("py"))
    a, b = px.withColumn("v", F.lit(1.0)), px.withColumn("v", F.lit(3.0))
    for mode, middle in ((0, 3.0), (1, 3.0), (2, 3.0), (3, 2.0)):
        got = {(r["px"], r["py"]): r["v"] for r in rays.keyhole(a, b, 1.0, 1.0, 0.9, mode).collect()}
        assert got[1, 1] == middle and got[0, 0] == 1.0
    assert {r["v"] for r in rays.depth_shaded(px.withColumn("depth", F.lit(4.0)), 2.0).collect()} == {1.0}
    lit = rays.shaded(spark.createDataFrame([(0.5, 0.5, 0.5, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0)], "r double, g double, b double, gx double, gy double, gz double, vx double, vy double, vz double"), 0.2, 0.3, 0.5, 2).first()
    assert lit["r"] == pytest.approx(0.5)


def test_ultrasound_fit_finds_the_mix(spark):
    rng = np.random.default_rng(0)
    rows = [(d, r, 2 * d - 3 * r + 0.5) for d, r in rng.random((30, 2)).tolist()]
    assert np.allclose(rays.ultrasound_fit(spark.createDataFrame(rows, "density double, reflection double, seen double")).first(), (2, -3, 0.5))
    assert rays.ultrasound_fit(spark.createDataFrame(rows[:1] * 3, "density double, reflection double, seen double")).first()["alpha"] is None


def test_minimisers():
    x, v = registration.powell(lambda p: (p[0] - 1) ** 2 + (p[1] + 2) ** 2 + p[0] * p[1] * 0.1, [(-5, 5), (-5, 5)])
    assert np.allclose(x, [1.1, -2.055], atol=0.05)
    x, v = registration.simplex(lambda ps: [float((p[0] - 1) ** 2 + 3 * (p[1] + 2) ** 2) for p in ps], [0.0, 0.0], 1.0, 1e-6)
    assert np.allclose(x, [1, -2], atol=1e-2)


def test_disparity_of_a_shifted_picture(spark):
    rng = np.random.default_rng(1)
    wide = rng.random((40, 12, 3))
    rows = [(x, y, 0, wide[x, y].tolist(), wide[x + 3, y].tolist()) for x in range(37) for y in range(12)]
    pair = spark.createDataFrame(rows, "x long, y long, z long, l array<double>, r array<double>")
    for side in (16, 64):
        got = array(stereo.disparity(pair, 5, radius=2, side=side), (37, 12, 1))
        assert (got[6:30, 2:-2] == 3).mean() > 0.95


def test_tiles_reject_wide_halos(spark, cube):
    with pytest.raises(ValueError):
        tiles.dealt(image(spark, cube), (5, 0, 0), 4)


def test_lookup_table_draws_later_polygons_over(spark):
    square = lambda lo, hi: ((lo, lo), (hi, lo), (hi, hi), (lo, hi))
    polys = [transfer.Polygon((1.0, 0, 0, 1), square(0.5, 6.5), 1), transfer.Polygon((0, 1.0, 0, 1), square(2.5, 4.5), 2)]
    t = {(r["i"], r["g"]): r["class"] for r in transfer.lookup_table(spark, polys, (8, 8), (0, 0), (7, 7)).collect()}
    assert (t[0, 0], t[1, 1], t[3, 3]) == (0, 1, 2) and len(t) == 64
    assert transfer.lookup_table(spark, [], (2, 2), (0, 0), (1, 1)).where("class <> 0").count() == 0


def test_moments_of_repeated_keys(spark):
    units = maps.UnitMap(2, np.array([0.5, 0.5]), np.array([[0.0, 0.0], [10.0, 10.0]]), np.ones((2, 2)))
    rows = spark.createDataFrame([(1, 0.0, 1.0), (1, 9.0, 10.0), (2, 1.0, 0.0), (3, None, 1.0)], "key long, a double, b double")
    got = {r["unit"]: tuple(r)[1:] for r in maps.moments(rows, ["a", "b"], units).collect()}
    assert got == {0: (2, 1.0, 1.0, 1.0, 1.0), 1: (1, 9.0, 81.0, 10.0, 100.0)}


def test_a_fixpoint_that_does_not_come_is_an_error(spark):
    rows = spark.createDataFrame([(0, 0, 0, 1.0)], "x long, y long, z long, v double")
    with pytest.raises(RuntimeError):
        tiles.fixpoint(rows, lambda a: a["v"] + 1, "v", [], most=2)
