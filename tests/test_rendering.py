"""Pictures of volumes against a loop over pixels and steps, and laws of rays, intervals and shades."""

import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import rays as old
from gridloom.operators import rendering, transfer
from gridloom.operators.transfer import Polygon

SIZE = (8, 6, 5)
VIEW = ((1.0, 0.5, 9.0, -1.0), (0.5, 5.0, 0.5, -0.5), (4.0, 0.2, 0.3, 0.1), (0.0, 0.1, 0.2, 1.0))
PLANES = [(1.0, 0.2, 0.0, -1.5), (-1.0, 0.0, 0.3, 6.0)]
HOLE = [(1.0, 0.0, 0.0, -2.5), (-1.0, 0.1, 0.0, 4.5)]
SHAPE, LOW, HIGH = (9, 7), (0.0, 0.0), (10.0, 10.0)
POLYGONS = [Polygon((1.0, 0.2, 0.1, 0.3), ((-1.0, -1.0), (6.0, -1.0), (6.0, 11.0), (-1.0, 11.0)), 1, (0.2, 0.7, 0.3, 4.0)), Polygon((0.0, 0.9, 0.4, 0.6), ((4.0, 3.0), (11.0, 3.0), (11.0, 11.0)), 2, (0.5, 0.5, 0.1, 2.0))]
INNER = [Polygon((0.1, 0.1, 1.0, 0.2), ((-1.0, -1.0), (11.0, -1.0), (11.0, 11.0), (-1.0, 11.0)), 3, (0.9, 0.1, 0.0, 1.0))]


@pytest.fixture(scope="module")
def pair():
    return np.random.default_rng(4).uniform(0, 10, (2, *SIZE))


def volume(spark, pair):
    return spark.createDataFrame([(*i, float(v), float(pair[1][i])) for i, v in np.ndenumerate(pair[0])], "x long, y long, z long, v double, w double")


def trilinear(a, p):
    base = [math.floor(c) for c in p]
    out = 0.0
    for o in product((0, 1), repeat=3):
        w = math.prod(c - b if d else 1 - (c - b) for c, b, d in zip(p, base, o, strict=True))
        if w > 0:
            out += w * a[tuple(b + d for b, d in zip(base, o, strict=True))]
    return out


def plain(r, pair, table, inner, light, spacing):
    """One ray, step by step; None if it has no step in the volume."""
    v, w = pair
    g = [np.diff(np.pad(v, [(1, 1) if j == k else (0, 0) for j in range(3)], mode="edge"), axis=k) for k in range(3)]
    g = [(np.take(d, range(1, d.shape[k]), k) + np.take(d, range(d.shape[k] - 1), k)) / spacing[k] for k, d in enumerate(g)]
    s, i = (np.array([r[f"{n}{c}"] for c in "xyz"]) for n in "si")
    ok = lambda p, planes: all(np.dot(n, p) + d >= -1e-9 for *n, d in planes)
    rgb, left, first, last = np.zeros(3), 1.0, None, None
    for k in range(r["last"] + 1):
        p = s + k * i
        if not all(-1e-9 <= c <= n - 1 + 1e-9 for c, n in zip(p, SIZE, strict=True)) or not ok(p, PLANES):
            continue
        first = k if first is None else first
        t = table if inner is table or not ok(p, HOLE) else inner
        if t is None:
            continue
        at = [min(n - 1, max(0, math.floor((round(trilinear(a, p), 9) - lo) / ((hi - lo) / (n - 1)) + 0.5))) for a, lo, hi, n in zip((v, w), LOW, HIGH, SHAPE, strict=True)]
        e = t[tuple(at)]
        q, way = np.array([trilinear(x, p) for x in g]), i * spacing
        f = min(1.0, abs(q @ way) / (np.linalg.norm(q) * np.linalg.norm(way)))
        amb, dif, spec, power = light or (e["ambient"], e["diffuse"], e["specular"], e["power"])
        if left < old.DARK:
            break
        rgb += left * e["a"] * np.clip((amb + dif * f) * np.array([e["r"], e["green"], e["b"]]) + spec * f**power, 0, 1)
        left *= 1 - e["a"]
        last = k
    return None if last is None else (*rgb, 1 - left, last - first + 1)


@pytest.mark.parametrize(("keyhole", "light", "spacing"), [("table", None, (1.0, 2.0, 0.5)), ("skip", (0.3, 0.6, 0.4, 3.0), (1.0, 1.0, 1.0))])
def test_picture_against_a_loop(spark, pair, keyhole, light, spacing):
    table, inner = (transfer.lookup_table(spark, p, SHAPE, LOW, HIGH, lights=True) for p in (POLYGONS, INNER))
    view = rendering.jittered(rendering.view_rays(spark, VIEW, 6, 5, 0.4), 7)
    got = rendering.rendered(view, volume(spark, pair), SIZE, table, SHAPE, LOW, HIGH, PLANES, HOLE, inner if keyhole == "table" else None, light, spacing, side=3).collect()
    t, u = ({(r["i"], r["g"]): r for r in x.collect()} for x in (table, inner))
    want = {r["ray"]: plain(r, pair, t, u if keyhole == "table" else None, light, np.array(spacing)) for r in view.collect()}
    want = {k: x for k, x in want.items() if x}
    assert len(want) > 10 and {r["ray"] for r in got} == set(want)
    for r in got:
        assert (r["r"], r["g"], r["b"], r["a"], r["depth"]) == pytest.approx(want[r["ray"]], abs=1e-7)


def test_rays_reach_the_ends_of_the_view(spark):
    for r in rendering.view_rays(spark, VIEW, 4, 3, 0.5).collect():
        for depth, k in ((0, 0), (1, r["last"])):
            h = np.array(VIEW) @ (r["px"] / 4, r["py"] / 3, depth, 1)
            assert np.allclose([r[f"s{c}"] + k * r[f"i{c}"] for c in "xyz"], h[:3] / h[3])
        assert math.dist((0, 0, 0), (r["ix"], r["iy"], r["iz"])) <= 0.5 + 1e-9


def test_jitter_is_seeded_and_under_a_step(spark):
    view = rendering.view_rays(spark, VIEW, 20, 3, 0.5)
    a, b, other = (rendering.jittered(view, s).orderBy("ray").collect() for s in (1, 1, 2))
    assert a == b and a != other
    share = [(x["sx"] - y["sx"]) / y["ix"] for x, y in zip(a, view.orderBy("ray").collect(), strict=True)]
    assert all(0 <= x < 1 for x in share) and share[0] == pytest.approx(share[16]) and len({round(x, 6) for x in share[:16]}) == 16


def test_intervals_are_what_clipping_by_sample_leaves(spark):
    view = rendering.view_rays(spark, VIEW, 6, 5, 0.3)
    cut = rendering.intervals(view, SIZE, PLANES, HOLE)
    got = {(r["ray"], r["k"]): r["inside"] for r in rendering.steps(cut, False).collect()}
    skipped = {(r["ray"], r["k"]) for r in rendering.steps(cut, True).collect()}
    want = {}
    ok = lambda p, planes: all(np.dot(n, p) + d >= -1e-9 for *n, d in planes)
    for r in view.collect():
        for k in range(r["last"] + 1):
            p = [r[f"s{c}"] + k * r[f"i{c}"] for c in "xyz"]
            if all(-1e-9 <= c <= n - 1 + 1e-9 for c, n in zip(p, SIZE, strict=True)) and ok(p, PLANES):
                want[r["ray"], k] = ok(p, HOLE)
    assert got == want and skipped == {k for k, inside in want.items() if not inside} and 0 < len(skipped) < len(want)
    flat = view.withColumns({"ix": F.lit(0.0), "sx": F.lit(-1.0)})  # beside the box, and along its side
    assert rendering.intervals(flat, SIZE).count() == 0
    with pytest.raises(Exception, match="too many steps"):
        rendering.steps(cut, False, 2).collect()


def test_cel_and_distance_shades(spark):
    rows = [(x, y, 1.0, 0.5, 0.25, 4 if x < 2 else 8) for x, y in product(range(4), range(3)) if (x, y) != (3, 1)]
    picture = spark.createDataFrame(rows, "px long, py long, r double, g double, b double, depth long")
    got = {(r["px"], r["py"]): r for r in rendering.cel_shaded(picture, (0.5, 0.1, 10.0), (0.4, 0.5, 1.0)).collect()}
    assert got[0, 0]["r"] == 1.0 and got[1, 0]["r"] == pytest.approx(0.5)  # an edge of depth on its right
    assert got[2, 0]["g"] == pytest.approx(0.5 * 0.8) and got[2, 1]["b"] == pytest.approx(0.25 * 0.8) and got[2, 0]["depth"] == 1.0
    assert rendering.cel_shaded(picture.limit(0), (0.5, 0.1, 10.0), (0.4, 0.5, 1.0)).count() == 0
