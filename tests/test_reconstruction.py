"""Reconstruction without holes, folds in order, numbers over tasks, and windows by event time."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import ordered
from gridloom.streaming import frames, reconstruction, timed


def test_numbers_run_on_over_tasks(spark):
    rnd = random.Random(1)
    rows = [(None if i % 11 == 0 else (5 if i % 3 else i % 7), i, rnd.random()) for i in range(3000)]
    got = ordered.numbered(spark.createDataFrame(rows, "g long, t long, v double").repartition(7), "g", ["t"]).collect()
    want, n = {}, {}
    for g, t, _ in sorted(rows, key=lambda r: r[1]):
        n[g] = n.get(g, 0) + 1
        want[g, t] = n[g]
    assert {(r["g"], r["t"]): r["at"] for r in got} == want and len(got) == len(rows)


def test_a_hot_voxel_of_a_million_frames(spark):
    """The fold in order of one voxel that has nearly all values, without a window over it."""
    n = 1_000_000
    v = spark.range(n).select(F.lit(1).cast("long").alias("voxel"), F.col("id").alias("ts"), F.col("id").alias("frame_id"), (F.col("id") * 7919 % 1000).cast("double").alias("v"))
    v = v.union(spark.createDataFrame([(2, 0, 0, 8.0), (2, 1, 1, 4.0), (2, 1, 2, 2.0)], "voxel long, ts long, frame_id long, v double"))
    for how, keep in (("avg", 0.5), ("alpha", 0.9)):
        df = frames.compounded(v, how)
        assert "Window" not in df._jdf.queryExecution().toString()
        acc = None
        for x in (np.arange(n) * 7919 % 1000).tolist():
            acc = x if acc is None else keep * acc + (1 - keep) * x
        got = {r["voxel"]: r["v"] for r in df.collect()}
        assert got[1] == pytest.approx(acc, rel=1e-12)
        assert got[2] == pytest.approx(keep * (keep * 8 + (1 - keep) * 4) + (1 - keep) * 2)


def test_a_stream_in_chunks(spark):
    old, frames.CHUNK = frames.CHUNK, 7
    try:
        df = spark.createDataFrame([(s, i // 2, i, float(i)) for s in (1, None) for i in range(60)], "stream long, ts long, frame_id long, v double")
        got = sorted((r["stream"] is None, r["frame_id"], r["v0"], r["v1"], r["v2"], r["v3"]) for r in frames.sliding(df).collect())
    finally:
        frames.CHUNK = old
    assert got == sorted((s, i, float(i), i - 1.0, i - 2.0, i - 3.0) for s in (False, True) for i in range(4, 60))


def pose(angle, tx, ty, tz):
    c, s = math.cos(angle), math.sin(angle)
    return [float(x) for x in (1, 0, 0, tx, 0, c, -s, ty, 0, s, c, tz)]


def made(spark, poses, w, h, f):
    """Frames whose pixels are f of their place in space."""
    rows = []
    for t, p in enumerate(poses):
        m = np.array(p).reshape(3, 4)
        px = [f(*(m @ [i * 0.9, j * 0.9, 0, 1])) for j in range(h) for i in range(w)]
        rows.append((1, t, t, [float(x) for x in p], [None if x is None else float(x) for x in px]))
    return spark.createDataFrame(rows, "stream long, ts long, frame_id long, pose array<double>, pixels array<double>")


@pytest.mark.parametrize("way", ["distance", "trajectory"])
def test_tilted_sweep_has_no_holes_and_keeps_a_linear_field(spark, way):
    """Planes that tilt alike and are further apart than voxels: every voxel between them is filled, and a field that is linear in space comes back."""
    poses = [pose(0.3, 0.2, 0.1, 0.13 + 2.3 * t) for t in range(9)]
    df = made(spark, poses, 14, 12, lambda x, y, z: 5 + 2 * x - y)
    got = {(r["x"], r["y"], r["z"]): r["v"] for r in reconstruction.volume(df, (14, 12), (0.9, 0.9), 1.0, way=way, chunk=3).collect()}
    assert len(got) > 500
    columns = {}
    for x, y, z in got:
        columns.setdefault((x, y), []).append(z)
    inner = [v for (x, y), v in columns.items() if 2 <= x <= 10 and 3 <= y <= 5]
    assert inner and all(sorted(v) == list(range(min(v), max(v) + 1)) and len(v) >= 8 for v in inner)
    splat = {(r["x"], r["y"], r["z"]) for r in frames.reconstructed(df.select("ts", "frame_id", "pose", F.posexplode("pixels").alias("k", "v")).select("ts", "frame_id", "pose", (F.col("k") % 14).cast("double").alias("i"), F.floor(F.col("k") / 14).cast("double").alias("j"), "v"), (0.9, 0.9), 1.0).collect()}
    assert any(set(range(min(v), max(v) + 1)) - {z for x, y, z in splat if (x, y) == k} for k, v in columns.items() if k in {(x, y) for x, y, _ in splat})  # the splat has holes
    if way == "trajectory":
        assert max(abs(v - (5 + 2 * x - y)) for (x, y, z), v in got.items()) < 2.5  # values of four planes along the probe's way
    flat = made(spark, [pose(0.0, 0.2, 0.1, 0.13 + 2.3 * t) for t in range(7)], 14, 12, lambda x, y, z: 5 + 2 * x - y)
    for r in reconstruction.volume(flat, (14, 12), (0.9, 0.9), 1.0, axis=None, way=way).collect():
        assert r["v"] == pytest.approx(5 + 2 * r["x"] - r["y"])


def plain(rows, w, h, sp, voxel, axis, box):
    """By loops: {(at, x, y, z): v} by distance."""
    out = {}
    rows = sorted(rows, key=lambda r: (r[1], r[2]))
    geo = []
    for r in rows:
        m = np.array(r[3]).reshape(3, 4)
        n = np.cross(m[:, 0], m[:, 1])
        n = n / np.linalg.norm(n)
        geo.append((m, n, -n @ m[:, 3], np.array([np.nan if x is None else x for x in r[4]]).reshape(h, w)))
    e = np.eye(3)[axis]
    for last in range(4, len(rows)):
        for p in np.ndindex(*box):
            p = np.array(p) - 4
            base = p * (1 - e) * voxel
            t = [-(g[1] @ base + g[2]) / (g[1] @ e) / voxel for g in geo[last - 2 : last]]
            lo = math.floor(min(t))
            if not lo <= p[axis] <= max(lo + 1, math.floor(max(t))):
                continue
            vs, fs = [], []
            for m, n, d, img in geo[last - 3 : last + 1]:
                q = p * voxel - m[:, 3]
                a, b = q @ m[:, 0] / sp, q @ m[:, 1] / sp
                i, j = math.floor(a), math.floor(b)
                u, v = a - i, b - j
                ok = 0 <= i < w - 1 and 0 <= j < h - 1
                vs.append(img[j, i] * (1 - u) * (1 - v) + img[j, i + 1] * u * (1 - v) + img[j + 1, i] * (1 - u) * v + img[j + 1, i + 1] * u * v if ok else np.nan)
                fs.append(abs(n @ (p * voxel) + d))
            if not np.isnan(vs).any():
                out[last + 1, *p.tolist()] = sum(v / f for v, f in zip(vs, fs, strict=True)) / sum(1 / f for f in fs)
    return out


def test_random_sweep_is_as_by_loops(spark):
    rnd = random.Random(4)
    for axis in (2, 1):
        poses = [pose(rnd.uniform(-0.4, 0.4) + (0 if axis == 2 else 1.5), rnd.random(), rnd.random(), 0.8 * t + rnd.random() / 3) for t in range(7)]
        rows = [(1, t, t, p, [rnd.choice([None, *range(1, 30)]) if rnd.random() < 0.1 else rnd.random() * 9 for _ in range(30)]) for t, p in enumerate(poses)]
        rows = [(s, t, i, p, [None if x is None else float(x) for x in px]) for s, t, i, p, px in rows]
        df = spark.createDataFrame(rows, "stream long, ts long, frame_id long, pose array<double>, pixels array<double>")
        got = {(r["at"], r["x"], r["y"], r["z"]): r["v"] for r in reconstruction.filled(df, (6, 5), (0.9, 0.9), 0.7, axis, chunk=3).collect()}
        assert got and got == pytest.approx(plain(rows, 6, 5, 0.9, 0.7, axis, (22, 22, 26)))


def test_windows_of_a_batch_are_worked_on_and_folded_at_once(spark, monkeypatch):
    """Streams shorter and longer than a chunk, in batches that cut them anywhere: the same folds as from each window's values, no Python call for a group, and whole streams leave folded."""
    rows = []
    for stream in (None, 1, 2, 3):
        rnd = random.Random(stream or 0)
        for t in range({None: 7, 1: 13, 2: 40, 3: 5}[stream]):
            rows.append((stream, t // 2, t, pose(rnd.uniform(-0.2, 0.2), rnd.random(), rnd.random(), (t if stream != 2 else t % 3) * 0.4), [rnd.random() for _ in range(20)]))
    df = spark.createDataFrame(rows, "stream long, ts long, frame_id long, pose array<double>, pixels array<double>").repartition(5)
    values = reconstruction.filled(df, (5, 4), (0.9, 0.9), 0.7, chunk=16)
    assert "FlatMapGroups" not in values._jdf.queryExecution().toString()
    want = {}
    for r in sorted(values.collect(), key=lambda r: r["at"]):
        k = (r["stream"], r["x"], r["y"], r["z"])
        want[k] = (want[k] + r["v"]) / 2 if k in want else r["v"]
    assert {k[0] for k in want} == {None, 1, 2, 3}
    for chunk, some, size in ((16, 10_000, 1 << 25), (16, 3, 1 << 25), (5, 10_000, 1 << 25), (16, 3, 1)):
        monkeypatch.setattr(reconstruction, "FRAME_BYTES", size)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", some)
        try:
            got = reconstruction.volume(df, (5, 4), (0.9, 0.9), 0.7, chunk=chunk).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(got) == len(want) and {(r["stream"], r["x"], r["y"], r["z"]): r["v"] for r in got} == pytest.approx(want)


def test_few_frames_and_bad_frames(spark):
    ddl = "stream long, ts long, frame_id long, pose array<double>, pixels array<double>"
    assert reconstruction.filled(spark.createDataFrame([], ddl), (2, 2), (1, 1), 1.0).collect() == []
    assert reconstruction.filled(spark.createDataFrame([(1, t, t, pose(0.0, 0, 0, t), [1.0] * 4) for t in range(4)], ddl), (2, 2), (1, 1), 1.0).collect() == []
    with pytest.raises(Exception, match="2 x 2 pixels"):
        reconstruction.filled(spark.createDataFrame([(1, t, t, pose(0.0, 0, 0, t), [1.0] * 3) for t in range(5)], ddl), (2, 2), (1, 1), 1.0).collect()


def at(s):
    return datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(seconds=s)


def test_windows_by_event_time(spark, tmp_path):
    """Late frames are put in order, frames behind the watermark dropped, and a silent stream begins anew."""
    ddl = "stream long, ts timestamp, frame_id long, v double"
    batches = [
        [(1, 0, 0), (1, 2, 2), (1, 1, 1), (2, 0, 50)],
        [(1, 4, 4), (1, 3, 3), (1, 6, 6)],
        [(1, 5, 5), (1, 8, 8), (2, 9, 51)],
        [(3, 200, 70)],  # the watermark goes on
        [(1, 7, 99), (1, 201, 20), (3, 201, 71)],  # the first is too late; stream 1 begins anew, as it was idle
        [(1, 202 + i, 21 + i) for i in range(4)] + [(3, 300, 72)],
        [(3, 400, 73)],
    ]
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        df = timed.windows(stream, 4, "5 seconds", 60_000)
        for i, rows in enumerate(batches):
            spark.createDataFrame([(s, at(t), f, float(f)) for s, t, f in rows], ddl).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
            q = df.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            q.awaitTermination()
        assert q.exception() is None
        state = q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress else 0
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = sorted((r["stream"], r["frame_id"], r["v0"], r["v1"], r["v2"], r["v3"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, f, float(f), f - 1.0, f - 2.0, f - 3.0) for f in (4, 5, 6)] + [(1, 8, 8.0, 6.0, 5.0, 4.0), (1, 24, 24.0, 23.0, 22.0, 21.0)]
    assert state <= 12  # stream 2's are gone, and those of 1 and 3 are bounded


def test_a_stream_has_one_row_of_state(spark, tmp_path):
    """State goes to Python and back with a stream's frames, whatever their number: one row a stream, with what waits, null values and a null stream in it."""
    ddl = "stream long, ts timestamp, frame_id long, v double"
    streams = [None, *range(60)]
    batches = [[(s, at(i % 7), 100 * i, None if i == 3 else i / 2) for s in streams for i in range(20)] + [(1, None, 5, 1.0)], [(s, at(20 + i), i, float(i)) for s in streams for i in range(3)]]
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        df = timed.windows(stream, 4, "5 seconds", 60_000)
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
            q = df.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            q.awaitTermination()
            assert max(op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]) == len(streams)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    vs = [None if i == 3 else i / 2 for i in sorted(range(20), key=lambda i: (i % 7, i))]
    want = [[str(s), *map(str, vs[k - 3 : k + 1][::-1])] for s in streams for k in range(4, 20)]  # the watermark is at 17 s
    got = [[str(r["stream"]), *(str(r[f"v{i}"]) for i in range(4))] for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == sorted(want)
