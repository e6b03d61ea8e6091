"""Files and streams: round trips, and streaming results against batches."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators.flow import Knobs
from gridloom.operators.transfer import Polygon
from gridloom.plans import apps
from gridloom.sources import fixtures, transfer_files, volumes
from gridloom.streaming import frames


def test_volume_round_trip(spark, tmp_path):
    a = np.random.default_rng(0).integers(-50, 50, (5, 4, 3))
    df = spark.createDataFrame([(*i, float(v)) for i, v in np.ndenumerate(a)], "x long, y long, z long, v double")
    volumes.write_volume(df, f"file://{tmp_path}/vol", "MET_SHORT", (1.0, 0.5, 2.0))
    meta = volumes.image_meta(spark, f"file://{tmp_path}/vol/volume.mhd").first()
    assert meta["ext"] == [0, 4, 0, 3, 0, 2] and meta["spacing"] == [1.0, 0.5, 2.0] and meta["ncomp"] == 1
    got = {(r["x"], r["y"], r["z"]): r["c"] for r in volumes.read_volumes(spark, f"file://{tmp_path}/vol/*.mhd").collect()}
    assert got == {i: [float(v)] for i, v in np.ndenumerate(a)}


def test_one_file_with_channels(spark, tmp_path):
    (tmp_path / "a.mhd").write_text("NDims = 3\nDimSize = 2 1 2\nElementNumberOfChannels = 2\nElementByteOrderMSB = True\nElementType = MET_USHORT\nElementDataFile = a.raw\n")
    (tmp_path / "a.raw").write_bytes(np.arange(8, dtype=">u2").tobytes())
    got = sorted((r["x"], r["y"], r["z"], r["c"]) for r in volumes.read_volumes(spark, f"file://{tmp_path}/a.mhd").collect())
    assert got == [(0, 0, 0, [0, 1]), (0, 0, 1, [4, 5]), (1, 0, 0, [2, 3]), (1, 0, 1, [6, 7])]


def test_segmentation_from_files(spark, tmp_path):
    for name, far in (("low", 0.2), ("high", 0.8)):
        df = spark.createDataFrame([(x, y, 0, abs((x > 2) - far) + 0.01 * y) for x in range(6) for y in range(3)], "x long, y long, z long, v double")
        volumes.write_volume(df, f"file://{tmp_path}/{name}", "MET_DOUBLE")
    nodes = spark.createDataFrame([(k, f"file://{tmp_path}/{k}/volume.mhd", None, 0.01) for k in ("low", "high")], "node string, DataTerm string, SmoothnessTerm string, Alpha double")
    edges = spark.createDataFrame([("root", "low", None), ("root", "high", 1.0)], "src string, dst string, weight double")
    got = {(r["x"], r["y"]): r["class"] for r in apps.segmented_files(spark, edges, nodes, Knobs(iterations=20, per_round=10)).collect()}
    assert got == {(x, y): int(x <= 2) for x in range(6) for y in range(3)}  # leaves by name: high, low
    with pytest.raises(ValueError):
        apps.segmented_files(spark, edges, nodes.where("node = 'low'"))


def test_bitmap(spark, tmp_path):
    row = bytes([1, 2, 3, 4, 5, 6, 0, 0])  # two pixels, blue first, padded to four bytes
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + 16, 0, 0, 54, 40, 2, 2, 1, 24, 0, 16, 0, 0, 0, 0)
    (tmp_path / "a.bmp").write_bytes(head + row + row)
    got = {(r["x"], r["y"]): r["c"] for r in volumes.read_bitmaps(spark, f"file://{tmp_path}/a.bmp").collect()}
    assert got[0, 0] == [3, 2, 1] and got[1, 1] == [6, 5, 4]


def test_polygon_files(spark, tmp_path):
    p = [Polygon((0.1, 0.2, 0.3, 0.4), ((0.0, 1.0), (2.0, 3.5), (4.0, 0.0)), 3, (1.0, 0.5, 0.25, 2.0)), Polygon((1.0, 0, 0, 1), (), 0)]
    transfer_files.write_polygons(spark, [*p, p[0]], f"file://{tmp_path}/tf")
    assert transfer_files.read_polygons(spark, f"file://{tmp_path}/tf") == p
    with pytest.raises(ValueError):
        transfer_files.parse("2 1 1 1 1")


def test_lists_schedules_noise_and_pictures(spark, tmp_path):
    (tmp_path / "n.txt").write_text("a.mhd\nb.mhd\n")
    (tmp_path / "l.txt").write_text("1\n2\n")
    (tmp_path / "s.txt").write_text("0 1 2 3 4 5 6\n\n10\t1 1 1 1 1 1\nbad line\n")
    path = f"file://{tmp_path}"
    assert sorted(tuple(r) for r in volumes.file_list(spark, f"{path}/n.txt", f"{path}/l.txt").collect()) == [(0, "a.mhd", "1"), (1, "b.mhd", "2")]
    assert sorted(r["iter"] for r in volumes.read_schedule(spark, f"{path}/s.txt").collect()) == [0, 10]
    n = volumes.noise(spark, (4, 3, 2), -1, 1, 2, seed=5)
    r = n.agg(F.count("*"), F.min("c0"), F.max("c1")).first()
    assert r[0] == 24 and r[1] >= -1 and r[2] < 1
    assert volumes.graymap(n.where("z = 0").select("x", "y", F.col("c0").alias("v"))).startswith(b"P5\n4 3\n255\n")


def test_window_starts_with_the_fifth_frame(spark):
    df = spark.createDataFrame([(1, i, i, float(i)) for i in range(6)] + [(2, 0, 9, 1.0)], "stream long, ts long, frame_id long, v double")
    got = sorted((r["frame_id"], r["v0"], r["v3"]) for r in frames.sliding(df).collect())
    assert got == [(4, 4.0, 1.0), (5, 5.0, 2.0)]


def test_compounding_depends_on_order(spark):
    df = spark.createDataFrame([(1, 0, 0, 10.0), (1, 1, 1, 20.0), (1, 2, 2, 40.0), (1, 3, 3, None)], "voxel long, ts long, frame_id long, v double")
    one = lambda how: frames.compounded(df, how).first()["v"]
    assert one("avg") == 27.5 and one("max") == 40 and one("if_empty") == 10 and one("overwrite") == 40
    assert one("alpha") == pytest.approx((10 * 0.9 + 2) * 0.9 + 4)


@pytest.mark.parametrize("how", ["avg", "max"])
def test_compound_stream_over_batches(spark, sf, tmp_path, how):
    v = fixtures.frames(spark, sf).withColumnRenamed("stream", "voxel").select("voxel", "ts", "frame_id", "v")
    half = v.agg(F.percentile_approx("ts", 0.5)).first()[0]
    v.where(F.col("ts") <= half).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    stream = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    run = lambda: frames.compound_stream(stream, how).writeStream.outputMode("update").foreachBatch(lambda df, i: df.write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    run()
    v.where(F.col("ts") > half).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    run()  # goes on from the checkpoint
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("voxel").agg(F.max_by("v", "n").alias("v"))
    want = {r["voxel"]: r["v"] for r in frames.compounded(v, how).collect()}
    assert {r["voxel"]: r["v"] for r in got.collect()} == pytest.approx(want)


def test_holes_take_the_mean_around_them(spark):
    rows = [(x, y, 0, None if (x, y) == (2, 2) else 3.0) for x in range(5) for y in range(5)]
    got = {(r["x"], r["y"]): r["v"] for r in frames.holes_filled(spark.createDataFrame(rows, "x long, y long, z long, v double")).collect()}
    assert got[2, 2] == 3.0 and len(got) == 25
