"""Windows and folds of frames, as batches and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch
from ..sources import fixtures as fx
from ..streaming import frames as fr
from ..streaming import reconstruction as rec
from ..streaming import timed
from .rounding import rounded, rounded_sql

_COLS = ["stream", "frame_id", "v0", "v1", "v2", "v3"]


def frame_window4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fr.sliding(fx.frames(spark, sf_dir)).select(*_COLS))


def frame_window4_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows by the stateful operator: all events are streamed and the windows are written by Spark's file sink."""
    schema = fx.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    frames = stream.select(F.col("user_id").alias("stream"), "ts", F.col("event_id").alias("frame_id"), F.col("value").cast("double").alias("v"))
    out = scratch(spark)
    windows = fr.sliding_stream(frames)
    query = windows.writeStream.format("parquet").option("path", f"{out}/windows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return rounded(spark.read.schema(windows.schema).parquet(f"{out}/windows").select(*_COLS))


def frame_windows_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows by event time of all events, streamed: up to ten seconds before the last event, where the watermark comes to lie."""
    schema = fx.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    frames = stream.select(F.col("user_id").alias("stream"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("frame_id"), F.col("value").cast("double").alias("v"))
    out = scratch(spark)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    windows = timed.windows(frames, late="10 seconds", idle_ms=400 * 86_400_000)
    query = windows.writeStream.format("parquet").option("path", f"{out}/windows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return rounded(spark.read.schema(windows.schema).parquet(f"{out}/windows").select(*_COLS))


TIMED = rounded_sql(f"with {fx.FRAMES}, w as (select stream, frame_id, ts, row_number() over o k, v v0, lag(v, 1) over o v1, lag(v, 2) over o v2, lag(v, 3) over o v3 from fr window o as (partition by stream order by ts, frame_id)), t as (select * from w where k > 4 and epoch_ms(ts) <= (select max(epoch_ms(ts)) from fr) - 10000)", "v0 v1 v2 v3", "stream frame_id")
WINDOW4 = rounded_sql(f"with {fx.FRAMES}, w as (select stream, frame_id, row_number() over o k, v v0, lag(v, 1) over o v1, lag(v, 2) over o v2, lag(v, 3) over o v3 from fr window o as (partition by stream order by ts, frame_id)), t as (select * from w where k > 4)", "v0 v1 v2 v3", "stream frame_id")


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.frames(spark, sf_dir).withColumnRenamed("stream", "voxel")


def frame_compound_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fr.compounded(_values(spark, sf_dir), "avg"))


def frame_compound_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fr.compounded(_values(spark, sf_dir), "alpha"))


def frame_compound_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [fr.compounded(_values(spark, sf_dir), k).select("voxel", F.lit(k).alias("how"), "v") for k in ("max", "if_empty", "overwrite")]
    return rounded(parts[0].union(parts[1]).union(parts[2]))


def _fold_sql(f: str) -> str:
    return rounded_sql(f"with {fx.FRAMES}, t as (select stream voxel, list_reduce(list(v order by ts, frame_id), lambda a, b: {f}) v from fr group by 1)", "v", "voxel")


def plane_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes of frames whose poses turn and shift with the event."""
    e = fx.frames(spark, sf_dir).where("v is not null")
    angle = F.col("v") / 50
    c, s, o, i = F.cos(angle), F.sin(angle), F.lit(0.0), F.lit(1.0)
    pose = F.array(c, -s, o, F.col("v"), s, c, o, F.col("v") * 2, o, o, i, F.lit(3.0), o, o, o, i)
    calibration = [1.0, 0.0, 0.0, 2.0, 0.0, 0.0, -1.0, 0.5, 0.0, 1.0, 0.0, -1.0]
    rows = e.select("frame_id", fr.composed(pose, calibration).alias("pose"))
    return rounded(rows.select("frame_id", *(p.alias(n) for p, n in zip(fr.plane_of(F.col("pose"), 63.0, 44.0), ("nx", "ny", "nz", "d"), strict=True))), 5)


PLANE = rounded_sql(f"""with {fx.FRAMES}, t as (select frame_id, sin(v / 50) nx, -cos(v / 50) ny, 0.0::double nz,
  -(sin(v / 50) * (cos(v / 50) * 2 - sin(v / 50) * 0.5 + v) - cos(v / 50) * (sin(v / 50) * 2 + cos(v / 50) * 0.5 + 2 * v)) d from fr where v is not null)""", "nx ny nz d", "frame_id", 5)


def reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the pixels of each order's frame, put in half-unit voxels."""
    l = fx.table(spark, sf_dir, "lineitem")
    shift = (F.col("l_suppkey") % 5).cast("double")
    o, i = F.lit(0.0), F.lit(1.0)
    rows = l.select(F.col("l_orderkey").alias("frame_id"), F.col("l_orderkey").alias("ts"), F.array(i, o, o, shift, o, i, o, o, o, o, i, F.lit(2.0)).alias("pose"), F.col("l_quantity").cast("double").alias("i"), F.col("l_linenumber").cast("double").alias("j"), (F.col("l_extendedprice") / 1000).alias("v"))
    return rounded(fr.reconstructed(rows, (0.3, 0.5), 1.0), 5)


RECONSTRUCTION = rounded_sql("""with p as (select l_orderkey f, l_quantity * 0.3::double + l_suppkey % 5 px, l_linenumber * 0.5::double py, l_extendedprice / 1000 v from lineitem),
q as (select f, floor(px + 0.5::double)::bigint x, floor(py + 0.5::double)::bigint y, 2::bigint z, px, py, v from p),
w as (select f, x, y, z, sum(v / (sqrt(pow(px - x, 2) + pow(py - y, 2)) + 0.1::double)) / sum(1 / (sqrt(pow(px - x, 2) + pow(py - y, 2)) + 0.1::double)) v from q group by all),
t as (select x, y, z, list_reduce(list(v order by f), lambda a, b: (a + b) / 2) v from w group by all)""", "v", "x y z", 5)

#: Each supplier's lines as a stream with a frame a month: 4 columns (line numbers) by 5 rows (quantities in tens) of mean prices, on planes that tilt and advance.
_MONTH = "year(l_shipdate) * 12 + month(l_shipdate) - 23904"
_PIXEL = "cast((l_linenumber - 1) % 4 + 4 * floor((l_quantity - 1) / 10) as int)"
_MEAN = "cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double) / (count(*) * 1e5)"


def tracked_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, ts, frame_id, pose, pixels): frames of 4 x 5 pixels, 0 where there was no line."""
    cells = fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("long").alias("stream"), F.expr(_MONTH).cast("long").alias("ts"), F.expr(_PIXEL).alias("k")).agg(F.expr(_MEAN).alias("v"))
    frames = cells.groupBy("stream", "ts").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    pixels = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)))
    t = F.col("ts")
    angle = (t % 3 - 1) * 0.05
    c, s, o, i = F.cos(angle), F.sin(angle), F.lit(0.0), F.lit(1.0)
    return frames.select("stream", "ts", t.alias("frame_id"), F.array(i, o, o, 0.3 + t % 2 * 0.05, o, c, -s, F.lit(0.23), o, s, c, t * 0.8 + 0.137).alias("pose"), pixels.alias("pixels"))


def reconstruction_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes of all suppliers' frames, without holes, by inverse distance."""
    return rounded(rec.volume(tracked_frames(spark, sf_dir), (4, 5), (1.3, 1.2), 1.0), 5)


BETWEEN = rounded_sql(f"""with cell as (select l_suppkey stream, {_MONTH} ts, {_PIXEL} k, {_MEAN} v from lineitem group by all),
f0 as (select stream, ts, map_from_entries(list((k, v))) m, row_number() over (partition by stream order by ts) at_ from cell group by 1, 2),
f as (select stream, at_, list_transform(range(20), lambda k: coalesce(m[k::int], 0.0)) img, cos((ts % 3 - 1) * 0.05::double) c, sin((ts % 3 - 1) * 0.05::double) s, 0.3::double + ts % 2 * 0.05::double tx, 0.23::double ty, ts * 0.8::double + 0.137::double tz from f0),
w as (select stream, at_, c c2, s s2, tz tz2, lag(c) over o c1, lag(s) over o s1, lag(tz) over o tz1, lead(at_) over o last_ from f window o as (partition by stream order by at_)),
ln as (select stream, last_, x, y, tz1 + (y - 0.23::double) * s1 / c1 t1, tz2 + (y - 0.23::double) * s2 / c2 t2 from w, range(-3, 9) a(x), range(-3, 10) b(y) where last_ > 4),
vx as (select stream, last_, x, y, unnest(range(floor(least(t1, t2))::bigint, greatest(floor(least(t1, t2)) + 1, floor(greatest(t1, t2)))::bigint + 1)) z from ln),
pl as (select vx.stream, last_, x, y, z, abs(c * (z - tz) - s * (y - ty)) far, (x - tx) / 1.3::double px, (c * (y - ty) + s * (z - tz)) / 1.2::double py, img from vx join f on f.stream = vx.stream and f.at_ between last_ - 3 and last_),
fl as (select *, floor(px)::int i, floor(py)::int j, px - floor(px) u, py - floor(py) v from pl),
bi as (select *, i >= 0 and j >= 0 and i < 3 and j < 4 ok, img[1 + i + 4 * j] * (1 - u) * (1 - v) + img[2 + i + 4 * j] * u * (1 - v) + img[5 + i + 4 * j] * (1 - u) * v + img[6 + i + 4 * j] * u * v val from fl),
ct as (select stream, last_, x, y, z, sum(val / far) / sum(1 / far) v from bi group by all having bool_and(ok)),
t as (select stream, x, y, z, list_reduce(list(v order by last_), lambda a, b: (a + b) / 2) v from ct group by all)""", "v", "stream x y z", 5)

REST = rounded_sql(f"with {fx.FRAMES}, t as (select stream voxel, 'max' how, max(v) v from fr group by 1 union all select stream, 'if_empty', arg_min(v, (ts, frame_id)) from fr group by 1 union all select stream, 'overwrite', arg_max(v, (ts, frame_id)) from fr group by 1)", "v", "voxel how")
QUERIES = {f.__name__: f for f in (frame_window4, frame_window4_stream, frame_windows_timed, frame_compound_avg, frame_compound_alpha, frame_compound_rest, plane_equations, reconstruction, reconstruction_between)}
ORACLES = {"frame_window4": WINDOW4, "frame_window4_stream": WINDOW4, "frame_windows_timed": TIMED, "frame_compound_avg": _fold_sql("(a + b) / 2"), "frame_compound_alpha": _fold_sql("0.9::double * a + 0.1::double * b"), "frame_compound_rest": REST, "plane_equations": PLANE, "reconstruction": RECONSTRUCTION, "reconstruction_between": BETWEEN}
