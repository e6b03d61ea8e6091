"""Frames in order of arrival: windows of the last four, poses and planes, and compounding into voxels."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..functions.arithmetic import cross, moved, norm
from ..operators.ordered import chunked, decayed, numbered, own

WINDOW = 4
CHUNK = 4096


def sliding(frames: DataFrame, n: int = WINDOW) -> DataFrame:
    """(stream, ts, frame_id, v0, ..., vn-1): each frame with the n - 1 before it, v0 the latest.

    Frames (stream, ts, frame_id, v) are in order of (ts, frame_id). The first window comes when more than n frames have
    arrived, so with frame n + 1. A stream is dealt in chunks of CHUNK frames that share n - 1, so it may hold any share of all frames.
    """
    rows = chunked(numbered(frames.select("stream", "ts", "frame_id", "v"), "stream", ["ts", "frame_id"]), "at", CHUNK, n - 1)
    by = Window.partitionBy("stream", "chunk").orderBy("at")
    rows = rows.withColumns({"v0": F.col("v"), **{f"v{i}": F.lag("v", i).over(by) for i in range(1, n)}})
    return rows.where((F.col("at") > n) & own("at", CHUNK)).select("stream", "ts", "frame_id", *(f"v{i}" for i in range(n)))


def sliding_stream(frames: DataFrame, n: int = WINDOW) -> DataFrame:
    """The same windows of a streaming DataFrame: a stream's state is its last n frames and how many there were.

    Within a micro-batch frames are put in order; over batches they count as they arrive. The state is bounded, and is
    kept by Spark's checkpoint. A null value is a NaN in the windows.
    """
    schema = ", ".join(["stream long", "ts timestamp", "frame_id long", *(f"v{i} double" for i in range(n))])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last = (state.get[0], list(state.get[1])) if state.exists else (0, [])
        new = pd.concat(list(batches)).sort_values(["ts", "frame_id"])
        rows = []
        for ts, frame_id, v in zip(new["ts"], new["frame_id"], new["v"], strict=True):
            last = [float(v), *last][:n]
            seen += 1
            if seen > n:
                rows.append((key[0], ts, frame_id, *last))
        state.update((seen, last))
        if rows:
            yield pd.DataFrame(rows, columns=["stream", "ts", "frame_id", *(f"v{i}" for i in range(n))])

    return frames.groupBy("stream").applyInPandasWithState(step, schema, "seen long, last array<double>", "append", "NoTimeout")


#: How a voxel's new value joins its old one.
COMPOUND = {
    "avg": lambda old, new: (old + new) / 2,
    "max": lambda old, new: F.greatest(old, new),
    "if_empty": lambda old, new: old,
    "overwrite": lambda old, new: new,
    "alpha": lambda old, new: 0.1 * new + 0.9 * old,
}


def compounded(values: DataFrame, how: str = "avg") -> DataFrame:
    """(voxel, v): the values (voxel, ts, frame_id, v) of each voxel folded in order of arrival; nulls are left out.

    avg is (old + new) / 2 at each step and so depends on the order, as alpha does: runs of values are folded where they lie and then one after
    the other (ordered.decayed); the other folds are partial aggregates. A voxel may hold any share of the values.
    """
    rows = values.where("v is not null")
    order = F.struct("ts", "frame_id")
    if how == "max":
        return rows.groupBy("voxel").agg(F.max("v").alias("v"))
    if how in ("if_empty", "overwrite"):
        return rows.groupBy("voxel").agg((F.min_by if how == "if_empty" else F.max_by)("v", order).alias("v"))
    return decayed(rows, "voxel", ["ts", "frame_id"], "v", {"avg": 0.5, "alpha": 0.9}[how])


def compound_stream(values: DataFrame, how: str = "avg") -> DataFrame:
    """(voxel, n, v) of a streaming DataFrame (voxel, ts, frame_id, v) at each change: the fold's state is one number a voxel."""
    keep = {"avg": 0.5, "alpha": 0.9}.get(how)

    def fold(old: float, new: float) -> float:
        return keep * old + (1 - keep) * new if keep else {"max": max(old, new), "if_empty": old, "overwrite": new}[how]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, v = state.get if state.exists else (0, 0.0)
        for x in pd.concat(list(batches)).dropna(subset=["v"]).sort_values(["ts", "frame_id"])["v"]:
            v = fold(v, float(x)) if n else float(x)
            n += 1
        state.update((n, v))
        yield pd.DataFrame({"voxel": [key[0]], "n": [n], "v": [v]})

    return values.groupBy("voxel").applyInPandasWithState(step, "voxel long, n long, v double", "n long, v double", "update", "NoTimeout")


def plane_of(pose: list[float] | Column, width: float, height: float) -> list[Column]:
    """(nx, ny, nz, d) with n . p + d = 0 of a frame of this width and height under a 3 x 4 pose."""
    o, x, y = (moved(pose, [F.lit(float(a)), F.lit(float(b)), F.lit(0.0)]) for a, b in ((0, 0), (width, 0), (0, height)))
    n = cross([p - q for p, q in zip(x, o, strict=True)], [p - q for p, q in zip(y, o, strict=True)])
    size = norm(n)
    unit = [c / size for c in n]
    return [*unit, -sum((u * p for u, p in zip(unit, o, strict=True)), F.lit(0.0))]


def composed(pose: Column, calibration: list[float]) -> Column:
    """The pose (array of 16, by rows) after a 3 x 4 calibration: an array of 12."""
    c = [*calibration, 0.0, 0.0, 0.0, 1.0]
    cell = lambda r, k: sum((pose[4 * r + j] * F.lit(float(c[4 * j + k])) for j in range(4)), F.lit(0.0))
    return F.array(*(cell(r, k) for r in range(3) for k in range(4)))


def placed_pixels(frames: DataFrame, spacing: tuple[float, float], voxel: float) -> DataFrame:
    """(frame_id, ts, x, y, z, weight, v): the pixels (frame_id, ts, pose array<12>, i, j, v) in the voxels they lie in.

    A pixel's weight falls with its distance from the voxel's middle: 1 / (distance + a tenth of a voxel).
    """
    at = moved(F.col("pose"), [F.col("i") * F.lit(spacing[0]), F.col("j") * F.lit(spacing[1]), F.lit(0.0)])
    rows = frames.select("frame_id", "ts", "v", *((p / F.lit(voxel)).alias(f"p{c}") for p, c in zip(at, "xyz", strict=True)))
    near = {c: F.floor(F.col(f"p{c}") + 0.5) for c in "xyz"}
    far = F.sqrt(sum(((F.col(f"p{c}") - near[c]) ** 2 for c in "xyz"), F.lit(0.0)))
    return rows.select("frame_id", "ts", *(near[c].alias(c) for c in "xyz"), (1 / (far + 0.1)).alias("weight"), "v")


def reconstructed(frames: DataFrame, spacing: tuple[float, float], voxel: float, how: str = "avg") -> DataFrame:
    """(x, y, z, v): each frame's pixels joined by their weights in a voxel, and the voxel's frames compounded in order."""
    rows = placed_pixels(frames, spacing, voxel).groupBy(F.struct("x", "y", "z").alias("voxel"), "ts", "frame_id").agg((F.sum(F.col("weight") * F.col("v")) / F.sum("weight")).alias("v"))
    return compounded(rows, how).select("voxel.*", "v")


def holes_filled(volume: DataFrame, side: int = 64) -> DataFrame:
    """(x, y, z, v): a volume with nulls; a null takes the mean of the known voxels of the 5^3 around it, and stays without any."""
    import numpy as np

    from ..operators.tiles import Arrays, tiled

    def kernel(a: Arrays) -> Arrays:
        v = a["v"]
        p = np.pad(v, 2, constant_values=np.nan)
        parts = [p[i : i + v.shape[0], j : j + v.shape[1], k : k + v.shape[2]] for i in range(5) for j in range(5) for k in range(5)]
        n = sum(~np.isnan(x) for x in parts)
        s = sum(np.nan_to_num(x) for x in parts)
        return {"v": np.where(np.isnan(v) & (n > 0), s / np.maximum(n, 1), v)}

    return tiled(volume, kernel, ["v"], {"v": "double"}, 2, side).withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))
