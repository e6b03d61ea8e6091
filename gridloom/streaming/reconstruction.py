"""A volume without holes from tracked frames: voxels between the middle planes of each four frames that follow each other.

Along every line of voxels the two middle planes of a window cut out a piece; its voxels take the four frames' values at their
feet, by inverse distance, or at one place of a plane that moves with the probe. Windows that follow each other share a plane,
so no voxel between the first and the last plane is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import BLOCK_BITS, chunked, numbered
from ..scratch import written
from .frames import compounded

WINDOW = 4
CHUNK = 128  # frames that lie in one task, with the three before them
VOXELS = 1 << 17  # that are worked on at once
FRAME_BYTES = 32 << 20  # of frames that are held at once
ROWS = pa.schema([("stream", pa.int64()), ("at", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("z", pa.int64()), ("v", pa.float64())])
MAPS = pa.schema([(c, pa.int64()) for c in ("stream", "x", "y", "z")] + [("v", pa.float64()), ("at", pa.int64())] + [(c, pa.float64()) for c in ("first", "by", "s")])


class Planes:
    """The geometry of some frames: corners, the pixels' directions, normals and offsets, a row each."""

    def __init__(self, pose: np.ndarray, spacing: tuple[float, float], size: tuple[int, int]):
        m = pose.reshape(-1, 3, 4)
        x, y, self.corner = m[:, :, 0], m[:, :, 1], m[:, :, 3]
        n = np.cross(x, y)
        self.normal = n / np.linalg.norm(n, axis=1, keepdims=True)
        self.offset = -(self.normal * self.corner).sum(1)
        self.x = x / (spacing[0] * (x * x).sum(1, keepdims=True))  # a point's product with it is its column
        self.y = y / (spacing[1] * (y * y).sum(1, keepdims=True))
        ends = np.stack([self.corner + (size[0] - 1) * spacing[0] * i * x + (size[1] - 1) * spacing[1] * j * y for i, j in product((0, 1), repeat=2)])
        self.low, self.high = ends.min(0), ends.max(0)


def boxes(p: Planes, i: np.ndarray, voxel: float, axis: int) -> tuple[np.ndarray, ...]:
    """Of the planes i and i + 1 each: the first of the lines along the axis that may meet voxels between them and the lines' numbers in both directions, and the most voxels of such a line."""
    n, d = np.stack([p.normal[i], p.normal[i + 1]], 1), np.stack([p.offset[i], p.offset[i + 1]], 1)
    if not np.isfinite(n).all():
        raise ValueError("a pose's columns span no plane")
    a, b = (k for k in range(3) if k != axis)
    lo, hi = np.minimum(p.low[i], p.low[i + 1]), np.maximum(p.high[i], p.high[i + 1])
    flat = (np.abs(n[:, :, axis]) < 1e-12).any(1)
    n[flat, :, axis] = 1.0
    margin = np.zeros(len(i))  # a voxel's foot is no further from it than the planes are along its line, which is most at a corner of the lines' box
    for _ in range(8):
        gap = np.zeros(len(i))
        for u, w in product((lo[:, a] - margin, hi[:, a] + margin), (lo[:, b] - margin, hi[:, b] + margin)):
            t = -(n[:, :, a] * u[:, None] + n[:, :, b] * w[:, None] + d) / n[:, :, axis]
            gap = np.maximum(gap, np.abs(t[:, 0] - t[:, 1]))
        if (gap <= margin).all():
            break
        margin = np.maximum(margin, gap)
    u0, w0 = (np.ceil((lo[:, k] - margin) / voxel).astype(np.int64) for k in (a, b))
    nu, nw = (np.maximum(np.floor((hi[:, k] + margin) / voxel).astype(np.int64) - k0 + 1, 0) for k, k0 in ((a, u0), (b, w0)))
    return u0, w0, np.where(flat, 0, nu), nw, np.floor(gap / voxel).astype(np.int64) + 3


def between(p: Planes, i: np.ndarray, voxel: float, axis: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which of the i, voxels as whole numbers, a row each) on lines along the axis that lie between the planes i and i + 1, those around both ends included; about VOXELS at once."""
    if axis is None:
        nearest = np.abs(p.normal[i] + p.normal[i + 1]).argmax(1)
        for k in range(3):
            some = np.flatnonzero(nearest == k)
            for which, grid in between(p, i[some], voxel, k):
                yield some[which], grid
        return
    if not len(i):
        return
    u0, w0, nu, nw, most = boxes(p, i, voxel, axis)
    a, b = (k for k in range(3) if k != axis)
    block = np.cumsum(nu * nw * most) // VOXELS
    for some in np.split(np.arange(len(i)), np.flatnonzero(np.diff(block)) + 1):
        lines = nu[some] * nw[some]
        which = np.repeat(some, lines)
        k = np.arange(len(which)) - np.repeat(np.cumsum(lines) - lines, lines)
        u, w = (u0[which] + k // nw[which]).astype(float), (w0[which] + k % nw[which]).astype(float)
        t = [-(n[:, a] * u * voxel + n[:, b] * w * voxel + p.offset[j]) / n[:, axis] / voxel for j in (i[which], i[which] + 1) for n in (p.normal[j],)]
        first = np.floor(np.minimum(*t)).astype(np.int64)
        count = np.maximum(first + 1, np.floor(np.maximum(*t)).astype(np.int64)) - first + 1
        out = np.empty((int(count.sum()), 3), np.int64)
        out[:, a], out[:, b] = np.repeat(u, count), np.repeat(w, count)
        out[:, axis] = np.repeat(first, count) + np.arange(len(out)) - np.repeat(np.cumsum(count) - count, count)
        yield np.repeat(which, count), out


def bilinear(images: np.ndarray, j: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """The images j (image, row, column) between their pixels, one for each place; NaN where one of the four is NaN or isn't there."""
    h, w = images.shape[1:]
    x0, y0 = np.floor(px), np.floor(py)
    inside = (x0 >= 0) & (y0 >= 0) & (x0 + 1 < w) & (y0 + 1 < h)
    some = slice(None) if inside.all() else np.flatnonzero(inside)
    x0, y0, flat = x0[some], y0[some], images.ravel()
    fx, fy = px[some] - x0, py[some] - y0
    at = (j[some] * h + y0.astype(np.int64)) * w + x0.astype(np.int64)
    v = np.full(len(px), np.nan)
    v[some] = flat[at] * (1 - fx) * (1 - fy) + flat[at + 1] * fx * (1 - fy) + flat[at + w] * (1 - fx) * fy + flat[at + w + 1] * fx * fy if len(at) else v[some]
    return v


def weighted(values: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Means of the four values (a row a frame) by inverse distance. A plane that a voxel lies on exactly has no weight, as in the published form; with no weight at all the mean is 0."""
    w = np.divide(1.0, far, out=np.zeros_like(far), where=far > 0)
    total = w.sum(0)
    out = np.divide((w * values).sum(0), total, out=np.zeros_like(total), where=total > 0)
    return np.where(np.isnan(values).any(0), np.nan, out)


def feet(p: Planes, i: np.ndarray, images: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which points have a value at their feet on all of the frames i to i + 3, these values, the points' distances), a row a frame. What one frame has no value for isn't looked up in the next."""
    kept, values, far = np.arange(len(points)), [], []
    for k in range(WINDOW):
        j, q = i[kept] + k, points[kept]
        rest = q - p.corner[j]
        v = bilinear(images, j, np.einsum("ij,ij->i", rest, p.x[j]), np.einsum("ij,ij->i", rest, p.y[j]))
        ok = np.flatnonzero(~np.isnan(v))
        kept, j, q = kept[ok], j[ok], q[ok]
        values, far = [x[ok] for x in (*values, v)], [*(x[ok] for x in far), np.abs(np.einsum("ij,ij->i", p.normal[j], q) + p.offset[j])]
    return kept, np.stack(values), np.stack(far)


def by_distance(p: Planes, i: np.ndarray, images: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which points have a value, the values): each frame's at the voxel's foot on it. i: each point's first frame."""
    kept, values, far = feet(p, i, images, points)
    return kept, weighted(values, far)


def cubic(t: np.ndarray) -> np.ndarray:
    """Keys' cubic kernel with a = -1/2."""
    t = np.abs(t)
    return np.where(t <= 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t <= 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0.0))


def by_trajectory(p: Planes, i: np.ndarray, images: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The frames' values at the voxel's place on a plane between them, whose corner and directions are cubic in time; frames count as evenly spaced in time.

    The moment is where the voxel divides the way between the two middle planes. A voxel that lies on both of them is left out, and so is
    one whose foot on one of the four frames is outside of it.
    """
    kept, _, far = feet(p, i, images, points)
    i, gap = i[kept], far[1] + far[2]
    moment = np.divide(far[1], gap, out=np.full_like(gap, np.nan), where=gap > 0)
    phi = cubic(moment[None] - (np.arange(WINDOW)[:, None] - 1))
    moved = lambda rows: sum(phi[k][:, None] * rows[i + k] for k in range(WINDOW))
    rest = points[kept] - moved(p.corner)
    px, py = (rest * moved(p.x)).sum(1), (rest * moved(p.y)).sum(1)
    v = weighted(np.stack([bilinear(images, i + k, px, py) for k in range(WINDOW)]), far)
    ok = ~np.isnan(v)
    return kept[ok], v[ok]


WAYS: dict[str, Callable] = {"distance": by_distance, "trajectory": by_trajectory}


def runs(key: list[np.ndarray], at: np.ndarray, v: np.ndarray, keep: float) -> tuple[np.ndarray, ...]:
    """The values of equal keys folded in order of `at`, by old keep + new (1 - keep): (a row of the first value, how many, the fold from the first, the fold from 0) of each key."""
    order = np.lexsort((at, *key))
    v = v[order]
    new = np.r_[True, np.any([k[order][1:] != k[order][:-1] for k in key], axis=0)] if len(v) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    n = np.diff(np.r_[first, len(v)])
    acc, zero = v[first], v[first] * (1 - keep)
    some = np.flatnonzero(n > 1)
    for r in range(1, int(n.max(initial=0))):
        some = some[n[some] > r]
        x = v[first[some] + r] * (1 - keep)
        acc[some], zero[some] = acc[some] * keep + x, zero[some] * keep + x
    return order[first], n, acc, zero


def _swept(size: tuple[int, int], spacing: tuple[float, float], voxel: float, axis: int | None, way: str, chunk: int, out: Callable) -> Callable:
    """A function for mapInArrow over (stream, chunk, at, pose, pixels) in order of the first three, a chunk in one task: what out(stream, whole, which, at, grid, v) makes of the voxels of the windows that have come.

    stream: of each chunk here, whole: if all windows of its stream are here, which: each voxel's chunk among these. Batches are worked on up to the end of a chunk, or
    of what they hold if that is over FRAME_BYTES.
    """
    fill, (w, h) = WAYS[way], size

    def work(rows: pa.Table, begun: bool, ended: bool) -> Iterator[pa.RecordBatch]:
        cols = [rows.column(c).combine_chunks() for c in ("pose", "pixels")]
        if any(r.null_count for r in cols) or set(pa.compute.unique(cols[0].value_lengths()).to_pylist()) != {12} or set(pa.compute.unique(cols[1].value_lengths()).to_pylist()) != {w * h}:
            raise ValueError(f"a frame needs a pose of 12 numbers and {w} x {h} pixels")
        pose, pixels = (r.flatten().to_numpy(zero_copy_only=False).astype(float) for r in cols)
        p, images, at = Planes(pose, spacing, size), pixels.reshape(-1, h, w), rows.column("at").to_numpy()
        new, of = starts(rows), rows.column("chunk").to_numpy()
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(new)] - 1
        whole = (of[first] == 0) & (at[last] <= chunk - WINDOW + 1)  # no frame of the stream went to another chunk too
        whole[0] &= begun
        whole[-1] &= ended
        i = np.arange(max(len(at) - WINDOW + 1, 0))
        end = i + WINDOW - 1
        i = i[(group[i] == group[end]) & (at[end] > WINDOW) & ((at[end] - 1) // chunk == of[end])]
        parts = []
        for which, grid in between(p, i + 1, voxel, axis):
            kept, v = fill(p, i[which], images, grid * float(voxel))
            parts.append((i[which[kept]] + WINDOW - 1, grid[kept], v))
        if parts:
            row, grid, v = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(v):
                yield out(rows.column("stream").combine_chunks().take(pa.array(first)), whole, group[row], at[row], grid, v)

    def starts(rows: pa.Table) -> np.ndarray:
        """Where another chunk begins."""
        stream, of = rows.column("stream"), rows.column("chunk").to_numpy()
        null, stream = stream.is_null().to_numpy(), stream.fill_null(0).to_numpy()
        return np.r_[True, (stream[1:] != stream[:-1]) | (null[1:] != null[:-1]) | (of[1:] != of[:-1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begun = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, new]) if held is not None else new
            cut = int(np.flatnonzero(starts(held))[-1])
            if cut:
                yield from work(held.slice(0, cut), begun, True)
                held, begun = held.slice(cut), True
            if held.nbytes > FRAME_BYTES:
                yield from work(held, begun, False)
                held, begun = held.slice(max(held.num_rows - WINDOW + 1, 0)), False
        if held is not None:
            yield from work(held, begun, True)

    return run


def _dealt(frames: DataFrame, chunk: int) -> DataFrame:
    """(stream, chunk, at, pose, pixels) of the frames, each chunk in one task and in order."""
    frames = written(frames.select("stream", "ts", "frame_id", "pose", "pixels"))
    keys = frames.select("stream", "ts", "frame_id")
    order = numbered(keys, "stream", ["ts", "frame_id"]).withColumnsRenamed({c: f"{c}_" for c in keys.columns})
    same = F.lit(True)
    for c in keys.columns:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_"))
    rows = frames.select(F.col("stream").cast("long").alias("stream"), "ts", "frame_id", "pose", "pixels").join(order, same).select("stream", "at", "pose", "pixels")
    return chunked(rows, "at", chunk, WINDOW - 1).repartition("stream", "chunk").sortWithinPartitions("stream", "chunk", "at").select("stream", "chunk", "at", "pose", "pixels")


def filled(frames: DataFrame, size: tuple[int, int], spacing: tuple[float, float], voxel: float, axis: int | None = 2, way: str = "distance", chunk: int = CHUNK) -> DataFrame:
    """(stream, at, x, y, z, v): what each window of four frames says of the voxels between its middle planes; `at` is the number of its last frame.

    frames: (stream long, ts, frame_id, pose, pixels): pose is a 3 x 4 matrix by rows from (column spacing, row spacing, 0) to space, pixels the
    size[0] x size[1] values by rows, null where the frame has none. Frames are in order of (ts, frame_id); the first window comes with frame 5.
    A voxel needs a value on all four frames. Lines of voxels run along `axis`, or where it is None along the one nearest to the middle planes' normal.
    A null stream is a stream; frames without a pose or with another number of pixels are errors; no frames give no rows.

    Only keys are sorted by ranges, so a stream may hold any share of the frames. Frames go once to the chunk of `chunk` frames of their stream that they
    are in, and the last three also to the next; a task works on a batch of frames at a time, with the three before it.
    """

    def out(stream: pa.Array, whole: np.ndarray, which: np.ndarray, at: np.ndarray, grid: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([stream.take(pa.array(which)), pa.array(at), *(pa.array(grid[:, a]) for a in range(3)), pa.array(v)], schema=ROWS)

    return _dealt(frames, chunk).mapInArrow(_swept(size, spacing, voxel, axis, way, chunk, out), "stream long, at long, x long, y long, z long, v double")


def volume(frames: DataFrame, size: tuple[int, int], spacing: tuple[float, float], voxel: float, axis: int | None = 2, way: str = "distance", how: str = "avg", chunk: int = CHUNK) -> DataFrame:
    """(stream, x, y, z, v): the windows' values of each voxel compounded in order of time.

    Folds that depend on the order are made where the windows are: a voxel's values of a batch are one map old -> by old + s. Those of streams whose
    windows are all there are done; the other voxels' maps are composed in order, 2^BLOCK_BITS windows at a time.
    """
    keep = {"avg": 0.5, "alpha": 0.9}.get(how)
    if keep is None:
        values = filled(frames, size, spacing, voxel, axis, way, chunk).select(F.struct("stream", "x", "y", "z").alias("voxel"), F.col("at").alias("ts"), F.col("at").alias("frame_id"), "v")
        return compounded(values, how).select("voxel.*", "v")

    def out(stream: pa.Array, whole: np.ndarray, which: np.ndarray, at: np.ndarray, grid: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        first, n, acc, zero = runs([*grid.T, which], at, v, keep)
        done = whole[which[first]]
        ends = [pa.array(x, mask=done) for x in (at[first], v[first], keep**n, zero)]
        return pa.RecordBatch.from_arrays([stream.take(pa.array(which[first])), *(pa.array(grid[first, a]) for a in range(3)), pa.array(acc, mask=~done), *ends], schema=MAPS)

    voxel_ = ["stream", "x", "y", "z"]
    maps = written(_dealt(frames, chunk).mapInArrow(_swept(size, spacing, voxel, axis, way, chunk, out), "stream long, x long, y long, z long, v double, at long, first double, by double, s double"))
    rest = maps.where("at is not null").repartition(*voxel_).select(*voxel_, F.shiftright("at", BLOCK_BITS).alias("block"), F.struct("at", "first", "by", "s").alias("m"))
    ms = rest.groupBy(*voxel_, "block").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    one = F.aggregate("ms", F.struct(F.lit(1.0).alias("by"), F.lit(0.0).alias("s")), lambda acc, m: F.struct((acc["by"] * m["by"]).alias("by"), (acc["s"] * m["by"] + m["s"]).alias("s")))
    blocks = ms.select(*voxel_, F.struct("block", F.col("ms")[0]["first"].alias("first"), one.alias("m")).alias("b")).groupBy(*voxel_).agg(F.sort_array(F.collect_list("b")).alias("bs"))
    rest = blocks.select(*voxel_, F.aggregate("bs", F.col("bs")[0]["first"], lambda acc, b: acc * b["m"]["by"] + b["m"]["s"]).alias("v"))
    return maps.where("at is null").select(*voxel_, "v").union(rest)
