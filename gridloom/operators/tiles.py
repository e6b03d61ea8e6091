"""Neighbourhood operators on dense images: overlapping tiles are shuffled once, and a kernel works on each as an array.

A tile is a box of `side` voxels an axis with `halo` voxels around it, so a task's memory is bounded by the tile however large
the image, and a kernel of reach r may be applied halo // r times before voxels have to be exchanged again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written

AXES = ("x", "y", "z")
Arrays = dict[str, np.ndarray]


def dealt(image: DataFrame, halo: tuple[int, int, int], side: int) -> DataFrame:
    """The rows with tile keys tx, ty, tz, once for each tile in whose halo they are."""
    for a, h in zip(AXES, halo, strict=True):
        if h > side:
            raise ValueError("a halo is wider than a tile")
        at = F.floor(F.col(a) / side)
        near = F.array_distinct(F.array(F.floor((F.col(a) - h) / side), at, F.floor((F.col(a) + h) / side)))
        image = image.withColumn(f"t{a}", F.explode(near) if h else at)
    return image


def as_arrays(group: pa.Table, names: list[str]) -> tuple[list[np.ndarray], tuple[int, ...], Arrays]:
    """The rows' places in their bounding box, its shape, and each column as an array over it, NaN where there is no row.

    An array column gives an array with one more axis, its first.
    """
    at = [group.column(a).to_numpy() for a in AXES]
    at = [p - p.min() for p in at]
    shape = tuple(int(p.max()) + 1 for p in at)
    out = {}
    for n in names:
        col = group.column(n).combine_chunks()
        if pa.types.is_list(col.type):
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1)
            box = np.full((flat.shape[1], *shape), np.nan)
            box[(slice(None), *at)] = flat.T
        else:
            box = np.full(shape, np.nan)
            box[tuple(at)] = col.to_numpy(zero_copy_only=False).astype(float)
        out[n] = box
    return at, shape, out


def tiled(image: DataFrame, kernel: Callable[[Arrays], Arrays], columns: list[str], out: dict[str, str], halo: int | tuple[int, int, int], side: int = 32) -> DataFrame:
    """(x, y, z, out...) of every row of the image (x, y, z, columns...).

    kernel: gets the columns as float arrays over a tile with its halo (axes x, y, z; NaN where the image has no voxel;
    smaller where the image ends) and returns arrays of that shape for `out`, names to Spark types double, long or
    array<double>. The ends of an array that aren't ends of the image count as the image's, so what is within the kernel's
    reach of them is wrong, and is in the halo. Voxels are unique; an empty image gives no rows.
    """
    halo = (halo,) * 3 if isinstance(halo, int) else halo
    kinds = {"double": pa.float64(), "long": pa.int64(), "array<double>": pa.list_(pa.float64())}
    schema = pa.schema([*((a, pa.int64()) for a in AXES), *((k, kinds[t]) for k, t in out.items())])

    def run(group: pa.Table) -> pa.Table:
        at, _, arrays = as_arrays(group, columns)
        got = kernel(arrays)
        own = np.logical_and.reduce([group.column(a).to_numpy() // side == group.column(f"t{a}")[0].as_py() for a in AXES])
        inner = tuple(p[own] for p in at)
        cols = [pa.array(group.column(a).to_numpy()[own]) for a in AXES]
        for k, t in out.items():
            v = got[k][(slice(None), *inner)].T if t.startswith("array") else got[k][inner]
            cols.append(pa.array(list(v) if t.startswith("array") else v.astype(np.int64 if t == "long" else float), kinds[t]))
        return pa.Table.from_arrays(cols, schema=schema)

    ids = [F.col(a).cast("long").alias(a) for a in AXES]
    rows = dealt(image.select(*ids, *columns), halo, side)
    return rows.groupBy("tx", "ty", "tz").applyInArrow(run, ", ".join([*(f"{a} long" for a in AXES), *(f"{k} {t}" for k, t in out.items())]))


def fixpoint(image: DataFrame, step: Callable[[Arrays], np.ndarray], v: str, others: list[str], reach: int = 1, inner: int = 8, side: int = 32, least: float = 1e-9, most: int = 10_000, flat: bool = False) -> DataFrame:
    """The rows with `v` after step() until it changes nowhere by more than `least`.

    step: the next `v` of a tile from its columns. Each round works `inner` steps in the tiles, is written to the shared
    folder, and sends one number to the driver. flat: step looks along x and y only.
    """
    halo, side = (reach * inner, reach * inner, 0 if flat else reach * inner), max(side, reach * inner)

    def kernel(arrays: Arrays) -> Arrays:
        first = arrays[v]
        for _ in range(inner):
            arrays = {**arrays, v: step(arrays)}
        return {v: arrays[v], "moved": np.abs(np.nan_to_num(arrays[v] - first)), **{k: arrays[k] for k in others}}

    for _ in range(most):
        image = written(tiled(image, kernel, [v, *others], {v: "double", "moved": "double", **dict.fromkeys(others, "double")}, halo, side))
        if not (image.agg(F.max("moved")).first()[0] or 0) > least:
            return image.drop("moved")
    raise RuntimeError(f"values still move after {most} rounds")


def before(a: np.ndarray, axis: int, edge: float | None = None) -> np.ndarray:
    """Each voxel's predecessor along an axis; at the start itself, or `edge`."""
    return _moved(a, axis, 1, edge)


def after(a: np.ndarray, axis: int, edge: float | None = None) -> np.ndarray:
    return _moved(a, axis, -1, edge)


def _moved(a: np.ndarray, axis: int, by: int, edge: float | None) -> np.ndarray:
    axis -= 3  # the last three axes are x, y, z
    out = np.roll(a, by, axis)
    at = [slice(None)] * a.ndim
    at[axis] = 0 if by > 0 else -1
    out[tuple(at)] = a[tuple(at)] if edge is None else edge
    if edge is None:
        return np.where(np.isnan(out), a, out)
    return np.where(np.isnan(out), edge, out)
