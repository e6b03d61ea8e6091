"""Kohonen maps, which are also Gaussian mixtures: training by batches, nearest units, probabilities and label likelihoods."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .statistics import principal_axes

MOST_UNITS = 1 << 16
PART = 1 << 22  # numbers of a batch against all units that are held at once


@dataclass(frozen=True)
class UnitMap:
    """An nx by ny map of units with weights, means and variances; unit (ux, uy) is row ux + nx * uy."""

    nx: int
    weight: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    def __post_init__(self) -> None:
        if len(self.weight) > MOST_UNITS:
            raise ValueError(f"over {MOST_UNITS} units")

    @property
    def ny(self) -> int:
        return len(self.weight) // self.nx

    def costs(self, x: np.ndarray) -> np.ndarray:
        """(rows, units): sum of squares over variances / 2 + ln of the variances' product / 2 - ln weight."""
        quad = (x * x) @ (0.5 / self.var).T - x @ (self.mean / self.var).T + (0.5 * self.mean**2 / self.var).sum(axis=1)
        return quad + 0.5 * np.log(self.var).sum(axis=1) - np.log(self.weight)


def _by_batch(df: DataFrame, cols: list[str], fn, schema: pa.Schema, ddl: str) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in cols], axis=1)
            out = fn(x)
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(v) for v in out)], schema=schema)

    return df.mapInArrow(run, ddl)


def _parts(x: np.ndarray, units: int) -> Iterator[np.ndarray]:
    step = max(1, PART // max(units, 1))
    for a in range(0, len(x), step):
        yield x[a : a + step]


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0)


def _nearest(units: UnitMap, x: np.ndarray) -> np.ndarray:
    n = len(units.weight)
    return _joined([n - 1 - units.costs(p)[:, ::-1].argmin(axis=1) for p in _parts(x, n)]).astype(np.int64)


def best_units(df: DataFrame, key: str, cols: list[str], units: UnitMap) -> DataFrame:
    """(key, ux, uy): the unit of least cost for each row; of equal ones the last. Rows with a null channel are left out."""

    def fn(x: np.ndarray) -> list[np.ndarray]:
        at = _nearest(units, x)
        return [at % units.nx, at // units.nx]

    rows = df.dropna(subset=cols).select(F.col(key).cast("long").alias("key"), *(F.col(c).cast("double") for c in cols))
    schema = pa.schema([("key", pa.int64()), ("ux", pa.int64()), ("uy", pa.int64())])
    return _by_batch(rows, cols, fn, schema, "key long, ux long, uy long").withColumnRenamed("key", key)


def _log_density(units: UnitMap, x: np.ndarray) -> np.ndarray:
    """ln of weight times normal density, (rows, units)."""
    return -units.costs(x) - 0.5 * x.shape[1] * math.log(2 * math.pi)


def _log_sum(l: np.ndarray) -> np.ndarray:
    m = l.max(axis=1, keepdims=True)
    return (m + np.log(np.exp(l - m).sum(axis=1, keepdims=True)))[:, 0]


def probability(df: DataFrame, key: str, cols: list[str], units: UnitMap, entropy: bool = True) -> DataFrame:
    """(key, p): -ln of the mixture's density at each row, or the density itself."""

    def fn(x: np.ndarray) -> list[np.ndarray]:
        l = _joined([_log_sum(_log_density(units, p)) for p in _parts(x, len(units.weight))])
        return [-l if entropy else np.exp(l)]

    rows = df.dropna(subset=cols).select(F.col(key).cast("long").alias("key"), *(F.col(c).cast("double") for c in cols))
    return _by_batch(rows, cols, fn, pa.schema([("key", pa.int64()), ("p", pa.float64())]), "key long, p double").withColumnRenamed("key", key)


SUMS = pa.schema([("label", pa.int64()), ("unit", pa.int64()), ("s", pa.float64()), ("l", pa.float64()), ("n", pa.int64())])


def _by_label(df: DataFrame, label: str, cols: list[str], units: UnitMap) -> DataFrame:
    """(label, unit, s, l, n): sums of responsibilities and of their ln, and rows, a row for each task, label and unit, then summed."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(units.weight)
        sums: dict[int, list] = {}
        for batch in it:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in cols], axis=1)
            y = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            for v in np.unique(y).tolist():
                own = sums.setdefault(v, [np.zeros(k), np.zeros(k), 0])
                for p in _parts(x[y == v], k):
                    l = _log_density(units, p)
                    r = l - _log_sum(l)[:, None]
                    own[0] += np.exp(r).sum(axis=0)
                    own[1] += np.maximum(r, -700.0).sum(axis=0)
                    own[2] += len(p)
        for v, (s, l, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, v)), pa.array(np.arange(k)), pa.array(s), pa.array(l), pa.array(np.full(k, n))], schema=SUMS)

    rows = df.dropna(subset=[*cols, label]).select(F.col(label).cast("long").alias("label"), *(F.col(c).cast("double") for c in cols))
    return rows.mapInArrow(run, "label long, unit long, s double, l double, n long").groupBy("label", "unit").agg(F.sum("s").alias("s"), F.sum("l").alias("l"), F.sum("n").alias("n"))


def responsibilities(df: DataFrame, label: str, cols: list[str], units: UnitMap) -> DataFrame:
    """(label, ux, uy, responsibility): sums over the rows of a label of the units' shares in their density."""
    u = F.col("unit")
    return _by_label(df, label, cols, units).select("label", (u % units.nx).alias("ux"), F.floor(u / units.nx).alias("uy"), F.col("s").alias("responsibility"))


def label_costs(df: DataFrame, label: str, cols: list[str], units: UnitMap, prior: float = 0.1) -> DataFrame:
    """(label, unit, cost): ln of a label's rows less ln of a unit's responsibility for them, which starts at `prior`."""
    rows = _by_label(df, label, cols, units)
    return rows.select("label", "unit", (F.ln(F.col("n").cast("double")) - F.ln(F.col("s") + F.lit(float(prior)))).alias("cost"))


def agreed_costs(df: DataFrame, label: str, cols: list[str], units: UnitMap, conservative: float = 1.0) -> DataFrame:
    """(label, unit, p): the units' shares in a label by the product of their responsibilities over its rows.

    Responsibilities are taken to the power conservative / rows, so that the product doesn't vanish with their number; a label's shares sum to 1.
    """
    rows = _by_label(df, label, cols, units).withColumn("v", F.lit(float(conservative)) * F.col("l") / F.col("n"))
    top = rows.groupBy("label").agg(F.max("v").alias("m"))
    rows = rows.join(F.broadcast(top), "label").withColumn("e", F.exp(F.col("v") - F.col("m")))
    sums = rows.groupBy("label").agg(F.sum("e").alias("all"))
    return rows.join(F.broadcast(sums), "label").select("label", "unit", (F.col("e") / F.col("all")).alias("p"))


def moments(df: DataFrame, cols: list[str], units: UnitMap) -> DataFrame:
    """(unit, n, s0, q0, s1, q1, ...): rows, sums and sums of squares of the rows nearest to each unit. Rows with a null channel are left out."""
    names = [f"{k}{i}" for i in range(len(cols)) for k in "sq"]
    schema = pa.schema([("unit", pa.int64()), ("n", pa.int64()), *((c, pa.float64()) for c in names)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(units.weight)
        sums = np.zeros((k, 1 + len(names)))
        for batch in it:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in cols], axis=1)
            at = _nearest(units, x)
            sums[:, 0] += np.bincount(at, minlength=k)
            for i in range(len(cols)):
                for j, v in ((1, x[:, i]), (2, x[:, i] ** 2)):
                    sums[:, 2 * i + j] += np.bincount(at, v, k)
        some = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some, 0].astype(np.int64)), *(pa.array(c) for c in sums[some, 1:].T)], schema=schema)

    rows = df.dropna(subset=cols).select(*(F.col(c).cast("double") for c in cols))
    parts = rows.mapInArrow(run, ", ".join(["unit long", "n long", *(f"{c} double" for c in names)]))
    return parts.groupBy("unit").agg(*(F.sum(c).alias(c) for c in ("n", *names)))


def epoch(df: DataFrame, key: str, cols: list[str], units: UnitMap, rate: float, width: float, floor: float = 1e-3) -> UnitMap:
    """The map after one batch: each unit moves by `rate` to the moments of the rows nearest to the units around it.

    What the units have is weighted by exp(-d^2 / 2 width^2) of their distance on the map. One aggregate with a row a unit.
    """
    k, c = len(units.weight), len(cols)
    n, s, q = np.zeros(k), np.zeros((k, c)), np.zeros((k, c))
    for r in moments(df, cols, units).collect():
        n[r["unit"]] = r["n"]
        s[r["unit"]] = [r[f"s{i}"] for i in range(c)]
        q[r["unit"]] = [r[f"q{i}"] for i in range(c)]
    at = np.stack([np.arange(k) % units.nx, np.arange(k) // units.nx], axis=1).astype(float)
    near = np.exp(-((at[:, None] - at[None]) ** 2).sum(axis=2) / (2 * max(width, 1e-6) ** 2))
    nn = near @ n
    some = nn > 0
    mean, var, weight = units.mean.copy(), units.var.copy(), units.weight
    m = (near @ s)[some] / nn[some, None]
    mean[some] += rate * (m - mean[some])
    var[some] += rate * (np.maximum((near @ q)[some] / nn[some, None] - m * m, floor) - var[some])
    if n.sum():
        weight = weight + rate * (np.maximum(nn / nn.sum(), 1e-9) - weight)
    return UnitMap(units.nx, weight / weight.sum(), mean, np.maximum(var, floor))


def plane(df: DataFrame, cols: list[str], nx: int, ny: int) -> UnitMap:
    """Units spread over two standard deviations along the first two principal axes."""
    mean, variance, axes = principal_axes(df, cols)
    u, v = np.meshgrid(np.linspace(-2, 2, nx) if nx > 1 else [0.0], np.linspace(-2, 2, ny) if ny > 1 else [0.0])
    sd = np.sqrt(np.maximum(variance, 1e-12))
    at = mean + u.ravel()[:, None] * sd[0] * axes[0] + (v.ravel()[:, None] * sd[1] * axes[1] if len(cols) > 1 else 0.0)
    spread = np.maximum((axes.T**2) @ variance, 1e-3)
    return UnitMap(nx, np.full(nx * ny, 1 / (nx * ny)), at, np.tile(spread, (nx * ny, 1)))


def doubled(units: UnitMap) -> UnitMap:
    """The map with twice the units along either side, between two of which lies the mean of both."""
    grow = lambda a: np.repeat(np.repeat(a.reshape(units.ny, units.nx, -1), 2, axis=0), 2, axis=1)
    soft = lambda a: (a + np.roll(np.pad(a, [(0, 1), (0, 0), (0, 0)], mode="edge"), -1, axis=0)[:-1]) / 2
    flip = lambda a: soft(soft(a).transpose(1, 0, 2)).transpose(1, 0, 2)
    mean, var, w = (flip(grow(a)).reshape(4 * len(units.weight), -1) for a in (units.mean, units.var, units.weight))
    return UnitMap(2 * units.nx, w[:, 0] / w.sum(), mean, var)


def schedule(points: list[tuple[float, float]], at: float) -> float:
    """A value of a schedule (epoch, value) that is linear between its points and level beyond them."""
    x, y = zip(*sorted(points), strict=True)
    return float(np.interp(at, x, y))


def train(df: DataFrame, key: str, cols: list[str], nx: int, ny: int, epochs: int, rates: list[tuple[float, float]], widths: list[tuple[float, float]], doublings: int = 0) -> UnitMap:
    """A map trained by batches from the principal plane; widths are shares of the map's greater side.

    Training row by row is sequential by nature; a batch gives each row the same map and is one aggregate. The map is
    doubled after equal numbers of epochs.
    """
    units = plane(df, cols, nx, ny)
    every = max(1, epochs // (doublings + 1))
    for i in range(epochs):
        if doublings and i and i % every == 0:
            units, doublings = doubled(units), doublings - 1
        units = epoch(df, key, cols, units, schedule(rates, i), schedule(widths, i) * max(units.nx, units.ny))
    return units


def reprojected(df: DataFrame, ux: str, uy: str, units: UnitMap) -> DataFrame:
    """The rows with m0, m1, ...: the units' means at the map location (ux, uy), linear between units and level beyond the map.

    The map is an array of at most MOST_UNITS numbers a channel, in the plan.
    """
    clamp = lambda c, n: F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), F.col(c).cast("double")))
    x, y = clamp(ux, units.nx), clamp(uy, units.ny)
    x0, y0 = F.floor(x), F.floor(y)
    x1, y1 = F.least(x0 + 1, F.lit(units.nx - 1)), F.least(y0 + 1, F.lit(units.ny - 1))
    fx, fy = x - x0, y - y0

    def channel(k: int):
        values = F.lit(units.mean[:, k].tolist())
        at = lambda i, j: F.element_at(values, (i + units.nx * j + 1).cast("int"))
        return at(x0, y0) * (1 - fx) * (1 - fy) + at(x1, y0) * fx * (1 - fy) + at(x0, y1) * (1 - fx) * fy + at(x1, y1) * fx * fy

    return df.withColumns({f"m{k}": channel(k) for k in range(units.mean.shape[1])})
