"""Minimisers whose every evaluation is a Spark aggregate: Powell's directions and the simplex of Nelder and Mead."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .similarity import shifted_differences

Objective = Callable[[np.ndarray], float]
GOLDEN = (3 - math.sqrt(5)) / 2


def line_minimum(f: Callable[[float], float], lo: float, hi: float, tolerance: float, most: int = 60) -> tuple[float, float]:
    """(place, value) of a minimum of f between lo and hi by golden sections, with the ends tried too."""
    a, b = lo, hi
    x, y = a + GOLDEN * (b - a), b - GOLDEN * (b - a)
    fx, fy = f(x), f(y)
    for _ in range(most):
        if b - a <= tolerance:
            break
        if fx <= fy:
            b, y, fy = y, x, fx
            x = a + GOLDEN * (b - a)
            fx = f(x)
        else:
            a, x, fx = x, y, fy
            y = b - GOLDEN * (b - a)
            fy = f(y)
    return min(((x, fx), (y, fy), (lo, f(lo)), (hi, f(hi))), key=lambda p: p[1])


def powell(f: Objective, brackets: list[tuple[float, float]], start: list[float] | None = None, tolerance: float = 1e-3, rounds: int = 20) -> tuple[np.ndarray, float]:
    """(place, value) of a minimum inside the brackets: line searches along directions, of which the one that gained most gives way to the sum of a round's moves."""
    lo, hi = (np.array(x, float) for x in zip(*brackets, strict=True))
    x = (lo + hi) / 2 if start is None else np.clip(np.array(start, float), lo, hi)
    seen: dict[bytes, float] = {}

    def value(p: np.ndarray) -> float:
        k = p.tobytes()
        if k not in seen:
            seen[k] = float(f(p))
        return seen[k]

    def along(p: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, float]:
        ends = [((lo[i] - p[i]) / d[i], (hi[i] - p[i]) / d[i]) for i in range(len(p)) if abs(d[i]) > 1e-12]
        a, b = max(min(e) for e in ends), min(max(e) for e in ends)
        if b - a <= tolerance:
            return p, value(p)
        t, v = line_minimum(lambda t: value(np.clip(p + t * d, lo, hi)), a, b, tolerance)
        return (np.clip(p + t * d, lo, hi), v) if v < value(p) else (p, value(p))

    directions = list(np.eye(len(x)))
    for _ in range(rounds):
        first, gains = x, []
        for d in directions:
            was = value(x)
            x, now = along(x, d)
            gains.append(was - now)
        if value(first) - value(x) <= tolerance * (abs(value(x)) + 1e-12):
            break
        move = x - first
        if np.linalg.norm(move) > tolerance:
            directions[int(np.argmax(gains))] = move / np.linalg.norm(move)
            x, _ = along(x, move / np.linalg.norm(move))
    return x, value(x)


def simplex(f: Callable[[list[np.ndarray]], list[float]], start: list[float], size: float, tolerance: float = 1e-3, rounds: int = 100) -> tuple[np.ndarray, float]:
    """(place, value) of a minimum by a simplex that reflects, grows and shrinks; f values several places at once.

    A round asks for the reflected, stretched and both shrunk places together, so it is one job whatever comes of it.
    """
    at = np.array([start] + [np.array(start, float) + size * e for e in np.eye(len(start))], float)
    val = np.array(f(list(at)))
    for _ in range(rounds):
        order = np.argsort(val, kind="stable")
        at, val = at[order], val[order]
        if val[-1] - val[0] <= tolerance * (abs(val[0]) + 1e-12) and np.abs(at - at[0]).max() <= tolerance:
            break
        mid = at[:-1].mean(axis=0)
        tries = [mid + t * (at[-1] - mid) for t in (-1.0, -2.0, 0.5, -0.5)]
        r, e, inner, outer = f(tries)
        if r < val[0]:
            at[-1], val[-1] = (tries[1], e) if e < r else (tries[0], r)
        elif r < val[-2]:
            at[-1], val[-1] = tries[0], r
        elif min(inner, outer) < val[-1]:
            at[-1], val[-1] = (tries[2], inner) if inner <= outer else (tries[3], outer)
        else:
            at[1:] = at[0] + 0.5 * (at[1:] - at[0])
            val[1:] = f(list(at[1:]))
    k = int(val.argmin())
    return at[k], float(val[k])


def register_shift(moving: DataFrame, fixed: DataFrame, brackets: list[tuple[float, float]], measure: str = "ssd", tolerance: float = 1e-2) -> DataFrame:
    """One row (dx, dy, dz, value, calls): the shift in the brackets of least mean sad or ssd, or greatest ncc, by powell().

    A shift under which no voxel is known has the value infinity.
    """
    calls = 0

    def f(shift: np.ndarray) -> float:
        nonlocal calls
        calls += 1
        r = shifted_differences(moving, fixed, tuple(shift.tolist())).first()
        if not r["n"] or r[measure] is None:
            return math.inf
        return -r["ncc"] if measure == "ncc" else r[measure] / r["n"]

    fixed_axes = [i for i, (a, b) in enumerate(brackets) if a == b]
    free = [b for i, b in enumerate(brackets) if i not in fixed_axes]
    full = lambda p: np.array([brackets[i][0] if i in fixed_axes else p[[j for j in range(3) if j not in fixed_axes].index(i)] for i in range(3)])
    x, v = powell(lambda p: f(full(p)), free, tolerance=tolerance)
    return moving.sparkSession.createDataFrame([(*full(x).tolist(), float(v), calls)], "dx double, dy double, dz double, value double, calls long").select(*(F.round(c, 6).alias(c) for c in ("dx", "dy", "dz", "value")), "calls")
