"""Continuous max-flow segmentation over a label hierarchy, and fuzzy connectedness.

The max-flow problem of a hierarchy with data terms D at its leaves and smoothness bounds a * S at its nodes is solved by the
augmented Lagrangian method: each node but the root has a spatial flow, the flow that goes out of it (`sink`) and a label u; what
comes into it is its parents' sinks by the shares of its edges. An iteration moves the spatial flows against the node's excess
and projects them onto their bounds, then finds the sinks that balance the excess of node and children, then moves the
labels by what excess is left. An image is worked in overlapping tiles, several iterations between two shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .hierarchy import LabelGraph
from .tiles import Arrays, after, before, fixpoint, tiled


@dataclass(frozen=True)
class Knobs:
    step: float = 0.1
    cc: float = 0.25
    iterations: int = 100
    per_round: int = 4  # iterations between shuffles; a tile's halo is twice as wide, since one reaches two voxels far


REACH = 2
#: Fuzzy and: the least, the product, Hamacher's product. Fuzzy or: the greatest, the probabilistic sum, the bounded sum.
T_NORMS = (np.minimum, np.multiply, lambda a, b: a * b / np.where(a + b - a * b > 0, a + b - a * b, 1.0))
S_NORMS = (np.maximum, lambda a, b: a + b - a * b, lambda a, b: np.minimum(1.0, a + b))
FIELDS = ("fx", "fy", "fz", "div", "sink", "label")  # arrays over the nodes but the root


def start(image: DataFrame, graph: LabelGraph, data: dict[str, Column], smooth: dict[str, Column]) -> DataFrame:
    """(x, y, z, d, s, fx, fy, fz, div, sink, label, source) before the first iteration.

    d: data terms by leaf. s: smoothness bounds by node. Flows are 0; what flows through every node is the least data term; a
    leaf's label is 1 if its term is the least, shared by those that are, and an inner node's is the sum over its leaves by shares.
    """
    nodes, leaves = graph.order[1:], graph.leaves
    rows = image.select("x", "y", "z", F.array(*(data[k].cast("double") for k in leaves)).alias("d"), F.array(*(smooth.get(k, F.lit(0.0)).cast("double") for k in nodes)).alias("s"))
    least = F.array_min("d")
    ties = F.size(F.filter("d", lambda c: c == least)).cast("double")
    label: dict[str, Column] = {k: F.when(F.col("d")[i] == least, 1 / ties).otherwise(F.lit(0.0)) for i, k in enumerate(leaves)}
    for k in reversed(nodes):
        if k not in label:
            label[k] = sum((label[c] * dict(graph.parents(c))[k] for c in nodes if k in dict(graph.parents(c))), F.lit(0.0))
    zero = F.array_repeat(F.lit(0.0), len(nodes))
    return rows.select("x", "y", "z", "d", "s", *(zero.alias(k) for k in FIELDS[:4]), F.array_repeat(least, len(nodes)).alias("sink"), F.array(*(label[k] for k in nodes)).alias("label"), F.array(least).alias("source"))


def iterate(a: Arrays, graph: LabelGraph, k: Knobs) -> Arrays:
    """One iteration on arrays over (node, x, y, z)."""
    nodes, leaves = graph.order[1:], graph.leaves
    place = {n: i for i, n in enumerate(nodes)}
    into = {n: graph.parents(n) for n in nodes}
    f, sink, label = [a["fx"], a["fy"], a["fz"]], a["sink"].copy(), a["label"]
    root = a["source"][0]
    flow_of = lambda p: root if p == graph.root else sink[place[p]]
    source = np.stack([sum(w * flow_of(p) for p, w in into[n]) for n in nodes])
    excess = k.step * (sink + a["div"] - source - label / k.cc)
    f = [np.where(_first(excess, i), 0.0, f[i] - (excess - before(excess, i))) for i in range(3)]
    size = np.sqrt(0.5 * sum(f[i] ** 2 + after(f[i], i, 0.0) ** 2 for i in range(3)))
    scale = np.where(size > a["s"], a["s"] / np.where(size > 0, size, 1.0), 1.0)
    f = [f[i] * 0.5 * (scale + before(scale, i)) for i in range(3)]
    div = sum(f[i] - after(f[i], i, 0.0) for i in range(3))

    need = {n: np.zeros_like(root) for n in (*nodes, graph.root)}  # what children ask of a node's sink
    share = dict.fromkeys(need, 0.0)
    for n in reversed(nodes):
        i = place[n]
        own = source[i] - div[i] + label[i] / k.cc
        sink[i] = np.minimum(a["d"][leaves.index(n)], own) if n in leaves else (own + need[n]) / (1 + share[n])
        for p, w in into[n]:
            held = a["source"][0] if p == graph.root else a["sink"][place[p]]
            need[p] = need[p] + w * (div[i] + sink[i] - label[i] / k.cc - source[i] + w * held)
            share[p] += w * w
    root = (need[graph.root] + 1 / k.cc) / share[graph.root]
    return {**a, "fx": f[0], "fy": f[1], "fz": f[2], "div": div, "sink": sink, "label": label - k.cc * (sink + div - source), "source": root[None]}


def _first(a: np.ndarray, axis: int) -> np.ndarray:
    """True at the voxels that have no predecessor along an axis."""
    return np.isnan(before(np.where(np.isnan(a), np.nan, 0.0), axis, np.nan))


def run(state: DataFrame, graph: LabelGraph, knobs: Knobs = Knobs(), side: int = 32) -> DataFrame:
    """The state after knobs.iterations; each round of per_round iterations is one shuffle and one written table."""
    left = knobs.iterations
    while left > 0:
        n = min(left, knobs.per_round)

        def kernel(a: Arrays, n=n) -> Arrays:
            for _ in range(n):
                a = iterate(a, graph, knobs)
            return a

        names = ["d", "s", *FIELDS, "source"]
        state = written(tiled(state, kernel, names, dict.fromkeys(names, "array<double>"), REACH * n, max(side, REACH * n)))
        left -= n
    return state


def leaf_labels(state: DataFrame, graph: LabelGraph) -> DataFrame:
    """(voxel struct x, y, z; slot, value): the leaves' labels, as maps for a vote."""
    nodes = graph.order[1:]
    at = F.array(*(F.struct(F.lit(i).alias("slot"), F.col("label")[nodes.index(k)].alias("value")) for i, k in enumerate(graph.leaves)))
    return state.select(F.struct("x", "y", "z").alias("voxel"), F.inline(at))


def data_energy(state: DataFrame, graph: LabelGraph) -> DataFrame:
    """One row (energy): sum over voxels and leaves of label times data term."""
    nodes = graph.order[1:]
    return state.agg(F.sum(sum((F.col("label")[nodes.index(k)] * F.col("d")[i] for i, k in enumerate(graph.leaves)), F.lit(0.0))).alias("energy"))


def smoothness_energy(state: DataFrame, graph: LabelGraph, side: int = 32) -> DataFrame:
    """(node, energy): sum over voxels of the node's smoothness bound times half the size of its label's gradient.

    An inner node's label is the sum of its children's by shares.
    """
    nodes, leaves = graph.order[1:], graph.leaves

    def kernel(a: Arrays) -> Arrays:
        u = {k: a["label"][nodes.index(k)] for k in leaves}
        for k in reversed(nodes):
            if k not in u:
                u[k] = sum(w * u[c] for c in nodes for p, w in graph.parents(c) if p == k)
        return {"e": np.stack([a["s"][i] * 0.5 * np.sqrt(sum((after(u[k], j) - before(u[k], j)) ** 2 for j in range(3))) for i, k in enumerate(nodes)])}

    rows = tiled(state, kernel, ["label", "s"], {"e": "array<double>"}, 1, side)
    return rows.select(F.posexplode("e").alias("at", "e")).groupBy("at").agg(F.sum("e").alias("energy")).select(F.element_at(F.array(*map(F.lit, nodes)), F.col("at") + 1).alias("node"), "energy")


def connectedness(image: DataFrame, t: int = 0, s: int = 0, inner: int = 16, side: int = 32) -> DataFrame:
    """(x, y, z, v): how strongly each voxel is connected to the seeds of an image (x, y, z, seed, ax, ay, az).

    A voxel takes from each of its six neighbours the fuzzy and (T_NORMS[t]) of the edge's affinity and the neighbour's
    strength, joins these by the fuzzy or (S_NORMS[s]), and keeps the greater of that and what it had, until nothing
    changes. ax, ay, az are the affinities to the next voxel along the axis.
    """

    def step(a: Arrays) -> np.ndarray:
        v, joined = a["v"], np.zeros_like(a["v"])
        for k, name in enumerate(("ax", "ay", "az")):
            edge = np.nan_to_num(a[name])
            for got in (T_NORMS[t](edge, after(v, k, 0.0)), T_NORMS[t](before(edge, k, 0.0), before(v, k, 0.0))):
                joined = S_NORMS[s](joined, got)
        return np.fmax(v, joined)

    rows = image.select("x", "y", "z", F.col("seed").cast("double").alias("v"), "ax", "ay", "az")
    return fixpoint(rows, step, "v", ["ax", "ay", "az"], inner=inner, side=side).select("x", "y", "z", "v")
