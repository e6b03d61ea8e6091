"""Whole applications: label graph segmentation from files and from seeds, map classification, and offline reconstruction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import combine, flow, hierarchy, maps
from ..operators.hierarchy import LabelGraph
from ..sources import volumes


def segmented(image: DataFrame, graph: LabelGraph, data: dict[str, Column], smooth: dict[str, Column], knobs: flow.Knobs = flow.Knobs()) -> DataFrame:
    """(x, y, z, class, value): the winning leaf of each voxel, by its place in graph.leaves, after max-flow."""
    state = flow.run(flow.start(image, graph, data, smooth), graph, knobs)
    return combine.vote(flow.leaf_labels(state, graph)).select("voxel.*", F.col("slot").cast("long").alias("class"), "value")


def segmented_files(spark: SparkSession, edges: DataFrame, nodes: DataFrame, knobs: flow.Knobs = flow.Knobs()) -> DataFrame:
    """As segmented(), of volumes: nodes (node, DataTerm, SmoothnessTerm, Alpha) name the files of leaves' data terms and nodes' bounds.

    The volumes are joined by voxel. A node without a smoothness volume has Alpha everywhere.
    """
    graph = hierarchy.read_graph(edges)
    rows, image = {r["node"]: r for r in nodes.collect()}, None
    data, smooth = {}, {}
    for n in graph.order[1:]:
        r = rows.get(n)
        for kind, to, name in (("DataTerm", data, f"d_{n}"), ("SmoothnessTerm", smooth, f"s_{n}")):
            if r is not None and r[kind] and (kind != "DataTerm" or n in graph.leaves):
                part = volumes.read_volumes(spark, r[kind]).select("x", "y", "z", F.col("c")[0].alias(name))
                image = part if image is None else image.join(part, ["x", "y", "z"])
                to[n] = F.col(name) * (F.lit(float(r["Alpha"])) if kind == "SmoothnessTerm" else F.lit(1.0))
        if r is not None and n not in smooth and r["Alpha"] is not None:
            smooth[n] = F.lit(float(r["Alpha"]))
    if missing := set(graph.leaves) - set(data):
        raise ValueError(f"leaves without a data term: {sorted(missing)}")
    return segmented(image, graph, data, smooth, knobs)


def segmented_from_seeds(image: DataFrame, seeds: DataFrame, labels: int, bins: int, alpha: float, knobs: flow.Knobs = flow.Knobs(iterations=200)) -> DataFrame:
    """As segmented(), of an image (x, y, z, v) and points (px, py, pz, label): a label's cost is its seeds' log-likelihood.

    A voxel that holds seeds has no cost for their labels and a high one for others.
    """
    marks = combine.seeds(seeds, labels)
    rows = image.join(F.broadcast(marks) if marks.count() <= 100_000 else marks, ["x", "y", "z"], "left")
    some = F.greatest(*(F.coalesce(F.col(f"m{k}"), F.lit(0)) for k in range(labels))) if labels > 1 else F.coalesce(F.col("m0"), F.lit(0))
    for k in range(labels):
        rows = combine.log_likelihood(rows, F.col(f"m{k}") == 1, ["v"], bins, scaled=True).withColumnRenamed("term", f"d{k}")
    graph = LabelGraph(tuple(("root", f"l{k:03d}", 1.0) for k in range(labels)))
    data = {f"l{k:03d}": F.when(F.col(f"m{k}") == 1, 0.0).when(some == 1, 1e3).otherwise(F.col(f"d{k}")) for k in range(labels)}
    return segmented(rows, graph, data, {f"l{k:03d}": F.lit(alpha) for k in range(labels)}, knobs)


def trained_and_applied(image: DataFrame, key: str, cols: list[str], nx: int, ny: int, epochs: int, mask: Column | None = None) -> DataFrame:
    """(key, ux, uy): the units of a map that is trained on the masked rows, for all rows."""
    units = maps.train(image if mask is None else image.where(mask), key, cols, nx, ny, epochs, [(0, 0.8), (epochs, 0.2)], [(0, 0.5), (epochs, 0.1)])
    return maps.best_units(image, key, cols, units)
