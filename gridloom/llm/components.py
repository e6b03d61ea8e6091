"""Connected components of a graph of any size: forests of runs of edges first, then hooking roots to smaller ones and halving paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_out, written

RUN = 1 << 17  # edges of which a task makes a forest at once, 2 MB; a graph of no more needs no rounds
FOREST = pa.schema([("node", pa.int64()), ("root", pa.int64())])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node reachable) of each node of the edges (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[u], root[v]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up


def _forests(run_: int):
    """The forests of a task's edges, run by run."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in it:
            a, b = (np.asarray(batch.column(k)) for k in ("a", "b"))
            while len(a):
                held.append((a[: run_ - n], b[: run_ - n]))
                a, b, n = a[run_ - n :], b[run_ - n :], n + len(held[-1][0])
                if n == run_:
                    yield rows_out(FOREST, list(forest(*map(np.concatenate, zip(*held, strict=True)))))
                    held, n = [], 0
        if held:
            yield rows_out(FOREST, list(forest(*map(np.concatenate, zip(*held, strict=True)))))

    return run


def _flat(parents: DataFrame) -> DataFrame:
    """(node, root) where every parent is smaller than its node, with chains followed to their ends."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
        parents = written(parents.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        if not parents.where("moved").limit(1).count():
            return parents.select("node", "root")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b), root being the least node reachable; nodes are longs.

    Tasks replace each run of RUN edges by its forest, so a graph of one run is done then. In a greater one each round hooks every root
    to the least smaller root that an edge leads to, and replaces the edges by edges
    between the new roots until none is left: a few rounds for any graph in practice, at most one for each node on
    a path. The rounds' tables are written to the shared folder; only numbers of rows reach the driver.
    """
    edges = edges.where("a <> b").select("a", "b")
    runs = -(-edges.count() // RUN)
    trees = written(edges.coalesce(max(runs, 1)).mapInArrow(_forests(RUN), "node long, root long"))
    if runs <= 1:
        return trees
    edges = written(trees.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")).distinct())
    roots = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("root"))
    while edges.limit(1).count():
        hooks = _flat(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
        roots = written(roots.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")))
        for side in ("a", "b"):
            edges = edges.join(hooks.select(F.col("node").alias(side), F.col("root").alias("above")), side, "left").withColumn(side, F.coalesce("above", side)).drop("above")
        edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return roots
