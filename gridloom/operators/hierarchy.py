"""Label hierarchies: rooted trees and directed acyclic graphs with weighted edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written


@dataclass(frozen=True)
class LabelGraph:
    """A small rooted acyclic graph of labels on the driver: its leaves are the classes of a segmentation.

    edges: (parent, child, weight). There is one root, every node is reachable from it, and there is no cycle.
    """

    edges: tuple[tuple[str, str, float], ...]

    def __post_init__(self) -> None:
        children = {c for _, c, _ in self.edges}
        roots = {p for p, _, _ in self.edges} - children
        if len(roots) != 1:
            raise ValueError(f"{len(roots)} roots")
        if len(self.order) != len(children) + 1:
            raise ValueError("a cycle, or nodes that the root doesn't reach")

    @property
    def root(self) -> str:
        return next(iter({p for p, _, _ in self.edges} - {c for _, c, _ in self.edges}))

    @property
    def order(self) -> list[str]:
        """Nodes, each after all its parents."""
        out, left = [], {p for p, _, _ in self.edges} | {c for _, c, _ in self.edges}
        while ready := sorted(n for n in left if not any(c == n and p in left for p, c, _ in self.edges)):
            out += ready
            left -= set(ready)
        return out

    @property
    def leaves(self) -> list[str]:
        inner = {p for p, _, _ in self.edges}
        return [n for n in self.order if n not in inner]

    def parents(self, node: str) -> list[tuple[str, float]]:
        """A node's parents with their shares of its weights, which sum to 1."""
        got = [(p, w) for p, c, w in self.edges if c == node]
        total = sum(w for _, w in got)
        return [(p, w / total) for p, w in got]

    def up_levels(self) -> dict[str, int]:
        """Length of the longest way from the root."""
        out: dict[str, int] = {}
        for n in self.order:
            out[n] = max((out[p] + 1 for p, _ in self.parents(n)), default=0)
        return out

    def down_levels(self) -> dict[str, int]:
        """Length of the shortest way from the root."""
        out: dict[str, int] = {}
        for n in self.order:
            out[n] = min((out[p] + 1 for p, _ in self.parents(n)), default=0)
        return out


def read_graph(edges: DataFrame, most: int = 10_000) -> LabelGraph:
    """A label graph from rows (src, dst, weight); a missing weight is 1. At most `most` edges."""
    rows = edges.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} edges")
    return LabelGraph(tuple((str(r["src"]), str(r["dst"]), 1.0 if r["weight"] is None else float(r["weight"])) for r in rows))


def levels(edges: DataFrame) -> DataFrame:
    """(node, up, down) of every node of a rooted acyclic graph of any size: longest and shortest way from its roots.

    One join a level; a graph with more levels than it has nodes has a cycle, which is an error.
    """
    edges = written(edges.select("src", "dst").distinct())
    front = written(edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"))
    n, level = edges.count() + 1, 0
    found = front.select("node", F.lit(0).alias("level"))
    while front.limit(1).count():
        level += 1
        if level > n:
            raise ValueError("the graph has a cycle")
        front = written(front.join(edges, front.node == edges.src).select(F.col("dst").alias("node")).distinct())
        found = found.union(front.select("node", F.lit(level).alias("level")))
    return found.groupBy("node").agg(F.max("level").cast("long").alias("up"), F.min("level").cast("long").alias("down"))


def roll_up(edges: DataFrame, leaves: DataFrame) -> DataFrame:
    """(node, total): each node's sum of (node, value) over itself and all below, times the weights of the edges on each way.

    One join and one aggregate a level, from the leaves to the root, so a parent gets one row from each task and child level.
    """
    edges = written(edges.select("src", "dst", "weight"))
    moving = written(leaves.groupBy("node").agg(F.sum("value").alias("total")))
    out = moving
    while moving.limit(1).count():
        moving = written(moving.join(edges, moving.node == edges.dst).groupBy(F.col("src").alias("node")).agg(F.sum(F.col("total") * F.coalesce("weight", F.lit(1.0))).alias("total")))
        out = out.union(moving)
    return out.groupBy("node").agg(F.sum("total").alias("total"))
