"""Rows in an order, without a task that has a whole group: numbers within groups, and folds that depend on the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

BLOCK_BITS = 12  # rows of a group that are folded in one array: 4,096


def ranged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows sorted by ranges of the keys over all tasks and written; `_id` ascends in that order, with the task's number in its high bits."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()))


def numbered(rows: DataFrame, group: str, order: list[str], name: str = "at") -> DataFrame:
    """The rows with their number within their group, from 1, by the order; a null group is a group.

    A group may lie in many tasks: what comes before a task's part of it is a sum over one row a task and group.
    """
    placed = ranged(rows, [group, *order]).withColumn("_part", F.shiftright("_id", 33))
    parts = placed.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_p")).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_group").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("_before", F.coalesce(before, F.lit(0)))
    both = placed.join(parts, placed[group].eqNullSafe(parts["_group"]) & (F.col("_part") == F.col("_p")))
    return both.select(*rows.columns, (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias(name))


def chunked(rows: DataFrame, at: str, size: int, halo: int) -> DataFrame:
    """The rows with `chunk`, their number over `size`; the last `halo` rows of a chunk come once more, in the next."""
    if halo > size:
        raise ValueError("chunks are shorter than what they share")
    c, k = F.floor((F.col(at) - 1) / size), (F.col(at) - 1) % size
    return rows.withColumn("chunk", F.explode(F.when(k >= size - halo, F.array(c, c + 1)).otherwise(F.array(c))))


def own(at: str, size: int) -> Column:
    """Whether a row of a chunk is no copy of one of the chunk before."""
    return F.floor((F.col(at) - 1) / size) == F.col("chunk")


def decayed(rows: DataFrame, group: str, order: list[str], v: str, keep: float) -> DataFrame:
    """(group, v): each group's values folded in order by old keep + new (1 - keep), from the first.

    A run of m values is the map old -> keep^m old + s, and such maps compose. Values are sorted by ranges and folded to maps in blocks of
    at most 2^BLOCK_BITS in the order's ids, then a group's maps are composed in order; so a group of any size is dealt over many tasks.
    """
    placed = ranged(rows.select(group, *order, v), [group, *order])
    block = placed.groupBy(group, F.shiftright("_id", BLOCK_BITS).alias("block")).agg(F.sort_array(F.collect_list(F.struct("_id", F.col(v).alias("v")))).alias("vs"))
    s = F.aggregate("vs", F.lit(0.0), lambda acc, x: acc * keep + x["v"] * (1 - keep))
    maps = block.select(group, F.struct("block", F.col("vs")[0]["v"].alias("first"), F.pow(F.lit(keep), F.size("vs")).alias("by"), s.alias("s")).alias("m"))
    every = maps.groupBy(group).agg(F.sort_array(F.collect_list("m")).alias("ms"))
    return every.select(group, F.aggregate("ms", F.col("ms")[0]["first"], lambda acc, m: acc * m["by"] + m["s"]).alias(v))
