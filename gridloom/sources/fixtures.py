"""Grids, samples, label maps, points, meshes, hierarchies and frames, derived from the retail and text tables.

Each has the SQL of the same rows beside it, as a list of common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NX, NY, NZ = 50, 7, 3  # quantities, line numbers and return flags


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels and a mask: quantity, price in thousands, and whether the line was returned."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("c0"), (F.col("l_extendedprice") / 1000).alias("c1"), (F.col("l_returnflag") == "R").alias("m"))


SAMPLES = "g2 as (select l_quantity::double c0, l_extendedprice / 1000 c1, l_returnflag = 'R' m from lineitem)"

_CELL = {"x": "cast(l_quantity as bigint) - 1", "y": "cast(l_linenumber as bigint) - 1", "z": "cast(case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as bigint)"}


def lattice(spark: SparkSession, nx: int = NX, ny: int = NY, nz: int = NZ) -> DataFrame:
    """Every (x, y, z) of a box."""
    n = spark.range(nx * ny * nz)
    i = F.col("id")
    return n.select((i % nx).alias("x"), F.floor(i / nx % ny).alias("y"), F.floor(i / (nx * ny)).alias("z"))


def filled(cells: DataFrame, **missing) -> DataFrame:
    """The cells (x, y, z, ...) with rows for those of the box that are not there."""
    out = lattice(cells.sparkSession).join(cells, ["x", "y", "z"], "left")
    return out.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in missing.items()})


def _mean_price(of: str) -> str:
    """Mean price in thousands of the lines for which `of` holds, from a sum of whole cents."""
    return f"cast(sum(case when {of} then cast(round(l_extendedprice * 100) as bigint) end) as double) / (nullif(count(case when {of} then 1 end), 0) * 1e5)"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, z, n, v): a dense image of the number of lines and their mean price in thousands."""
    cells = table(spark, sf_dir, "lineitem").groupBy(*(F.expr(e).alias(k) for k, e in _CELL.items())).agg(F.count("*").alias("n"), F.expr(_mean_price("true")).cast("double").alias("v"))
    return filled(cells, n=0, v=0.0)


_BOX = f"box as (select x, y, z from range({NX}) a(x), range({NY}) b(y), range({NZ}) c(z))"
_KEYS = ", ".join(f"{e} {k}" for k, e in _CELL.items())
GRID = f"{_BOX}, cell3 as (select {_KEYS}, count(*) n, {_mean_price('true')} v from lineitem group by all), g3 as (select x, y, z, coalesce(n, 0) n, coalesce(v, 0.0) v from box left join cell3 using (x, y, z))"


def grid_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, z, a, b): two aligned images, the mean price of finished and of other lines, 0 where there is none."""
    cells = table(spark, sf_dir, "lineitem").groupBy(*(F.expr(e).alias(k) for k, e in _CELL.items())).agg(*(F.expr(_mean_price(c)).alias(k) for k, c in _STATUS.items()))
    return filled(cells, a=0.0, b=0.0)


_STATUS = {"a": "l_linestatus = 'F'", "b": "l_linestatus <> 'F'"}
_PAIR = ", ".join(f"{_mean_price(c)} {k}" for k, c in _STATUS.items())
GRID_PAIR = f"{_BOX}, cell4 as (select {_KEYS}, {_PAIR} from lineitem group by all), gp as (select x, y, z, coalesce(a, 0.0) a, coalesce(b, 0.0) b from box left join cell4 using (x, y, z))"


def label_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(voxel, slot, label): the maps quality (0), toxic (1) and French (2) of the labelled documents."""
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    maps = F.array(*(F.struct(F.lit(i).cast("long").alias("slot"), c.cast("long").alias("label")) for i, c in enumerate((F.col("quality"), F.col("toxic"), F.col("lang") == "fr"))))
    return both.select(F.col("doc_id").alias("voxel"), F.explode(maps).alias("s")).select("voxel", "s.slot", "s.label").where("label is not null")


LABEL_MAPS = "lm as (select doc_id voxel, slot, label from (select doc_id, unnest([{'slot': 0::bigint, 'label': quality::bigint}, {'slot': 1::bigint, 'label': toxic::bigint}, {'slot': 2::bigint, 'label': (lang = 'fr')::int::bigint}], recursive := true) from labels join documents using (doc_id)) where label is not null)"


def vectors(spark: SparkSession, sf_dir: str, n: int, *also: str) -> DataFrame:
    """(pid, f0, ..., fn-1): the first components of the embeddings as doubles, and the columns `also` as longs."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("pid"), *(F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(n)), *(F.col(c).cast("long") for c in also))


def vectors_sql(n: int) -> str:
    return f"vec as (select vec_id pid, {', '.join(f'embedding[{i + 1}]::double f{i}' for i in range(n))} from embeddings)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, x, y, z): the embeddings' first three components."""
    return vectors(spark, sf_dir, 3).withColumnsRenamed({"f0": "x", "f1": "y", "f2": "z"})


POINTS = f"{vectors_sql(3)}, pt as (select pid, f0 x, f1 y, f2 z from vec)"


def strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cid, p0, p1, p2): a strip of triangles over each three points that follow each other in blocks of 100 ids."""
    e = table(spark, sf_dir, "embeddings").where("vec_id % 100 < 98")
    i = F.col("vec_id")
    return e.select(i.alias("cid"), i.alias("p0"), (i + 1).alias("p1"), (i + 2).alias("p2"))


STRIP = "tri as (select vec_id cid, vec_id p0, vec_id + 1 p1, vec_id + 2 p2 from embeddings where vec_id % 100 < 98)"


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight): a root, regions, nations and customers as a weighted tree."""
    r, n, c = (table(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    one = F.lit(1.0).alias("weight")
    top = r.select(F.lit("root").alias("src"), F.concat(F.lit("r"), "r_regionkey").alias("dst"), one)
    mid = n.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"), one)
    return top.union(mid).union(c.select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"), one))


HIERARCHY = "edge as (select 'root' src, 'r' || r_regionkey dst, 1.0::double weight from region union all select 'r' || n_regionkey, 'n' || n_nationkey, 1.0 from nation union all select 'n' || c_nationkey, 'c' || c_custkey, 1.0 from customer)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, ts, frame_id, v): each user's events as the frames of a stream."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), "ts", F.col("event_id").alias("frame_id"), F.col("value").cast("double").alias("v"))


FRAMES = "fr as (select user_id stream, ts, event_id frame_id, value::double v from events)"
