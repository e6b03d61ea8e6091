"""Statistics, information measures, differences, label maps and data terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms
from ..functions.arithmetic import bending_energy as bending
from ..functions.arithmetic import log_sum_exp
from ..operators import combine, similarity, statistics
from ..sources import fixtures as fx
from .rounding import rounded, rounded_sql

BINS = 32
SHIFT = (0.5, 0.25, 0.0)


def multi_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.multi_statistics(fx.samples(spark, sf_dir), ["c0", "c1"]))


def multi_stats_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.multi_statistics(fx.samples(spark, sf_dir), ["c0", "c1"], F.col("m")))


def _stats_sql(where: str) -> str:
    pairs = ((0, 0), (0, 1), (1, 1))
    cols = ", ".join(f"avg(c{i} * c{j}) s{i}{j}, covar_pop(c{i}, c{j}) v{i}{j}" for i, j in pairs)
    rows = " union all ".join(f"select {i}::bigint i, {j}::bigint j, n, m{i} mean_i, m{j} mean_j, s{i}{j} square, v{i}{j} covariance from a" for i, j in pairs)
    return rounded_sql(f"with {fx.SAMPLES}, a as (select count(*) n, avg(c0) m0, avg(c1) m1, {cols} from g2 {where}), t as ({rows})", "mean_i mean_j square covariance", "i j n")


def hist1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.dense_histogram(fx.samples(spark, sf_dir), ["c1"], 50)


def hist2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.dense_histogram(fx.samples(spark, sf_dir), ["c0", "c1"], 20)


def _bin(c: str, bins: int, of: str = "r") -> str:
    return f"least(floor({bins}::double * ({c} - {of}.lo_{c}) / ({of}.hi_{c} - {of}.lo_{c})), {bins - 1})::bigint"


def _range(table: str, *cols: str, name: str = "r") -> str:
    return f"{name} as (select {', '.join(f'min({c})::double lo_{c}, max({c})::double hi_{c}' for c in cols)} from {table})"


HIST1D = f"with {fx.SAMPLES}, {_range('g2', 'c1')}, h as (select {_bin('c1', 50)} b0, count(*) c from g2, r group by 1) select b.b0, coalesce(c, 0) c from (select range::bigint b0 from range(50)) b left join h using (b0)"
HIST2D = f"with {fx.SAMPLES}, {_range('g2', 'c0', 'c1')}, h as (select {_bin('c0', 20)} b0, {_bin('c1', 20)} b1, count(*) c from g2, r group by 1, 2) select b0, b1, coalesce(c, 0) c from (select x.range::bigint b0, y.range::bigint b1 from range(20) x, range(20) y) left join h using (b0, b1)"


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.samples(spark, sf_dir).withColumn("c2", F.col("m").cast("double"))


def entropy_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.entropy(_channels(spark, sf_dir), ["c1"], 100))


def entropy_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.entropy(_channels(spark, sf_dir), ["c0", "c1"], 100))


def entropy_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.entropy(_channels(spark, sf_dir), ["c0", "c1", "c2"], 100))


def _entropy_sql(*cols: str) -> str:
    return rounded_sql(f"with {fx.SAMPLES}, g as (select c0, c1, m::int::double c2 from g2), {_range('g', *cols)}, h as (select {', '.join(f'{_bin(c, 100)} b{i}' for i, c in enumerate(cols))}, count(*)::double c from g, r group by all), t as (select (ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(2.0::double) entropy from h)", "entropy")


def _information(spark: SparkSession, sf_dir: str, *cols: str, masked: bool = False) -> DataFrame:
    g = fx.samples(spark, sf_dir)
    pair = (g.where("m") if masked else g).select(F.col("c0").alias("a"), F.col("c1").alias("b"))
    return rounded(similarity.information(similarity.joint_histogram(pair, BINS, rounded=masked)).select(*cols))


def mi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _information(spark, sf_dir, "hs", "ht", "hst", "mi")


def nmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _information(spark, sf_dir, "nmi")


def ecr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _information(spark, sf_dir, "ecr")


def ecr_smi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _information(spark, sf_dir, "ecr_smi")


def renyi_mi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _information(spark, sf_dir, "rmi")


def tsallis_mi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _information(spark, sf_dir, "tmi")


def smi_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _information(spark, sf_dir, "mi", "nmi", "ecr_smi", masked=True)


def _information_sql(cols: str, masked: bool = False) -> str:
    where = "where m" if masked else ""
    s, t = (f"greatest(0, least(floor({c} / (r.hi_{c} / {BINS - 1}) + 0.5::double), {BINS - 1}))::bigint" if masked else _bin(c, BINS) for c in ("c0", "c1"))
    sums = lambda k, by: f"select '{k}' k, sum(n) n, sum(n * ln(n)) l, sum(n * n) q from (select sum(c)::double n from j group by {by})"
    return rounded_sql(f"""with {fx.SAMPLES}, gm as (select * from g2 {where}), {_range("gm", "c0", "c1")}, j as (select {s} s, {t} t, count(*) c from gm, r group by 1, 2),
e as (select k, ln(n) - l / n h, 2 * ln(n) - ln(q) y, 1 - q / (n * n) z from ({sums("s", "s")} union all {sums("t", "t")} union all {sums("st", "s, t")})),
u as (select max(h) filter (k = 's') hs, max(h) filter (k = 't') ht, max(h) filter (k = 'st') hst, max(y) filter (k = 's') + max(y) filter (k = 't') - max(y) filter (k = 'st') rmi,
  max(z) filter (k = 's') + max(z) filter (k = 't') - max(z) filter (k = 's') * max(z) filter (k = 't') - max(z) filter (k = 'st') tmi from e),
t as (select *, hs + ht - hst mi, (hs + ht) / hst / 2 nmi, sqrt(hst / (hs + ht)) ecr, sqrt(2 * (1 - hst / (hs + ht))) ecr_smi from u)""", cols)


def sad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(similarity.differences(fx.grid_pair(spark, sf_dir)).select("sad"))


def ssd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(similarity.differences(fx.grid_pair(spark, sf_dir)).select("ssd"))


def ncc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(similarity.differences(fx.grid_pair(spark, sf_dir)).select("ncc"))


def _difference_sql(cols: str) -> str:
    return rounded_sql(f"with {fx.GRID_PAIR}, t as (select sum(abs(a - b)) sad, sum((a - b) * (a - b)) ssd, sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) ncc from gp)", cols)


def _images(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pair = fx.grid_pair(spark, sf_dir)
    return pair.select("x", "y", "z", F.col("a").alias("v")), pair.select("x", "y", "z", F.col("b").alias("v"))


def shifted_sad_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(similarity.shifted_differences(*_images(spark, sf_dir), (2.0, -1.0, 1.0)))


def shifted_sad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(similarity.shifted_differences(*_images(spark, sf_dir), SHIFT))


def _corners(shift: tuple[float, float, float]) -> str:
    return f"corner as (select * from (values {', '.join(f'({x}, {y}, {z}, {w}::double)' for x, y, z, w in similarity.corner_weights(shift))}) v(dx, dy, dz, w))"


def _shifted_sql(shift: tuple[float, float, float]) -> str:
    return rounded_sql(f"""with {fx.GRID_PAIR}, {_corners(shift)}, s as (select f.x, f.y, f.z, any_value(f.b) b, sum(m.a * w) a from gp f cross join corner join gp m on m.x = f.x + dx and m.y = f.y + dy and m.z = f.z + dz group by 1, 2, 3 having count(*) = (select count(*) from corner)),
t as (select count(*) n, sum(abs(a - b)) sad, sum((a - b) * (a - b)) ssd, sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) ncc from s)""", "sad ssd ncc", "n")


def pvi_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(similarity.partial_volume_joint(*_images(spark, sf_dir), SHIFT, 8))


PVI = rounded_sql(f"""with {fx.GRID_PAIR}, {_corners(SHIFT)}, {_range("gp", "a", "b")}, p as (select f.x, f.y, f.z, any_value({_bin("b", 8).replace("(b ", "(f.b ")}) t, list({{'s': {_bin("a", 8).replace("(a ", "(m.a ")}, 'w': w}}) parts from gp f cross join corner join gp m on m.x = f.x + dx and m.y = f.y + dy and m.z = f.z + dz cross join r group by 1, 2, 3 having count(*) = (select count(*) from corner)),
q as (select t, unnest(parts) u from p), t as (select u.s s, t, sum(u.w) w from q group by 1, 2)""", "w", "s t")


def dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(combine.dice(fx.table(spark, sf_dir, "labels").select(F.col("quality").alias("a"), F.col("toxic").alias("b")), 1))


def atlas_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(combine.atlas_probability(fx.label_maps(spark, sf_dir), 1))


def atlas_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(combine.atlas_probability(fx.label_maps(spark, sf_dir), 1, entropy=True, most=3.0))


def loglik_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(combine.log_likelihood(fx.samples(spark, sf_dir), F.col("m"), ["c1"], 64).select("c0", "c1", "term"))


def loglik_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(combine.log_likelihood(fx.samples(spark, sf_dir), F.col("m"), ["c0", "c1"], 16, scaled=True).select("c0", "c1", "term"))


def _loglik_sql(cols: list[str], bins: int, scale: str) -> str:
    keys = ", ".join(f"{_bin(c, bins)} b{i}" for i, c in enumerate(cols))
    by = ", ".join(f"b{i}" for i in range(len(cols)))
    return rounded_sql(f"with {fx.SAMPLES}, {_range('g2', *cols)}, b as (select g2.*, {keys} from g2, r), h as (select {by}, count(*) h from b where m group by all), t as (select c0, c1, -ln(coalesce(h, 0) / (select sum(h) from h)::double + 1e-10) / {scale} term from b left join h using ({by}))", "c0 c1 term")


def loglik_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(combine.rounded_log_likelihood(fx.samples(spark, sf_dir), F.col("m"), "c1", 200).select("c0", "c1", "term"))


LOGLIK_ROUNDED = rounded_sql(f"""with {fx.SAMPLES}, r as (select min(c1) - (max(c1) - min(c1)) * 0.0125::double lo, max(c1) + (max(c1) - min(c1)) * 0.0125::double hi from g2), b as (select g2.*, floor(199 * ((c1 - lo) / (hi - lo)) + 0.5::double)::bigint k from g2, r), h as (select k, count(*) h from b where m group by 1),
t as (select c0, c1, greatest(0.0::double, least(1.0::double, coalesce(ln(h / (select sum(h) from h)::double) / ln(1e-10), 1.0))) term from b left join h using (k))""", "c0 c1 term")


def span_stencil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums inside and outside of the spans x from z + 1 to 3 y + z."""
    image = fx.grid(spark, sf_dir)
    spans = fx.lattice(spark, 1, fx.NY, fx.NZ).select("y", "z", (F.col("z") + 1).alias("x0"), (3 * F.col("y") + F.col("z")).alias("x1"))
    part = lambda reverse: combine.within_spans(image, spans, reverse).groupBy("z").agg(F.sum("n").alias("n")).select(F.lit(reverse).alias("outside"), "z", "n")
    return part(False).union(part(True))


SPANS = f"with {fx.GRID} select not (x between z + 1 and 3 * y + z) outside, z, sum(n)::bigint n from g3 group by 1, 2"


def smi_pvi(spark: SparkSession, sf_dir: str) -> DataFrame:
    joint = similarity.partial_volume_joint(*_images(spark, sf_dir), SHIFT, 8)
    return rounded(similarity.information(joint.withColumnRenamed("w", "c")).select("mi", "nmi"), 5)


SMI_PVI = rounded_sql("with joint as (%s), e as (select 's' k, s b, sum(w) c from joint group by 2 union all select 't', t, sum(w) from joint group by 2 union all select 'st', s * 100 + t, w from joint), h as (select k, ln(sum(c)) - sum(c * ln(c)) / sum(c) h from e where c > 0 group by 1), p as (select max(h) filter (k = 's') hs, max(h) filter (k = 't') ht, max(h) filter (k = 'st') hst from h), t as (select hs + ht - hst mi, (hs + ht) / hst / 2 nmi from p)" % PVI.replace("round(w, 6)", "w"), "mi nmi", digits=5)


def branch_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label tree's branches over the embeddings' components as leaf labels."""
    edges = spark.createDataFrame([("root", "low", 1.0), ("root", "high", 1.0), *((("low", "high")[i > 4], f"l{i}", 1.0) for i in range(10))], "src string, dst string, weight double")
    e = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("voxel"), F.posexplode(F.slice("embedding", 1, 10)).alias("i", "value"))
    return rounded(combine.branch_labels(e.select("voxel", F.concat(F.lit("l"), "i").alias("node"), F.col("value").cast("double")), edges))


BRANCHES = rounded_sql("with e as (select vec_id voxel, unnest(range(10)) i, unnest(embedding[1:10])::double value from embeddings), t as (select voxel, node, sum(value) as value from (select voxel, value, unnest(['l' || i, case when i > 4 then 'high' else 'low' end, 'root']) node from e) group by 1, 2)", "value", "voxel node")


def argmax_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("voxel"), F.posexplode(F.slice("embedding", 1, 10)).alias("slot", "value"))
    return rounded(combine.vote(e.withColumn("value", F.col("value").cast("double")).withColumn("slot", F.col("slot").cast("long"))))


VOTE = rounded_sql("with e as (select vec_id voxel, unnest(range(10)) slot, unnest(embedding[1:10])::double value from embeddings), t as (select voxel, slot, value from (select *, row_number() over (partition by voxel order by value desc, slot) k from e) where k = 1)", "value", "voxel slot")


def _planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = F.array(*(F.struct(F.lit(i).alias("slot"), c.alias("value")) for i, c in enumerate((F.col("a"), F.col("b"), (F.col("a") + F.col("b")) / 4))))
    return fx.grid_pair(spark, sf_dir).select("x", "y", "z", F.inline(maps))


def entropy_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(combine.entropy_planes(_planes(spark, sf_dir)))


def entropy_plane_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(combine.best_planes(_planes(spark, sf_dir)))


_PLANES = f"""with {fx.GRID_PAIR}, m as (select x, y, z, unnest([a, b, (a + b) / 4]) v from gp), s as (select x, y, z, case when sum(v) > 0 then ln(sum(v)) - sum(case when v > 0 then v * ln(v) else 0 end) / sum(v) else ln(count(*)) end e from m group by all),
p as (select 'x' axis, x slice, sum(e) entropy from s group by x union all select 'y', y, sum(e) from s group by y union all select 'z', z, sum(e) from s group by z)"""
PLANES = rounded_sql(f"{_PLANES}, t as (select * from p)", "entropy", "axis slice")
PLANE_BEST = rounded_sql(f"{_PLANES}, t as (select axis, slice, entropy from (select *, row_number() over (partition by axis order by round(entropy, 9) desc, slice) k from p) where k = 1)", "entropy", "axis slice")


def _term(spark: SparkSession, sf_dir: str, **columns) -> DataFrame:
    return rounded(fx.samples(spark, sf_dir).select("c0", "c1", *(c.alias(k) for k, c in columns.items())))


def dt_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _term(spark, sf_dir, p=terms.constant(0.4), cost=terms.constant(0.4, True))


def dt_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (terms.logistic(F.col("c0"), 0.3, 25), terms.logistic(F.col("c1"), 0.1, 38)), (terms.logistic(F.col("c0"), 0.3, 25, True), terms.logistic(F.col("c1"), 0.1, 38, True))
    return _term(spark, sf_dir, p=terms.combined(*a), cost=terms.combined(*b, entropy=True))


def dt_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _term(spark, sf_dir, p=terms.gaussian(F.col("c1"), 12, 38), cost=terms.gaussian(F.col("c1"), 12, 38, True))


def dt_spike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _term(spark, sf_dir, p=terms.spike(F.col("c0"), 7, 0.9, 0.1), cost=terms.spike(F.col("c0"), 7, 0.9, 0.1, True))


def dt_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(terms.normalized(fx.samples(spark, sf_dir), "c1", lambda v: terms.gaussian(v, 12, 38)).select("c0", "c1", "term"))


def _term_sql(p: str, cost: str) -> str:
    return rounded_sql(f"with {fx.SAMPLES}, t as (select c0, c1, {p} p, {cost} cost from g2)", "c0 c1 p cost")


def logsumexp(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fx.table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 1000).alias("v"))
    most = g.groupBy("l_returnflag").agg(F.max("v").alias("most"))
    return rounded(g.join(F.broadcast(most), "l_returnflag").groupBy("l_returnflag").agg(log_sum_exp(F.col("v"), F.col("most")).alias("lse")))


LOGSUMEXP = rounded_sql("with g as (select l_returnflag, l_extendedprice / 1000 v from lineitem), t as (select l_returnflag, any_value(m) + ln(sum(exp(v - m))) lse from g join (select l_returnflag, max(v) m from g group by 1) using (l_returnflag) group by 1)", "lse", "l_returnflag")


def histogram_equalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.stretch(fx.samples(spark, sf_dir), "c1", 2, 3).select("c0", "c1", "stretched"))


EQUALIZE = rounded_sql(f"with {fx.SAMPLES}, s as (select list(c1 order by c1) l, count(*) n from g2), q as (select l[floor(n * 2 / 100.0)::bigint + 1] lo, l[floor(n * 97 / 100.0)::bigint + 1] hi from s), t as (select c0, c1, greatest(0.0::double, least(255.0::double, 255.0::double * (c1 - lo) / (hi - lo))) stretched from g2, q)", "c0 c1 stretched")


def bending_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bending({"xx": F.col("c0"), "yy": F.col("c1"), "xy": F.col("c0") - F.col("c1")}, (0.5, 2.0, 1.0))
    return _term(spark, sf_dir, energy=e)


BENDING = rounded_sql(f"with {fx.SAMPLES}, t as (select c0, c1, pow(c0 / 0.25::double, 2) + pow(c1 / 4, 2) + 2 * pow(c0 - c1, 2) energy from g2)", "c0 c1 energy")


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("voxel"), F.posexplode(F.slice("embedding", 1, 6)).alias("image", "v"))
    return e.select("voxel", F.col("image").cast("long"), F.col("v").cast("double"))


def pca_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.gram(_components(spark, sf_dir)))


GRAM = rounded_sql("with e as (select vec_id voxel, unnest(range(6)) image, unnest(embedding[1:6])::double v from embeddings), c as (select voxel, image, v - avg(v) over (partition by voxel) v from e), t as (select x.image a, y.image b, sum(x.v * y.v) dot from c x join c y on x.voxel = y.voxel and x.image <= y.image group by 1, 2)", "dot", "a b")


def pca_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.reconstructed(_components(spark, sf_dir), 2), 4)


def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.image_modes(_components(spark, sf_dir), 3), 4)


_LOGS = [f"(greatest({e}, 0) + ln(1 + exp(-abs({e}))))" for e in ("-0.3::double * (c0 - 25)", "-0.1::double * (c1 - 38)")]
_GAUSS = "((c1 - 38) / 12 * ((c1 - 38) / 12) / 2)"
QUERIES = {f.__name__: f for f in (multi_stats, multi_stats_masked, hist1d, hist2d, entropy_single, entropy_joint, entropy_total, mi, nmi, ecr, ecr_smi, renyi_mi, tsallis_mi, smi_masked, sad, ssd, ncc, shifted_sad_whole, shifted_sad, pvi_joint, dice, atlas_prob, atlas_entropy, loglik_1d, loglik_2d, loglik_rounded, span_stencil, smi_pvi, branch_sums, argmax_vote, entropy_planes, entropy_plane_best, dt_constant, dt_logistic, dt_gaussian, dt_spike, dt_normalized, logsumexp, histogram_equalize, bending_energy, pca_gram, pca_project, pca_reconstruct)}
ORACLES = {
    "multi_stats": _stats_sql(""),
    "multi_stats_masked": _stats_sql("where m"),
    "hist1d": HIST1D,
    "hist2d": HIST2D,
    "entropy_single": _entropy_sql("c1"),
    "entropy_joint": _entropy_sql("c0", "c1"),
    "entropy_total": _entropy_sql("c0", "c1", "c2"),
    "mi": _information_sql("hs ht hst mi"),
    "nmi": _information_sql("nmi"),
    "ecr": _information_sql("ecr"),
    "ecr_smi": _information_sql("ecr_smi"),
    "renyi_mi": _information_sql("rmi"),
    "tsallis_mi": _information_sql("tmi"),
    "smi_masked": _information_sql("mi nmi ecr_smi", True),
    "sad": _difference_sql("sad"),
    "ssd": _difference_sql("ssd"),
    "ncc": _difference_sql("ncc"),
    "shifted_sad_whole": _shifted_sql((2.0, -1.0, 1.0)),
    "shifted_sad": _shifted_sql(SHIFT),
    "pvi_joint": PVI,
    "dice": rounded_sql("with t as (select 2.0::double * count(*) filter (quality = 1 and toxic = 1) / (count(*) filter (quality = 1) + count(*) filter (toxic = 1)) dice from labels)", "dice"),
    "atlas_prob": rounded_sql(f"with {fx.LABEL_MAPS}, t as (select voxel, count(*) filter (label = 1) / count(*)::double p from lm group by 1)", "p", "voxel"),
    "atlas_entropy": rounded_sql(f"with {fx.LABEL_MAPS}, k as (select voxel, count(*) filter (label = 1)::double k, count(*)::double n from lm group by 1), t as (select voxel, case when k > 0 then least(3.0::double, ln(n) - ln(k)) else 3.0::double end p from k)", "p", "voxel"),
    "loglik_1d": _loglik_sql(["c1"], 64, "1.0::double"),
    "loglik_2d": _loglik_sql(["c0", "c1"], 16, "(-ln(1e-10))"),
    "loglik_rounded": LOGLIK_ROUNDED,
    "span_stencil": SPANS,
    "smi_pvi": SMI_PVI,
    "branch_sums": BRANCHES,
    "argmax_vote": VOTE,
    "entropy_planes": PLANES,
    "entropy_plane_best": PLANE_BEST,
    "dt_constant": _term_sql("0.4::double", "-ln(0.4::double)"),
    "dt_logistic": _term_sql(f"exp(-({_LOGS[0]} + {_LOGS[1]}))", f"{_LOGS[0]} + {_LOGS[1]}"),
    "dt_gaussian": _term_sql(f"exp(-{_GAUSS})", _GAUSS),
    "dt_spike": _term_sql("case when c0 = 7 then 0.9::double else 0.1::double end", "case when c0 = 7 then -ln(0.9::double) else -ln(0.1::double) end"),
    "dt_normalized": rounded_sql(f"with {fx.SAMPLES}, g as (select c0, c1, exp(-{_GAUSS}) e from g2), t as (select c0, c1, (e - min(e) over ()) / (max(e) over () - min(e) over ()) term from g)", "c0 c1 term"),
    "logsumexp": LOGSUMEXP,
    "histogram_equalize": EQUALIZE,
    "bending_energy": BENDING,
    "pca_gram": GRAM,
}
