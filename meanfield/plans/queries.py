"""The registered clustering queries and the SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meanfield.functions import draws
from meanfield.functions.vectors import sqdist, sqnorm, uniform, vectors
from meanfield.operators import assign, init, kmeans, pruned, samesize, stats
from meanfield.sources import matrix

K, LAMBDA, ROUNDS, RATE, SEED = 8, 0.5, 5, 0.5, 7


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _e(spark, d) -> DataFrame:
    return vectors(_table(spark, d, "embeddings"), "vec_id", "embedding")


def _first(spark, d, k: int = K) -> np.ndarray:
    return np.array([r["v"] for r in _e(spark, d).where(F.col("id") < k).orderBy("id").collect()])


def _c(spark, d) -> DataFrame:
    return _e(spark, d).where(F.col("id") < K).select(F.col("id").cast("int").alias("cid"), F.col("v").alias("c"))


def _r(col, digits: int = 6):
    return F.round(col, digits) + F.lit(0.0)


def _r_many(col: str):
    """The same values as ``_r`` for many rows: decimal arithmetic only where the seventh digit is near a tie or the number is large."""
    x = F.col(col) * 1e6
    plain = (F.abs(x) < 1e9) & (F.abs(x - F.floor(x) - 0.5) > 1e-4)
    return F.when(plain, F.rint(x) / 1e6 + F.lit(0.0)).otherwise(_r(col))


def _assigned(spark, d) -> DataFrame:
    return assign.classify(_e(spark, d), _first(spark, d))


def _flat(spark, c: np.ndarray) -> DataFrame:
    """(cid, j, x) of a centroid matrix."""
    rows = [(i, j, float(x)) for i, row in enumerate(c) for j, x in enumerate(row)]
    return spark.createDataFrame(rows, "cid long, j long, x double").withColumn("x", _r("x"))


def scan_vectors(spark, d):
    return _e(spark, d).select("id", F.size("v").cast("long").alias("dim"), _r(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)).alias("s"))


def total_sum(spark, d):
    return stats.total(_e(spark, d)).select(_r("total").alias("total"))


def column_stats(spark, d):
    s = stats.column_stats(_e(spark, d))
    return s.select(F.col("j").cast("long").alias("j"), *(_r(c).alias(c) for c in ("lo", "hi", "mean", "std")))


def cov_trace(spark, d):
    return stats.column_stats(_e(spark, d)).agg(F.sum("var").alias("t")).select(_r("t").alias("trace"))


def standardize(spark, d):
    e = _e(spark, d)
    return stats.standardized(e, stats.column_stats(e)).select("id", F.col("j").cast("long").alias("j"), _r("z").alias("z"))


def destandardize(spark, d):
    e = _e(spark, d)
    s = stats.column_stats(e)
    return stats.destandardized(stats.standardized(e, s), s).select("id", F.col("j").cast("long").alias("j"), _r("x").alias("x"))


def row_block_partition(spark, d):
    e = assign.positions(_e(spark, d))
    n = e.count()
    blocks = spark.createDataFrame([(i + 1, s, c) for i, (s, c) in enumerate(matrix.row_blocks(n, 7))], "block long, start long, n long")
    x = e.join(F.broadcast(blocks), (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + F.col("n")))
    return x.groupBy("block").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))


def select_rows(spark, d):
    want = spark.createDataFrame(list(enumerate([5, 3, 3, 99, 0, 5])), "k long, pos long")
    return assign.positions(_e(spark, d)).join(F.broadcast(want), "pos").select("k", "id", _r(F.get("v", F.lit(0))).alias("x"))


def fetch_row(spark, d):
    return assign.positions(_e(spark, d)).where("pos = 42").select("id", F.posexplode("v").alias("j", "x")).select("id", F.col("j").cast("long").alias("j"), _r("x").alias("x"))


def pairwise_sqdist(spark, d):
    return assign.pairwise(_e(spark, d)).select("a", "b", _r_many("d2").alias("d2"))


def row_norms(spark, d):
    return _e(spark, d).select("id", _r(sqnorm("v")).alias("n2"))


def centroid_pairwise(spark, d):
    c = _first(spark, d)
    m = ((c[:, None] - c[None]) ** 2).sum(-1)
    return spark.createDataFrame([(i, j, float(np.sqrt(m[i, j]) / 2)) for i in range(K) for j in range(i)], "a long, b long, half double").withColumn("half", _r("half"))


def smallest_centroid_dist(spark, d):
    c = _c(spark, d)
    o = c.select(F.col("cid").alias("o"), F.col("c").alias("w"))
    return c.join(F.broadcast(o), F.col("cid") != F.col("o")).groupBy(F.col("cid").cast("long").alias("cid")).agg(F.min(sqdist("c", "w")).alias("m")).select("cid", _r(F.sqrt("m")).alias("s"))


def classify(spark, d):
    return _assigned(spark, d).select("id", F.col("cid").cast("long").alias("cid"))


def classify_dist(spark, d):
    return assign.classify_relational(_e(spark, d), _c(spark, d)).select("id", F.col("cid").cast("long").alias("cid"), _r("d2").alias("d2"))


def second_nearest(spark, d):
    return assign.nearest(_e(spark, d), _first(spark, d), 2).where("rank = 2").select("id", F.col("cid").cast("long").alias("cid"), _r("d2").alias("d2"))


def top_b_nearest(spark, d):
    return assign.nearest(_e(spark, d), _first(spark, d), 4).select("id", F.col("rank").cast("long").alias("rank"), F.col("cid").cast("long").alias("cid"), _r("d2").alias("d2"))


def annulus_candidates(spark, d):
    o = _table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.array(F.col("c_acctbal").cast("double") / 1000, F.col("c_nationkey").cast("double")).alias("v"))
    c = o.where(F.col("id") < K).select(F.col("id").cast("int").alias("cid"), F.col("v").alias("c"))
    return assign.annulus_candidates(o.withColumn("r", F.lit(2.5)), c).groupBy("id").agg(F.count("*").alias("n"), F.min("cid").cast("long").alias("lo"), F.sum("cid").alias("s"))


def mse(spark, d):
    return _assigned(spark, d).agg(F.avg("d2").alias("m")).select(_r("m").alias("mse"))


def _labels(spark, d):
    return _table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("int").alias("cls"))


def mse_given_labels(spark, d):
    x = _e(spark, d).join(_labels(spark, d), "id").join(F.broadcast(_c(spark, d)), F.col("cls") % K == F.col("cid"))
    return x.agg(F.avg(sqdist("v", "c")).alias("m")).select(_r("m").alias("mse"))


def cluster_sse(spark, d):
    return assign.cluster_sse(_assigned(spark, d), K).select(F.col("cid").cast("long").alias("cid"), "n", _r("sse").alias("sse"))


def cluster_sizes(spark, d):
    return assign.cluster_sse(_assigned(spark, d), K).select(F.col("cid").cast("long").alias("cid"), "n")


def size_balance_stats(spark, d):
    return assign.balance(_assigned(spark, d), K).select(*(_r(c).alias(c) for c in ("mean", "std", "cv")))


def compute_centers(spark, d):
    return assign.centers(_e(spark, d), _labels(spark, d)).select(F.col("cls").cast("long").alias("cls"), F.col("j").cast("long").alias("j"), _r("x").alias("x"))


def class_lists(spark, d):
    return _labels(spark, d).groupBy(F.col("cls").cast("long").alias("cls")).agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))


def class_members(spark, d):
    return assign.members(_labels(spark, d)).select(F.col("cls").cast("long").alias("cls"), F.col("at").cast("long").alias("at"), "id")


def quantize(spark, d):
    q = assign.quantize(_assigned(spark, d), _c(spark, d))
    return q.select("id", F.col("cid").cast("long").alias("cid"), _r(F.get("c", F.lit(0))).alias("x0"), _r(F.get("c", F.lit(63))).alias("x63"))


def write_classes(spark, d):
    return _assigned(spark, d).select("id", (F.col("cid") + 1).cast("long").alias("cls"))


def find_objects(spark, d):
    return _assigned(spark, d).where("cid = 3").select("id")


def filter_class(spark, d):
    return _e(spark, d).join(_labels(spark, d).where("cls = 4"), "id").select("id", _r(F.get("v", F.lit(0))).alias("x0"))


def dump_clusters(spark, d):
    s = assign.cluster_sse(_assigned(spark, d), K).join(_c(spark, d), "cid")
    return s.select(F.col("cid").cast("long").alias("cid"), "n", _r(F.get("c", F.lit(0)), 2).alias("x0"))


def sort_centroids(spark, d):
    rows = [r["cid"] for r in _c(spark, d).orderBy(F.col("c").desc()).collect()]
    return spark.createDataFrame(list(enumerate(rows)), "place long, cid long")


def _perm(spark):
    return spark.createDataFrame([(i, (3 * i + 1) % K) for i in range(K)], "src int, dst int")


def permute_centroids(spark, d):
    return assign.permute(_c(spark, d), _perm(spark)).select(F.col("cid").cast("long").alias("cid"), _r(F.get("c", F.lit(0))).alias("x0"))


def inverse_permutation(spark, d):
    p = _perm(spark)
    return assign.inverse(p).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), (F.col("src") == F.col("dst")).alias("fixed"), F.lit(assign.is_identity(p)).alias("identity"))


def _prepared(spark, d):
    return assign.positions(_e(spark, d))


def init_forgy(spark, d):
    return _flat(spark, init.forgy(_prepared(spark, d), K, SEED))


def init_random(spark, d):
    return _flat(spark, init.random_partition(_prepared(spark, d), K, SEED))


def init_mindist(spark, d):
    return _flat(spark, init.min_dist(_prepared(spark, d), K, 5, SEED))


def init_plusplus(spark, d):
    return _flat(spark, init.plus_plus(_prepared(spark, d), K, SEED))


def init_oror(spark, d):
    c = init.scalable(_prepared(spark, d), K, 1.0, seed=SEED)
    return _flat(spark, c)


def _fit(spark, d, **options) -> kmeans.Model:
    return kmeans.fit(_table(spark, d, "embeddings"), K, id_col="vec_id", features=("embedding",), init=_first(spark, d), **options)


def _history(spark, m: kmeans.Model, *extra: str) -> DataFrame:
    rows = [(h["it"], i, h["counts"][i], float(h["fit"]), *(float(h[x]) for x in extra)) for h in m.history for i in range(len(h["counts"]))]
    out = spark.createDataFrame(rows, ", ".join(["it long, cid long, n long, fit double", *(f"{x} double" for x in extra)]))
    return out.select("it", "cid", "n", *(_r(c).alias(c) for c in ("fit", *extra)))


def lloyd_fit_history(spark, d):
    return _history(spark, _fit(spark, d, max_iter=ROUNDS))


def lloyd_centroids(spark, d):
    return _flat(spark, _fit(spark, d, max_iter=ROUNDS).centroids)


def lloyd_part(spark, d):
    p = _table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size").cast("double") / 50).alias("a"), (F.col("p_retailprice").cast("double") / 1000).alias("b"))
    c = np.array([(r["a"], r["b"]) for r in p.where("id < 5").orderBy("id").collect()])
    return _history(spark, kmeans.fit(p, 5, id_col="id", features=("a", "b"), init=c, max_iter=3))


def balanced_kmeans(spark, d):
    return _history(spark, _fit(spark, d, max_iter=6, balance_lambda=LAMBDA), "pure")


def sampled_kmeans(spark, d):
    """A fresh sample in each iteration."""
    return _history(spark, _fit(spark, d, max_iter=ROUNDS, min_iter=ROUNDS, sample_rate=RATE, seed=SEED))


def lloyd_no_mse(spark, d):
    """Until no assignment changes."""
    return _flat(spark, _fit(spark, d, track_mse=False).centroids)


def lloyd_repair(spark, d):
    """One cluster is empty at first and becomes the first row."""
    c = _first(spark, d)
    c[-1] = 9.0
    m = kmeans.fit(_table(spark, d, "embeddings"), K, id_col="vec_id", features=("embedding",), init=c, max_iter=3, min_iter=3, repair="cyclic")
    return _flat(spark, m.centroids)


def _accelerated(name, **options):
    def query(spark, d):
        return _history(spark, _fit(spark, d, algorithm=name, max_iter=ROUNDS, **options))

    query.__name__ = name
    return query


def yinyang_groups(spark, d):
    return spark.createDataFrame([(i, int(g)) for i, g in enumerate(pruned.group_centroids(_first(spark, d), 3))], "cid long, grp long")


def move_deltas(spark, d):
    c0 = _first(spark, d)
    c1 = _fit(spark, d, max_iter=1).centroids
    e = _e(spark, d)
    x = assign.moved(e, assign.classify(e, c0), assign.classify(e, c1))
    return x.select(F.col("cid").cast("long").alias("cid"), F.col("j").cast("long").alias("j"), F.col("n").cast("long").alias("delta"), _r("x").alias("x"))


def best_of_restarts(spark, d):
    m = kmeans.fit(_table(spark, d, "embeddings"), K, id_col="vec_id", features=("embedding",), init="forgy", seed=SEED, repetitions=3, max_iter=2)
    return spark.createDataFrame([(float(m.fit),)], "fit double").select(_r("fit").alias("fit"))


def drift(spark, d):
    c0 = _first(spark, d)
    c1 = _fit(spark, d, max_iter=1).centroids
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(((c0 - c1) ** 2).sum(1))], "cid long, d2 double").withColumn("d2", _r("d2"))


def samesize_assignment(spark, d):
    return samesize.same_size(_e(spark, d), _first(spark, d)).select("id", F.col("cid").cast("long").alias("cid"), _r("d2").alias("d2"), _r("before").alias("before"))


def samesize_iterative(spark, d):
    return samesize.balanced(_e(spark, d), _fit(spark, d, max_iter=3).centroids, rounds=100)


def samesize_from_assignment(spark, d):
    """Swaps from a dealt assignment of equal sizes."""
    e = assign.positions(_e(spark, d)).withColumn("cid", F.col("pos") % K)
    return samesize.balanced(e, _first(spark, d), rounds=100, given="cid")


def random_draws(spark, d):
    o = _table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("id"))
    return o.select("id", draws.integer(9, SEED, "int", "id").alias("i"), _r(draws.open_uniform(SEED, "open", "id")).alias("u"), _r(draws.normal(SEED, "n", "id")).alias("z"), _r(draws.cauchy(SEED, "c", "id"), 2).alias("c"))


def stochastic_relaxation(spark, d):
    m = kmeans.relaxed(_prepared(spark, d), _first(spark, d), seed=SEED, max_iter=ROUNDS)
    return _history(spark, m)


def distance_ratios(spark, d):
    out = []
    n = _e(spark, d).count()
    for name in pruned.KERNELS:
        m = _fit(spark, d, algorithm=name, max_iter=ROUNDS, groups=3, n_bounds=4)
        out += [(name, h["it"], 100.0 * h["dist_count"] / n / K) for h in m.history]
    return spark.createDataFrame(out, "algorithm string, it long, ratio double")


QUERIES = {f.__name__: f for f in (
    scan_vectors, total_sum, column_stats, cov_trace, standardize, destandardize, row_block_partition, select_rows, fetch_row, pairwise_sqdist, row_norms, centroid_pairwise, smallest_centroid_dist,
    classify, classify_dist, second_nearest, top_b_nearest, annulus_candidates, mse, mse_given_labels, cluster_sse, cluster_sizes, size_balance_stats, compute_centers, class_lists, quantize, write_classes,
    find_objects, filter_class, dump_clusters, sort_centroids, permute_centroids, inverse_permutation, init_forgy, init_random, init_mindist, init_plusplus, init_oror, lloyd_fit_history, lloyd_centroids,
    lloyd_part, balanced_kmeans, sampled_kmeans, lloyd_no_mse, _accelerated("elkan"), _accelerated("hamerly"), _accelerated("annulus"), _accelerated("drake", n_bounds=4), _accelerated("yinyang", groups=3),
    yinyang_groups, move_deltas, drift, best_of_restarts, samesize_assignment, samesize_iterative, samesize_from_assignment, random_draws, stochastic_relaxation, distance_ratios, class_members, lloyd_repair,
)}

E_ = "e as (select cast(vec_id as bigint) id, list_transform(embedding, lambda x: cast(x as double)) v, label from embeddings)"
X_ = "x as (select id, label, unnest(v) x, cast(unnest(range(0, len(v))) as bigint) j from e)"
S_ = "s as (select j, min(x) lo, max(x) hi, avg(x) mean, stddev_samp(x) std, var_samp(x) var from x group by j)"
C_ = f"c as (select id cid, v c from e where id < {K})"
D_ = "d as (select e.id, e.label, c.cid, list_distance(e.v, c.c) ** 2 d2 from e, c)"
A_ = "a as (select id, min(struct_pack(d2 := d2, cid := cid)) m from d group by id)"
P_ = "p as (select row_number() over (order by id) - 1 pos, * from e)"


def _u(*keys: str) -> str:
    return f"(cast('0x' || substr(md5({' || '.join(keys)}), 1, 13) as bigint) / 4503599627370496.0)"


def _q(*ctes: str, select: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{', '.join(ctes)} {select}"


def _z(col: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({col}, {digits}) + 0.0 {name or col}"


def _lloyd(rows: str, k: int, iterations: int, penalty: str = "", sample: str = "", name: str = "l", start: str = "", noise: str = "") -> list[str]:
    """CTEs name(it, cid, c, n, fit, pure): after ``it`` updates; n, fit and pure are of the pass that led there."""
    start = start or f"select id cid, v c from r where id < {k}"
    return [
        rows,
        f"""{name} as (select cast(0 as bigint) it, cast(cid as bigint) cid, c, cast(0 as bigint) n, cast(null as double) fit, cast(0 as double) pure from ({start})
        union all
        select it, cid, list(x{noise} order by j), n, fit, pure from (
          select it, cid, j, avg(x) x, any_value(n) n, any_value(fit) fit, any_value(pure) pure from (
            select it, m.cid cid, unnest(v) x, unnest(range(0, len(v))) j, n, fit, pure from (
              select *, count(*) over (partition by m.cid) n, avg(m.p) over () fit, avg(m.d) over () pure from (
                select l.it + 1 it, r.id, any_value(r.v) v, min(struct_pack(p := list_distance(r.v, l.c) ** 2{penalty}, cid := l.cid, d := list_distance(r.v, l.c) ** 2)) m
                from r, {name} l where l.it < {iterations} {sample} group by l.it, r.id)))
          group by it, cid, j) group by it, cid, n, fit, pure)""",
    ]


def _forgy(seed: int) -> str:
    return f"select i cid, v c from range({K}) t(i) join (select row_number() over (order by id) - 1 pos, * from e) on pos = cast(floor({_u(repr(f'{seed}:forgy:'), 'i')} * (select count(*) from e)) as bigint)"


_R = "r as (select id, v, count(*) over () total from e)"
_HISTORY = _q(E_, *_lloyd(_R, K, ROUNDS), select=f"select it, cid, n, {_z('fit')} from l where it > 0", recursive=True)
_FLAT = f"select cid, cast(unnest(range(0, len(c))) as bigint) j, {_z('unnest(c)', 'x')}"
_PERM = f"select cast(i as bigint) src, cast((3 * i + 1) % {K} as bigint) dst from range({K}) t(i)"

ORACLE_SQL = {
    "scan_vectors": _q(E_, select=f"select id, cast(len(v) as bigint) dim, {_z('list_sum(v)', 's')} from e"),
    "total_sum": _q(E_, select=f"select {_z('sum(list_sum(v))', 'total')} from e"),
    "column_stats": _q(E_, X_, S_, select=f"select j, {_z('lo')}, {_z('hi')}, {_z('mean')}, {_z('std')} from s"),
    "cov_trace": _q(E_, X_, S_, select=f"select {_z('sum(var)', 'trace')} from s"),
    "standardize": _q(E_, X_, S_, select=f"select id, j, {_z('(x - mean) / std', 'z')} from x join s using (j)"),
    "destandardize": _q(E_, X_, S_, select=f"select id, j, {_z('(x - mean) / std * std + mean', 'x')} from x join s using (j)"),
    "row_block_partition": _q(E_, "b as (select id, ntile(7) over (order by id) block from e)", select="select block, count(*) n, min(id) lo, max(id) hi from b group by block"),
    "select_rows": _q(E_, P_, "w as (select cast(k as bigint) k, pos from (values (0, 5), (1, 3), (2, 3), (3, 99), (4, 0), (5, 5)) t(k, pos))", select=f"select k, id, {_z('v[1]', 'x')} from w join p using (pos)"),
    "fetch_row": _q(E_, P_, select=f"select id, cast(unnest(range(0, len(v))) as bigint) j, {_z('unnest(v)', 'x')} from p where pos = 42"),
    "pairwise_sqdist": _q(E_, select=f"select a.id a, b.id b, {_z('list_distance(a.v, b.v) ** 2', 'd2')} from e a join e b on a.id < b.id"),
    "row_norms": _q(E_, select=f"select id, {_z('list_inner_product(v, v)', 'n2')} from e"),
    "centroid_pairwise": _q(E_, C_, select=f"select a.cid a, b.cid b, {_z('list_distance(a.c, b.c) / 2', 'half')} from c a join c b on a.cid > b.cid"),
    "smallest_centroid_dist": _q(E_, C_, select=f"select a.cid cid, {_z('min(list_distance(a.c, b.c))', 's')} from c a join c b on a.cid <> b.cid group by a.cid"),
    "classify": _q(E_, C_, D_, A_, select="select id, m.cid cid from a"),
    "classify_dist": _q(E_, C_, D_, A_, select=f"select id, m.cid cid, {_z('m.d2', 'd2')} from a"),
    "second_nearest": _q(E_, C_, D_, "n as (select *, row_number() over (partition by id order by d2, cid) rank from d)", select=f"select id, cid, {_z('d2')} from n where rank = 2"),
    "top_b_nearest": _q(E_, C_, D_, "n as (select *, row_number() over (partition by id order by d2, cid) rank from d)", select=f"select id, rank, cid, {_z('d2')} from n where rank <= 4"),
    "annulus_candidates": f"""with o as (select cast(c_custkey as bigint) id, sqrt((cast(c_acctbal as double) / 1000) ** 2 + cast(c_nationkey as double) ** 2) n from customer)
        select o.id, count(*) n, min(c.id) lo, cast(sum(c.id) as bigint) s from o join o c on c.id < {K} and abs(o.n - c.n) <= 2.5 group by o.id""",
    "mse": _q(E_, C_, D_, A_, select=f"select {_z('avg(m.d2)', 'mse')} from a"),
    "mse_given_labels": _q(E_, C_, D_, select=f"select {_z('avg(d2)', 'mse')} from d where label % {K} = cid"),
    "cluster_sse": _q(E_, C_, D_, A_, select=f"select c.cid, count(a.id) n, {_z('coalesce(sum(m.d2), 0)', 'sse')} from c left join a on m.cid = c.cid group by c.cid"),
    "cluster_sizes": _q(E_, C_, D_, A_, select="select c.cid, count(a.id) n from c left join a on m.cid = c.cid group by c.cid"),
    "size_balance_stats": _q(E_, C_, D_, A_, "n as (select c.cid, count(a.id) n from c left join a on m.cid = c.cid group by c.cid)", select=f"select {_z('avg(n)', 'mean')}, {_z('stddev_pop(n)', 'std')}, {_z('stddev_pop(n) / avg(n)', 'cv')} from n"),
    "compute_centers": _q(E_, X_, select=f"select cast(label as bigint) cls, j, {_z('avg(x)', 'x')} from x group by label, j"),
    "class_lists": "select cast(label as bigint) cls, count(*) n, min(vec_id) lo, max(vec_id) hi from embeddings group by label",
    "quantize": _q(E_, C_, D_, A_, select=f"select a.id, c.cid, {_z('c.c[1]', 'x0')}, {_z('c.c[64]', 'x63')} from a join c on a.m.cid = c.cid"),
    "write_classes": _q(E_, C_, D_, A_, select="select id, m.cid + 1 cls from a"),
    "find_objects": _q(E_, C_, D_, A_, select="select id from a where m.cid = 3"),
    "filter_class": _q(E_, select=f"select id, {_z('v[1]', 'x0')} from e where label = 4"),
    "dump_clusters": _q(E_, C_, D_, A_, select=f"select c.cid, count(a.id) n, {_z('any_value(c.c[1])', 'x0', 2)} from c left join a on m.cid = c.cid group by c.cid"),
    "sort_centroids": _q(E_, C_, select="select row_number() over (order by c desc) - 1 place, cid from c"),
    "permute_centroids": _q(E_, C_, f"p as ({_PERM})", select=f"select dst cid, {_z('c[1]', 'x0')} from c join p on cid = src"),
    "inverse_permutation": _q(f"p as ({_PERM})", select="select dst src, src dst, src = dst fixed, (select bool_and(src = dst) from p) as identity from p"),
    "class_members": "select cast(label as bigint) cls, row_number() over (partition by label order by vec_id) - 1 as at, cast(vec_id as bigint) id from embeddings",
    "init_forgy": _q(E_, P_, f"c as (select cast(i as bigint) cid, v c from range({K}) t(i) join p on pos = cast(floor({_u(repr(f'{SEED}:forgy:'), 'i')} * (select count(*) from e)) as bigint))", select=f"{_FLAT} from c"),
    "init_random": _q(E_, "k as (select *, cast(floor(" + _u(repr(f"{SEED}:rp:"), "id") + f" * {K}) as bigint) cid from e)", "y as (select cid, unnest(v) x, cast(unnest(range(0, len(v))) as bigint) j from k)", select=f"select cid, j, {_z('avg(x)', 'x')} from y group by cid, j"),
    "init_mindist": _q(
        E_, X_, P_, "g as (select list(m order by j) m from (select j, avg(x) m from x group by j))",
        f"t as (select i, t, v from range({K}) a(i), range(5) b(t) join p on pos = cast(floor({_u(repr(f'{SEED}:md:'), 'i', repr(':'), 't')} * (select count(*) from e)) as bigint))",
        """z as (select cast(0 as bigint) i, [arg_min(v, struct_pack(d := list_distance(v, m), t := t))] cs from t, g where i = 0
        union all select z.i + 1, list_append(any_value(z.cs), arg_min(t.v, struct_pack(d := -list_min(list_transform(z.cs, lambda c: list_distance(c, t.v))), t := t.t)))
        from z join t on t.i = z.i + 1 group by z.i)""",
        f"c as (select cast(unnest(range(0, {K})) as bigint) cid, unnest(cs) c from z where i = {K - 1})", select=f"{_FLAT} from c", recursive=True),
    "init_plusplus": _q(
        E_, P_,
        f"""z as (select cast(0 as bigint) i, pos, v, cast('infinity' as double) d2, pos = cast(floor({_u(repr(f'{SEED}:pp:0'))} * (select count(*) from e)) as bigint) sel from p
        union all select i, pos, v, d2, pos = min(case when cum >= u * total then pos end) over () sel from (
          select *, sum(d2) over (order by pos) cum, sum(d2) over () total from (
            select z.i + 1 i, z.pos, z.v, least(z.d2, list_distance(z.v, s.v) ** 2) d2, {_u(repr(f'{SEED}:pp:'), '(z.i + 1)')} u from z, (select v from z where sel) s where z.i < {K - 1})))""",
        "c as (select i cid, v c from z where sel)", select=f"{_FLAT} from c", recursive=True),
    "lloyd_fit_history": _HISTORY,
    "lloyd_centroids": _q(E_, *_lloyd(_R, K, ROUNDS), select=f"{_FLAT} from l where it = {ROUNDS}", recursive=True),
    "lloyd_part": _q("r as (select cast(p_partkey as bigint) id, [cast(p_size as double) / 50, cast(p_retailprice as double) / 1000] v from part)", *_lloyd("q as (select 1)", 5, 3), select=f"select it, cid, n, {_z('fit')} from l where it > 0", recursive=True),
    "balanced_kmeans": _q(E_, *_lloyd(_R, K, 6, f" + {LAMBDA} * l.pure / r.total * {K} / 64 * l.n"), select=f"select it, cid, n, {_z('fit')}, {_z('pure')} from l where it > 0", recursive=True),
    "sampled_kmeans": _q(
        E_, f"""r as (select i it, id, v, count(*) over (partition by i) total, row_number() over (partition by i order by {_u(repr(f'{SEED}:s:'), 'i', repr(':'), 'id')}, id) rk from e, range(1, {ROUNDS + 1}) t(i))""",
        *_lloyd("q as (select 1)", K, ROUNDS, sample=f"and r.it = l.it + 1 and r.rk <= floor(r.total * {RATE})", start=f"select id cid, v c from e where id < {K}"), select=f"select it, cid, n, {_z('fit')} from l where it > 0", recursive=True),
    "lloyd_no_mse": _q(E_, *_lloyd(_R, K, 40), select=f"{_FLAT} from l where it = 40", recursive=True),
    "lloyd_repair": _q(
        E_, _R, f"s as (select id cid, v c from r where id < {K - 1} union all select {K - 1}, list_transform(v, lambda x: cast(9 as double)) from r where id = 0)",
        "a as (select r.id, any_value(r.v) v, min(struct_pack(d := list_distance(r.v, s.c), cid := s.cid)).cid cid from r, s group by r.id)",
        "f as (select cid, list(x order by j) c from (select cid, j, avg(x) x from (select cid, unnest(v) x, unnest(range(0, len(v))) j from a) group by cid, j) group by cid)",
        *_lloyd("q as (select 1)", K, 2, start="select cid, c from f union all select s.cid, (select v from r order by id limit 1) from s where s.cid not in (select cid from f)"), select=f"{_FLAT} from l where it = 2", recursive=True),
    "best_of_restarts": _q(
        E_, *(x for i in range(3) for x in _lloyd(_R if not i else f"q{i} as (select 1)", K, 2, name=f"l{i}", start=_forgy(SEED + i))),
        select=f"select {_z('min(fit)', 'fit')} from (select fit from l0 union all select fit from l1 union all select fit from l2)", recursive=True),
    "stochastic_relaxation": _q(
        E_, X_, S_, *_lloyd(_R, K, ROUNDS, noise=f" + ({_u(repr(f'{SEED}:sr:'), 'it', repr(':'), 'cid', repr(':'), 'j')} - 0.5) * (select list(std order by j) from s)[j + 1] * (1 - it / {ROUNDS}.0) ** 2"),
        select=f"select it, cid, n, {_z('fit')} from l where it > 0", recursive=True),
    **{name: _HISTORY for name in pruned.KERNELS},
    "yinyang_groups": _q(
        E_, *_lloyd(f"r as (select id, v, {K} total from e where id < {K})", 3, 5),
        select="select r.id cid, min(struct_pack(d := list_distance(r.v, l.c), g := l.cid)).g grp from r, l where l.it = 5 group by r.id", recursive=True),
    "random_draws": f"""select o_orderkey id, cast(floor({_u(repr(f'{SEED}:int:'), 'o_orderkey')} * 10) as bigint) i, {_z(_u(repr(f'{SEED}:open:'), 'o_orderkey'), 'u')},
        {_z(f"sqrt(-2 * ln({_u(repr(f'{SEED}:n:r:'), 'o_orderkey')} + 0.5 / 4503599627370496.0)) * cos(2 * pi() * {_u(repr(f'{SEED}:n:a:'), 'o_orderkey')})", 'z')},
        {_z(f"tan(pi() * ({_u(repr(f'{SEED}:c:'), 'o_orderkey')} + 0.5 / 4503599627370496.0 - 0.5))", 'c', 2)} from orders""",
    "samesize_assignment": _q(
        E_, C_, "o as (select e.id, list(list_distance(e.v, c.c) ** 2 order by c.cid) ds from e, c group by e.id)",
        "q as (select row_number() over (order by list_min(ds) desc, id) - 1 r, * from o)",
        # a row of the recursion is a row's choice among the clusters with room
        f"""z as (select cast(-1 as bigint) r, cast(null as bigint) id, cast(null as bigint) cid, cast(null as double) d2, (select list((n + {K - 1}) // {K}) from (select count(*) n from e), range({K})) room
        union all select r, id, cid, ds[cid + 1], list_transform(range(0, {K}), lambda j: room[j + 1] - case when j = cid then 1 else 0 end) from (
          select q.r, q.id, q.ds, z.room, cast(list_min(list_transform(range(0, {K}), lambda j: struct_pack(d := case when z.room[j + 1] > 0 then q.ds[j + 1] else 1e300 end, j := j))).j as bigint) cid from z join q on q.r = z.r + 1))""",
        select=f"select id, cid, {_z('d2')}, {_z('avg(d2) over ()', 'before')} from z where r >= 0", recursive=True),
    "move_deltas": _q(
        E_, *_lloyd(_R, K, 1), "a as (select l.it, r.id, any_value(r.v) v, min(struct_pack(d := list_distance(r.v, l.c), cid := l.cid)).cid cid from r, l group by l.it, r.id)",
        "b as (select o.v, o.cid old, n.cid new from a o join a n on o.id = n.id and o.it = 0 and n.it = 1 and o.cid <> n.cid)",
        "m as (select old cid, -1 s, v from b union all select new, 1, v from b)",
        select=f"select cid, j, cast(sum(s) as bigint) delta, {_z('sum(s * x)', 'x')} from (select cid, s, unnest(v) x, cast(unnest(range(0, len(v))) as bigint) j from m) group by cid, j", recursive=True),
    "init_oror": _q(
        E_, P_,
        # a round: rows whose draw falls under their share are candidates; the next lowers the distances to them
        f"""z as (select cast(-1 as bigint) r, pos, id, v, cast('infinity' as double) d2, pos = cast(floor({_u(repr(f'{SEED}:or:0'))} * (select count(*) from e)) as bigint) hit from p
        union all select r, pos, id, v, d2, {_u(repr(f'{SEED}:or:'), 'r', repr(':'), 'id')} < {K} * d2 / sum(d2) over () hit from (
          select a.r + 1 r, a.pos, a.id, a.v, least(a.d2, (select min(list_distance(a.v, b.v) ** 2) from z b where b.hit)) d2 from z a where a.r < 4))""",
        "c as (select row_number() over (order by r, pos) - 1 j, v from z where hit)",
        "w as (select j, count(*) w from (select p.id, min(struct_pack(d := list_distance(p.v, c.v), j := c.j)).j j from p, c group by p.id) group by j)",
        "k as (select c.j, c.v, coalesce(w.w, 0) w, count(*) over () m from c left join w using (j))",
        f"""y as (select cast(0 as bigint) i, j, v, w, cast('infinity' as double) d2, j = cast(floor({_u(repr(f'{SEED}:orpp:0'))} * m) as bigint) sel from k
        union all select i, j, v, w, d2, j = min(case when cum >= u * total then j end) over () sel from (
          select *, sum(w * d2) over (order by j) cum, sum(w * d2) over () total from (
            select y.i + 1 i, y.j, y.v, y.w, least(y.d2, list_distance(y.v, s.v) ** 2) d2, {_u(repr(f'{SEED}:orpp:'), '(y.i + 1)')} u from y, (select v from y where sel) s where y.i < {K - 1})))""",
        "f as (select i cid, v c from y where sel)", select=f"{_FLAT} from f", recursive=True),
    "drift": _q(E_, *_lloyd(_R, K, 1), select=f"select a.cid cid, {_z('list_distance(a.c, b.c) ** 2', 'd2')} from l a join l b on a.cid = b.cid and a.it = 0 and b.it = 1", recursive=True),
}
