from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from meanfield.functions.vectors import distances, sqdist, uniform, uniform_value
from meanfield.operators import assign, init, kmeans, pruned, samesize
from meanfield.plans import queries
from meanfield.sources import matrix

DIR = "/root/testdata/sf0.001"
QUICK = ["scan_vectors", "column_stats", "standardize", "row_block_partition", "select_rows", "classify", "top_b_nearest", "annulus_candidates", "cluster_sse", "compute_centers", "init_forgy", "init_mindist", "lloyd_fit_history", "balanced_kmeans", "sampled_kmeans", "move_deltas", "pairwise_sqdist", "random_draws", "classify_dist", "init_oror", "lloyd_repair", "best_of_restarts", "stochastic_relaxation", "yinyang_groups", "class_members"]


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")


def clouds(n=300, k=5, d=3, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, d)) + 4 * rng.normal(size=(k, d))[rng.integers(0, k, n)]


@pytest.mark.parametrize("name", QUICK)
def test_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("embeddings", "customer", "part", "orders"):
        db.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DIR)
    cols = sorted(got.columns)
    want = db.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_registry():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def naive(x, c, rounds):
    out = []
    for _ in range(rounds):
        d = ((x[:, None] - c[None]) ** 2).sum(-1)
        cid = d.argmin(1)
        out.append((d.min(1).mean(), np.bincount(cid, minlength=len(c)).tolist()))
        c = np.array([x[cid == j].mean(0) if (cid == j).any() else c[j] for j in range(len(c))])
    return out


@pytest.mark.parametrize("name", sorted(pruned.KERNELS))
@pytest.mark.parametrize("k", [1, 12])
def test_accelerated_equals_naive(spark, name, k):
    """Each iteration against plain steps; every bound is verified against all distances."""
    x = clouds()
    options = {"groups": 3} if name == "yinyang" else {"n_bounds": 4} if name == "drake" else {}
    m = kmeans.fit(frame(spark, x), k, id_col="id", features=("v",), algorithm=name, init=x[:k], max_iter=4, verify=True, **options)
    want = naive(x, x[:k], len(m.history))
    for h, (fit, counts) in zip(m.history, want, strict=True):
        assert h["fit"] == pytest.approx(fit, rel=1e-9)
        assert h["counts"] == counts
        assert h["dist_count"] <= len(x) * (k + 1)
    if k > 1:
        assert m.history[-1]["dist_count"] < len(x) * k


@pytest.mark.parametrize("name,options", [("yinyang", {"local_filter": False, "groups": 4}), ("yinyang", {"groups": [0, 0, 0, 1, 1, 1, 2, 2, 2, 2, 0, 1]}), ("yinyang", {"groups": 3, "group_by": "samesize"}), ("yinyang", {"groups": 3, "reorder": True}), ("drake", {"adaptive": True})])
def test_variants(spark, name, options):
    x = clouds(200)
    m = kmeans.fit(frame(spark, x), 12, id_col="id", features=("v",), algorithm=name, init=x[:12], max_iter=5, verify=True, **options)
    want = naive(x, x[:12], len(m.history))
    assert [h["fit"] for h in m.history] == pytest.approx([f for f, _ in want])
    assert [sorted(h["counts"]) for h in m.history] == [sorted(n) for _, n in want]
    if name == "drake":
        # a quarter of the centroids twice, then what was needed, and an eighth less one at least
        assert all(1 <= h["max_active"] <= 3 for h in m.history[1:])


def test_centroid_groups():
    c = clouds(12)
    for by in ("kmeans", "samesize"):
        g = pruned.group_centroids(c, 3, by=by)
        assert set(g) == {0, 1, 2} and (by == "kmeans" or np.bincount(g).tolist() == [4, 4, 4])
        new, group, perm = pruned.contiguous(c, g)
        assert (np.diff(group) >= 0).all() and np.array_equal(new[perm], c) and np.array_equal(group[perm], g)


def test_stop_rules(spark):
    x = clouds()
    df = frame(spark, x)
    run = lambda **o: len(kmeans.fit(df, 4, id_col="id", features=("v",), init=x[:4], **o).history)
    assert run(max_iter=1) == 1
    assert run(min_iter=3, max_iter=1) == 3
    assert run(min_rel=0.99) == 2
    # the fit rises or stays: only before min_iter that doesn't end it
    steps = iter([5.0, 4.0, 4.0, 6.0, 3.0, 3.0, 1.0])
    m = kmeans.run(lambda c, i: (c, {"fit": next(steps)}), x[:2], 0, 5, None)
    assert [h["fit"] for h in m.history] == [5.0, 4.0, 4.0, 6.0, 3.0, 3.0] and m.fit == 3.0
    m = kmeans.fit(df, 4, id_col="id", features=("v",), init=x[:4])
    fits = [h["fit"] for h in m.history]
    assert all(a > b for a, b in zip(fits[:-2], fits[1:-1], strict=True)) and m.fit == min(fits)


@pytest.mark.parametrize("bad", [{"k": 0}, {"sample_rate": 0.0}, {"min_rel": 0.1, "track_mse": False}, {"balance_lambda": 1.0, "sample_rate": 0.5}, {"algorithm": "none"}])
def test_options(spark, bad):
    with pytest.raises(ValueError):
        kmeans.fit(frame(spark, clouds(20)), bad.pop("k", 2), id_col="id", features=("v",), **bad)


@pytest.mark.parametrize("rows", [[[1.0, None]], [[1.0, float("nan")]], [[1.0, 2.0], [1.0]]])
def test_bad_vectors(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "id long, v array<double>")
    with pytest.raises(ValueError):
        kmeans.fit(df, 1, id_col="id", features=("v",))


def test_empty_clusters_and_ties(spark):
    df = frame(spark, [[1.0, 1.0]] * 6)
    m = kmeans.fit(df, 3, id_col="id", features=("v",), init=np.array([[1.0, 1], [1, 1], [9, 9]]), max_iter=2)
    assert m.history[0]["counts"] == [6, 0, 0]
    assert np.array_equal(m.centroids, np.ones((3, 2)))


def test_distances_are_exact_near_ties():
    x = np.array([[1e6 + 0.5, 0.0]])
    assert distances(x, np.array([[1e6, 0.0], [1e6 + 1, 0.0]])).argmin() == 0


def test_uniform(spark):
    got = [r[0] for r in spark.range(5).select(uniform(3, "t", "id")).collect()]
    assert got == [uniform_value(3, "t", i) for i in range(5)]


@pytest.mark.parametrize("make", [lambda d: init.plus_plus(d, 6, 1), lambda d: init.scalable(d, 6, 1.0, seed=1), lambda d: init.random_partition(d, 6, 1)])
def test_initializers(spark, make):
    x = clouds(60)
    c = make(assign.positions(frame(spark, x)))
    assert c.shape == (6, 3) and np.isfinite(c).all()


def test_plus_plus_by_definition(spark):
    """With weights, against a cumulative sum over all rows."""
    x, w = clouds(80), np.random.default_rng(2).integers(0, 5, 80).astype(float)
    df = assign.positions(frame(spark, x)).withColumn("w", F.element_at(F.array(*(F.lit(float(v)) for v in w)), (F.col("pos") + 1).cast("int")))
    chosen = [int(uniform_value(4, "pp", 0) * 80)]
    for i in range(1, 5):
        cum = np.cumsum(w * ((x[:, None] - x[None, chosen]) ** 2).sum(-1).min(1))
        chosen.append(int(np.searchsorted(cum, uniform_value(4, "pp", i) * cum[-1])))
    assert np.allclose(init.plus_plus(df, 5, 4), x[chosen])


def test_positions(spark):
    """Every place once, in order, also when no exchange is shared."""
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.range(300_000).select((F.col("id") * 7 % 300_007).alias("id"), F.array(F.lit(1.0)).alias("v"))
        out = assign.positions(df)
        assert out.columns == ["id", "v", "pos"]
        n, low, high, places = out.agg(F.count("*"), F.min("pos"), F.max("pos"), F.count_distinct("pos")).first()
        assert (n, low, high, places) == (300_000, 0, 299_999, 300_000)
        some = out.orderBy("id").limit(2000).select("pos").collect()
        assert [r["pos"] for r in some] == list(range(2000))
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_plus_plus_without_mass(spark):
    assert init.plus_plus(assign.positions(frame(spark, [[2.0]] * 4)), 3, 1).tolist() == [[2.0]] * 3


def greedily(d, room):
    """Same-size assignment by definition: again and again the row that is farthest from its best cluster with room moves in."""
    n, k = d.shape
    out, free, best = [-1] * n, [room] * k, d.argmin(1).tolist()
    left = set(range(n))
    while left:
        i = min(left, key=lambda i: (-d[i, best[i]], i))
        if free[best[i]]:
            out[i], free[best[i]] = best[i], free[best[i]] - 1
            left.discard(i)
        else:
            best[i] = min((j for j in range(k) if free[j]), key=lambda j: (d[i, j], j))
    return out


def swapped(d, cid):
    """One round of swaps by definition; who may begin one is settled ahead of it."""
    n = 0
    for i in [i for i in range(len(d)) if d[i].min() < d[i, cid[i]]]:
        for j in range(i + 1, len(d)):
            if d[i, cid[j]] + d[j, cid[i]] < d[i, cid[i]] + d[j, cid[j]]:
                cid[i], cid[j], n = cid[j], cid[i], n + 1
                break
    return n


def test_same_size(spark):
    x = clouds(50)
    d = ((x[:, None] - x[None, :4]) ** 2).sum(-1)
    want = greedily(d, 13)
    first = sorted((r["id"], r["cid"]) for r in samesize.same_size(frame(spark, x), x[:4]).collect())
    assert [c for _, c in first] == want
    c, cid = x[:4].copy(), list(want)
    for _ in range(50):
        if not swapped(((x[:, None] - c[None]) ** 2).sum(-1), cid):
            break
        c = np.array([x[np.array(cid) == j].mean(0) for j in range(4)])
    rows = sorted(tuple(r) for r in samesize.same_size(frame(spark, x), x[:4], rounds=50).collect())
    assert [r[1] for r in rows] == cid and rows[0][3] == pytest.approx(d[np.arange(50), want].mean())
    assert [r[2] for r in rows] == pytest.approx(((x - c[cid]) ** 2).sum(1).tolist())


@pytest.mark.parametrize("n,k,block", [(50, 4, 7), (41, 5, 64), (30, 1, 8)])
def test_same_size_by_rounds(spark, monkeypatch, n, k, block):
    """The rounds over a table too large for one task, against one task."""
    monkeypatch.setattr(samesize, "BLOCK", block)
    x = clouds(n)
    x[: n // 4] = x[0]
    one = sorted(map(tuple, samesize.same_size(frame(spark, x), x[-k:]).collect()))
    monkeypatch.setattr(samesize, "MAX_ROWS", 10)
    out = sorted(map(tuple, samesize.same_size(frame(spark, x), x[-k:]).collect()))
    assert [r[:3] for r in out] == [r[:3] for r in one] and out[0][3] == pytest.approx(one[0][3])
    with pytest.raises(ValueError):
        samesize.same_size(frame(spark, x), x[:k], rounds=1)


@pytest.mark.parametrize("name", ["samesize_iterative", "samesize_from_assignment"])
def test_same_size_queries_take_any_size(spark, monkeypatch, name):
    """above the rows of one task the queries go by tiles, with all rows."""
    monkeypatch.setattr(samesize, "MAX_ROWS", 10)
    monkeypatch.setattr(samesize, "by_swaps", lambda df, c, rounds, given=None: df.select("id", F.lit(rounds).alias("rounds")))
    out = queries.QUERIES[name](spark, DIR)
    assert out.where("rounds = 100").count() == 500


def test_same_size_from_assignment(spark):
    x = clouds(40)
    df = frame(spark, x).withColumn("at", F.col("id") % 4)
    rows = samesize.same_size(df, x[:4], rounds=50, given="at").collect()
    assert np.bincount([r["cid"] for r in rows]).tolist() == [10] * 4
    assert np.mean([r["d2"] for r in rows]) < rows[0]["before"]


def test_all_pairs(spark, monkeypatch):
    """vectors travel by blocks, not by pairs; null, ragged and repeated rows keep what a join of rows gave."""
    rows = [(i // 2 if i < 6 else i, [float(v) for v in x]) for i, x in enumerate(clouds(40))]
    rows += [(50, None), (51, [1.0, None, 2.0]), (52, [1.0, 2.0]), (53, [2.0, 4.0]), (54, []), (None, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    b = df.select(F.col("id").alias("b"), F.col("v").alias("w"))
    want = df.join(b, F.col("id") < F.col("b")).select(F.col("id").alias("a"), "b", sqdist("v", "w").alias("d2"))
    key = lambda r: (r[0], r[1], r[2] is not None, r[2] or 0.0)
    monkeypatch.setattr(assign, "PAIR_BLOCKS", 4)
    out = assign.pairwise(df)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert "CartesianProduct" not in (plan := out._jdf.queryExecution().toString()) and "NestedLoop" not in plan


def shuffled(spark):
    """Bytes written to shuffles so far."""
    found = spark._jsparkSession.sparkContext().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_all_pairs_disk(spark):
    """what is shuffled is the table times a number of blocks that doesn't grow with its rows as long as they are small."""
    x = np.random.default_rng(3).normal(size=(17_500, 64)).astype(np.float32)
    df = spark.range(len(x), numPartitions=4).mapInArrow(rows_of(x), "id long, v array<double>")
    before = shuffled(spark)
    a, b, d2 = assign.pairwise(df).head(1)[0]
    assert d2 == pytest.approx(((x[a].astype(float) - x[b]) ** 2).sum())
    assert shuffled(spark) - before < 6 * x.size * 8  # 18 times before, and the order of id


def rows_of(x):
    import pyarrow as pa

    return lambda batches: (pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x[b.column(0).to_numpy()].astype(float)), pa.list_(pa.float64()))], ["id", "v"]) for b in batches)


@pytest.mark.parametrize("n,values", [(1, 3), (7, 0), (50, 3), (400, 1)])
@pytest.mark.parametrize("partitions", [1, 9])
def test_all_pairs_small(spark, monkeypatch, n, values, partitions):
    """fewer rows than blocks, vectors without values or that aren't floats, ids below 0 and repeated, and several tiles in one task."""
    monkeypatch.setattr(assign, "PAIR_STEP", 70)
    monkeypatch.setattr(assign, "PAIR_BYTES", 128)
    monkeypatch.setattr(assign, "PAIR_TASKS", 5)
    rng = np.random.default_rng(n)
    x, ids = rng.normal(size=(n, values)) * 10.0 ** rng.integers(-3, 60, (n, 1)), rng.permutation(n) // 2 * 2 - 20
    rows = [(int(i), [float(v) for v in row]) for i, row in zip(ids, x, strict=True)]
    got = assign.pairwise(spark.createDataFrame(rows, "id long, v array<double>").repartition(partitions))
    want = [(i, j, reduce(lambda s, pq: s + (pq[0] - pq[1]) * (pq[0] - pq[1]), zip(v, w, strict=True), 0.0)) for i, v in rows for j, w in rows if i < j]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_rounding_of_many(spark):
    """the same bits as Spark's round, also at and next to ties."""
    rng = np.random.default_rng(2)
    ties = np.concatenate([rng.integers(0, 4 * 10**6, 20_000) / 1e6 + 5e-7, rng.integers(0, 10**9, 2000) / 1e6 + 5e-7])
    x = np.concatenate([ties, np.nextafter(ties, 9e9), np.nextafter(ties, 0), rng.uniform(0, 4, 50_000), rng.uniform(900, 1100, 2000), 10.0 ** rng.uniform(-12, 300, 2000), [0.0, -0.0, np.inf, np.nan]])
    df = spark.createDataFrame([(float(v),) for v in [*x, *-x]] + [(None,)], "x double")
    assert df.where(~queries._r_many("x").eqNullSafe(queries._r("x"))).count() == 0


@pytest.mark.parametrize("n,k,block,group", [(90, 4, 90, 128), (90, 5, 17, 4), (64, 3, 1, 1), (41, 1, 8, 2), (300, 7, 128, 16)])
def test_swaps_by_tiles(monkeypatch, n, k, block, group):
    """Groups and tiles of rows, with equal rows and ties, against plain loops."""
    monkeypatch.setattr(samesize, "GROUP", group)
    x = np.round(clouds(n), 1)
    x[: n // 4] = x[0]
    d = ((x[:, None] - x[None, -k:]) ** 2).sum(-1)
    want, cid = [i % k for i in range(n)], np.arange(n) % k
    count, todo, blocks = swapped(d, want), d.min(1) < d[np.arange(n), cid], -(-n // block)
    for t in range(2 * blocks - 1):
        for i in range(max(0, t - blocks + 1), t // 2 + 1):
            a, b = slice(i * block, (i + 1) * block), slice((t - i) * block, (t - i + 1) * block)
            count -= samesize.swap_rows(d[a], cid[a], todo[a], None if 2 * i == t else (d[b], cid[b]))
    assert cid.tolist() == want and not count


@pytest.mark.parametrize("given,tile,packed", [("at", 14, 9), (None, 64, 1000)])
def test_swaps_beyond_one_task(spark, monkeypatch, given, tile, packed):
    """a table too large for one task gets the same swaps, by tiles."""
    x = clouds(40)
    df = frame(spark, x).withColumn("at", F.col("id") % 4)
    one = sorted(map(tuple, samesize.balanced(df, x[:4], 50, given).collect()))
    monkeypatch.setattr(samesize, "MAX_ROWS", 10)
    monkeypatch.setattr(samesize, "TILE", tile)
    monkeypatch.setattr(samesize, "PACKED", packed)
    out = sorted(map(tuple, samesize.balanced(df, x[:4], 50, given).collect()))
    assert [r[:2] for r in out] == [r[:2] for r in one]
    assert [r[2:] for r in out] == [pytest.approx(r[2:]) for r in one]


@pytest.mark.parametrize("n,rate,bins", [(200, 0.5, 16), (200, 0.003, 16), (200, 1.0, 1), (7, 0.3, 65_536)])
def test_sample_takes_the_smallest_uniforms(spark, n, rate, bins):
    got = sorted(r["id"] for r in kmeans.sampled(frame(spark, np.zeros((n, 1))), n, rate, 3, 1, bins).collect())
    order = sorted(range(n), key=lambda i: (uniform_value(3, "s:1", i), i))
    assert got == sorted(order[: max(1, int(n * rate))])


def test_formats(spark, tmp_path):
    x = clouds(21).astype(np.float32)
    df = frame(spark, x).withColumnRenamed("id", "pos")
    matrix.save_dataset(df.repartition(5), str(tmp_path / "x.fbin"))
    back = matrix.read_dataset(spark, str(tmp_path / "x.fbin"), 4).orderBy("pos").collect()
    assert np.array_equal(np.array([r["v"] for r in back], np.float32), x)
    for double in (False, True):
        matrix.save_centroids(x[:3], str(tmp_path / "c"), double)
        assert np.array_equal(matrix.load_centroids(str(tmp_path / "c"), 3, 3), x[:3].astype(np.float64))
    with pytest.raises(ValueError):
        matrix.load_centroids(str(tmp_path / "c"), 4)
    classes = assign.classify(frame(spark, x), x[:3].astype(float)).withColumnRenamed("id", "pos")
    matrix.save_classes(classes.repartition(3), str(tmp_path / "cls"))
    assert sorted(map(tuple, matrix.load_classes(spark, str(tmp_path / "cls")).collect())) == sorted((r["pos"], r["cid"]) for r in classes.collect())
    matrix.save_dataset(df.limit(0), str(tmp_path / "none"))
    assert matrix.read_dataset(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        matrix.save_dataset(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "pos long, v array<double>"), str(tmp_path / "bad"))
    matrix.save_permutation([2, 0, 1], str(tmp_path / "p"))
    assert [tuple(r) for r in matrix.load_permutation(spark, str(tmp_path / "p")).collect()] == [(0, 2), (1, 0), (2, 1)]
    matrix.save_stats(np.ones((4, 3)), str(tmp_path / "s"))
    assert matrix.load_stats(str(tmp_path / "s")).tolist() == np.ones((4, 3)).tolist()


def test_stream(spark, tmp_path):
    from meanfield.streaming.scoring import score_stream

    x = clouds(30)
    frame(spark, x).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, v array<double>").parquet(str(tmp_path / "in"))
    q = score_stream(stream, x[:3], str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30


def test_command_line(spark, tmp_path):
    from meanfield.__main__ import main
    from meanfield.operators import report

    x = clouds(60).astype(np.float32)
    path = str(tmp_path / "x.fbin")
    matrix.save_dataset(frame(spark, x).withColumnRenamed("id", "pos"), path)
    lines = []
    out = tmp_path / "out"
    first = str(tmp_path / "first")
    matrix.save_centroids(x[:4], first)
    matrix.save_permutation([1, 0, 2, 3], str(tmp_path / "perm"))
    m = main([path, "-c", "4", "-a", "yinyang", "-G", "2", "-t", first, "-I", "3", "-s", str(out), "-o", str(tmp_path / "run"), "-b", "1", "-v", "5", "-p", str(tmp_path / "perm")], spark, report.Output(lines.append))
    want = naive(x.astype(float), x[:4].astype(float), len(m.history))
    assert [h["fit"] for h in m.history] == pytest.approx([f for f, _ in want])
    assert np.array_equal(matrix.load_centroids(str(out / "centroids.fbin"), 4, 3), m.centroids)
    cid = ((x[:, None] - m.centroids[None]) ** 2).sum(-1).argmin(1)
    assert [r["cls"] for r in matrix.load_classes(spark, str(out / "classes.cls")).orderBy("pos").collect()] == cid.tolist()
    for i in range(len(m.history) + 1):
        assert matrix.load_centroids(f"{tmp_path}/run_{i}.cnt", 4, 3).shape == (4, 3) and matrix.load_classes(spark, f"{tmp_path}/run_{i}.cls").count() == 60
    assert any("reductions" in x for x in lines) and any("on average" in x for x in lines)
    with pytest.raises(ValueError):
        main([path, "-c", "5", "-t", first], spark, report.Output(None))


def test_reports(spark):
    from meanfield.operators import report

    x = clouds(30)
    df = frame(spark, x)
    assert report.info_lines(df.withColumnRenamed("id", "pos"), 2)[0] == "30 rows, 3 columns" and len(report.info_lines(df.withColumnRenamed("id", "pos"), 2)) == 3
    assert report.assigned_lines(x[:3], samesize.same_size(df, x[:3]))[1].endswith(":10 objects")
    assert report.timed_total(df)[0] == pytest.approx(x.sum())
    assert len(report.reducer_seconds(spark, 3, 2, 4, 2)) == 2
    assert assign.is_identity(spark.createDataFrame([(0, 0), (1, 1)], "src int, dst int")) and not assign.is_identity(spark.createDataFrame([(0, 1), (1, 0)], "src int, dst int"))
