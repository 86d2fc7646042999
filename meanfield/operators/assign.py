"""Assignment of vectors to centroids, and what follows from one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meanfield.functions.storage import stored
from meanfield.functions.vectors import distances, matrix, sqdist

#: For all pairs: blocks, at least; bytes of a block, about; pairs that a step compares; tasks, at most.
PAIR_BLOCKS, PAIR_BYTES, PAIR_STEP, PAIR_TASKS = 8, 16 << 20, 1 << 15, 4096
PARTIAL = "cid int, s array<double>, n long, sse double, pen double"


def centroid_frame(spark: SparkSession, c: np.ndarray) -> DataFrame:
    """(cid, c)."""
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(c)], "cid int, c array<double>")


def classify(df: DataFrame, c: np.ndarray) -> DataFrame:
    """(id, cid, d2): nearest centroid of each row of ``df`` (id, v); the lowest number wins ties."""

    def run(batches):
        for batch in batches:
            if len(batch):
                d = distances(matrix(batch), c)
                cid = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cid.astype(np.int32)), pa.array(d[np.arange(len(d)), cid])], ["id", "cid", "d2"])

    return df.select("id", "v").mapInArrow(run, "id long, cid int, d2 double")


def classify_relational(df: DataFrame, centroids: DataFrame) -> DataFrame:
    """The same in expressions: the least (distance, number) over an array of all centroids; ``centroids`` has K rows."""
    every = centroids.agg(F.array_sort(F.collect_list(F.struct("cid", "c"))).alias("cs"))
    found = F.array_min(F.transform("cs", lambda x: F.struct(sqdist("v", x["c"]).alias("d2"), x["cid"].alias("cid"))))
    return df.join(F.broadcast(every)).select("id", found.alias("m")).select("id", "m.cid", "m.d2")  # one row beside each


def nearest(df: DataFrame, c: np.ndarray, b: int) -> DataFrame:
    """(id, rank, cid, d2): the b nearest centroids of each row, in order."""
    b = min(b, len(c))

    def run(batches):
        for batch in batches:
            if len(batch):
                x = matrix(batch)
                d = np.stack([((x - row) ** 2).sum(1) for row in c], 1)
                order = np.argsort(d, axis=1, kind="stable")[:, :b]
                ids = np.repeat(batch.column(0).to_numpy(), b)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.tile(np.arange(1, b + 1, dtype=np.int32), len(x))), pa.array(order.ravel().astype(np.int32)), pa.array(np.take_along_axis(d, order, 1).ravel())], ["id", "rank", "cid", "d2"])

    return df.select("id", "v").mapInArrow(run, "id long, rank int, cid int, d2 double")


def annulus_candidates(df: DataFrame, centroids: DataFrame, radius: str = "r") -> DataFrame:
    """(id, cid): centroids whose norm differs from the row's by at most its ``radius``: a band join with K rows."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return df.withColumn("_n", norm("v")).join(F.broadcast(centroids.withColumn("_m", norm("c"))), F.abs(F.col("_n") - F.col("_m")) <= F.col(radius)).select("id", "cid")


def partial_sums(df: DataFrame, c: np.ndarray, penalty: np.ndarray | None = None) -> list:
    """Sum, count, squared error and penalised error of each cluster: K rows a task, then K rows."""
    k = len(c)

    def run(batches):
        s, n, e, p = np.zeros_like(c), np.zeros(k, np.int64), np.zeros(k), np.zeros(k)
        for batch in batches:
            if len(batch):
                x = matrix(batch)
                d = distances(x, c)
                cid = (d if penalty is None else d + penalty).argmin(axis=1)
                best = d[np.arange(len(x)), cid] if penalty is None else ((x - c[cid]) ** 2).sum(1)
                np.add.at(s, cid, x)
                n += np.bincount(cid, minlength=k)
                e += np.bincount(cid, best, k)
                p += np.bincount(cid, best if penalty is None else best + penalty[cid], k)
        yield sums_batch(s, n, e, p)

    return reduced(df.select("id", "v").mapInArrow(run, PARTIAL))


def sums_batch(s, n, e, p) -> pa.RecordBatch:
    at = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(list(s[at]), pa.list_(pa.float64())), pa.array(n[at]), pa.array(e[at]), pa.array(p[at])], ["cid", "s", "n", "sse", "pen"])


def reduced(partials: DataFrame) -> list:
    """Adds the tasks' rows of each cluster, in an order that depends on their values alone; K rows reach the driver."""

    def add(key, t):
        s = t["s"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        order = np.lexsort((*s.T[:4], t["sse"].to_numpy(), t["n"].to_numpy()))
        s, t = s[order].sum(0), t.take(pa.array(order))
        return pa.table({"cid": pa.array([key[0].as_py()], pa.int32()), "s": pa.array([s], pa.list_(pa.float64())), "n": [sum(t["n"].to_pylist())], "sse": [sum(t["sse"].to_pylist())], "pen": [sum(t["pen"].to_pylist())]})

    return partials.groupBy("cid").applyInArrow(add, PARTIAL).collect()


def cluster_sse(assigned: DataFrame, k: int) -> DataFrame:
    """(cid, n, sse) of all k clusters, 0 for empty ones."""
    all_ = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("cid"))
    per = assigned.groupBy("cid").agg(F.count("*").alias("n"), F.sum("d2").alias("sse"))
    return all_.join(per, "cid", "left").select("cid", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sse", F.lit(0.0)).alias("sse"))


def balance(assigned: DataFrame, k: int) -> DataFrame:
    """(mean, std, cv) of the sizes of all k clusters; std is that of the population."""
    return cluster_sse(assigned, k).agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("std")).withColumn("cv", F.col("std") / F.col("mean"))


def centers(df: DataFrame, labels: DataFrame) -> DataFrame:
    """(cls, j, x): means of the classes of ``labels`` (id, cls)."""
    return means(df.join(labels, "id").select("cls", "v"))


def means(df: DataFrame) -> DataFrame:
    """(cls, j, x): means of the vectors of each class of ``df`` (cls, v).  A task sends one row for each class."""

    def sums(batches):
        total: dict = {}
        for batch in batches:
            if len(batch):
                cls, at = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
                x = matrix(batch)
                s = np.zeros((len(cls), x.shape[1]))
                np.add.at(s, at, x)
                for c, row, n in zip(cls.tolist(), s, np.bincount(at).tolist(), strict=True):
                    old, m = total.get(c, (0.0, 0))
                    total[c] = old + row, m + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([s for s, _ in total.values()], pa.list_(pa.float64())), pa.array([n for _, n in total.values()], pa.int64())], ["cls", "s", "n"])

    rows = df.select(F.col("cls").cast("long").alias("cls"), "v").mapInArrow(sums, "cls long, s array<double>, n long")
    x = rows.select("cls", "n", F.posexplode("s").alias("j", "x"))
    return x.groupBy("cls", "j").agg((F.sum("x") / F.sum("n")).alias("x"))


def quantize(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, cid, c): each row's nearest centroid in its place."""
    return assigned.join(F.broadcast(centroids), "cid").select("id", "cid", "c")


def permute(centroids: DataFrame, perm: DataFrame) -> DataFrame:
    """new[dst] = old[src] for ``perm`` (src, dst)."""
    return centroids.join(perm, centroids["cid"] == perm["src"]).select(F.col("dst").alias("cid"), "c")


def positions(df: DataFrame, *order) -> DataFrame:
    """Adds pos, the place from 0 in the order of id, or of the columns ``order`` (equal rows in any order).

    Ranges of ids are sorted and written once with each row's place in its range; their totals, one row for each range, are
    counted from the written table, so both come from the same ranges.
    """
    place = F.monotonically_increasing_id()
    order = order or ("id",)
    part = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.struct("*").alias("row"), place.alias("at")), "positions")
    range_ = F.shiftright("at", 33).alias("range")
    totals = part.groupBy(range_).agg(F.count("*").alias("n"))
    before = totals.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    out = part.withColumn("range", range_).join(F.broadcast(before), "range")  # a row for each task of the range shuffle
    return out.select("row.*", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("pos"))


def pairwise(df: DataFrame) -> DataFrame:
    """(a, b, d2): the squared distance of all pairs of rows of ``df`` (id, v) with ids a < b.

    d2 is null where a vector is null or holds nulls, or the two are of different lengths.  Rows are dealt to blocks and each
    two blocks meet in one task, so a vector travels once for each block, not for each pair.  There are as few blocks as their
    bytes allow, as all that is shuffled is the table times their number.
    """
    df = df.select("id", "v").where("id is not null")
    n, width = df.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, min(n, max(PAIR_BLOCKS, -(-n * 8 * max(1, width or 0) // PAIR_BYTES))))
    packed = stored(df.mapInArrow(lambda batches: pair_blocks(batches, blocks), "block int, ids binary, sizes binary, single boolean, v binary"), "pair-blocks")
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    low, high = F.least("block", "other").cast("long"), F.greatest("block", "other").cast("long")
    mixed = blocks * (blocks - 1) // 2
    tile = F.when(low < high, F.floor(high * (high - 1) / 2) + low).otherwise(mixed + low)  # a block with itself is half the work: last
    tiles = packed.select("*", each).withColumns({"low": low, "high": high, "tile": tile}).drop("other")
    parts, step = min(PAIR_TASKS, mixed + blocks), PAIR_STEP
    tiles = tiles.repartitionById(parts, (F.col("tile") % parts).cast("int")).sortWithinPartitions("tile")
    return tiles.mapInArrow(lambda batches: pair_distances(batches, step), "a long, b long, d2 double")


def pair_blocks(batches, blocks: int):
    """The rows (id, v) of each batch dealt to ``blocks`` rows of bytes; sizes has -1 for a vector that is null or holds nulls."""
    at = TaskContext.get().partitionId()
    for batch in batches:
        ids, col = batch.column(0).to_numpy(), batch.column(1)
        rows = [x if x is not None and None not in x else None for x in col.to_pylist()] if col.null_count or col.flatten().null_count else None
        sizes = np.array([-1 if x is None else len(x) for x in rows], np.int64) if rows else col.value_lengths().to_numpy().astype(np.int64)
        width = max(0, int(sizes.max(initial=0)))
        if rows or (sizes != width).any():
            v = np.zeros((len(sizes), width))
            for i, x in enumerate(rows or col.to_pylist()):
                v[i, : len(x or ())] = x or ()
        else:
            v = col.flatten().to_numpy().reshape(len(sizes), width)
        with np.errstate(over="ignore"):
            small = v.astype(np.float32)
        single = np.array_equal(small, v, equal_nan=True)  # doubles that come from floats take half the bytes
        out = []
        for i in range(min(blocks, len(ids))):
            take = slice(i, None, blocks)
            out.append(((at + i) % blocks, ids[take].tobytes(), sizes[take].tobytes(), single, (small if single else v)[take].tobytes()))
        at += len(ids)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.bool_(), pa.binary()), strict=True)], ["block", "ids", "sizes", "single", "v"])


def pair_distances(batches, pairs: int):
    """The pairs of the blocks ``low`` and ``high`` of each tile, whose rows follow one another."""
    tile, sides = None, {}
    for batch in batches:
        for r in batch.to_pylist():
            if r["tile"] != tile:
                yield from met(sides, pairs)
                tile, sides = r["tile"], {r["low"]: [], r["high"]: []}
            sides[r["block"]].append(r)
    yield from met(sides, pairs)


def met(sides: dict, pairs: int):
    """Batches of (a, b, d2) of one block with itself or of two, about ``pairs`` a batch, which fit a core's cache."""
    if not sides or not all(sides.values()):
        return
    same, sides = len(sides) == 1, [unpacked(rows) for rows in sides.values()]
    (ia, na, x), (ib, nb, y) = sides[0], sides[-1]
    alike = len({*na.tolist(), *nb.tolist()}) == 1 and na[0] >= 0
    whole = not same and not len(np.intersect1d(ia, ib))
    step = max(1, pairs // len(ib))
    for lo in range(0, len(ia), step):
        at = lo if same else 0  # rows lie in the order of id
        p, q = ia[lo : lo + step, None], ib[at:]
        s, e = np.zeros((len(p), len(q))), np.empty((len(p), len(q)))
        for u, w in zip(x[:, lo : lo + step], y[:, at:], strict=False):  # a longer side has no distance
            np.subtract(u[:, None], w, out=e)
            s += np.multiply(e, e, out=e)
        known = None if alike else (na[lo : lo + step, None] == nb[at:]) & (nb[at:] >= 0)
        found = [np.minimum(p, q), np.maximum(p, q), s, known]
        keep = ... if whole else p < q if same else p != q
        a, b, d2, known = (None if c is None else c[keep].ravel() for c in found)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d2, mask=None if known is None else ~known)], ["a", "b", "d2"])


def unpacked(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, sizes and columns of a block, in the order of id."""
    ids, sizes = (np.concatenate([np.frombuffer(r[c], np.int64) for r in rows]) for c in ("ids", "sizes"))
    parts = [np.frombuffer(r["v"], np.float32 if r["single"] else np.float64).reshape(len(r["ids"]) // 8, -1) for r in rows]
    v, at = np.zeros((max(p.shape[1] for p in parts), len(ids))), 0
    for p in parts:
        v[: p.shape[1], at : at + len(p)] = p.T
        at += len(p)
    order = np.argsort(ids, kind="stable")
    return ids[order], sizes[order], np.ascontiguousarray(v[:, order])


def moved(df: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(cid, j, n, x): what rows of ``df`` (id, v) that change from ``old`` to ``new`` (id, cid) add to each cluster's count and sums."""
    pairs = old.select("id", F.col("cid").alias("a")).join(new.select("id", F.col("cid").alias("b")), "id").where("a <> b").join(df.select("id", "v"), "id")
    signed = pairs.select("v", F.explode(F.array(F.struct(F.col("a").alias("cid"), F.lit(-1).alias("sign")), F.struct(F.col("b").alias("cid"), F.lit(1).alias("sign")))).alias("m"))
    x = signed.select("m.cid", "m.sign", F.posexplode("v").alias("j", "x"))
    return x.groupBy("cid", "j").agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("x")).alias("x"))


def members(labels: DataFrame) -> DataFrame:
    """(cls, at, id): the class lists of ``labels`` (id, cls) as rows; at counts from 0 in the order of id."""
    return labels.select("cls", (F.row_number().over(Window.partitionBy("cls").orderBy("id")) - 1).alias("at"), "id")


def is_identity(perm: DataFrame) -> bool:
    """Whether ``perm`` (src, dst) leaves every centroid where it is."""
    return bool(perm.agg(F.coalesce(F.bool_and(F.col("src") == F.col("dst")), F.lit(True))).first()[0])


def inverse(perm: DataFrame) -> DataFrame:
    """The permutation (src, dst) that undoes ``perm``."""
    return perm.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def take_rows(df: DataFrame, wanted: list[int]) -> np.ndarray:
    """Vectors at the given positions of ``df`` (pos, v), in request order, repeats kept."""
    rows = {r["pos"]: r["v"] for r in df.where(F.col("pos").isin(list(set(wanted)))).select("pos", "v").collect()}
    return np.array([rows[p] for p in wanted], np.float64)
