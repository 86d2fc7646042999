"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import maybe_broadcast, parts, stored, tidy

INDEX = "dim int, shard int, vectors binary, members binary, counts binary, graph binary, starts binary"
#: Vertices at most at which a search begins.
STARTS = 32
#: Vectors up to which a shard keeps its given size; beyond, shards grow with the root of their number.
GROWS = 1 << 20
FOUND = "query_id long, ids array<long>, scores array<double>"


class Graph:
    """A directed graph over vectors, searched greedily from a few starts; nearness is the largest inner product.

    Vectors get one more component that makes their norms equal, so that nearness is the Euclidean one that pruning needs.
    """

    def __init__(self, vectors: np.ndarray, degree: int = 32, beam: int = 64, slack: float = 1.2):
        self.degree, self.beam, self.slack = degree, beam, slack
        norms = (vectors.astype(np.float64) ** 2).sum(axis=1)
        self.x = np.concatenate([vectors, np.sqrt(np.maximum(norms.max(initial=0) - norms, 0))[:, None]], axis=1).astype(np.float32)
        self.radius = float(norms.max(initial=0))
        n = len(vectors)
        self.graph = np.full((n, degree), -1, np.int32)
        self.starts = np.random.default_rng(n).permutation(n)[: max(1, min(STARTS, n // 64))]

    def build(self, seed: int = 0) -> "Graph":
        """Inserts the vectors in random order, in batches that double up to a fiftieth of all; then all once more.

        The second time every vector's edges are chosen anew from its old ones and what a search of the whole graph finds.
        """
        order = np.random.default_rng(seed).permutation(len(self.x))
        for again in (False, True):
            left = order if again else order[~np.isin(order, self.starts)]
            done, size = 0, 512 if again else 1
            while done < len(left):
                batch = left[done : done + size]
                self._insert(batch)
                done += len(batch)
                size = min(2 * size, max(1, len(order) // 50), 512)
        return self

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest vertices met by each query (rows of ids, -1 padded; their products), nearest first."""
        q, n = len(queries), len(self.x)
        met = np.zeros((q, n + 1), bool)
        met[:, -1] = True
        ids = np.full((q, beam), -1, np.int64)
        near = np.full((q, beam), -np.inf, np.float32)
        open_ = np.zeros((q, beam), bool)
        first = self.starts[: min(beam, len(self.starts))]
        score = queries @ self.x[first].T
        take = np.argsort(-score, axis=1, kind="stable")
        ids[:, : len(first)], near[:, : len(first)], open_[:, : len(first)] = first[take], np.take_along_axis(score, take, 1), True
        met[:, first] = True
        live = np.arange(q)
        while len(live):
            best = np.argmax(open_[live], axis=1)  # rows are sorted, so the first open one is the nearest
            at = ids[live, best]
            open_[live, best] = False
            next_ = self.graph[at].astype(np.int64)
            new = ~met[live[:, None], next_]
            next_[~new] = -1
            met[live[:, None], next_] = True
            score = np.einsum("qrd,qd->qr", self.x[next_], queries[live])
            score[~new] = -np.inf
            some = new.any(axis=1)
            rows = live[some]
            all_ids = np.concatenate([ids[rows], next_[some]], axis=1)
            all_near = np.concatenate([near[rows], score[some]], axis=1)
            all_open = np.concatenate([open_[rows], new[some]], axis=1)
            take = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
            ids[rows] = np.take_along_axis(all_ids, take, 1)
            near[rows] = np.take_along_axis(all_near, take, 1)
            open_[rows] = np.take_along_axis(all_open, take, 1)
            live = live[open_[live].any(axis=1)]
        return ids, near

    def _insert(self, batch: np.ndarray) -> None:
        ids, _ = self.search(self.x[batch], self.beam)
        self.graph[batch] = self._pruned(batch, np.concatenate([ids, self.graph[batch]], axis=1))
        source = np.repeat(batch, self.degree)
        target = self.graph[batch].ravel().astype(np.int64)
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        points, first, count = np.unique(target, return_index=True, return_counts=True)
        for lo in range(0, len(points), 256):
            p, f, c = points[lo : lo + 256], first[lo : lo + 256], count[lo : lo + 256]
            extra = np.full((len(p), int(c.max())), -1, np.int64)
            col = np.arange(extra.shape[1])
            fill = col[None, :] < c[:, None]
            extra[fill] = source[(f[:, None] + col[None, :])[fill]]
            old = self.graph[p].astype(np.int64)
            degree = (old >= 0).sum(axis=1)
            simple = degree + c <= self.degree
            for k in np.flatnonzero(simple).tolist():
                self.graph[p[k], degree[k] : degree[k] + c[k]] = extra[k, : c[k]]
            full = np.flatnonzero(~simple)
            if len(full):
                self.graph[p[full]] = self._pruned(p[full], np.concatenate([old[full], extra[full]], axis=1))

    def _pruned(self, points: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Robust pruning: keeps the nearest candidate, drops those nearer to it, by the slack, than to the point, and so on."""
        x = self.x[points]
        c = self.x[found]
        away = 2 * self.radius - 2 * np.einsum("qmd,qd->qm", c, x)
        away[(found < 0) | (found == points[:, None])] = np.inf  # a repeated candidate is dropped by the first, at distance 0
        take = np.argsort(away, axis=1, kind="stable")
        away, found = np.take_along_axis(away, take, 1), np.take_along_axis(found, take, 1)
        c = np.take_along_axis(c, take[:, :, None], 1)
        between = 2 * self.radius - 2 * np.matmul(c, c.transpose(0, 2, 1))
        out = np.full((len(points), self.degree), -1, np.int32)
        rows = np.arange(len(points))
        for k in range(self.degree):
            best = np.argmin(away, axis=1)
            good = np.isfinite(away[rows, best])
            if not good.any():
                break
            out[good, k] = found[rows, best][good]
            limit = away.copy()
            away[rows, best] = np.inf
            away[self.slack**2 * between[rows, best] <= limit] = np.inf
        return out


def _build(degree: int, beam: int, slack: float):
    def run(key, table):
        dim, shard = key[0].as_py(), key[1].as_py()
        order = np.argsort([m[0] for m in table["ids"].to_pylist()], kind="stable")
        table = table.take(pa.array(order))
        vectors = table["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        ids = table["ids"].combine_chunks()
        g = Graph(vectors, degree, beam, slack).build(shard)
        counts = np.diff(ids.offsets.to_numpy()).astype(np.int64)
        row = [[dim], [shard], [vectors.astype("<f8").tobytes()], [ids.flatten().to_numpy().astype("<i8").tobytes()], [counts.tobytes()], [g.graph.tobytes()], [g.starts.astype(np.int64).tobytes()]]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])

    return run


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, dim): rows with an id and a vector that isn't null, empty or zero and has only finite components."""
    out = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast("double") + 0.0).alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return out.where("id is not null and v is not null").where(good).withColumn("dim", F.size("v"))


def build_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, shard_rows: int = 8192, degree: int = 32, beam: int = 64, slack: float = 1.2) -> DataFrame:
    """Rows INDEX, one robust-pruned graph for every shard of distinct vectors of one length.

    A shard holds about ``shard_rows`` vectors, and more as their number n grows: ``shard_rows`` times the root of
    n / GROWS, up to 16 times.  So the shards that each query has to search grow with the root of n up to there.

    Equal vectors are one vertex, which keeps its k + 1 smallest distinct ids: no query can return more of them.  Repeated
    rows and further ids are cut before the vectors are grouped, so a vector that a third of the rows share costs k + 1
    rows a task.
    """
    rows = valid_vectors(vectors, id_col, vec_col).select("id", "v", "dim").dropDuplicates(["id", "v"])
    first = Window.partitionBy("v", "dim").orderBy("id")
    rows = rows.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k + 1)
    classes = stored(rows.groupBy("dim", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "ann-classes")
    size = shard_rows * F.least(F.greatest(F.sqrt(F.col("n") / GROWS), F.lit(1.0)), F.lit(16.0))
    counts = stored(classes.groupBy("dim").agg(F.count("*").alias("n")).select("dim", F.ceil(F.col("n") / size).alias("shards")), "ann-dims")
    classes = classes.join(maybe_broadcast(counts), "dim").select("dim", F.pmod(F.xxhash64("v"), "shards").cast("int").alias("shard"), "v", "ids")
    # a given number of partitions isn't merged: a shard is little data and much work
    classes = classes.repartition(_tasks(counts.agg(F.sum("shards")).first()[0]), "dim", "shard")
    return stored(classes.groupBy("dim", "shard").applyInArrow(_build(degree, beam, slack), INDEX), "ann-index")


def _tasks(units) -> int:
    """Partitions for so many units of work: four times as many while they are few, so that hardly two meet."""
    units = int(units or 1)
    return max(units, min(4 * units, 4000))


def _found(g: Graph, vectors, members, counts, q, k: int, beam: int):
    """Lists query ids, their nearest ids and scores, of the queries ``q`` (a struct array of id, v) in one shard."""
    ends = np.cumsum(counts)
    ids = q.field("id").to_numpy()
    qv = q.field("v").flatten().to_numpy().reshape(-1, vectors.shape[1])
    out: list[list] = [[], [], []]
    for lo in range(0, len(ids), 256):
        part = qv[lo : lo + 256]
        scale = np.abs(part).max(axis=1, keepdims=True)
        wide = np.concatenate([part / scale, np.zeros((len(part), 1))], axis=1).astype(np.float32)
        found, _ = g.search(wide, beam)
        for i in range(len(part)):
            hit = found[i][found[i] >= 0]
            score = vectors[hit] @ part[i]
            hit, score = hit[np.argsort(-score, kind="stable")], np.sort(-score, kind="stable")
            # classes until k rows other than the query's own are certain
            need = np.searchsorted(np.cumsum(counts[hit]), k + 1) + 1
            edge = need if need >= len(hit) else int(np.searchsorted(score, score[need - 1], "right"))
            hit, score = hit[:edge], -score[:edge]
            rows = np.concatenate([members[ends[h] - counts[h] : ends[h]] for h in hit]) if len(hit) else members[:0]
            scores = np.repeat(score, counts[hit])
            other = rows != ids[lo + i]
            rows, scores = rows[other], scores[other]
            order = np.lexsort((rows, -scores))[:k]
            for col, v in zip(out, (ids[lo + i], rows[order].tolist(), scores[order].tolist()), strict=True):
                col.append(v)
    return out


def _search(k: int, beam: int):
    """Rows of a shard's index, then blocks of queries: holds one shard and searches it for each block that follows."""

    def run(batches):
        at = None
        for batch in batches:
            names = {n: i for i, n in enumerate(batch.schema.names)}
            for row in range(len(batch)):
                value = {n: batch.column(i)[row] for n, i in names.items()}
                place = value["dim"].as_py(), value["shard"].as_py()
                if not value["q"].is_valid:
                    vectors = np.frombuffer(value["vectors"].as_py(), "<f8").reshape(-1, place[0])
                    members, counts = np.frombuffer(value["members"].as_py(), "<i8"), np.frombuffer(value["counts"].as_py(), np.int64)
                    g = Graph(vectors)
                    g.graph = np.frombuffer(value["graph"].as_py(), np.int32).reshape(len(vectors), -1)
                    g.starts = np.frombuffer(value["starts"].as_py(), np.int64)
                    at = place
                elif place == at:  # a hash may have left a shard without vectors
                    out = _found(g, vectors, members, counts, value["q"].values, k, beam)
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.list_(pa.float64()))], ["query_id", "ids", "scores"])

    return run


def search_index(index: DataFrame, queries: DataFrame, k: int = 20, beam: int = 128, block: int = 1024, each: int = 65_536) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for each of ``queries`` (id, v, dim).

    Every query searches every shard of its length; a beam search in each gives k rows a shard, which are merged.  The
    queries travel in blocks of about ``block``; a task holds one shard, read once, and one block at a time.  A shard's
    index is sent once for every ``each`` queries.  Scores are inner products in double precision of the vectors as given;
    ties go to the smaller vec_id.  Rows of INDEX and of (id, v, dim) come from ``build_index`` and ``valid_vectors``,
    which leave out what has no place here; empty tables and queries of a length without vectors give no rows; a query id
    with several vectors has the nearest of all of them; extra columns are ignored.
    """
    n = queries.count()
    subs = parts(n, each)
    sub = lambda b: F.pmod(b, F.lit(subs)).cast("int").alias("sub")
    blocks = queries.groupBy("dim", F.pmod(F.xxhash64("id"), F.lit(parts(n, block))).alias("b")).agg(F.collect_list(F.struct("id", "v")).alias("q"))
    shards = index.groupBy("dim").agg(F.max("shard").alias("last"))
    blocks = blocks.join(maybe_broadcast(stored(shards, "ann-shards")), "dim")
    blocks = blocks.select("dim", F.explode(F.sequence(F.lit(0), "last")).alias("shard"), sub(F.col("b")), "q")
    graphs = index.withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(subs - 1))))
    both = graphs.unionByName(blocks, allowMissingColumns=True)
    both = both.repartition(_tasks(index.count() * subs), "dim", "shard", "sub").sortWithinPartitions("dim", "shard", "sub", F.col("q").isNotNull())
    found = both.mapInArrow(tidy(_search(k, beam)), FOUND)
    rows = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = rows.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k)
    return top.dropDuplicates(["query_id", "rank"]).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", beam: int = 128, **params) -> DataFrame:
    """The ``k`` nearest rows, by inner product, of every row whose id is divisible by ``every``, against all other rows.

    Cases: rows with a null id, or a vector that is null, empty, zero or has null or non-finite components, take no part;
    vectors meet those of their own length only; a query's own id is no candidate, nor are rows that repeat it; equal
    vectors tie and go by id; with fewer than k candidates all are returned; extra columns are ignored; an empty table
    gives an empty result.
    """
    index = build_index(vectors, id_col, vec_col, k, **params)
    queries = stored(valid_vectors(vectors, id_col, vec_col).where(F.col("id") % every == 0).dropDuplicates(["id", "v"]), "ann-queries")
    return search_index(index, queries, k, beam)
