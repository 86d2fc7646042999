"""Exact K-means with its variants: balanced, sampled, without error tracking, accelerated, restarted."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meanfield.functions.vectors import uniform, uniform_value, validated, vectors

from meanfield.sources.matrix import load_centroids

from . import assign, init, pruned, stats


@dataclass
class Model:
    """Centroids and what each iteration gave; the methods are lazy plans over (id, v)."""

    centroids: np.ndarray
    fit: float = float("nan")
    history: list[dict] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        return assign.classify(df, self.centroids)

    def quantize(self, df: DataFrame) -> DataFrame:
        return assign.quantize(self.transform(df), assign.centroid_frame(df.sparkSession, self.centroids))

    def cluster_sse(self, df: DataFrame) -> DataFrame:
        return assign.cluster_sse(self.transform(df), len(self.centroids))

    def balance(self, df: DataFrame) -> DataFrame:
        return assign.balance(self.transform(df), len(self.centroids))

    def permuted(self, perm: list[int]) -> "Model":
        """new[perm[i]] = old[i]."""
        new = np.empty_like(self.centroids)
        new[perm] = self.centroids
        return Model(new, self.fit, self.history)


class Repair:
    """What an empty cluster becomes: "random" a row drawn anew, "cyclic" the next row from position 0."""

    def __init__(self, df: DataFrame, kind: str, seed: int):
        if kind not in ("random", "cyclic"):
            raise ValueError(f"unknown repair {kind!r}")
        self.df, self.kind, self.seed, self.next, self.n = df, kind, seed, 0, None

    def __call__(self, c: np.ndarray, empty: np.ndarray, iteration: int) -> None:
        if not len(empty):
            return
        self.n = self.n or self.df.count()
        if self.kind == "cyclic":
            at = [(self.next + i) % self.n for i in range(len(empty))]
            self.next = (at[-1] + 1) % self.n
        else:
            at = [int(uniform_value(self.seed, "repair", iteration, int(k)) * self.n) for k in empty]
        c[empty] = assign.take_rows(self.df, at)


def updated(c: np.ndarray, rows: list, repair, iteration: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """New centroids, counts, squared error and penalised error from the clusters' sums."""
    new, n = c.copy(), np.zeros(len(c), np.int64)
    for r in rows:
        n[r["cid"]] = r["n"]
        new[r["cid"]] = np.array(r["s"]) / r["n"]
    if repair is not None:
        repair(new, np.flatnonzero(n == 0), iteration)
    return new, n, sum(r["sse"] for r in rows), sum(r["pen"] for r in rows)


def run(step, c: np.ndarray, max_iter: int, min_iter: int, min_rel: float | None, report=None) -> Model:
    """Iterates while the fit falls.  A fit is the error before the update; the centroids are one update past the last fit.

    Before iteration ``min_iter`` all tests are skipped, also that of the fit, of which the best is kept; then it stops if
    the relative gain is under ``min_rel`` or ``max_iter`` (0: no limit) iterations are done.  report: called with the
    centroids and 0 first, then after each iteration that lowers the fit.
    """
    best, history, i = float("inf"), [], 0
    if report:
        report(c, 0)
    while True:
        i += 1
        began = time.time()
        c, row = step(c, i)
        history.append({"it": i, **row, "seconds": time.time() - began})
        fit = row["fit"]
        if not fit < best:
            if i < min_iter:
                continue
            break
        if report:
            report(c, i)
        rel = 1.0 if best == float("inf") else (best - fit) / best
        best = fit
        if i < min_iter:
            continue
        if (min_rel and min_rel > rel) or (max_iter and i >= max_iter):
            break
    return Model(c, best, history)


def lloyd_step(df: DataFrame, n: int, dim: int, repair, balance_lambda: float = 0.0):
    """Naive iteration; with a lambda, distance + w * previous size, w = lambda * previous pure error / n * k / dim."""
    state = {"pure": 0.0, "counts": None}

    def step(c, i):
        penalty = None
        if balance_lambda > 0 and state["counts"] is not None:
            penalty = balance_lambda * state["pure"] / n * len(c) / dim * state["counts"]
        new, counts, sse, pen = updated(c, assign.partial_sums(df, c, penalty), repair, i)
        state["pure"], state["counts"] = sse / n, counts
        size = counts.mean()
        return new, {"fit": pen / n, "pure": sse / n, "counts": counts.tolist(), "std": float(counts.std()), "cv": float(counts.std() / size), "dist_count": n * len(c)}

    return step


def sampled(df: DataFrame, n: int, rate: float, seed: int, iteration: int, bins: int = 65_536) -> DataFrame:
    """A fresh sample without replacement of max(1, floor(n * rate)) rows: those with the smallest (uniform, id).

    Rows per bin of the uniform find the bin in which the sample ends; lower bins are taken by a filter and only that one,
    about n / ``bins`` rows, is sorted.
    """
    left = max(1, int(n * rate))
    df = df.withColumn("_u", uniform(seed, f"s:{iteration}", "id"))
    bin_ = F.floor(F.col("_u") * bins)
    last = bins
    for r in df.groupBy(bin_.alias("b")).agg(F.count("*").alias("n")).orderBy("b").collect():
        if r["n"] >= left:
            last = r["b"]
            break
        left -= r["n"]
    whole, part = df.where(bin_ < last), df.where(bin_ == last).orderBy("_u", "id").limit(left)
    return whole.unionByName(part).drop("_u")


def sampled_step(df: DataFrame, n: int, rate: float, seed: int, repair):
    """As naive, on the iteration's sample; the fit is over the sample."""

    def step(c, i):
        new, counts, sse, _ = updated(c, assign.partial_sums(sampled(df, n, rate, seed, i), c), repair, i)
        return new, {"fit": sse / counts.sum(), "pure": sse / counts.sum(), "counts": counts.tolist(), "dist_count": int(counts.sum()) * len(c)}

    return step


INITS = {"first": lambda df, k, p, s: init.first(df, k), "forgy": lambda df, k, p, s: init.forgy(df, k, s), "random": lambda df, k, p, s: init.random_partition(df, k, s), "mindist": lambda df, k, p, s: init.min_dist(df, k, int(p or 5), s), "plusplus": lambda df, k, p, s: init.plus_plus(df, k, s), "oror": lambda df, k, p, s: init.scalable(df, k, p or 1.0, seed=s)}


def prepared(df: DataFrame, id_col: str, *features: str) -> tuple[DataFrame, int, int]:
    """Cached (id, v, pos), the number of rows and the dimension."""
    df, dim = validated(vectors(df, id_col, *features))
    df = assign.positions(df).persist()
    n = df.count()
    if not n:
        raise ValueError("no rows")
    return df, n, dim


def fit(df: DataFrame, k: int, *, id_col: str, features: tuple[str, ...], algorithm: str = "naive", init: str | np.ndarray = "forgy", init_param: float | None = None, seed: int = 0, max_iter: int = 0, min_iter: int = 0, min_rel: float | None = None, balance_lambda: float = 0.0, sample_rate: float = 1.0, track_mse: bool = True, repetitions: int = 1, time_budget: float | None = None, repair: str = "cyclic", allow_unused_lambda: bool = False, report=None, each=None, **accelerated) -> Model:
    """Clusters the rows of ``df``; of several repetitions (each with its own draws) or restarts within ``time_budget``
    seconds the best fit's model is returned.

    init: a matrix, one of INITS or the path of a centroid file, whose shape must be that of the clusters.  report: called
    with (centroids, iteration) as ``run`` says; each: called with (model, repetition) after each repetition.  accelerated:
    the options of ``pruned.step``.  Null, non-finite or ragged vectors raise ValueError.
    """
    if k < 1 or not 0 < sample_rate <= 1 or balance_lambda < 0 or (min_rel is not None and not 0 <= min_rel < 1):
        raise ValueError("k, sample_rate, balance_lambda or min_rel out of range")
    if min_rel and not track_mse:
        raise ValueError("min_rel needs the error")
    if balance_lambda and sample_rate < 1 and not allow_unused_lambda:
        raise ValueError("sampling ignores balance_lambda")
    if algorithm != "naive" and (balance_lambda or sample_rate < 1):
        raise ValueError("balance_lambda and sample_rate need the naive algorithm")
    data, n, dim = prepared(df, id_col, *features)
    best, began, rep = None, time.time(), 0
    while rep < repetitions or (time_budget is not None and time.time() - began < time_budget):
        if not isinstance(init, str):
            c = np.asarray(init, np.float64)
        else:
            c = INITS[init](data, k, init_param, seed + rep) if init in INITS else load_centroids(init, k, dim)
        if c.shape != (k, dim):
            raise ValueError(f"initial centroids are {c.shape}, not {(k, dim)}")
        fix = Repair(data, repair, seed + rep)
        if not track_mse:
            model = without_mse(data, c, fix, max_iter)
        else:
            if sample_rate < 1:
                step = sampled_step(data, n, sample_rate, seed + rep, fix)
            elif algorithm == "naive":
                step = lloyd_step(data, n, dim, fix, balance_lambda)
            else:
                step = pruned.step(data, n, algorithm, fix, **accelerated)
            model = run(step, c, max_iter, min_iter, min_rel, report)
            getattr(step, "close", lambda: None)()
        if best is None or model.fit < best.fit:
            best = model
        if each:
            each(model, rep)
        rep += 1
    data.unpersist()
    return best


def without_mse(df: DataFrame, c: np.ndarray, repair, max_iter: int = 0) -> Model:
    """Until an iteration after the first changes no assignment; the first compares with cluster 0 for all.

    Assignments change exactly if the clusters' counts or sums do, or the centroids move; unchanged centroids mean
    unchanged assignments at the next pass.
    """
    history, i = [], 0
    while True:
        i += 1
        new, counts, sse, _ = updated(c, assign.partial_sums(df, c), repair, i)
        moved = not np.array_equal(new, c)
        history.append({"it": i, "changed": moved, "counts": counts.tolist()})
        c = new
        if (i > 1 and not moved) or (max_iter and i >= max_iter):
            return Model(c, sse / counts.sum(), history)


def relaxed(df: DataFrame, c: np.ndarray, seconds: float | None = None, seed: int = 0, max_iter: int = 1000) -> Model:
    """Stochastic relaxation: after each step uniform noise (U - 0.5) * std_j * (1 - t / T) ** 2, until time T.

    t / T is the share of ``seconds``, or of the ``max_iter`` iterations where no time is given: the result then follows
    from the rows and the seed.  The draws are ``uniform_value(seed, "sr", iteration, cluster, column)``.
    """
    n = df.count()
    std = np.array([r["std"] or 0.0 for r in stats.column_stats(df).orderBy("j").collect()])
    step, began, history = lloyd_step(df, n, c.shape[1], Repair(df, "random", seed)), time.time(), []
    best = Model(c, float("inf"))
    for i in range(1, max_iter + 1):
        before = c
        c, row = step(c, i)
        history.append({"it": i, **row})
        if row["fit"] < best.fit:
            best = Model(before, row["fit"])
        t = i / max_iter if seconds is None else (time.time() - began) / seconds
        if t >= 1:
            break
        noise = np.array([[uniform_value(seed, "sr", i, a, b) for b in range(c.shape[1])] for a in range(len(c))])
        c = c + (noise - 0.5) * std * (1 - t) ** 2
    best.history = history
    return best
