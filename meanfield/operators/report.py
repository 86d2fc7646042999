"""Reports: what a run writes and prints, how long parts of it take, and how many distances it saves."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meanfield.sources.matrix import save_centroids, save_classes

from . import assign, stats


class Output:
    """Where reports are printed: ``print`` on the driver, another function of a line, or nowhere with None."""

    def __init__(self, line: Callable[[str], None] | None = print):
        self.line = line

    def __call__(self, text: str) -> None:
        if self.line:
            self.line(text)


def centroid_lines(c: np.ndarray, digits: int = 2) -> list[str]:
    """A line for each centroid."""
    return [" ".join(f"{x:.{digits}f}" for x in row) for row in c]


def cluster_lines(c: np.ndarray, counts: list[int], digits: int = 2) -> list[str]:
    """A line for each cluster: its centroid and its size; with three digits for clusters of a given assignment."""
    return [f"{line} :{n} objects" for line, n in zip(centroid_lines(c, digits), counts, strict=True)]


def assigned_lines(c: np.ndarray, assigned: DataFrame, digits: int = 3) -> list[str]:
    """``cluster_lines`` for an assignment (id, cid, d2), such as one of equal sizes."""
    sizes = {r["cid"]: r["n"] for r in assign.cluster_sse(assigned, len(c)).collect()}
    return cluster_lines(c, [sizes[j] for j in range(len(c))], digits)


def info_lines(df: DataFrame, limit: int = 20) -> list[str]:
    """Rows and dimension of (pos, v) and its first ``limit`` rows."""
    n, d = df.agg(F.count("*"), F.max(F.size("v"))).first()
    rows = [r["v"] for r in df.where(F.col("pos") < limit).orderBy("pos").collect()]
    return [f"{n} rows, {d or 0} columns", *(" ".join(f"{x:g}" for x in v) for v in rows)]


def iteration_files(df: DataFrame, stem: str):
    """A ``report`` for ``kmeans.fit``: writes <stem>_<i>.cls and <stem>_<i>.cnt of the rows (id, v, pos)."""

    def write(c: np.ndarray, i: int) -> None:
        save_classes(assign.classify(df.select(F.col("pos").alias("id"), "v"), c).withColumnRenamed("id", "pos"), f"{stem}_{i}.cls")
        save_centroids(c, f"{stem}_{i}.cnt", double=True)

    return write


def repetition_files(folder: str):
    """An ``each`` for ``kmeans.fit``: writes the centroids of every repetition to <folder>/centroids.fbin, over the last."""
    return lambda model, rep: save_centroids(model.centroids, os.path.join(folder, "centroids.fbin"), double=True)


def history_lines(history: list[dict], n: int, k: int) -> list[str]:
    """A line for each iteration: fit, relative gain, share of the n * k distances computed and seconds; then the mean share."""
    out, best, shares = [], float("inf"), []
    for h in history:
        share = 100 * h.get("dist_count", n * k) / (n * k)
        shares.append(share)
        fit = h.get("fit", float("nan"))
        gain = 1.0 if best == float("inf") else (best - fit) / best
        best = min(best, fit)
        out.append(f"{h['it']}: fit {fit:.8g}, gain {gain:.3g}, distances {share:.2f} %, {h.get('seconds', 0):.3f} s")
    return [*out, f"distances {sum(shares) / max(1, len(shares)):.2f} % on average"]


def timed_total(df: DataFrame) -> tuple[float, float]:
    """The sum of all elements of (id, v), and the seconds it took."""
    began = time.time()
    return stats.total(df).first()[0], time.time() - began


def reducer_seconds(spark: SparkSession, k: int, dim: int, tasks: int, repetitions: int) -> list[float]:
    """Seconds of each of ``repetitions`` reductions of k x dim zeros from ``tasks`` tasks, as an iteration does them."""

    def zeros(batches):
        for batch in batches:
            for _ in range(len(batch)):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array([np.zeros(dim)] * k, pa.list_(pa.float64())), pa.array(np.zeros(k, np.int64)), pa.array(np.zeros(k)), pa.array(np.zeros(k))], ["cid", "s", "n", "sse", "pen"])

    out = []
    for _ in range(repetitions):
        began = time.time()
        rows = assign.reduced(spark.range(tasks, numPartitions=tasks).mapInArrow(zeros, assign.PARTIAL))
        assert len(rows) == k
        out.append(time.time() - began)
    return out
