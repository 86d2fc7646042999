"""Initial centroids; draws are U(seed, tag, keys), so that they can be repeated elsewhere."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meanfield.functions.storage import discard, stored
from meanfield.functions.vectors import distances, matrix, uniform, uniform_value

from .assign import means, take_rows

BLOCK = 65_536


def first(df: DataFrame, k: int) -> np.ndarray:
    """The k rows with the smallest positions."""
    return take_rows(df, list(range(k)))


def forgy(df: DataFrame, k: int, seed: int = 0) -> np.ndarray:
    """k random rows, with replacement."""
    n = df.count()
    return take_rows(df, [int(uniform_value(seed, "forgy", i) * n) for i in range(k)])


def random_partition(df: DataFrame, k: int, seed: int = 0) -> np.ndarray:
    """Means of a random partition; a class that got no row takes the first row."""
    rows = means(df.select(F.floor(uniform(seed, "rp", "id") * k).alias("cls"), "v")).collect()
    out = np.tile(take_rows(df, [0]), (k, 1))
    for r in rows:
        out[r["cls"], r["j"]] = r["x"]
    return out


def min_dist(df: DataFrame, k: int, trials: int, seed: int = 0) -> np.ndarray:
    """First the trial row nearest to the mean; then, of each round's trial rows, the farthest from those chosen."""
    n = df.count()
    picks = [[int(uniform_value(seed, "md", i, t) * n) for t in range(trials)] for i in range(k)]
    rows = take_rows(df, [p for r in picks for p in r]).reshape(k, trials, -1)
    mean = np.array([r["x"] for r in means(df.select(F.lit(0).alias("cls"), "v")).orderBy("j").collect()])
    chosen = [rows[0][int(((rows[0] - mean) ** 2).sum(1).argmin())]]
    for i in range(1, k):
        chosen.append(rows[i][int(distances(rows[i], np.array(chosen)).min(1).argmax())])
    return np.array(chosen)


def _closer(df: DataFrame, new: np.ndarray) -> DataFrame:
    """Lowers the column d2 to the distance to the nearest of ``new``."""

    def run(batches):
        for batch in batches:
            if len(batch):
                d = np.stack([((matrix(batch) - c) ** 2).sum(1) for c in new], 1).min(1)
                at = batch.schema.get_field_index("d2")
                yield batch.set_column(at, "d2", pa.array(np.minimum(d, batch.column(at).to_numpy())))

    return df.mapInArrow(run, df.schema)


def _mass(df: DataFrame, chosen: np.ndarray) -> DataFrame:
    """(pos, m): each row's squared distance to the nearest chosen one, times its weight w where ``df`` has one."""
    weighted = "w" in df.columns

    def run(batches):
        for batch in batches:
            if len(batch):
                m = distances(matrix(batch), chosen).min(1)
                if weighted:
                    m = m * batch.column(2).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m)], ["pos", "m"])

    return df.select("pos", "v", *(["w"] if weighted else [])).mapInArrow(run, "pos long, m double")


def plus_plus(df: DataFrame, k: int, seed: int = 0) -> np.ndarray:
    """A uniform first row, then rows drawn in proportion to their weighted squared distance to the nearest chosen.

    ``df`` has id, pos and v, and w (double) if rows have weights, which the first draw ignores.  A draw is one pass that
    sums the mass of each block of positions, and finds its row in the block it falls into; nothing is written.  When all
    mass is gone the lowest positions not yet chosen follow.
    """
    n = df.count()
    chosen = [int(uniform_value(seed, "pp", 0) * n)]
    out = take_rows(df, chosen)
    for i in range(1, k):
        blocks = _mass(df, out).groupBy(F.floor(F.col("pos") / BLOCK).alias("b")).agg(F.sum("m").alias("s")).orderBy("b").collect()
        total = sum(b["s"] for b in blocks)
        want = uniform_value(seed, "pp", i) * total
        if total <= 0:
            pick = next(p for p in range(n + 1) if p not in chosen)
        else:
            for b in blocks:
                if want <= b["s"]:
                    break
                want -= b["s"]
            lo = b["b"] * BLOCK
            rows = _mass(df.where((F.col("pos") >= lo) & (F.col("pos") < lo + BLOCK)), out).orderBy("pos").collect()
            cum = np.cumsum([r["m"] for r in rows])
            pick = rows[min(int(np.searchsorted(cum, want)), len(rows) - 1)]["pos"]
        chosen.append(pick)
        out = np.concatenate([out, take_rows(df, [min(pick, n - 1)])])
    return out


def scalable(df: DataFrame, k: int, factor: float = 1.0, rounds: int | None = None, seed: int = 0) -> np.ndarray:
    """k-means||: rounds of independent draws with chance factor * k * d2 / cost, then weighted k-means++ of the candidates."""
    n = df.count()
    rounds = rounds or (10 if factor <= 0.1 else 5)
    out = take_rows(df, [int(uniform_value(seed, "or", 0) * n)])
    state = df.select("id", "pos", "v", F.lit(float("inf")).alias("d2"))
    new = out
    for r in range(rounds):
        old, state = state, stored(_closer(state, new), "oror")
        discard(old)
        cost = state.agg(F.sum("d2")).first()[0]
        if not cost:
            break
        hit = state.where(uniform(seed, f"or:{r}", "id") < factor * k * F.col("d2") / cost).orderBy("pos").select("v").collect()
        if not hit:
            continue
        new = np.array([h["v"] for h in hit])
        out = np.concatenate([out, new])
    from .assign import classify

    weights = np.zeros(len(out))
    for row in classify(df, out).groupBy("cid").count().collect():
        weights[row["cid"]] = row["count"]
    if len(out) <= k:
        extra = take_rows(df, list(range(min(n, k - len(out))))) if k > len(out) else out[:0]
        return np.concatenate([out, extra])
    chosen = [int(uniform_value(seed, "orpp", 0) * len(out))]
    for i in range(1, k):
        mass = weights * distances(out, out[chosen]).min(1)
        mass[chosen] = 0
        cum = np.cumsum(mass)
        pick = int(np.searchsorted(cum, uniform_value(seed, "orpp", i) * cum[-1])) if cum[-1] > 0 else next(j for j in range(len(out)) if j not in chosen)
        chosen.append(min(pick, len(out) - 1))
    return out[chosen]


def check_finite(c: np.ndarray) -> np.ndarray:
    if not np.isfinite(c).all() or math.prod(c.shape) == 0:
        raise ValueError("initial centroids must be finite and not empty")
    return c
