"""Vector expressions, numpy distance kernels and reproducible uniforms."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vectors(df: DataFrame, id_col: str, *features: str) -> DataFrame:
    """(id, v): v from one array column or from several numeric columns, as doubles."""
    if len(features) == 1 and df.schema[features[0]].dataType.typeName() == "array":
        v = F.col(features[0]).cast("array<double>")
    else:
        v = F.array(*(F.col(f).cast("double") for f in features))
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def validated(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` (id, v) and its dimension; null, non-finite or ragged vectors raise ValueError."""
    bad = F.col("v").isNull() | F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    low, high, wrong = df.agg(F.min(F.size("v")), F.max(F.size("v")), F.sum(bad.cast("int"))).first()
    if wrong or low != high:
        raise ValueError("vectors must be of one length, without nulls and finite")
    return df, high or 0


def sqdist(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance of two array columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def sqnorm(v: Column | str) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)


def uniform(seed: int, tag: str, *keys: Column | str | int) -> Column:
    """U(seed, tag, keys) in [0, 1): the first 52 bits of an md5."""
    parts = [F.lit(f"{seed}:{tag}"), *(F.lit(k) if isinstance(k, int) else (F.col(k) if isinstance(k, str) else k) for k in keys)]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(4503599627370496.0)


def uniform_value(seed: int, tag: str, *keys) -> float:
    """The same number on the driver."""
    return int(hashlib.md5(":".join([f"{seed}:{tag}", *map(str, keys)]).encode()).hexdigest()[:13], 16) / 4503599627370496.0


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances (rows x centroids): a matrix product, made exact where it could decide a tie."""
    shift = c.mean(axis=0)
    a, b = x - shift, c - shift
    d = np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)
    low = d.min(axis=1, keepdims=True)
    near = d <= low + 1e-9 * (1 + low + (a * a).sum(1)[:, None])
    i, j = np.nonzero(near)
    d[i, j] = ((x[i] - c[j]) ** 2).sum(1)
    return d


def matrix(batch, column: str = "v") -> np.ndarray:
    """The (rows, dimension) array of a list column of an Arrow batch."""
    col = batch.column(batch.schema.get_field_index(column))
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)
