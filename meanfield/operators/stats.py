"""Column statistics and standardization."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meanfield.functions.vectors import matrix


def column_stats(df: DataFrame) -> DataFrame:
    """(j, lo, hi, mean, std, var): std is that of the sample.  A task sends one row for each column."""

    def parts(batches):
        total = None
        for batch in batches:
            if len(batch):
                x = matrix(batch)
                mean = x.mean(0)
                new = np.stack([np.full(x.shape[1], len(x), float), x.min(0), x.max(0), mean, ((x - mean) ** 2).sum(0)])
                if total is not None:
                    n, gap = total[0] + new[0], new[3] - total[3]
                    square = total[4] + new[4] + gap**2 * total[0] * new[0] / n
                    new = np.stack([n, np.minimum(total[1], new[1]), np.maximum(total[2], new[2]), total[3] + gap * new[0] / n, square])
                total = new
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.shape[1], dtype=np.int32)), *(pa.array(row) for row in total)], ["j", "n", "lo", "hi", "mean", "square"])

    rows = df.select("v").mapInArrow(parts, "j int, n double, lo double, hi double, mean double, square double")
    all_ = rows.groupBy("j").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_list(F.struct("n", "mean", "square")).alias("parts"))  # one for each task
    mean = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["n"] * p["mean"]) / F.col("n")
    square = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["square"] + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")))
    var = F.when(F.col("n") > 1, F.col("square") / (F.col("n") - 1))
    all_ = all_.withColumn("mean", mean).withColumn("square", square).withColumn("var", var)
    return all_.select("j", "lo", "hi", "mean", F.sqrt("var").alias("std"), "var")


def standardized(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(id, j, z); a column without variance gives null."""
    x = df.select("id", F.posexplode("v").alias("j", "x")).join(F.broadcast(stats), "j")  # one row for each column
    return x.select("id", "j", F.when(F.col("std") > 0, (F.col("x") - F.col("mean")) / F.col("std")).alias("z"))


def destandardized(z: DataFrame, stats: DataFrame) -> DataFrame:
    """(id, j, x)."""
    return z.join(F.broadcast(stats), "j").select("id", "j", (F.col("z") * F.col("std") + F.col("mean")).alias("x"))


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.sum(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)).alias("total"))
