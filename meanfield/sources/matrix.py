"""The compact binary matrix formats: datasets, centroids, classes, permutations and column statistics.

A dataset file is int32 rows, int32 columns and row-major float32 values, little-endian.  ``spark.read.format("fbin")``
reads it by ranges of rows, one partition each; ``save_dataset`` writes it, each task its own rows.  These formats are single
files with places fixed by row number, so they are read and written with plain file calls: paths must be on a file system
that the driver and all executors share.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEADER = 8


class Rows(InputPartition):
    def __init__(self, start: int, count: int):
        self.start, self.count = start, count


def row_blocks(n: int, parts: int) -> list[tuple[int, int]]:
    """(start, count) of contiguous blocks, the larger first."""
    sizes = [n // parts + (i < n % parts) for i in range(parts)]
    return [(sum(sizes[:i]), s) for i, s in enumerate(sizes) if s]


class MatrixReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.parts = options["path"].removeprefix("file://"), int(options.get("partitions", 8))

    def partitions(self):
        n, _ = np.fromfile(self.path, "<i4", 2)
        return [Rows(*b) for b in row_blocks(int(n), self.parts)] or [Rows(0, 0)]

    def read(self, partition):
        _, d = np.fromfile(self.path, "<i4", 2).tolist()
        for lo in range(0, partition.count, 1024):
            rows = min(1024, partition.count - lo)
            start = partition.start + lo
            x = np.fromfile(self.path, "<f4", rows * d, offset=HEADER + 4 * d * start).reshape(rows, d)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + rows)), pa.array(list(x), pa.list_(pa.float32()))], ["pos", "v"])


class MatrixSource(DataSource):
    @classmethod
    def name(cls):
        return "fbin"

    def schema(self):
        return "pos long, v array<float>"

    def reader(self, schema):
        return MatrixReader(self.options)


def read_dataset(spark: SparkSession, path: str, partitions: int = 8) -> DataFrame:
    """(pos, v)."""
    spark.dataSource.register(MatrixSource)
    return spark.read.format("fbin").option("partitions", partitions).load(path)


def _create(path: str, header: list[int], size: int) -> str:
    """A file of ``size`` bytes that begins with ``header``; rows are written into it in place."""
    path = path.removeprefix("file://")
    os.makedirs(os.path.dirname(path) or ".", 0o755, exist_ok=True)
    with open(path, "wb") as f:
        f.write(np.array(header, "<i4").tobytes())
        f.truncate(size)
    return path


def _write_rows(df: DataFrame, path: str, offset: int, width: int, values) -> None:
    """Every task writes its rows (pos, ...) to their places, neighbours together; doing so again changes nothing.

    values: the rows' little-endian bytes of a batch, ``width`` each.
    """

    def run(batches):
        with open(path, "r+b") as f:
            for batch in batches:
                pos, raw = batch.column(0).to_numpy(), memoryview(values(batch))
                cut = [0, *(np.flatnonzero(np.diff(pos) != 1) + 1).tolist(), len(pos)]
                for i, j in zip(cut, cut[1:], strict=False):
                    if j > i:
                        f.seek(offset + int(pos[i]) * width)
                        f.write(raw[i * width : j * width])
        yield pa.RecordBatch.from_arrays([pa.array([0])], ["done"])

    df.mapInArrow(run, "done long").write.format("noop").mode("overwrite").save()


def save_dataset(df: DataFrame, path: str) -> None:
    """Writes (pos, v), pos counting from 0 without gaps; vectors of several lengths raise ValueError.

    The driver makes the file and the tasks write their rows into it, sorted within each task, so no row passes the driver.
    """
    n, low, high = df.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if low != high:
        raise ValueError("vectors must be of one length")
    d = high or 0
    path = _create(path, [n, d], HEADER + 4 * d * n)
    flat = lambda batch: batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes()
    _write_rows(df.select("pos", "v").sortWithinPartitions("pos"), path, HEADER, 4 * d, flat)


def save_centroids(c: np.ndarray, path: str, double: bool = False) -> None:
    os.makedirs(os.path.dirname(path) or ".", 0o755, exist_ok=True)
    with open(path, "wb") as f:
        f.write(np.array(c.shape, "<i4").tobytes() + c.astype("<f8" if double else "<f4").tobytes())


def load_centroids(path: str, k: int | None = None, dim: int | None = None) -> np.ndarray:
    """The width of the values follows from the file's length; another k or dimension raises ValueError."""
    rows, d = np.fromfile(path, "<i4", 2).tolist()
    if (k is not None and rows != k) or (dim is not None and d != dim):
        raise ValueError(f"{path} holds {rows} x {d} centroids")
    wide = os.path.getsize(path) - HEADER == 8 * rows * d
    return np.fromfile(path, "<f8" if wide else "<f4", rows * d, offset=HEADER).reshape(rows, d).astype(np.float64)


def save_classes(assigned: DataFrame, path: str) -> None:
    """Writes the classes of (pos, cid); they count from 1 in the file, which the tasks fill as in ``save_dataset``."""
    n = assigned.count()
    path = _create(path, [n], 4 + 4 * n)
    plus = lambda batch: (batch.column(1).to_numpy().astype("<i4") + 1).astype("<i4").tobytes()
    _write_rows(assigned.select("pos", "cid").sortWithinPartitions("pos"), path, 4, 4, plus)


def load_classes(spark: SparkSession, path: str) -> DataFrame:
    """(pos, cls), classes from 0."""
    cls = np.fromfile(path, "<i4", offset=4) - 1
    return spark.createDataFrame(pa.table({"pos": np.arange(len(cls)), "cls": cls}))


def save_permutation(perm: list[int], path: str) -> None:
    np.array(perm, "<i4").tofile(path)


def load_permutation(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst)."""
    perm = np.fromfile(path, "<i4")
    return spark.createDataFrame(pa.table({"src": np.arange(len(perm), dtype=np.int32), "dst": perm}))


def save_stats(stats: np.ndarray, path: str) -> None:
    """Rows: original means, original deviations, means, deviations."""
    with open(path, "wb") as f:
        f.write(np.array([stats.shape[1]], "<i4").tobytes() + stats.astype("<f4").tobytes())


def load_stats(path: str) -> np.ndarray:
    (d,) = np.fromfile(path, "<i4", 1)
    return np.fromfile(path, "<f4", 4 * d, offset=4).reshape(4, d)
