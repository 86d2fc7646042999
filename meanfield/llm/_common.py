"""Session, storage and Arrow helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import _tokens

#: Largest side, in rows, that an operator broadcasts after counting it.
BROADCAST_ROWS = 500_000
#: Elements that all lists of a broadcast side may hold together.
BROADCAST_ITEMS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none (tests on one machine), a folder under /tmp.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/meanfield/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str, hashes: bool = False) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it: cuts the lineage.

    A plain table survives lost executors; nothing is kept in executor memory.
    hashes: the columns hold hardly any value twice, so the writer doesn't try dictionaries.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(not hashes).lower()).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._meanfield_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table made by ``stored`` that no later plan reads."""
    path = getattr(df, "_meanfield_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(jpath, True)


def maybe_broadcast(df: DataFrame, items: str | None = None) -> DataFrame:
    """Marks ``df`` for broadcast if it has at most ``BROADCAST_ROWS`` rows; otherwise the join shuffles.

    items: a list column of ``df``, whose lists may hold at most ``BROADCAST_ITEMS`` elements together.
    """
    from pyspark.sql import functions as F

    n, held = df.agg(F.count("*"), F.sum(F.size(items)) if items else F.lit(0)).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and (held or 0) <= BROADCAST_ITEMS else df


def _release() -> None:
    """Gives free memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library; only its habits differ


def tidy(run, tokens: bool = False):
    """A function for mapInArrow that leaves no free memory behind: workers stay alive, idle, between stages.

    tokens: ``run`` encodes texts; a worker that runs any other function forgets the vocabularies it has loaded.
    """

    def tidied(batches):
        if not tokens:
            _tokens.forget()
        _release()
        try:
            yield from run(batches)
        finally:
            _release()

    return tidied


def parts(rows: int, each: int) -> int:
    """Number of groups of about ``each`` rows."""
    return max(1, -(-int(rows) // int(each)))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, and n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :]
    lo, hi = int(offs[0]), int(offs[-1])
    raw = np.frombuffer(data, np.uint8, hi) if data is not None and hi else np.zeros(0, np.uint8)
    return raw[lo:hi], offs - lo


def spans(offsets: np.ndarray, limit: int):
    """Yields (first, last) row ranges whose bytes total about ``limit``; a longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def list_column(values: np.ndarray, lengths: np.ndarray, kind) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offs = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, kind))


def binary_rows(matrix: np.ndarray) -> pa.Array:
    """A binary column with the bytes of each row of ``matrix``."""
    matrix = np.ascontiguousarray(matrix)
    n, width = matrix.shape[0], matrix.dtype.itemsize * int(np.prod(matrix.shape[1:]))
    offs = (np.arange(n + 1, dtype=np.int64) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(matrix.tobytes())])
