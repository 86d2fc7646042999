"""Packed token-id output: best-fit-decreasing packing with a segment tree, written as id matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import tidy

from ._tokens import encoder, piece_starts

ROW = "n_tokens int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, resets array<int>, ids binary"


class CapacityTree:
    """Segment tree over capacities: finds the smallest open capacity of at least a size in O(log capacity)."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.base)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, item: int) -> None:
        self.bins[room].append(item)
        i = room + self.base
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes a bin of the least capacity >= size: (capacity, bin)."""
        i = size + self.base
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.base
        while i:
            self.count[i] -= 1
            i >>= 1
        return room, self.bins[room].pop()


def pack_block(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the items of each sequence, in order."""
    tree, out = CapacityTree(capacity), []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        found = tree.take(sizes[k])
        room, b = found if found else (capacity, len(out))
        if not found:
            out.append([])
        out[b].append(k)
        if room > sizes[k]:
            tree.add(room - sizes[k], b)
    return out


def packed_rows(docs: DataFrame, seq_len: int = 2048, tokenizer: str = "byte_bpe_50k.json", end_id: int | None = 50256, pad_id: int = 50256, block_tokens: int = 2_000_000, tight: float = 0.98) -> DataFrame:
    """Rows ROW, one for each packed sequence of ``docs`` (doc_id, text).

    ids: ``seq_len`` little-endian unsigned 32-bit ids, padded at the end (np.frombuffer and stack give the id matrix);
    cu_seqlens: cumulative segment lengths from 0 to n_tokens; resets: where position ids start again from 0.
    A document longer than seq_len is split without loss into pieces of seq_len, of which the first may be shorter.

    Every task packs what it reads, in blocks of about ``block_tokens``: best-fit decreasing with a segment tree over
    open capacities.  Sequences filled under ``tight`` are taken apart and their pieces join the next block; the last
    block writes all.  No shuffle, and memory is bounded by a block and the longest document.

    Cases: null and empty texts are their end id alone, or, with end_id None, give nothing; repeated rows are packed each
    for itself; null doc_ids stay null; extra columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        enc = encoder(tokenizer)
        held: list[tuple] = []
        held_tokens = 0

        def flush(final: bool):
            nonlocal held, held_tokens
            groups = pack_block([len(x[2]) for x in held], seq_len)
            fills = [sum(len(held[k][2]) for k in g) for g in groups]
            write = [g for g, f in zip(groups, fills, strict=True) if final or f >= tight * seq_len]
            if not final and 2 * len(write) < len(groups):
                write = groups
            cols: list[list] = [[], [], [], [], [], []]
            for g in write:
                ends = np.cumsum([len(held[k][2]) for k in g])
                ids = np.full(seq_len, pad_id, "<u4")
                ids[: ends[-1]] = np.concatenate([held[k][2] for k in g])
                for col, v in zip(cols, (int(ends[-1]), [held[k][0] for k in g], [held[k][1] for k in g], [0, *ends.tolist()], [0, *ends[:-1].tolist()], ids.tobytes()), strict=True):
                    col.append(v)
            gone = {k for g in write for k in g}
            held = [x for k, x in enumerate(held) if k not in gone]
            held_tokens = sum(len(x[2]) for x in held)
            kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["n_tokens", "doc_ids", "pieces", "cu_seqlens", "resets", "ids"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.ids(text.as_py())
                if end_id is not None:
                    ids = np.append(ids, np.uint32(end_id))
                starts = piece_starts(len(ids), seq_len)
                held += [(doc, p, ids[s:e]) for p, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True))]
                held_tokens += len(ids)
                if held_tokens >= block_tokens:
                    yield flush(False)
        if held:
            yield flush(True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run, tokens=True), ROW)


def write_packed(docs: DataFrame, path: str, **params) -> DataFrame:
    """Writes ``packed_rows`` as a Parquet table of binary id rows and returns the table as read back.

    The cases are those of ``packed_rows``; an empty table is written as a table without rows; a path that exists is an error.
    """
    packed_rows(docs, **params).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def position_ids(resets: list[int], n: int) -> np.ndarray:
    """Position ids 0, 1, ... that start again at every reset."""
    at = np.zeros(n, np.int64)
    at[resets] = resets
    return np.arange(n) - np.maximum.accumulate(at)
