"""Best-fit packing of documents into sequences, certified by dual feasible functions."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import parts, stored, tidy
from ._tokens import encoder, piece_starts

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: bin and offset of each item, and the number of bins.

    The open capacities are the set bits of one integer, so the tightest bin is found by a shift.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offs = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, count = 0, 0
    for k, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fit = mask >> size
        if fit:
            room = size + ((fit & -fit).bit_length() - 1)
            b = open_[room].pop()
            if not open_[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, count
            count += 1
        bins[k], offs[k] = b, capacity - room
        room -= size
        if room:
            open_[room].append(b)
            mask |= 1 << room
    return bins, offs, count


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The largest bound on the number of bins that dual feasible functions give.

    For every threshold e: U(e) rounds items over capacity - e up to a whole bin and drops those under e.  Composed with
    u(k), which rounds (k + 1) * x / capacity down to a k-th of a bin.
    """
    if not len(sizes):
        return 0
    x, n = np.unique(sizes, return_counts=True)
    best = -(-int((x * n).sum()) // capacity)
    for e in range(1, capacity // 2 + 1):
        y = np.where(x > capacity - e, capacity, np.where(x < e, 0, x))
        best = max(best, -(-int((y * n).sum()) // capacity))
        if e == 1 or e % 16 == 0:
            for k in range(1, 21):
                exact = (k + 1) * y % capacity == 0
                z = np.where(exact, y * k, (k + 1) * y // capacity * capacity)
                best = max(best, -(-int((z * n).sum()) // (capacity * k)))
    return best


def token_pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int | None) -> DataFrame:
    """Rows PIECE: the pieces of each document (doc_id, text), in one pass and without a shuffle."""

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.ids(text.as_py())
                if end_id is not None:
                    ids = np.append(ids, np.uint32(end_id))
                raw = memoryview(ids.astype("<u4").tobytes())
                starts = piece_starts(len(ids), capacity) or [0]
                for p, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    for col, v in zip(rows, (doc, p, s, e - s, zlib.crc32(raw[4 * s : 4 * e])), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run, tokens=True), PIECE)


def _pack_group(capacity: int):
    def run(key, table):
        bins, offs, count = best_fit(table["length"].to_numpy(), capacity)
        fill = np.bincount(bins, weights=table["length"].to_numpy(), minlength=count).astype(np.int64)
        bound = lower_bound(table["length"].to_numpy(), capacity)
        g = key[0].as_py()
        out = table.drop_columns(["g"])
        for name, col in (("sequence_id", (g << 24) + bins), ("offset", offs), ("gap", capacity - fill[bins]), ("surplus", np.full(len(bins), count - bound)), ("bins", np.where(offs == 0, 1, 0))):
            out = out.append_column(name, pa.array(col.astype(np.int64)))
        return out

    return run


def pack(docs: DataFrame, capacity: int = 1024, tokenizer: str = "byte_bpe_50k.json", end_id: int | None = 2, group: int = 50_000, rounds: int = 3) -> DataFrame:
    """Packs the documents of ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns PIECE plus sequence_id long and offset long for each piece.  A document's ids are followed by ``end_id``;
    only longer documents are cut, into pieces of ``capacity`` of which the first may be shorter.  A piece's offset is its
    place in its sequence; pieces lie there without gaps.

    Method: whole pieces have a sequence each.  The rest is dealt by hash over partitions of about ``group`` pieces; each
    is packed by best-fit decreasing and its bin count held against dual-feasible-function lower bounds.  A partition
    that reaches its bound is certified and stays.  From the others, the documents of sequences with gaps are exchanged:
    they are dealt anew over fewer partitions and best-fit decreasing runs again; a round counts only if it saves
    sequences, and the rounds end when none is saved, everything is certified or ``rounds`` are over.

    Cases: null text counts as empty, and an empty document is its end id alone (with end_id None, a piece of length 0
    at offset 0 of some sequence); repeated rows and doc_ids are packed each for itself; null doc_ids pass through;
    extra columns are ignored; an empty table gives an empty result.
    """
    pieces = stored(token_pieces(docs, capacity, tokenizer, end_id), "pack-pieces")
    whole = pieces.where(F.col("length") == capacity).withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(1 << 62)).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.where(F.col("length") < capacity)
    schema = f"{PIECE}, sequence_id long, offset long, gap long, surplus long, bins long"

    def run(rows: DataFrame, n: int, k: int) -> DataFrame:
        # rows are of a written table, so a row keeps its number; by it repeated rows are spread like any others
        g = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id(), F.lit(k)), F.lit(parts(n, group))) + F.lit(k << 32)
        return stored(rows.select(*pieces.columns, g.alias("g")).groupBy("g").applyInArrow(_pack_group(capacity), schema), "pack-round")

    done, packed = [], run(rest, rest.count(), 0)
    loose = (F.col("surplus") > 0) & (F.col("gap") > 0)
    for k in range(1, rounds + 1):
        n, had = packed.where(loose).agg(F.count("*"), F.sum("bins")).first()
        if not n:
            break
        again = run(packed.where(loose), n, k)
        if again.agg(F.sum("bins")).first()[0] >= had:
            break
        done.append(packed.where(~loose))
        packed = again
    done.append(packed)
    out = whole
    for packed in done:
        out = out.unionByName(packed.select(*whole.columns))
    return out
