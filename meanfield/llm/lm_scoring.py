"""Language-model scores by stupid backoff over n-gram tables dealt by hash."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import parts, text_buffer, tidy
from ._text import _BASE, _BYTE, _LOWER, U64, mix64, rising, word_hashes

#: Bytes of text and documents of a batch on average, at most.
BATCH_BYTES, BATCH_DOCS = 12 << 20, 1 << 18
#: Bytes of text that a task packs at a time.
CHUNK = 16 << 20


def _deal():
    """Rows (batch, docs): rows (batch, doc_id, text) of about CHUNK bytes at a time, those of a batch as one compressed value."""
    kind = pa.schema([("doc_id", pa.int64()), ("text", pa.large_string())])
    def packed(batches):
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
        table = pa.Table.from_batches(batches)
        number = table["batch"].to_numpy()
        order = np.argsort(number, kind="stable")
        cut = np.flatnonzero(np.diff(number[order], prepend=-1))
        table = table.select(["doc_id", "text"]).cast(kind).take(pa.array(order)).combine_chunks()
        out = []
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kind, options=options) as w:
                w.write_table(table.slice(i, j - i))
            out.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(number[order][cut]), pa.array(out, pa.binary())], ["batch", "docs"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > CHUNK:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return run


def _documents(values: pa.ChunkedArray, unit: str):
    """Ids of the documents in packed values, hashes of their symbols, A-Z as a-z, and each document's offsets into these."""
    ids, symbols, lengths = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for value in values:
        table = pa.ipc.open_stream(value.as_buffer()).read_all()
        ids.append(table["doc_id"])
        data, offsets = text_buffer(table["text"])
        if unit == "words":
            found, offsets = word_hashes(data, offsets)
        else:
            found = mix64(_BYTE[_LOWER[data]])
        symbols.append(found)
        lengths.append(np.diff(offsets))
    lengths = np.concatenate(lengths)
    return pa.chunked_array([c for x in ids for c in x.chunks], pa.int64()), np.concatenate(symbols), lengths


def _grams(symbols: np.ndarray, lengths: np.ndarray, order: int):
    """Of each order from 0: for every symbol the 64-bit hash of the gram that ends there, and of the one that ends before it.

    Before a text's start stand ``order`` marks; a gram of order k ends in the gram of order k - 1 that ends there.
    """
    at = np.arange(len(symbols)) + order * (np.repeat(np.arange(len(lengths)), lengths) + 1)
    padded = np.zeros(len(symbols) + order * len(lengths), np.uint64)
    padded[at] = symbols
    h = np.zeros(len(padded), np.uint64)
    for k in range(order + 1):
        if k:
            h[1:] = h[:-1].copy()
            h = mix64(h * U64(_BASE) + padded + U64(k))
        yield k, h[at], h[at - 1]


def _distinct(k: int, order: int, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The rising hashes of the grams of order k that a batch asks for."""
    return rising(ends) if k == order else rising(np.concatenate([rising(ends), rising(before)]))


def _counted(values: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """How often each of the rising ``values`` stands in ``hashes``, which hold no others."""
    found, n = np.unique(hashes, return_counts=True)
    out = np.zeros(len(values), np.int64)
    out[np.searchsorted(values, found)] = n
    return out


def _looked_up(hashes: np.ndarray, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The count of each hash, from those of the rising ``values``; hashes are put in order first, so that no search is at random."""
    order = np.argsort(hashes)
    rising = hashes[order]
    new = np.ones(len(rising), bool)
    new[1:] = rising[1:] != rising[:-1]
    found = counts[np.searchsorted(values, rising[new])]
    out = np.empty(len(hashes), counts.dtype)
    out[order] = found[np.cumsum(new) - 1]
    return out


def _narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def _pack(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def _unpack(data: pa.Buffer, kind) -> np.ndarray:
    n, width = int.from_bytes(data.slice(0, 8).to_pybytes(), "little"), np.dtype(kind).itemsize
    raw = pa.Codec("zstd").decompress(data.slice(8), n * width)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).ravel()


def _cuts(values: np.ndarray, count: int) -> np.ndarray:
    """Ends of the ``count`` ranges of hashes in rising hashes."""
    edges = np.array([(p << 64) // count for p in range(1, count)], np.uint64)
    return np.concatenate([[0], np.searchsorted(values, edges), [len(values)]]).astype(np.int64)


def _explode(order: int, unit: str, count: int):
    """Rows (batch, p, h, n, m): a batch's distinct grams in hash range p, how often each ends at a symbol and stands before one."""

    def run(key, table):
        _, symbols, lengths = _documents(table["docs"], unit)
        rows: list[tuple] = [([], [], []) for _ in range(count)]
        for k, ends, before in _grams(symbols, lengths, order):
            values = _distinct(k, order, ends, before)
            n, m = _counted(values, ends), (_counted(values, before) if k < order else np.zeros(len(values), np.int64))
            cuts = _cuts(values, count).tolist()
            for p, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                for col, x in zip(rows[p], (values, n, m), strict=True):
                    col.append(x[i:j])
        cols: list[list] = [[], [], [], []]
        for p, parts_ in enumerate(rows):
            h, n, m = (np.concatenate(x) for x in parts_)
            if len(h):
                # rising hashes travel as differences
                for col, x in zip(cols, (p, _pack(np.diff(h, prepend=U64(0))), _pack(n), _pack(m)), strict=True):
                    col.append(x)
        return pa.table([pa.array([key[0].as_py()] * len(cols[0]), pa.int64()), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["batch", "p", "h", "n", "m"])

    return run


def _total(key, table):
    """Rows (batch, p, n, m) of a hash range with the counts over all batches, in each batch's order."""
    asked = [np.cumsum(_unpack(x.as_buffer(), np.uint64), dtype=np.uint64) for x in table["h"]]
    values = rising(np.concatenate(asked))
    asked = [np.searchsorted(values, x) for x in asked]
    cols = []
    for name in ("n", "m"):
        sums = np.zeros(len(values), np.int64)
        for at, x in zip(asked, table[name], strict=True):
            sums[at] += _unpack(x.as_buffer(), np.int64)  # a batch names a gram once
        cols.append(pa.array([_pack(sums[at]) for at in asked], pa.binary()))
    return pa.table([table["batch"], table["p"], *cols], ["batch", "p", "n", "m"])


def _sum(order: int, unit: str, count: int, min_count: int, backoff: float):
    def run(key, docs, table):
        ids, symbols, lengths = _documents(docs["docs"], unit)
        values = [_distinct(k, order, ends, before) for k, ends, before in _grams(symbols, lengths, order)]
        cuts = [_cuts(v, count) for v in values]
        # of each order the answers' parts, by range
        answers: list[list] = [[] for _ in range(order + 1)]
        for row in table.sort_by("p").to_batches():
            for p, n, m in zip(row["p"].to_pylist(), row["n"], row["m"], strict=True):
                n, m, i = _unpack(n.as_buffer(), np.int64), _unpack(m.as_buffer(), np.int64), 0
                for k, c in enumerate(cuts):
                    j = i + int(c[p + 1] - c[p])
                    answers[k].append((_narrow(n[i:j]), _narrow(m[i:j])))
                    i = j
        lp, context = np.zeros(len(symbols)), None
        for k, ends, before in _grams(symbols, lengths, order):
            n, m = (np.concatenate([x[i] for x in answers[k]] or [np.zeros(0, np.uint8)]) for i in (0, 1))
            if k:
                c = _looked_up(ends, values[k], n)
                use = c >= (min_count if k > 1 else 1)
                lp[use] = np.log(c[use].astype(np.float64) / context[use]) + (order - k) * math.log(backoff)
            context = _looked_up(before, values[k], m) if k < order else None
            answers[k] = values[k] = None
        total = np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=lp, minlength=len(lengths))
        return pa.table({"doc_id": ids, "n_symbols": pa.array(lengths.astype(np.int64)), "log_prob": pa.array(total.astype(np.float64))})

    return run


def score(docs: DataFrame, order: int = 5, min_count: int = 2, backoff: float = 0.4, unit: str = "words") -> DataFrame:
    """doc_id, n_symbols, log_prob, mean_log_prob, perplexity for each row of ``docs`` (doc_id, text).

    A stupid-backoff language model over symbols, learned from all of ``docs``: the words of a text (``unit`` "words",
    runs between white space) or its bytes, A-Z as a-z, all others apart.  A symbol's log score is log(count / context
    count) at the highest order at which its gram occurs ``min_count`` times, plus log(backoff) for each order below; at
    order 1 every count will do.  A context's count is the sum over its continuations; marks stand before a text's start.

    Method: documents are dealt by hash over batches of about BATCH_BYTES of text and travel there compressed.  A batch sends
    its distinct grams of every order, known by 64-bit hashes, with their counts to the tasks of their hash ranges, each
    once; these add the counts up and answer every batch in its order, without hashes.  Scores are summed per document.

    Cases: null and empty texts have no symbols, log_prob 0 and null mean_log_prob and perplexity; repeated rows score
    alike and meet in one batch; null doc_ids pass through; a very long text is scored whole; extra columns are ignored; an empty table gives
    an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text").cast("long"))).first()
    n = max(parts(rows, BATCH_DOCS), parts(size or 0, BATCH_BYTES))
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("batch"), "doc_id", "text")
    dealt = dealt.mapInArrow(tidy(_deal()), "batch long, docs binary")
    grams = dealt.groupBy("batch").applyInArrow(_explode(order, unit, n), "batch long, p int, h binary, n binary, m binary")
    totals = grams.groupBy("p").applyInArrow(_total, "batch long, p int, n binary, m binary")
    summed = dealt.groupBy("batch").cogroup(totals.groupBy("batch")).applyInArrow(_sum(order, unit, n, min_count, backoff), "doc_id long, n_symbols long, log_prob double")
    mean = F.when(F.col("n_symbols") > 0, F.col("log_prob") / F.col("n_symbols"))
    return summed.withColumn("mean_log_prob", mean).withColumn("perplexity", F.exp(-mean))
