"""Fuzzy line deduplication by MinHash over character shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import binary_rows, discard, list_column, maybe_broadcast, spans, stored, text_buffer, tidy
from ._links import link_components
from ._text import _SPACE, band_keys, char_shingles, minhash, odd_sketch, permutations, unique_sets, xor_limit

CHUNK = 2 << 20
#: White space on one side of a line that is taken away byte by byte.
SPACES = 8
LINE = "doc_id long, th long, line_no int, id long, more long, bands array<long>, sketch binary"
#: Place of a null doc_id in the order of documents: last.
LAST = 2**63 - 1


def _lines(data: np.ndarray, offsets: np.ndarray):
    """Starts, ends, text and number of each line; lines end at byte 10."""
    cut = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], cut + 1]), kind="stable")
    ends = np.sort(np.concatenate([cut, offsets[1:]]), kind="stable")
    row = np.repeat(np.arange(len(offsets) - 1), np.searchsorted(cut, offsets[1:]) - np.searchsorted(cut, offsets[:-1]) + 1)
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    return starts, ends, row, np.arange(len(row)) - np.repeat(first, np.diff(np.concatenate([first, [len(row)]])))


def _trimmed(data, starts, ends):
    """Starts and ends without white space on either side; a blank line ends where it starts."""
    lo, hi = starts.copy(), ends.copy()
    for at, step, before in ((lo, 1, 0), (hi, -1, 1)):
        todo = np.flatnonzero(hi > lo)
        for _ in range(SPACES + 1):
            todo = todo[_SPACE[data[at[todo] - before]]]
            at[todo] += step
            todo = todo[hi[todo] > lo[todo]]
        if len(todo):
            return _trimmed_far(data, starts, ends)
    full = hi > lo
    return np.where(full, lo, starts), np.where(full, hi, starts)


def _trimmed_far(data, starts, ends):
    """The same for any amount of white space."""
    inside = np.flatnonzero(~_SPACE[data])
    lo, hi = np.searchsorted(inside, starts), np.searchsorted(inside, ends)
    full, inside = hi > lo, np.append(inside, 0)
    return np.where(full, inside[lo], starts), np.where(full, inside[hi - 1] + 1, starts)


def _line_prints(data, starts, ends) -> np.ndarray:
    """A 128-bit print of each line (lines x 2, int64)."""
    raw = data.tobytes()
    digests = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(digests, np.int64).reshape(-1, 2)


def _line_rows(min_bytes: int, size: int, bands: int, rows: int, bits: int):
    def run(batches):
        mult, add = permutations(bands * rows, 11)
        seen: dict[int, None] = {}
        for batch in batches:
            data, offs = text_buffer(batch.column(2))
            docs, hashes = batch.column(0), batch.column(1)
            for i, j in spans(offs, CHUNK):
                part, at = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                starts, ends, row, number = _lines(part, at)
                use = ends - starts >= min_bytes
                starts, ends = _trimmed(part, starts, ends)
                use &= ends > starts
                starts, ends, row, number = starts[use], ends[use], row[use], number[use]
                prints = _line_prints(part, starts, ends)
                ids = prints[:, 0]
                # lines lately seen in this task need no second signature, and a line of one short shingle equals no other
                fresh = np.zeros(len(ids), bool)
                long = (ends - starts >= size).tolist()
                for k, v in enumerate(ids.tolist()):
                    if long[k] and v not in seen:
                        seen[v] = None
                        fresh[k] = True
                if len(seen) > 500_000:
                    seen.clear()
                sig = minhash(*char_shingles(part, starts[fresh], ends[fresh], size), mult, add)
                keys = band_keys(sig, bands, rows)
                sketch = np.zeros((len(ids), bits // 64), np.uint64)
                sketch[fresh] = odd_sketch(sig, bits)
                cols = [docs.take(pa.array(row + i)), hashes.take(pa.array(row + i)), pa.array(number.astype(np.int32)), pa.array(ids), pa.array(prints[:, 1]), list_column(keys.ravel(), fresh * bands, pa.int64()), binary_rows(sketch)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "line_no", "id", "more", "bands", "sketch"])

    return run


def _wanted(batches):
    """(id, s) of the wanted lines, s the line: rows (text, want), want a list of (line_no, id)."""
    for batch in batches:
        data, offs = text_buffer(batch.column(0))
        want = batch.column(1)
        number, ids = want.flatten().flatten()
        row = np.repeat(np.arange(len(batch)), pc.list_value_length(want).to_numpy())
        cut = np.append(np.flatnonzero(data == 10), len(data))
        first = np.searchsorted(cut, offs[row])  # the line feed after the text's first line, if it has one
        at = first + number.to_numpy()
        starts = np.where(at > first, cut[np.maximum(at - 1, 0)] + 1, offs[row]).tolist()
        ends = np.minimum(cut[at], offs[row + 1]).tolist()
        if len(ids):
            out = [data[a:b].tobytes().strip(b" \t\n\r\v\f") for a, b in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(out, pa.binary())], ["id", "s"])


def _line_sets(size: int):
    """Lines to the rising hashes of their shingles; lines travel, for their sets are eight times as large."""

    def expand(lines: list[bytes]) -> list[np.ndarray]:
        ends = np.cumsum([len(x) for x in lines], dtype=np.int64)
        starts = ends - np.array([len(x) for x in lines], np.int64)
        flat, n = unique_sets(*char_shingles(np.frombuffer(b"".join(lines), np.uint8), starts, ends, size))
        last = np.cumsum(n)
        return [flat[a:b] for a, b in zip((last - n).tolist(), last.tolist(), strict=True)]

    return expand


def dedup_lines(docs: DataFrame, min_bytes: int = 1, shingle: int = 9, percent: int = 85, bands: int = 10, rows: int = 4, bits: int = 128) -> DataFrame:
    """``docs`` (doc_id, text, ...) with lines removed that repeat an earlier line, and n_lines, removed, share.

    Lines end at a line feed; blank lines and lines of under ``min_bytes`` UTF-8 bytes take no part and always stay (1: every
    line that isn't blank takes part).  Lines are compared without white space on either side.  Two lines are linked if
    their sets of ``shingle``-byte shingles have a Jaccard similarity of at least percent / 100; a line shorter than a
    shingle is linked to its equals only.  Of each component of linked or equal lines one stays: that with the smallest
    (doc_id, text hash, line number).

    Method: MinHash signatures over character shingles, ``bands`` bands of ``rows`` values (a pair at 0.85 is found with
    a chance of 1 - (1 - 0.85 ** 4) ** 10 = 0.9994), exact Jaccard checks on the full sets, and distributed union-find.
    Equal lines are one vertex, known by a 128-bit print of which the first half is its id; should other lines have the
    same half, all but one of them take the second half instead.  A line in a very large document is read whole.

    n_lines: lines of the text; removed: numbers (from 0, rising) of those removed, never null; share: bytes of removed
    lines over bytes of the text.  Cases: null and empty text stay as they are; repeated rows (equal doc_id and text)
    are one document and stay alike; a null doc_id sorts last; other columns, whatever their names, pass through, except
    that n_lines, removed and share are replaced; an empty table gives an empty result.
    """
    docs = docs.drop("n_lines", "removed", "share")
    # the row as it came is one column, so that names in it can't clash with those below
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64("text", F.col("doc_id").isNull()).alias("th"), F.col("text").cast("string").alias("text")]
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), *key)
    slim = docs.select(*key)
    lines = stored(slim.mapInArrow(tidy(_line_rows(min_bytes, shingle, bands, rows, bits)), LINE), "line-sig", hashes=True)

    def classed() -> DataFrame:
        at = F.min(F.struct("doc_id", "th", "line_no")).alias("at")
        return stored(lines.groupBy("id").agg(at, F.count("*").alias("n"), F.min("more").alias("least"), F.max("more").alias("most")), "line-class", hashes=True)

    classes = classed()
    tables = [lines, classes]
    clash = classes.where("least <> most").select("id", "least")
    if not clash.isEmpty():
        other = F.col("more") != F.col("least")  # null where no line clashes
        lines = lines.join(maybe_broadcast(clash), "id", "left").withColumn("id", F.when(other, F.col("more")).otherwise(F.col("id"))).drop("least")
        classes = classed()
        tables.append(classes)
    sigs = lines.where(F.size("bands") > 0).select("id", "bands", "sketch")

    def fetch(ids: DataFrame) -> DataFrame:
        want = classes.join(maybe_broadcast(ids), "id", "left_semi").groupBy("at.doc_id", "at.th").agg(F.collect_list(F.struct("at.line_no", "id")).alias("want"))
        tables.append(stored(want, "line-want"))
        want = maybe_broadcast(tables[-1], items="want")
        return slim.join(want, ["doc_id", "th"]).select("text", "want").mapInArrow(tidy(_wanted), "id long, s binary")

    comp = link_components(sigs, xor_limit(bands * rows, bits, percent / 100), percent, fetch, _line_sets(shingle))
    linked = classes.join(maybe_broadcast(comp), "id").select("id", "at", "component")
    first = maybe_broadcast(stored(linked.groupBy("component").agg(F.min("at").alias("first")), "line-first"))
    stays = linked.join(first, "component").select("id", F.col("first").alias("at"))
    stays = stored(stays.unionByName(classes.where("n > 1").join(maybe_broadcast(comp.select("id")), "id", "left_anti").select("id", "at")), "line-stays")
    gone = lines.select("doc_id", "th", "line_no", "id").join(maybe_broadcast(stays), "id").where(F.struct("doc_id", "th", "line_no") != F.col("at"))
    gone = stored(gone.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("line_no")).alias("gone")), "line-gone")
    for table in (*tables, stays):
        discard(table)

    out = whole.join(maybe_broadcast(gone, items="gone"), ["doc_id", "th"], "left")

    def rest(lines):
        at = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.array_join(F.transform(at, lambda i: F.get(lines, i)), "\n")

    # the text is split once, as the variable of a function: an expression within another's would be run for each line
    kept = F.get(F.transform(F.array(F.split("text", "\n", -1)), rest), F.lit(0))
    size = F.octet_length("text")
    out = out.withColumn("left", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(size - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    share = F.when(F.col("gone").isNull() | (size == 0), 0.0).otherwise((size - F.octet_length("left")) / size)
    return out.select(
        *(F.col("left").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns),
        n_lines.alias("n_lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("removed"), share.alias("share"),
    )
