"""MinHash near-duplicate detection with odd sketches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import binary_rows, list_column, maybe_broadcast, spans, stored, text_buffer, tidy
from ._links import link_components
from ._text import band_keys, minhash, odd_sketch, permutations, set_prints, unique_sets, word_hashes, word_shingles, xor_limit

CHUNK = 4 << 20
#: A byte of a word.
WORD = r"[^\x20\x09-\x0D]"
SIG = "doc_id long, th long, n_shingles long, p0 long, p1 long, bands array<long>, sketch binary"


def _sets(data, offsets, size):
    words, woffs = word_hashes(data, offsets)
    return unique_sets(*word_shingles(words, woffs, size))


def _signatures(size: int, bands: int, rows: int, samples: int, bits: int):
    def run(batches):
        mult, add = permutations(samples, 7)
        for batch in batches:
            data, offs = text_buffer(batch.column(2))
            for i, j in spans(offs, CHUNK):
                flat, n = _sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], size)
                bounds = np.concatenate([[0], np.cumsum(n)])
                sig = minhash(flat, bounds, mult, add)
                keys, prints = band_keys(sig, bands, rows), set_prints(flat, n)
                full = n > 0
                cols = [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n), pa.array(prints[:, 0]), pa.array(prints[:, 1]), list_column(keys[full].ravel(), full * bands, pa.int64()), binary_rows(odd_sketch(sig, bits))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "n_shingles", "p0", "p1", "bands", "sketch"])

    return run


def _full_sets(size: int):
    def run(batches):
        for batch in batches:
            data, offs = text_buffer(batch.column(1))
            for i, j in spans(offs, CHUNK):
                flat, n = _sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], size)
                ends = np.cumsum(n) * 8
                raw = flat.tobytes()
                col = pa.array([raw[e - 8 * k : e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), col], ["id", "s"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = 3, percent: int = 85, bands: int = 16, rows: int = 4, samples: int = 128, bits: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text).

    A document's set is its distinct ``shingle``-word shingles, lower-cased in A-Z; a document with fewer words has its
    whole sequence as one shingle.  Documents are linked if 100 * intersection >= percent * union.

    Method: ``samples`` MinHash values; the first bands * rows give band keys, all of them are folded into an odd sketch
    of ``bits`` parity bits.  The XOR population count of two sketches estimates their similarity; pairs that share a band
    and look similar enough (five deviations of slack) are checked on their full sets, and components follow by
    distributed union-find.  Equal sets are one vertex.  At the threshold a pair misses all bands with a chance of
    (1 - 0.85 ** 4) ** 16 = 8e-6.

    Cases: null or wordless text has the empty set and links with nothing (component_id = doc_id, kept); ties go to the
    smallest doc_id; repeated rows share component and flag; a null doc_id has its copies' component and isn't kept, or,
    with no copies, a null component and is kept; of several texts under one doc_id any may stand for it in its links.  Extra columns are ignored; an empty table gives an empty result.
    """
    return _labelled(docs, shingle, percent, bands, rows, samples, bits).drop("th")


def _labelled(docs: DataFrame, shingle: int = 3, percent: int = 85, bands: int = 16, rows: int = 4, samples: int = 128, bits: int = 512) -> DataFrame:
    """What ``near_duplicates`` returns, and th, the text's hash."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    sigs = stored(docs.mapInArrow(tidy(_signatures(shingle, bands, rows, samples, bits)), SIG), "near-sig")
    full = sigs.where("n_shingles > 0")
    classes = stored(full.groupBy("n_shingles", "p0", "p1").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "near-class")
    reps = full.join(classes.select("n_shingles", "p0", "p1", F.col("rep").alias("doc_id")), ["n_shingles", "p0", "p1", "doc_id"], "left_semi")
    reps = reps.select(F.col("doc_id").alias("id"), "bands", "sketch")

    def fetch(ids: DataFrame) -> DataFrame:
        ids = maybe_broadcast(ids.select(F.col("id").alias("doc_id")))
        return docs.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(tidy(_full_sets(shingle)), "id long, s binary")

    comp = link_components(reps, xor_limit(samples, bits, percent / 100), percent, fetch)
    linked = classes.join(maybe_broadcast(comp.select(F.col("id").alias("rep"), "component")), "rep", "left").where("copies > 1 or component is not null")
    linked = stored(linked.select("n_shingles", "p0", "p1", F.coalesce("component", "rep").alias("component"), F.lit(True).alias("linked")), "near-linked")
    out = full.select("doc_id", "th", "n_shingles", "p0", "p1").join(maybe_broadcast(linked), ["n_shingles", "p0", "p1"], "left")
    out = out.select("doc_id", "th", "n_shingles", F.when(F.col("linked"), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    out = out.unionByName(sigs.where("n_shingles = 0").select("doc_id", "th", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, once each: one document of every group.

    Rows without words all stay.  A row is known by its doc_id, null included, and its text: of rows that repeat both one
    stays, and of several texts under one doc_id each goes or stays for itself.  All columns pass through, and the method
    and the other cases are those of ``near_duplicates``.
    """
    gone = _labelled(docs, **params).where("not kept").select(F.col("doc_id").alias("_gone"), F.col("th").alias("_text")).distinct()
    gone = maybe_broadcast(stored(gone, "near-gone"))
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"))
    out = row.join(gone, F.col("id").eqNullSafe(F.col("_gone")) & (F.col("th") == F.col("_text")), "left_anti")
    again = stored(row.groupBy("id", "th").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("_again"), F.col("th").alias("_text")), "near-again")
    if again.isEmpty():
        return out.select("row.*")
    same = F.col("id").eqNullSafe(F.col("_again")) & (F.col("th") == F.col("_text"))
    again = maybe_broadcast(again)
    twice = out.join(again, same, "left_semi").withColumn("blank", ~F.coalesce(F.col("row.text").cast("string"), F.lit("")).rlike(WORD))
    once = twice.where("not blank").dropDuplicates(["id", "th"])
    return out.join(again, same, "left_anti").select("row.*").unionByName(once.select("row.*")).unionByName(twice.where("blank").select("row.*"))
