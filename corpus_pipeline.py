"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meanfield.llm import line_dedup, minhash_dedup, mixing, packing, toxicity
from meanfield.llm._common import stored


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that score 0.7 or more; the model is fitted on the input and its labels.

    Null and empty texts score as clean ones do; repeated rows go or stay alike; labels of unknown documents teach nothing.
    """
    return toxicity.reject(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines; a document of which only blank lines are left goes, all others stay with what they hold alone.

    Null and empty texts stay; of repeated lines that of the smallest doc_id stays, null last; n_chars follows the text.
    """
    out = line_dedup.dedup_lines(docs)
    out = out.where((F.size("removed") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, a similarity of 0.8 or more.

    That with the smallest doc_id stays, a null one last; documents without words all stay; repeated rows stay once.
    """
    return minhash_dedup.keep_one(docs, shingle=5, percent=80).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Flattens the source shares as far as no source is read more than 1.25 times; every document is read at least once.

    Rows are written in the order of the mixture.  A null source is one of its own; null and empty texts are read once.
    """
    mixed = mixing.mix(docs, max_repeat=1.25, budget="cover")
    return mixed.repartitionByRange("mix_key").sortWithinPartitions("mix_key").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mixture into sequences of at most 1024 tokens; one row for each piece.

    Null and empty texts are their end mark alone; every copy of a repeated row is packed for itself.
    """
    return packing.pack(docs, capacity=1024, end_id=2)


STAGES = [("toxicity", reject_toxic), ("line dedup", dedup_lines), ("near duplicates", near_duplicates), ("mixing", mix_sources), ("packing", pack)]

#: Hashing, tokenization and packing can't be put in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
