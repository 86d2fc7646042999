"""The registered queries of the corpus operators, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, line_dedup, lm_scoring, media, minhash_dedup, mixing, packing, token_output, toxicity, warc
from ._common import shared_dir, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), capacity=1024, end_id=2)


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"), max_repeat=2.0, budget="all")
    return out.select("doc_id", "source", "epoch", "mix_key", "tokens")


def op3_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op4_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_table(spark, sf_dir, "documents"), order=3, unit="words")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_output.write_packed(_table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/op5-{uuid.uuid4().hex[:12]}", seq_len=2048)
    return rows.select("n_tokens", "doc_ids", "pieces", "cu_seqlens", "resets", F.octet_length("ids").alias("ids_bytes"), F.crc32("ids").alias("ids_crc32"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_features(stored(media.store_texts(_table(spark, sf_dir, "documents")), "media"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), min_bytes=1).select("doc_id", "n_lines", "removed", "share", "text")


def op8_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles = stored(warc.bundle_pages(_table(spark, sf_dir, "pages")), "warc")
    return warc.read_bundles(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_temperature_mixing, op3_graph_neighbours, op4_backoff_scores, op5_token_output, op6_media_columns, op7_line_dedup, op8_warc_bundles, op9_toxicity, op10_near_duplicates)}

ORACLE_SQL = {
    "op8_warc_bundles": """
        with p as (select page_id, coalesce(html, '') h from pages),
        d as (select page_id, cast(strlen(h) as bigint) payload_bytes, sha1(h) payload_digest from p),
        m as (select *, max(page_id) over (partition by payload_digest, payload_bytes) last, count(*) over (partition by payload_digest, payload_bytes) n from d)
        select page_id, payload_bytes, payload_digest,
               case when n > 1 and payload_bytes >= 1000 and last is not null and page_id is distinct from last then 'revisit' else 'response' end record_type,
               case when n > 1 and payload_bytes >= 1000 and last is not null and page_id is distinct from last then last end refers_to
        from m""",
    "op10_near_duplicates": r"""
        with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
        g as (select doc_id, list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                     when len(w) > 0 then [array_to_string(w, ' ')] else cast([] as varchar[]) end) s from t),
        e as (select doc_id, len(s) n, unnest(s) x from g),
        p as (select a.doc_id a, b.doc_id b from e a join e b on a.x = b.x and a.doc_id <> b.doc_id
              group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        r as (select doc_id a, doc_id b from g union select r.a, p.b from r join p on r.b = p.a)
        select g.doc_id, cast(len(s) as bigint) n_shingles, m.c component_id, g.doc_id = m.c kept
        from g join (select a, min(b) c from r group by a) m on g.doc_id = m.a""",
}
