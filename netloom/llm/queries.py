"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from netloom.llm import chat, filter_audit, line_dedup, ngram_join, ogg, packing, piece_lattice, pii, quality, secrets_scan, simhash, topk

WORD_FILE, PIECE_FILE = "word_bpe_49k.json", "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    scores = quality.scored(docs, weights)
    return scores.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_FILE))


def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return chat.preference_pairs(rows, chat.with_rejected(rows))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal(table(spark, sf_dir, "documents"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_lattice.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_FILE))


def op8_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.as_media(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.told(table(spark, sf_dir, "documents"), least=1)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = [op1_ngram_jaccard, op2_quality, op3_secrets, op4_packing, op5_preferences, op6_personal_data, op7_pieces, op8_ogg_media, op9_line_dedup, op10_topk, op11_simhash, op12_filter_audit]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


_TOP = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256.0 * x::double)::bigint) as e from embeddings
           where vec_id is not null and embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::bigint as score
      from v q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e) where q.vec_id % 50 = 0)
select query_id, rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s) where rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_preferences": chat.ORACLE, "op10_topk": _TOP, "op12_filter_audit": filter_audit.ORACLE}
