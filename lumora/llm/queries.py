"""The registered queries of this subpackage: opN_<name>(spark, sf_dir), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm.op01_langid import fit, held_out, identify
from lumora.llm.op02_sentencepiece import encode_texts
from lumora.llm.op03_mixing import mix_sources
from lumora.llm.op04_token_counts import count_tokens
from lumora.llm.op05_fingerprints import compare_edited
from lumora.llm.op06_lm import score_texts
from lumora.llm.op07_token_files import written_and_read
from lumora.llm.op08_chat import format_chats, read_back, with_hostile
from lumora.llm.op09_embedding_dedup import near_duplicates as near_vectors
from lumora.llm.op10_minhash import near_duplicates
from lumora.llm.op11_hard_negatives import mine_negatives
from lumora.llm.op12_bpe import decode_ids, encode_texts as encode_bytes
from lumora.llm.op13_alignment import align_texts
from lumora.llm.sql import ORACLE_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out("doc_id", 4, 2)).select(F.col("doc_id").alias("key"), "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).withColumn("held_out", held_out("doc_id", 4, 2)).select("doc_id", "held_out", "lang_pred", "score")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_pieces", "piece_ids", F.col("text").alias("decoded"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_repeats=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(_table(spark, sf_dir, "documents"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id", 7, 2).alias("held_out")))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_and_read(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(format_chats(with_hostile(_table(spark, sf_dir, "conversations"))))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), similarity=0.9)


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return mine_negatives(vectors, anchors="vec_id % 50 = 0", positives=5, negatives=3, low=50, high=95, scale=256.0)


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    decoded = decode_ids(encode_bytes(_table(spark, sf_dir, "documents"), path), path)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align_texts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return aligned.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_language_id, op2_sentencepiece, op3_mixing, op4_token_counts, op5_fingerprints,
        op6_lm_scores, op7_token_files, op8_chat_format, op9_embedding_dedup, op10_minhash_dedup,
        op11_hard_negatives, op12_bpe, op13_alignment,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLE_SQL.items() if k in queries()}
