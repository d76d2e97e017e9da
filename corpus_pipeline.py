"""Corpus preparation: each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns a DataFrame.

All stages but the last return the columns of documents: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm.op01_langid import UNKNOWN, fit, identify
from lumora.llm.op02_sentencepiece import encode_texts
from lumora.llm.op03_mixing import mix_sources
from lumora.llm.op10_minhash import BROADCAST_IDS, near_duplicates
from lumora.session import cut, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def with_rows(docs: DataFrame) -> DataFrame:
    """The columns of documents and a number of each row's own, as a table, so that decisions are taken and joined by row."""
    return cut(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")))


def by_row(decided: DataFrame) -> DataFrame:
    """A table of decisions by row as rows meet it: broadcast if it is counted to be small, so that no text is shuffled."""
    return F.broadcast(decided) if decided.count() <= BROADCAST_IDS else decided


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts in which no language is found (null, empty, without letters) go; the others' null lang becomes the one found.

    Where no document has a lang to learn from, those with a letter stay, their lang null.
    """
    model = fit(docs.select(F.col("doc_id").alias("key"), "text", "lang"))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = identify(docs.select(*COLUMNS), model).where(F.col("lang_pred") != UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup on five-word shingles at a similarity of 0.8: the row of the smallest doc_id (nulls last) of each group stays."""
    rows = with_rows(docs)
    groups = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), shingle=5, num=80, den=100)
    groups = cut(groups.select(F.col("doc_id").alias("_row"), "component_id"))
    members = rows.select("doc_id", "_row").join(groups, "_row")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_row"))
    gone = cut(members.select("_row").join(first.select("_row"), "_row", "left_anti"))  # by row: a large group isn't joined by its component
    return rows.join(by_row(gone), "_row", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to the weights 5, 2, 1, repeating: a row for each time that the mix takes a document, up to 3."""
    rows = with_rows(docs)
    copies = cut(mix_sources(rows, weights=(5, 2, 1), max_repeats=3, keep=("_row",)).where("copies > 0").select("_row", "copies"))
    return rows.join(by_row(copies), "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding: piece_ids and n_pieces of each text, and the text as decoding gives it back."""
    return encode_texts(docs.select(*COLUMNS), public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language ID", keep_identified), ("MinHash near-dedup", keep_distinct), ("mixing", mix), ("SentencePiece", encode)]

#: SQL can't express the model of stage 1 or the search of stage 4; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's result written to the shared checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "pipeline-")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
