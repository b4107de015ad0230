"""Corpus pipeline: language ID, near copies, benchmark passages, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor
kept; its result is written as Parquet and read again as the next one's input. All but
the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.llm import decontaminate, language, mixing, neardup, token_files
from claimscope.llm.common import documents, new_folder, staged, table

PIECES = "piece_bpe_32k.model"
BYTE_BPE = "byte_bpe_50k.json"
#: A document stays if its language is determined with at least this posterior.
LANGUAGE_SCORE = 0.5


def _texts(found: DataFrame) -> DataFrame:
    """The texts that a verdict names, by id and hash: a repeated id, or none, holds for each of its texts apart."""
    return found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()


def _same_text(docs: DataFrame, texts: DataFrame) -> Column:
    return docs["doc_id"].eqNullSafe(texts["__id"]) & (F.xxhash64(docs["text"]) == texts["__hash"])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language can be told; rows without text go."""
    vocabulary = public_tokenizers.path(PIECES)
    model = language.fit(docs, vocabulary, F.lit(True))
    found = language.identify(docs, vocabulary, model)
    told = (F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LANGUAGE_SCORE)
    kept = _texts(found.where(told))
    return docs.where(F.col("text").isNotNull()).join(kept, _same_text(docs, kept), "left_semi")


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the least doc_id."""
    return neardup.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    gone = _texts(found.where("contaminated"))
    return docs.join(gone, _same_text(docs, gone), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that domain tokens match the target weights."""
    return mixing.resampled(docs, table(spark, sf_dir, "labels"))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents; returns what they hold, as counts and checksums."""
    path = new_folder(spark, "token-files")
    token_files.write_token_files(docs, path, public_tokenizers.path(BYTE_BPE))
    return token_files.digests(token_files.read_token_files(spark, path))


STAGES = [
    ("language", identify_language),
    ("near_copies", remove_near_copies),
    ("decontaminate", decontaminate_benchmark),
    ("mix", mix_sources),
    ("token_files", write_tokens),
]

#: Language models, signatures and tokenizers have no SQL form: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
