"""A training-corpus pipeline of five operators: language, near duplicates, repeated passages, personal data, packing.

Every stage is a function of (spark, docs, sf_dir); all but the last return the columns of ``documents``, others that
``docs`` has as well. A table without rows gives one without rows at every stage.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import chunk_dedup, language_id, packing, pseudonyms, setsketch
from termloom.llm.common import maybe_broadcast, stage, unstage
from termloom.llm.queries import pseudonym_key
from termloom.session import settled, ship

#: Most labelled rows that the language model is fitted on.
LANGUAGE_ROWS = 2000
#: Bytes of rows that go to a Python worker at once. With Spark's 64 MB, or 10,000 rows, every task slot holds a few such
#: batches outside the heap and in its worker, and what the stages leave behind adds up over the pipeline.
BATCH_BYTES, BATCH_SETTING = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


def ready(spark: SparkSession) -> SparkSession:
    """``ship``, and batches of BATCH_BYTES from now on, unless the session has a setting of its own."""
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    return ship(spark)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are near a centroid of a language that ``docs`` has; those without letters or far from all go.

    Null and empty texts have no letters and go; a null language is no language to learn, but its row may stay. Repeated
    rows stay or go together. If no row has a text and a language, all go.
    """
    ready(spark)
    model = language_id.fit(docs, max_rows=LANGUAGE_ROWS)
    return language_id.identify(docs, model, docs.columns).where(~F.col("rejected")).select(docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 on five-word shingles, the one with the smallest id.

    A document without words, or without an id, is linked with nothing and stays. Rows of one id are one document: they
    stay or go together.
    """
    ready(spark)
    found = setsketch.near_duplicates(docs, size=5, percent=80)
    extra = stage(found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "extra")
    return docs.join(maybe_broadcast(extra, extra.count(), 16), "doc_id", "left_anti").select(docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of chunks that came before in another place; n_chars follows.

    Every row stays; null and empty texts and rows without an id stay as they are.
    """
    ready(spark)
    return chunk_dedup.dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal data; n_chars follows. Every row stays, null texts as null."""
    return pseudonyms.pseudonymise(docs, pseudonym_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens. A null or empty text is one piece of one token."""
    ready(spark)
    path = public_tokenizers.path
    return packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, end_id=2, capacity=1024)


STAGES = [
    ("language_id", keep_known_languages),
    ("minhash_near_dedup", keep_one_of_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("pii", replace_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: The models, sketches and tokenizer ids have no SQL form; tests hold near duplicates, passages, personal data and pieces
#: against plain versions, and the languages against the given ones.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        kept = settled(partial(function, spark, docs, sf_dir), name)  # what the stage wrote on the way goes
        unstage(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
