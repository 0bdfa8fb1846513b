"""The registered queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chunk_dedup, divergence, kd_search, language_id, oracles, packing, pseudonyms, quality_additive, sampling, setsketch, suffix_dedup, threshold_clusters
from . import url_reputation, word_quality

RULES = [url_reputation.Rule("block", "net", "/"), url_reputation.Rule("allow", "example.net", "/en/"),
    url_reputation.Rule("block", "example.com", "/de/"), url_reputation.Rule("allow", "org", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pseudonym_key(spark: SparkSession) -> str:
    """The secret in the setting ``termloom.pseudonym.key``; where it is unset, a public one, fit for tests and checks alone."""
    return spark.conf.get("termloom.pseudonym.key", "a public key for tests")


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the document with its id: good if of quality and not toxic."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    judged = url_reputation.judge_urls(table(spark, sf_dir, "pages"), outcomes, RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "n_labelled", F.round("lower", 6).alias("lower"))


def op2_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pseudonym_key(spark))
    return out.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))


def op3_content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunk_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "n_removed", F.size("spans").cast("long").alias("n_spans"))


def op4_large_item_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    packed = packing.pack(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
        end_id=2, capacity=1024)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op5_kd_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return kd_search.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op6_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = setsketch.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return word_quality.judge(docs, sampling.labelled(docs, labels, "quality", max_rows=2000), max_rows=2000, drawn=True)


def op8_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    model = language_id.fit(docs.where(~held))
    predicted = language_id.identify(docs, model)
    return predicted.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))).select("doc_id", "held_out",
        "lang_pred", "score", "rejected")


def op9_suffix_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(table(spark, sf_dir, "documents"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(encoded, path, public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=30, most_terms=50)


def op12_threshold_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_clusters.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dimensions=64, scale=64, seed="1")


def op13_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from labels of documents that are not held out; a document's label is the greatest of its rows'."""
    docs, held = table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    known = sampling.labelled(docs, table(spark, sf_dir, "labels").where(~held), "quality", max_rows=4000)
    model = quality_additive.train(known, max_rows=4000, drawn=True)
    scored = quality_additive.score(docs, model, threshold=0.3).withColumn("held_out", F.coalesce(held, F.lit(False)))
    return scored.select("doc_id", "held_out", "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_reputation, op2_feistel_pseudonyms, op3_content_chunks, op4_large_item_packing, op5_kd_top_k,
        op6_setsketch, op7_quality_model, op8_language_centroids, op9_suffix_buckets, op10_chunked_bpe, op11_source_divergence,
        op12_threshold_clusters, op13_additive_quality)}


def oracle_sql() -> dict[str, str]:
    """The others have models, tokenizers, hashes or byte offsets that SQL has not; tests hold them against plain versions."""
    return {"op1_url_reputation": oracles.OP1, "op5_kd_top_k": oracles.OP5, "op6_setsketch": oracles.OP6,
        "op11_source_divergence": oracles.OP11, "op12_threshold_clusters": oracles.op12(16, 3)}
