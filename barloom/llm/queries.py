"""The registered queries: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, license, lm, minhash, packing, phrases, secrets, substring, topk, toxicity, urlfilter, whiten
from .common import crc_mod, table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = minhash.classes(table(spark, sf_dir, "documents"))
    return named.withColumnRenamed("_id", "doc_id")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.train(urlfilter.labelled_urls(spark)))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents"))


def vocabulary() -> tuple[str, str]:
    """Paths of the public byte-level vocabulary, in both of its forms."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), *vocabulary())


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = toxicity.judge(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return judged.select("doc_id", (crc_mod(F.col("doc_id"), toxicity.FOLDS) == 0).alias("held_out"), "score", "predicted")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whiten.apply(vectors, whiten.fit(vectors)).withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def word_vocabulary() -> str:
    """Path of the public vocabulary of words."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op12_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = word_vocabulary()
    read = bpe.tokens(table(spark, sf_dir, "documents"), path)
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return read.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_secret_scan, op3_decontamination, op4_exact_top_k, op5_language_model, op6_url_filter, op7_substring_dedup, op8_best_fit_packing, op9_license_scan, op10_toxicity, op11_embedding_whitening, op12_bpe_tokens, op13_phrases)}
ORACLES = {"op2_secret_scan": secrets.oracle(), "op3_decontamination": decontam.oracle(), "op4_exact_top_k": topk.ORACLE, "op7_substring_dedup": substring.oracle(), "op13_phrases": phrases.oracle()}
