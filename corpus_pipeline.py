"""From raw documents to packed sequences: five stages, each one operator over all that the stage before it kept.

``run`` writes every stage's result as Parquet to the folder that the cluster
names for checkpoints and reads it again, so a lost executor costs no more
than a stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontam, minhash, packing, secrets, toxicity
from barloom.llm.common import checkpoint_folder, remove_folder, table
from barloom.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labelled documents among them, doesn't reject; without labels of both kinds all stay."""
    return toxicity.remove(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates; every text without words stays, of rows equal in every column one."""
    return minhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more than traces of the benchmark; null and wordless texts stay."""
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live credentials replaced by a mark; n_chars follows the text, and stays where that is null."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; a null text is the end token alone."""
    return packing.pack_documents(docs, *vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: Near-dedup classes and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages leave of ``documents``.

    Nulls, repeated rows and clashing names are treated as each operator says;
    every stage but the last returns the columns that it is given, and an empty
    table stays empty through all of them.  A stage's table is deleted once the
    next one is written; the last is read by the result.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
