"""Corpus pipeline: documents to packed training sequences.

Five stages, each over all that the one before has kept: toxic documents go, one
document of each near-duplicate class stays, documents that hold benchmark items
go, secrets are blacked out, and what is left is packed into windows with its
lexical neighbours.  All stages but the last return the columns of
``documents``; every stage is written as Parquet and read again by the next.

Null texts pass the filters (they are empty to the packer), null ids are kept
(see the operators), repeated rows count as copies, further columns are carried
along up to the last stage, and an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketsift.llm import decontaminate, minhash, packing, secret_scan, toxicity
from ticketsift.llm.common import free_name, give_back, rows_of
from ticketsift.session import materialize

#: Documents scored so high or higher are rejected.
TOXIC = 0.5
#: What the packer puts after each document.
END_ID = 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold."""
    model = toxicity.train(docs, rows_of(spark, sf_dir, "labels"))
    score = free_name(docs.columns, "_score")
    return toxicity.score(docs, model, spans=False, score_col=score).where(F.col(score) < TOXIC).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return minhash.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, rows_of(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets blacked out (and counted anew where ``n_chars`` says how long they are)."""
    model = secret_scan.train(secret_scan.labelled_samples(docs))
    out = secret_scan.redact(docs, model)
    if "n_chars" in docs.columns:
        changed = F.col("text").contains(secret_scan.REDACTED)
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most one window."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID, with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_benchmark),
    ("secrets", redact_secrets),
    ("packing", pack_windows),
]

#: Models and retrieval are beyond SQL; the tests check each stage's decisions on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs = rows_of(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline_{name}")
        give_back()  # what a stage held on the driver does not add to the next one's
    return docs
