"""Ticket tables from the driver's parquet tables and from any mapped table (SRC8-10)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.normalise import clean_known, drop_blank

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that yields fewer partitions than task slots.

    A text table stored as one big row group is read by a single task, which
    then tokenises everything alone.  Only then is a shuffle worth it; a
    large table already arrives in many splits and is left as it is.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < slots:
        return df.repartition(slots)
    return df


def map_columns(df: DataFrame, mapping: dict[str, str | F.Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """SRC10: any table as a ticket source through a column map
    ``{ticket column: source column or expression}``; ``keep`` passes extras."""
    cols = [(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in mapping.items()]
    return df.select(*cols, *[F.col(k) for k in keep])


def document_tickets(spark: SparkSession, sf_dir: str, spread_scan: bool = True) -> DataFrame:
    """``documents`` as tickets: id ``DOC-<doc_id>``, description = text,
    label = source, notes blank; extras doc_id/lang/n_chars; order key doc_id."""
    docs = table(spark, sf_dir, "documents")
    if spread_scan:
        docs = spread(docs)
    raw = map_columns(
        docs,
        {
            "ticket_id": F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")),
            "issue_description": "text",
            "current_label": "source",
            "resolution_notes": F.lit(""),
        },
        keep=("doc_id", "lang", "n_chars"),
    )
    return clean_known(drop_blank(raw))


def conversation_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as tickets: per conversation the first user turn is the
    description and the last assistant turn the resolution notes.

    One hash aggregate on conv_id with ``min_by``/``max_by`` (partial agg
    map-side; no row collection per group).
    """
    conv = table(spark, sf_dir, "conversations")
    agg = conv.groupBy("conv_id").agg(
        F.min_by(F.col("text"), F.when(F.col("role") == "user", F.col("turn"))).alias("issue_description"),
        F.max_by(F.col("text"), F.when(F.col("role") == "assistant", F.col("turn"))).alias("resolution_notes"),
        F.count(F.lit(1)).alias("turns"),
    )
    raw = agg.select(
        F.concat(F.lit("CONV-"), F.col("conv_id").cast("string")).alias("ticket_id"),
        "issue_description",
        F.lit("").alias("current_label"),
        "resolution_notes",
        "conv_id",
        "turns",
    )
    return clean_known(drop_blank(raw))


# --- fixed values -----------------------------------------------------------
# Built-in data sets (SRC8/SRC9): key → (label, one-line context, builder).
DATASETS = {
    "documents": ("Crawled documents", "Invented multilingual documents from a synthetic crawl, read as support tickets"),
    "conversations": ("Chat transcripts", "Assistant chat transcripts: first user turn as the issue, last reply as the resolution"),
}
# -----------------------------------------------------------------------------


def dataset(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """SRC8: a built-in ticket table by key; an unknown key names the valid ones."""
    builders = {"documents": document_tickets, "conversations": conversation_tickets}
    if key not in builders:
        raise ValueError(f"unknown data set '{key}'; choose one of: {', '.join(sorted(builders))}")
    return builders[key](spark, sf_dir)


def dataset_context(key: str) -> str:
    """SRC9: the one-line context of a built-in data set."""
    if key not in DATASETS:
        raise ValueError(f"unknown data set '{key}'; choose one of: {', '.join(sorted(DATASETS))}")
    return DATASETS[key][1]
