"""Structured Streaming forms (STR1-STR3).

* STR1 ``stream_categorise``: every micro-batch is one accumulation round.
  The taxonomy is a table: read before the batch is labelled, new names
  appended after.  Labels and taxonomy rows of batch ``b`` are written to
  partition ``round=b`` with overwrite, so a replayed batch after a failure
  rewrites the same files (idempotent); state lives in tables, so a restart
  resumes from the stream checkpoint.
* STR2 ``stream_category_counts``: running category counts of the labelled
  ticket stream (stateful aggregate, update mode); each micro-batch writes
  its changed counts to partition ``batch=<id>`` (overwrite, so a replay is
  idempotent) and the reader keeps the latest count per category.
* STR3 ``stream_window_counts``: per-day category counts with a watermark,
  update mode; each batch writes its updated rows, the reader keeps the
  latest value per (day, category).

All paths live under the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from ..operators.deciders import label_lexical
from ..operators.name_table import ranked, seed_names, unseen
from ..operators.normalise import clean_known, drop_blank
from ..operators.taxonomy import Taxonomy
from ..session import ensure_checkpoint_dir


TAXONOMY_SCHEMA = "ordinal long, category string, source string"


def _scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "ticketsift-stream", f"{name}-{uuid.uuid4().hex}")


def _tickets_from_docs(df: DataFrame) -> DataFrame:
    raw = df.select(
        F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")).alias("ticket_id"),
        F.col("text").alias("issue_description"),
        F.col("source").alias("current_label"),
        F.lit("").alias("resolution_notes"),
        "doc_id",
    )
    return clean_known(drop_blank(raw))


def _known_names(spark: SparkSession, path: str, seed: Taxonomy, before: int) -> DataFrame:
    """Seed plus the names appended by rounds below ``before``, as a table, so a
    replayed micro-batch sees exactly the taxonomy its first attempt saw, not the
    names it appended itself."""
    seeded = seed_names(spark, seed)
    found = spark.read.schema(f"{TAXONOMY_SCHEMA}, round int").parquet(path).where(F.col("round") < before).drop("round")
    return seeded.unionByName(found.join(seeded.select("category"), "category", "left_anti").select(*seeded.columns))


def _file_stream(spark: SparkSession, folder: str, pattern: str, max_files: int | None = None) -> DataFrame:
    """A table below ``folder`` as a file stream: one file or a folder of part
    files of that name, or the folder's own files that match the pattern."""
    path, options = folder, {"pathGlobFilter": pattern}
    try:
        schema = spark.read.options(**options).parquet(path).schema
    except AnalysisException:  # no file of that name: the table is a folder
        path, options = os.path.join(folder, pattern), {}
        schema = spark.read.parquet(path).schema
    if max_files:
        options["maxFilesPerTrigger"] = max_files
    return spark.readStream.schema(schema).options(**options).parquet(path)


def stream_categorise(spark: SparkSession, sf_dir: str, seed: Taxonomy, max_files: int = 1,
                      pattern: str = "documents.parquet", decider: str = "lexical", context: str = "",
                      mode: str = "manual_list", call_factory=None, concurrency: int | None = None,
                      responses: DataFrame | None = None, out_dir: str | None = None) -> DataFrame:
    """STR1 over the document files of ``sf_dir`` (``pattern``) as a file stream.

    Every micro-batch is one accumulation round.  ``decider='callable'``
    numbers and batches the micro-batch's tickets, sends one request per
    batch listing the names known before the round (``call_factory`` as in
    ``run``), parses and applies the replies, and appends the new names.  The
    replies are the record: written to ``<out_dir>/replies/round=<id>``
    (overwrite, so a replayed micro-batch rewrites them).  ``decider='replay'``
    reads them back from ``responses(round, batch_id, raw, error)`` instead of
    calling the model.  ``out_dir`` defaults to a fresh folder under the
    checkpoint folder.
    """
    base = out_dir or _scratch(spark, "categorise")
    labels_path, tax_path, replies_path, ckpt = (
        os.path.join(base, p) for p in ("labels", "taxonomy", "replies", "_checkpoint"))
    stream = _file_stream(spark, sf_dir, pattern, max_files)
    # an empty round below every micro-batch id, so the taxonomy table
    # exists before the first round appends to it
    spark.createDataFrame([], TAXONOMY_SCHEMA).write.mode("overwrite").parquet(os.path.join(tax_path, "round=-1"))

    def decide(tickets: DataFrame, known: DataFrame, round_id: int) -> DataFrame:
        if decider == "lexical":
            return label_lexical(tickets, seed)  # names without keywords match nothing
        if not ((decider == "callable" and call_factory is not None) or (decider == "replay" and responses is not None)):
            raise ValueError("streaming rounds take decider='lexical', 'callable' with call_factory, "
                             "or 'replay' with responses")
        from ..operators.deciders import call_requests, replay_requests
        from ..operators.ordering import assign_batches, assign_positions
        from ..operators.prompts import categorise_requests
        from ..operators.responses import apply_replies, parse_replies

        b = assign_batches(assign_positions(tickets, "doc_id"))
        req = categorise_requests(b, context, mode, known)
        if decider == "callable":
            got = call_requests(req, call_factory, concurrency)
        else:
            got = replay_requests(req, responses.filter(F.col("round") == round_id).drop("round"))
        here = os.path.join(replies_path, f"round={round_id}")
        got.write.mode("overwrite").parquet(here)
        resp = tickets.sparkSession.read.parquet(here)
        return apply_replies(b, parse_replies(resp, req))

    def round_(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        known = _known_names(session, tax_path, seed, before=batch_id)
        out = decide(_tickets_from_docs(batch), known, batch_id).select(
            "ticket_id", "doc_id", "new_category", "confidence", "reasoning")
        here = os.path.join(labels_path, f"round={batch_id}")
        out.write.mode("overwrite").parquet(here)
        # new names in first-seen order, read from the labels just written: an
        # anti join against the names so far, appended as one more part
        fresh = ranked(unseen(session.read.parquet(here), known, "doc_id"), known.count())
        fresh.write.mode("overwrite").parquet(os.path.join(tax_path, f"round={batch_id}"))

    q = stream.writeStream.foreachBatch(round_).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(labels_path)


def stream_category_counts(spark: SparkSession, sf_dir: str, seed: Taxonomy, max_files: int = 1,
                           pattern: str = "documents.parquet") -> DataFrame:
    """STR2 over the document files of ``sf_dir`` (``pattern``) as a file stream."""
    base = _scratch(spark, "counts")
    out_path, ckpt = os.path.join(base, "updates"), os.path.join(base, "_checkpoint")
    stream = _file_stream(spark, sf_dir, pattern, max_files)
    counts = (
        label_lexical(_tickets_from_docs(stream), seed)
        .groupBy(F.col("new_category").alias("category"))
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out_path, f"batch={batch_id}"))

    q = counts.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    ups = spark.read.parquet(out_path)
    w = Window.partitionBy("category").orderBy(F.desc("batch"))
    return ups.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).select("category", "n")


def stream_window_counts(spark: SparkSession, sf_dir: str, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """STR2/STR3 over the ``events`` file: per-window category counts."""
    base = _scratch(spark, "windows")
    out_path, ckpt = os.path.join(base, "updates"), os.path.join(base, "_checkpoint")
    events = _file_stream(spark, sf_dir, "events.parquet")
    counts = (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", watermark)
        .groupBy(F.window("ts", window).alias("w"), F.col("event_type").alias("category"))
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.select(F.col("w.start").alias("start"), "category", "n").write.mode("overwrite").parquet(
            os.path.join(out_path, f"batch={batch_id}")
        )

    q = counts.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    ups = spark.read.parquet(out_path)
    w = Window.partitionBy("start", "category").orderBy(F.desc("batch"))
    latest = ups.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)
    return latest.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "category", "n")
