"""Streams with state of their own (STR1-STR3).

* ``stream_category_state``: first ticket and count per category, kept by
  ``transformWithState`` in the state store, so a restart goes on from the last
  finished micro-batch.  Every task sums its rows up first: a category that holds a
  third of the tickets sends a row per task to its state, not its tickets.
* ``stream_unique_windows``: windowed counts of events that may come late or twice:
  ``dropDuplicatesWithinWatermark`` and append mode, so a window is written once,
  when the watermark has passed it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.deciders import label_lexical
from ..operators.taxonomy import Taxonomy
from .rounds import _file_stream, _scratch, _tickets_from_docs

STORE_KEY = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COUNTED = "category string, first_doc long, n long"


class CategoryState(StatefulProcessor):
    """First document and ticket count of one category."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "first_doc long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, n = self.seen.get() if self.seen.exists() else (None, 0)
        for b in rows:
            low = int(b["first_doc"].min())
            first, n = low if first is None else min(first, low), n + int(b["n"].sum())
        self.seen.update((first, n))
        yield pd.DataFrame({"category": [key[0]], "first_doc": [first], "n": [n]})

    def close(self) -> None:
        pass


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's rows as one row per category (its categories, not its tickets, in memory)."""
    total: dict[str, list[int]] = {}
    for b in batches:
        per = b.groupby("category")["doc_id"].agg(["min", "size"])
        for c, low, n in per.itertuples():
            own = total.setdefault(c, [int(low), 0])
            own[0], own[1] = min(own[0], int(low)), own[1] + int(n)
    if total:
        yield pd.DataFrame([(c, low, n) for c, (low, n) in total.items()], columns=["category", "first_doc", "n"])


def stream_category_state(spark: SparkSession, folder: str, seed: Taxonomy, max_files: int = 1,
                          pattern: str = "documents.parquet", out_dir: str | None = None) -> DataFrame:
    """Per category its first document and number of tickets, over the document
    files of ``folder``; called again with the same ``out_dir`` it takes what has
    come since and adds it to the state."""
    base = out_dir or _scratch(spark, "state")
    updates, ckpt = os.path.join(base, "updates"), os.path.join(base, "_checkpoint")
    stream = _file_stream(spark, folder, pattern, max_files)
    labels = label_lexical(_tickets_from_docs(stream), seed).select(F.col("new_category").alias("category"), F.col("doc_id").cast("long").alias("doc_id"))
    counted = labels.mapInPandas(_summed, COUNTED).groupBy("category").transformWithStateInPandas(
        statefulProcessor=CategoryState(), outputStructType=COUNTED, outputMode="Update", timeMode="None")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(updates, f"batch={batch_id}"))

    before = spark.conf.get(STORE_KEY, None)
    spark.conf.set(STORE_KEY, STORE)  # the provider that this operator needs, read when the query starts
    try:
        query = counted.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STORE_KEY)
        else:
            spark.conf.set(STORE_KEY, before)
    latest = Window.partitionBy("category").orderBy(F.desc("batch"))
    rows = spark.read.schema(f"{COUNTED}, batch int").parquet(updates)
    return rows.withColumn("_rn", F.row_number().over(latest)).where("_rn = 1").select("category", "first_doc", "n")


def stream_unique_windows(spark: SparkSession, folder: str, window: str = "1 day", delay: str = "2 hours",
                          pattern: str = "*.parquet", max_files: int = 1) -> DataFrame:
    """Per window and event type the events, each id once, over files in the order
    of their arrival; events behind the watermark are left out, and a window comes
    out when the watermark has passed its end."""
    base = _scratch(spark, "unique")
    out_path, ckpt = os.path.join(base, "windows"), os.path.join(base, "_checkpoint")
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", pattern).parquet(folder)
    counts = (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", delay)
        .dropDuplicatesWithinWatermark(["event_id"])
        .groupBy(F.window("ts", window).alias("w"), F.col("event_type").alias("category"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), "category", "n")
    )
    query = counts.writeStream.outputMode("append").format("parquet").option("path", out_path).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("start timestamp, category string, n long").parquet(out_path)
