"""Exact deduplication by a persistent digest index (operator 13).

The index is a Parquet table of digests, bucketed and sorted by digest, in a
folder of the caller's.  A batch of documents becomes one entry per digest
(SHA-256 of the text with ``A-Z`` lower-cased), partly counted before the
shuffle, so copies of one text never travel as rows.  A sort-merge anti-join
against the index tells which digests are new: the index side is read as it
lies, only the batch's entries move.  The batch's entries are then appended,
the new ones with the id that stays, the others with their counts alone.

An index outlives the session (``open_index`` finds its bucket count in the
folder); a batch has a name and counts once, so a job that died can be run
again.  Within a batch the largest id of a text stays, across batches the one
that came first; a table taken in batches of falling ids keeps the largest.

Rows: a null text is an empty one; a null id never stays unless all ids of the
text are null (then the row that stays is called null); rows that repeat both
id and text count each and share one decision; extra columns are not read.  An
empty table adds nothing.  Texts are read whole, however long.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, materialize, shuffle_partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Batches in which ``deduplicate`` takes a table.
BATCHES = 3


def normalised(text: Column) -> Column:
    """The text with ``A-Z`` (and no other letters) lower-cased; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id`` and ``digest`` (32 bytes)."""
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"))


@dataclass
class DigestIndex:
    spark: SparkSession
    path: str
    buckets: int
    id_type: str

    @property
    def table(self) -> str:
        return f"digest_index_{hashlib.md5(self.path.encode()).hexdigest()}"

    def entries(self) -> DataFrame:
        """All entries: ``digest, keep (null unless new then), fresh, n, batch``."""
        return self.spark.table(self.table)

    def has(self, batch: str) -> bool:
        """Whether the batch is in the index whole."""
        done = self.path.rstrip("/") + "_done"
        return _exists(self.spark, done) and not self.spark.read.schema("batch string").json(done).where(F.col("batch") == batch).isEmpty()

    def add(self, rows: DataFrame, batch: str) -> None:
        """Add rows ``(id, digest)``; a batch that is there whole is left out, one
        that was cut off is added again (its entries repeat, ``groups`` counts them once)."""
        if self.has(batch):
            return
        seen = rows.groupBy("digest").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n"))
        seen = materialize(seen.repartition(self.buckets, "digest"), "digest_batch")
        known = self.entries().where(F.col("fresh") & (F.col("batch") != batch)).select("digest")
        new = seen.join(known.hint("merge"), "digest", "left_anti").select("digest", F.col("top").alias("keep"), F.lit(True).alias("fresh"), "n")
        again = seen.join(known.hint("merge"), "digest", "left_semi").select("digest", F.lit(None).cast(self.id_type).alias("keep"), F.lit(False).alias("fresh"), "n")
        # both joins leave the rows dealt by digest as the buckets are: no exchange before the write
        both = materialize(new.unionAll(again).withColumn("batch", F.lit(batch)), "digest_entries")
        _writer(both.repartition(self.buckets, "digest"), self).mode("append").saveAsTable(self.table)
        self.spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").json(self.path.rstrip("/") + "_done")

    def groups(self) -> DataFrame:
        """Per digest the id that stays and the number of rows of all batches;
        the buckets serve the aggregate, so nothing is shuffled."""
        once = self.entries().groupBy("digest", "batch").agg(F.max(F.when(F.col("fresh"), F.col("keep"))).alias("keep"), F.max("n").alias("n"))
        return once.groupBy("digest").agg(F.max("keep").alias("keep"), F.sum("n").alias("n"))


def _writer(df: DataFrame, index: DigestIndex):
    return df.write.format("parquet").option("path", index.path).bucketBy(index.buckets, "digest").sortBy("digest")


def open_index(spark: SparkSession, path: str, id_type: str = "bigint", buckets: int | None = None) -> DigestIndex:
    """The index in ``path``, made there if the folder has none.  ``buckets``
    (the session's shuffle partitions by default) is fixed when it is made."""
    meta = path.rstrip("/") + "_spec"
    known = spark.read.schema("buckets int, id_type string").json(meta).first() if _exists(spark, meta) else None
    if known is None:
        index = DigestIndex(spark, path, buckets or shuffle_partitions(spark), id_type)
        spark.createDataFrame([(index.buckets, id_type)], "buckets int, id_type string").coalesce(1).write.json(meta)
    else:
        index = DigestIndex(spark, path, known["buckets"], known["id_type"])
    if not spark.catalog.tableExists(index.table):
        schema = f"digest binary, keep {index.id_type}, fresh boolean, n bigint, batch string"
        spark.sql(f"CREATE TABLE {index.table} ({schema}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {index.buckets} BUCKETS LOCATION '{path}'")
    return index


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def decisions(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """Per row ``(id, digest)`` of an indexed batch: ``keep_id``, ``group_size``.

    Texts with more rows than a partition holds on average (never more texts
    than partitions) are joined by broadcast, so their rows stay where they are."""
    groups = index.groups()
    total = groups.agg(F.sum("n")).first()[0] or 0
    fair = max(1, total // shuffle_partitions(index.spark))
    hot = materialize(groups.where(F.col("n") > fair), "digest_hot")  # fewer than the partitions
    found = rows.join(F.broadcast(hot), "digest", "left")
    listed = found.where("n is not null")
    cold = found.where("n is null").drop("keep", "n").join(groups.where(F.col("n") <= fair).hint("merge"), "digest")
    return listed.unionByName(cold).select("id", "digest", F.col("keep").alias("keep_id"), F.col("n").alias("group_size"))


def deduplicate(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    The table goes through a new index (in ``path``, else below the checkpoint
    folder) in BATCHES ranges of falling ids, so of equal texts the row with the
    largest id stays."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    index = open_index(spark, path or os.path.join(ensure_checkpoint_dir(spark), "ticketsift", f"digests-{uuid.uuid4().hex}"), id_type)
    rows = materialize(digests(docs, id_col, text_col), "digests")
    for k, batch in enumerate(falling(rows, BATCHES)):
        index.add(batch, f"batch-{k}")
    out = decisions(rows, index)
    kept = F.coalesce(F.col("id") == F.col("keep_id"), F.col("id").isNull() & F.col("keep_id").isNull())
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def falling(rows: DataFrame, batches: int) -> list[DataFrame]:
    """The rows in ranges of falling ids (null ids in the last), cut at even shares of the id range."""
    ends = rows.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    if ends["low"] is None or isinstance(ends["low"], (str, bytes)) or ends["low"] == ends["high"]:
        return [rows]
    step = (ends["high"] - ends["low"]) / batches
    cuts = [ends["high"] - step * k for k in range(1, batches)]
    out = [rows.where(F.col("id") > cuts[0])]
    out += [rows.where((F.col("id") > low) & (F.col("id") <= high)) for high, low in zip(cuts, cuts[1:])]
    return [*out, rows.where(F.col("id").isNull() | (F.col("id") <= cuts[-1]))]
