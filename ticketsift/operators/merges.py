"""Consolidation with the merge list as a table (CNS5, CNS6, JON4), at any number
of categories and merges.

A merge list has rows ``(merge_no, merge_these, into)``.  Merges apply in order
and see earlier results, so a category's way is a chain: the first merge that
names it among its sources, then the first later merge that names that one's
target, and so on.  The chain's links only point to later merges, so they form a
forest over the merges; pointer jumping (one self-join per doubling, written each
time) finds every merge's last successor and the tickets that pass through it in
O(log longest chain) rounds.  Nothing of it is held on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .consolidate import LOG_FORMAT

MERGE_SCHEMA = "merge_no int, merge_these array<string>, into string"


def valid_merges(merges: DataFrame) -> DataFrame:
    """Merges with a target and at least one source that is not null."""
    sources = F.filter("merge_these", lambda s: s.isNotNull())
    return merges.select(F.col("merge_no").cast("long").alias("merge_no"), sources.alias("merge_these"), "into").where(
        (F.size("merge_these") > 0) & F.col("into").isNotNull() & (F.col("into") != ""))


def next_merges(merges: DataFrame) -> DataFrame:
    """``(merge_no, into, next)``: the first later merge that names the target
    among its sources (null at a chain's end).

    One window per name over the events "is a source" and "is a target", latest
    first, that remembers the last source event met (a running value, no frame
    over the rest of the partition)."""
    named = merges.select(F.explode(F.array_distinct("merge_these")).alias("name"), "merge_no", F.lit(False).alias("target"))
    events = named.unionByName(merges.select(F.col("into").alias("name"), "merge_no", F.lit(True).alias("target")))
    # at one merge the source event comes after (in falling order) its target
    # event, so a target that is its own source does not point at itself
    latest_first = Window.partitionBy("name").orderBy(F.desc("merge_no"), F.desc("target"))
    seen = F.last(F.when(~F.col("target"), F.col("merge_no")), ignorenulls=True).over(
        latest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return events.withColumn("next", seen).where("target").select("merge_no", F.col("name").alias("into"), "next")


def first_merges(counts: DataFrame, merges: DataFrame) -> DataFrame:
    """Of each category ``(category, n)`` that a merge names the first such merge."""
    named = merges.select(F.explode("merge_these").alias("category"), "merge_no")
    first = named.groupBy("category").agg(F.min("merge_no").alias("first"))
    return counts.where(F.col("category").isNotNull()).join(first, "category")


def follow(links: DataFrame, own: DataFrame) -> DataFrame:
    """Pointer jumping over ``links(merge_no, next)``: per merge ``last`` (the end of
    its chain) and ``tickets`` (all of ``own(merge_no, n)`` whose chain passes it).

    After r rounds ``hop`` lies 2^r links ahead and ``tickets`` holds what starts
    less than 2^r links behind, so a round adds the sums of the merges that hop
    here and doubles the hop; every row moves once per round."""
    state = links.select("merge_no", F.col("next").alias("hop"), F.coalesce("next", "merge_no").alias("last")).join(own, "merge_no", "left")
    state = materialize(state.select("merge_no", "hop", "last", F.coalesce("n", F.lit(0)).cast("long").alias("tickets")), "merge_chain")
    while not state.where(F.col("hop").isNotNull()).isEmpty():
        ahead = state.select(F.col("merge_no").alias("hop"), F.col("hop").alias("hop2"), F.col("last").alias("last2"))
        behind = state.where(F.col("hop").isNotNull()).groupBy(F.col("hop").alias("merge_no")).agg(F.sum("tickets").alias("more"))
        jumped = state.join(ahead, "hop", "left").join(behind, "merge_no", "left")
        state = materialize(jumped.select(
            "merge_no", F.col("hop2").alias("hop"), F.coalesce("last2", "last").alias("last"),
            (F.col("tickets") + F.coalesce("more", F.lit(0))).alias("tickets")), "merge_chain")
    return state.drop("hop")


class MergeTables:
    """The composed result of a merge list over a category table ``(category, n)``."""

    def __init__(self, counts: DataFrame, merges: DataFrame):
        self.merges = materialize(valid_merges(merges), "merge_list")
        links = materialize(next_merges(self.merges), "merge_links")
        start = materialize(first_merges(counts, self.merges), "merge_starts")
        own = start.groupBy(F.col("first").alias("merge_no")).agg(F.sum("n").alias("n"))
        self.chain = follow(links, own)
        ends = self.chain.select(F.col("merge_no").alias("first"), "last")
        named = links.select(F.col("merge_no").alias("last"), F.col("into").alias("final"))
        #: ``(old, final, merge_no)``: where each category that a merge names ends, and
        #: the last merge of its chain; a category may end where it began
        self.mapping = materialize(
            start.join(ends, "first").join(named, "last").select(F.col("category").alias("old"), "final", F.col("last").cast("int").alias("merge_no")),
            "merge_map")

    def tickets(self) -> DataFrame:
        """CNS6: ``(merge_no, into, tickets)`` of the merges that moved any ticket."""
        return self.chain.where("tickets > 0").join(self.merges, "merge_no").select(F.col("merge_no").cast("int").alias("merge_no"), "into", "tickets")

    def log(self) -> DataFrame:
        """RPT5: ``(merge_no, log, tickets)``, a line per merge that moved any ticket."""
        sources = F.array_join(F.transform("merge_these", lambda s: F.concat(F.lit("'"), s, F.lit("'"))), " + ")
        head, rest = LOG_FORMAT.format(labels="\0", target="\1", n="\2").split("\0")
        middle, tail = rest.split("\1")
        line = F.concat(F.lit(head), sources, F.lit(middle), F.col("into"), F.lit(tail.split("\2")[0]), F.col("tickets").cast("string"), F.lit(tail.split("\2")[1]))
        return self.chain.where("tickets > 0").join(self.merges, "merge_no").select(F.col("merge_no").cast("int").alias("merge_no"), line.alias("log"), "tickets")


def apply_merge_map(labelled: DataFrame, mapping: DataFrame, col: str = "new_category") -> DataFrame:
    """JON4: rows under their final category by a left join (Spark broadcasts the
    written map if its size allows; else both sides shuffle and AQE splits a
    category that holds many rows)."""
    moved = mapping.where(F.col("old") != F.col("final")).select(F.col("old").alias("_old"), F.col("final").alias("_final"))
    out = labelled.join(moved, F.col(col) == F.col("_old"), "left")
    return out.withColumn(col, F.coalesce("_final", col)).drop("_old", "_final")


def merged_counts(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """The category table ``(category, n)`` after the merges."""
    return apply_merge_map(counts, mapping, "category").groupBy("category").agg(F.sum("n").alias("n"))
