"""ACC1 / JON5 with the taxonomy as a table that grows from round to round.

Rows are ``(ordinal, category, source)``.  A round's new names are a left anti
join of its labels against the table (Spark broadcasts the written table as long
as its size allows), ranked by first appearance without a single-partition window,
and appended as one more written part; nothing of it is held on the driver, so the
number of names has no bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .normalise import UNCATEGORISED
from .ordering import assign_positions
from .taxonomy import Category, Taxonomy

NAME_SCHEMA = "ordinal long, category string, source string"


def seed_names(spark: SparkSession, seed: Taxonomy) -> DataFrame:
    """The starting list as a name table."""
    return spark.createDataFrame([(k, c.name, c.source) for k, c in enumerate(seed.categories)], NAME_SCHEMA)


def unseen(labels: DataFrame, known: DataFrame, order_col: str = "pos", col: str = "new_category") -> DataFrame:
    """JON5: names of the labels that the table lacks, ``(category, first)``; null,
    ``''`` and Uncategorised are no names."""
    firsts = labels.where(F.col(col).isNotNull() & ~F.col(col).isin(UNCATEGORISED, "")).groupBy(F.col(col).alias("category")).agg(
        F.min(order_col).alias("first"))
    return firsts.join(known.select("category"), "category", "left_anti")


def ranked(fresh: DataFrame, start: int, source: str = "discovered", written: bool = False) -> DataFrame:
    """New names in order of appearance (a ticket has one category, so first
    appearances differ), numbered from ``start``; ``written``: the names are a
    written table already."""
    fresh = fresh if written else materialize(fresh, "new_names")
    return assign_positions(fresh, "first", "_rank", written=True).select((F.col("_rank") + start).alias("ordinal"), "category", F.lit(source).alias("source"))


class NameTable:
    """A name list that grows; ``parts`` are written tables."""

    def __init__(self, spark: SparkSession, seed: Taxonomy):
        self.spark, self.seed = spark, seed
        self.parts = [materialize(seed_names(spark, seed), "names")]
        self.size = len(seed.categories)

    @property
    def table(self) -> DataFrame:
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.unionByName(p)
        return out

    def add(self, labels: DataFrame, order_col: str = "pos") -> None:
        """ACC1: append the names that this round's labels bring."""
        fresh = materialize(unseen(labels, self.table, order_col), "unseen_names")
        n = fresh.count()
        if n:
            self.parts.append(materialize(ranked(fresh, self.size, written=True), "names"))
            self.size += n

    def taxonomy(self) -> Taxonomy:
        """The list on the driver, for a caller who asks for it."""
        known = {c.name: c for c in self.seed.categories}
        rows = self.table.orderBy("ordinal").collect()
        return Taxonomy([known.get(r["category"]) or Category(r["category"], (), 1, r["source"]) for r in rows])
