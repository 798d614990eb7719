"""Reports over any labelled table (AGG1-AGG9, WIN1, WIN2, ORD4, ORD5, JON6, RPT1-RPT9).

Every report first reduces rows to one row per category (partial + final
hash aggregate, so a hot category is combined map-side), and only then runs
the small global steps (shares, ranks) on that tiny table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cut, pct_half_even
from .normalise import UNCATEGORISED
from .ordering import running_total
from .taxonomy import category_counts
from ..session import materialize


def distribution(labelled: DataFrame, col: str = "new_category", order_col: str = "pos") -> DataFrame:
    """AGG3 / RPT2: ``(rank, category, n, pct, label)``; total = sum of counts
    (null categories excluded); label ``"n (p%)"`` with half-even percent;
    rank by count desc, ties by first appearance (ORD4)."""
    return distribution_of_counts(category_counts(labelled, col, order_col))


def distribution_of_counts(c: DataFrame) -> DataFrame:
    """AGG3 / RPT2 from a count table ``(category, n, first_pos)``."""
    # both windows run on the aggregated table (one row per category)
    ranked = c.withColumn("_total", F.sum("n").over(Window.partitionBy())).withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("n"), "first_pos"))
    )
    pct = pct_half_even(F.col("n"), F.col("_total"))
    return ranked.select(
        "rank", "category", "n", pct.alias("pct"),
        F.concat(F.col("n").cast("string"), F.lit(" ("), pct.cast("string"), F.lit("%)")).alias("label"),
    )


def keep_zero(dist: DataFrame, names: list[str] | DataFrame) -> DataFrame:
    """A distribution with the categories of the caller's list that no ticket has, as
    rows of 0 (0%) after the others, in list order.  ``names``: a list, or a table
    ``(ordinal, category)``; both sides have one row per category."""
    if not isinstance(names, DataFrame):
        names = dist.sparkSession.createDataFrame(list(enumerate(dict.fromkeys(names))), "ordinal long, category string")
    empty = names.join(dist.select("category"), "category", "left_anti")
    after = F.row_number().over(Window.orderBy("ordinal"))
    ranked = dist.agg(F.coalesce(F.max("rank"), F.lit(0)).alias("r")).scalar()
    zero = empty.select((after + ranked).cast("int").alias("rank"), "category", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("pct"), F.lit("0 (0%)").alias("label"))
    return dist.unionByName(zero)


def named_count(labelled: DataFrame, col: str = "new_category") -> Column:
    """AGG4: distinct named categories (Uncategorised and null excluded)."""
    return F.count_distinct(F.when(F.col(col) != UNCATEGORISED, F.col(col)))


def category_samples(labelled: DataFrame, k: int = 3, col: str = "new_category", order_col: str = "pos") -> DataFrame:
    """WIN1: first ``k`` tickets per category in order.  ``row_number <= k``
    becomes a WindowGroupLimit before the exchange, so a category holding a
    third of the rows still ships only ``k`` rows per task."""
    w = Window.partitionBy(col).orderBy(order_col)
    return (
        labelled.filter(F.col(col).isNotNull())
        .withColumn("rn", F.row_number().over(w))
        .filter(F.col("rn") <= k)
        .select(F.col(col).alias("category"), "rn", order_col, "ticket_id", "issue_description", "reasoning")
    )


def uncategorised_head(labelled: DataFrame, n: int = 10, col: str = "new_category", order_col: str = "pos") -> DataFrame:
    """ORD5: first ``n`` Uncategorised tickets (TakeOrderedAndProject)."""
    return labelled.filter(F.col(col) == UNCATEGORISED).orderBy(order_col).limit(n)


def running_categories(labelled: DataFrame, col: str = "new_category", batch: str = "batch_id") -> DataFrame:
    """WIN2 / RPT8: distinct named categories seen up to and including each batch.

    Per category its first batch (aggregate, one row per category); per batch
    the number of categories first seen there; the running sum over batches
    uses the bucketed distributed prefix sum (no single-partition window).
    """
    named = F.col(col).isNotNull() & (F.col(col) != UNCATEGORISED)
    firsts = labelled.filter(named).groupBy(col).agg(F.min(batch).alias("_fb"))
    per_batch = labelled.select(F.col(batch).alias("batch_id"), F.lit(0).alias("_v")).unionByName(
        firsts.select(F.col("_fb").alias("batch_id"), F.lit(1).alias("_v"))
    ).groupBy("batch_id").agg(F.sum("_v").alias("new_categories"))
    # the prefix sum reads its input three times (bounds, bucket totals, rows):
    # write the small per-batch table once instead of re-running the upstream
    per_batch = materialize(per_batch, "per_batch")
    return running_total(per_batch, "batch_id", "new_categories", "categories_so_far", written=True)


def breakdown_from_counts(summaries: DataFrame, counts: DataFrame) -> DataFrame:
    """JON6 / RPT4 over a ``(_cat, n)`` count table: one row per summarised category
    (Uncategorised skipped): tickets (0 when none), share of *all* rows, summary.
    Categories without a summary are not listed.  Both sides have one row per category."""
    named = summaries.filter(F.col("category") != UNCATEGORISED)
    # both inputs have one row per category: stack them and aggregate by
    # category (no join); the row total is a window over that small result
    stacked = named.select("category", "summary", F.lit(None).cast("long").alias("n"), F.lit(1).alias("_s")).unionByName(
        counts.select(F.col("_cat").alias("category"), F.lit(None).cast("string").alias("summary"), "n", F.lit(0).alias("_s"))
    )
    per = stacked.groupBy("category").agg(
        F.max("summary").alias("summary"), F.sum("n").alias("n"), F.max("_s").alias("_s")
    ).withColumn("_rows", F.sum("n").over(Window.partitionBy()))
    j = per.filter((F.col("_s") == 1) & F.col("category").isNotNull())
    n = F.coalesce(F.col("n"), F.lit(0))
    return j.select("category", n.alias("tickets"), pct_half_even(n, F.col("_rows")).alias("pct"), "summary")


def results_table(labelled: DataFrame, low_only: bool = False) -> DataFrame:
    """RPT1 = FLT1 + PRJ1."""
    src = labelled.filter(F.col("confidence") == "Low") if low_only else labelled
    return src.select(
        "ticket_id",
        cut("issue_description", 80).alias("description"),
        F.col("current_label").alias("old_label"),
        F.col("new_category").alias("category"),
        "confidence",
        "reasoning",
    )


def uncategorised_panel(counts: DataFrame) -> DataFrame:
    """AGG7 / RPT6 from a count table: the Uncategorised count and whether the bucket is empty."""
    n = F.coalesce(F.sum(F.when(F.col("category") == UNCATEGORISED, F.col("n"))), F.lit(0))
    return counts.agg(n.alias("uncategorised")).withColumn("all_categorised", F.col("uncategorised") == 0)


def batch_metrics(labelled: DataFrame, col: str = "new_category", batch: str = "batch_id") -> DataFrame:
    """RPT8: per batch: tickets, failed rows (reasoning starts with the error
    prefix), categories so far."""
    per = labelled.groupBy(F.col(batch).alias("batch_id")).agg(
        F.count(F.lit(1)).alias("tickets"),
        F.count_if(F.col("reasoning").startswith("Processing error: ")).alias("failed"),
    )
    return per.join(running_categories(labelled, col, batch), "batch_id", "left")


def trend_by_day(events: DataFrame, ts: str = "ts", col: str = "event_type") -> DataFrame:
    """Documented-only trend: per day and category the count and the change
    against the previous day of that category (lag over one row per day)."""
    daily = events.groupBy(F.date_trunc("day", F.col(ts)).alias("day"), F.col(col).alias("category")).agg(
        F.count(F.lit(1)).alias("n")
    )
    w = Window.partitionBy("category").orderBy("day")
    return daily.withColumn("change", F.col("n") - F.lag("n").over(w))
