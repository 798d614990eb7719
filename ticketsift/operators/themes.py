"""Multi-tag themes (MTG1, DEC3 output, AGG5, AGG6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import pct_half_even, ustrip

TAG_SEP = " | "


def join_tags(df: DataFrame, tags: str = "tags", out: str = "multi_tags") -> DataFrame:
    """``tags`` array → the exported `` | ``-joined string ('' when empty)."""
    return df.withColumn(out, F.coalesce(F.array_join(F.col(tags), TAG_SEP), F.lit("")))


def theme_occurrences(themed: DataFrame, col: str = "multi_tags", order_col: str = "pos") -> DataFrame:
    """AGG5 input: one row per tag occurrence: skip empty strings, split on
    ``|``, strip each piece (an inner empty piece stays as '').  A ticket
    without tags yields one row with a null theme, so the ticket count can be
    taken in the same pass (rows with ``_idx`` 0 or null = one per ticket)."""
    parts = F.when(F.col(col).isNotNull() & (F.col(col) != ""), F.split(F.col(col), "[|]"))
    return themed.select(F.col(order_col).alias("_pos"), F.posexplode_outer(parts).alias("_idx", "_t")).select(
        "_pos", "_idx", ustrip("_t").alias("theme")
    )


def _theme_groups(themed: DataFrame, col: str, order_col: str) -> DataFrame:
    occ = theme_occurrences(themed, col, order_col)
    return occ.groupBy("theme").agg(
        F.count("_idx").alias("n"),
        F.count_if(F.coalesce(F.col("_idx") == 0, F.lit(True))).alias("_tickets"),
        F.min(F.struct("_pos", "_idx")).alias("_first"),
    )


def theme_counts(themed: DataFrame, col: str = "multi_tags", order_col: str = "pos") -> DataFrame:
    """AGG5 / RPT3: ``(theme, n, first_pos, first_idx)``; a tag repeated within one
    ticket counts twice.  Partial aggregation map-side, one row per theme out."""
    g = _theme_groups(themed, col, order_col).filter(F.col("theme").isNotNull())
    return g.select("theme", "n", F.col("_first._pos").alias("first_pos"), F.col("_first._idx").alias("first_idx"))


def top_themes(themed: DataFrame, k: int = 3, col: str = "multi_tags", order_col: str = "pos") -> DataFrame:
    """AGG6 / RPT7: top-k themes by count (ties: first appearance), with
    ``round(n / tickets * 100)`` where the denominator is the ticket count.
    One pass: the ticket count is summed over the per-theme groups."""
    g = _theme_groups(themed, col, order_col).withColumn("tickets", F.sum("_tickets").over(Window.partitionBy()))
    g = g.filter(F.col("theme").isNotNull()).select(
        "theme", "n", "tickets", F.col("_first._pos").alias("first_pos"), F.col("_first._idx").alias("first_idx")
    )
    ranked = g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "first_pos", "first_idx")))
    return ranked.filter(F.col("rank") <= k).select("rank", "theme", "n", pct_half_even("n", "tickets").alias("pct"))


def tag_total_check(themed: DataFrame, col: str = "multi_tags") -> DataFrame:
    """QLT6: total tags vs rows (tags should not undercount rows at full depth)."""
    n_tags = F.when(F.col(col) == "", 0).otherwise(F.size(F.split(F.col(col), "[|]")))
    return themed.agg(F.sum(n_tags).alias("tags"), F.count(F.lit(1)).alias("rows")).withColumn(
        "tags_exceed_rows", F.col("tags") >= F.col("rows")
    )
