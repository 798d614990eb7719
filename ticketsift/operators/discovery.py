"""Category discovery as a table function (2.15) over a partitioned table argument.

``top_terms`` takes a table of counted terms, partitioned by label and ordered by
falling count: it returns each partition's first rows and reads past the rest.  The
counts are aggregated before (map-side first), so a label that holds a third of the
tickets sends its vocabulary, not its texts, to one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.text import tokens
from .taxonomy import STOP_WORDS


@udtf(returnType="label string, rank int, term string, df long")
class TopTerms:
    """The first ``k`` rows of a partition with their rank."""

    def __init__(self):
        self.rank = 0

    def eval(self, row, k: int):
        if self.rank < k:
            self.rank += 1
            yield row["label"], self.rank, row["term"], row["df"]


def label_terms(tickets: DataFrame, label: str = "current_label", text: str = "issue_description", min_len: int = 4) -> DataFrame:
    """``(label, term, df)``: tickets of a label that hold a term."""
    rows = tickets.select(F.col(label).alias("label"), F.explode(F.array_distinct(tokens(text))).alias("term"))
    rows = rows.where((F.length("term") >= min_len) & ~F.col("term").isin(list(STOP_WORDS)))
    return rows.groupBy("label", "term").agg(F.count(F.lit(1)).alias("df"))


def discover_by_label(tickets: DataFrame, k: int = 3, label: str = "current_label") -> DataFrame:
    """Per label its ``k`` most frequent terms (ties by term): ``(label, rank, term, df)``."""
    terms = label_terms(tickets, label)
    argument = terms.asTable().partitionBy("label").orderBy(F.desc("df"), F.asc("term"))
    return TopTerms(argument, F.lit(k))
