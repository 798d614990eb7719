"""Taxonomy model, threshold fold-in (AGG2/JON7), first-seen order (ACC2/WIN3),
sampling (SMP1/SMP2) and term-based category discovery (DEC4)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import materialize
from .normalise import UNCATEGORISED

# --- fixed values -----------------------------------------------------------
# Starter taxonomy for the lexical decider over the driver tables, in ordinal
# order: (name, keywords, weight).  Structural categories first (weight 10),
# then one function-word category per language (weight 1).
STARTER = (
    ("Licence Notice", ("license", "licensed"), 10),
    ("Credential Exposure", ("token", "secret", "password"), 10),
    ("Contact Data", ("mail", "example"), 10),
    ("English Text", ("the", "and", "with", "that"), 1),
    ("German Text", ("und", "der", "die", "von"), 1),
    ("French Text", ("une", "les", "des", "elle"), 1),
    ("Spanish Text", ("los", "para", "una", "del"), 1),
)
MIN_BUCKET = 5          # named categories below this many rows fold into Uncategorised
SAMPLE_MIN, SAMPLE_MAX, SAMPLE_FRACTION = 13, 25, 0.25
SAMPLE_SEED = 42
# Short function words of the four test languages, removed before discovery.
STOP_WORDS = (
    "the", "and", "with", "that", "for", "are", "this", "was", "from", "has",
    "und", "der", "die", "von", "das", "den", "ein", "eine", "ist", "mit", "sich", "nicht",
    "une", "les", "des", "elle", "est", "pour", "par", "dans", "que", "qui", "avec", "sur",
    "los", "para", "una", "del", "las", "por", "con", "que", "como", "uno",
)
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Category:
    name: str
    keywords: tuple[str, ...] = ()
    weight: int = 1
    source: str = "seed"


@dataclass
class Taxonomy:
    """Ordered category list; small by construction (driver-held, broadcast)."""

    categories: list[Category] = field(default_factory=list)

    @classmethod
    def starter(cls) -> "Taxonomy":
        return cls([Category(n, tuple(k), w) for n, k, w in STARTER])

    @classmethod
    def from_names(cls, names, source: str = "seed") -> "Taxonomy":
        out: list[Category] = []
        for n in names:
            if n and n != UNCATEGORISED and n not in {c.name for c in out}:
                out.append(Category(n, (), 1, source))
        return cls(out)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.categories]

    def keywords(self) -> list[str]:
        seen: list[str] = []
        for c in self.categories:
            for k in c.keywords:
                if k not in seen:
                    seen.append(k)
        return seen

    def append(self, names, source: str = "discovered") -> "Taxonomy":
        """ACC1 append: unseen, non-empty, non-Uncategorised names, in order."""
        cats = list(self.categories)
        have = {c.name for c in cats}
        for n in names:
            if n and n != UNCATEGORISED and n not in have:
                cats.append(Category(n, (), 1, source))
                have.add(n)
        return Taxonomy(cats)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i, c.name, c.source, list(c.keywords), c.weight) for i, c in enumerate(self.categories)]
        return spark.createDataFrame(
            rows, "ordinal int, category string, source string, keywords array<string>, weight int"
        )


def category_counts(labelled: DataFrame, cat: str = "new_category", order_col: str = "pos") -> DataFrame:
    """AGG1: rows per category (nulls ignored, '' counted) with first position."""
    return (
        labelled.filter(F.col(cat).isNotNull())
        .groupBy(F.col(cat).alias("category"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(order_col).alias("first_pos"))
    )


def apply_threshold(
    labelled: DataFrame,
    min_bucket: int = MIN_BUCKET,
    min_fraction: float = 0.0,
    cat: str = "new_category",
    order_col: str = "pos",
    max_categories: int | None = None,
) -> DataFrame:
    """AGG2: every named category with fewer than ``k`` rows becomes Uncategorised.

    ``k = max(min_bucket, ceil(min_fraction * rows))``.  One pass over the
    original counts; Uncategorised and null categories are untouched.

    The counts table has one row per distinct category.  When the caller knows
    that bound (``max_categories`` = taxonomy size + 1 for the lexical decider)
    it is broadcast; otherwise it is counted first and broadcast only below
    the session's broadcast limit, else a shuffle join is used.  ``labelled``
    should be materialised (see ``session.materialize``) because it is read twice.
    """
    counts = (
        labelled.filter(F.col(cat).isNotNull())
        .groupBy(F.col(cat).alias("_cat"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    if min_fraction:
        total = labelled.filter(F.col(cat).isNotNull()).count()
        k = max(min_bucket, int(-(-min_fraction * total // 1)))
    else:
        k = min_bucket
    small = counts.filter((F.col("_n") < k) & (F.col("_cat") != UNCATEGORISED)).select("_cat")
    small = bounded_broadcast(small, max_categories)
    flagged = labelled.join(small.withColumn("_fold", F.lit(True)), F.col(cat) == F.col("_cat"), "left")
    return flagged.withColumn(
        cat, F.when(F.col("_fold"), F.lit(UNCATEGORISED)).otherwise(F.col(cat))
    ).drop("_cat", "_fold")


def small_categories(counts: dict, min_bucket: int = MIN_BUCKET, min_fraction: float = 0.0) -> list[str]:
    """AGG2 decision on a category → rows table already on the driver:
    named categories below ``k = max(min_bucket, ceil(min_fraction * rows))``
    (rows = tickets with a category); Uncategorised and null are exempt."""
    total = sum(n for c, n in counts.items() if c is not None)
    k = max(min_bucket, int(-(-min_fraction * total // 1))) if min_fraction else min_bucket
    return sorted(c for c, n in counts.items() if c is not None and c != UNCATEGORISED and n < k)


def fold_small(labelled: DataFrame, small: list[str], cat: str = "new_category") -> DataFrame:
    """Apply the AGG2 decision with a literal ``isin``: one projection, no join,
    no shuffle (the list is at most the category count table)."""
    if not small:
        return labelled
    return labelled.withColumn(cat, F.when(F.col(cat).isin(small), F.lit(UNCATEGORISED)).otherwise(F.col(cat)))


def low_to_uncategorised(labelled: DataFrame, cat: str = "new_category") -> DataFrame:
    """Rows of low confidence leave their category (an option of a run)."""
    return labelled.withColumn(cat, F.when((F.col("confidence") == "Low") & F.col(cat).isNotNull(), F.lit(UNCATEGORISED)).otherwise(F.col(cat)))


def fold_small_table(labelled: DataFrame, min_bucket: int = MIN_BUCKET, min_fraction: float = 0.0,
                     cat: str = "new_category", order_col: str = "pos") -> tuple[DataFrame, DataFrame]:
    """AGG2 with the counts as a written table, for any number of categories:
    the labels after the threshold and their count table ``(category, n, first_pos)``.

    The small names join from the written table, so Spark decides by its bytes
    whether to broadcast it; ``labelled`` should be a written table (read twice)."""
    counts = materialize(category_counts(labelled, cat, order_col), "counts")
    k = min_bucket
    if min_fraction:
        total = counts.agg(F.sum("n")).first()[0] or 0
        k = max(k, int(-(-min_fraction * total // 1)))
    is_small = (F.col("n") < k) & (F.col("category") != UNCATEGORISED)
    small = counts.where(is_small).select(F.col("category").alias("_cat"))
    folded = labelled.join(small, F.col(cat) == F.col("_cat"), "left")
    folded = folded.withColumn(cat, F.when(F.col("_cat").isNotNull(), F.lit(UNCATEGORISED)).otherwise(F.col(cat))).drop("_cat")
    kept = counts.withColumn("category", F.when(is_small, F.lit(UNCATEGORISED)).otherwise(F.col("category")))
    kept = kept.groupBy("category").agg(F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"))
    return folded, materialize(kept, "counts")


def fold_counts(counts: dict, small: list[str]) -> dict:
    """The count table after ``fold_small`` (computed on the driver)."""
    out: dict = {}
    for c, n in counts.items():
        key = UNCATEGORISED if c in small else c
        out[key] = out.get(key, 0) + n
    return out


BROADCAST_ROWS = 100_000


def bounded_broadcast(df: DataFrame, bound: int | None) -> DataFrame:
    """Broadcast a small side only when its row count is proven small."""
    if bound is not None and bound <= BROADCAST_ROWS:
        return F.broadcast(df)
    n = df.count()
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def first_seen(labelled: DataFrame, cat: str = "new_category", order_col: str = "pos") -> DataFrame:
    """ACC2 + WIN3: distinct named categories in first-appearance order.

    The aggregated table has one row per category, so the global ordinal
    window runs on a tiny input.
    """
    firsts = (
        labelled.filter(F.col(cat).isNotNull() & (F.col(cat) != "") & (F.col(cat) != UNCATEGORISED))
        .groupBy(F.col(cat).alias("category"))
        .agg(F.min(order_col).alias("first_pos"), F.count(F.lit(1)).alias("n"))
    )
    return firsts.withColumn("ordinal", F.row_number().over(Window.orderBy("first_pos", "category")) - 1)


def sample_size(rows: int, lo: int = SAMPLE_MIN, hi: int = SAMPLE_MAX, frac: float = SAMPLE_FRACTION) -> int:
    """SMP1 size rule: 25 % of the rows, at least 13, at most 25."""
    return max(lo, min(hi, int(rows * frac)))


def sample_key(id_col: str = "ticket_id", seed: int = SAMPLE_SEED):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col)))


def suggestion_sample(tickets: DataFrame, n: int, id_col: str = "ticket_id", seed: int = SAMPLE_SEED) -> DataFrame:
    """SMP1: exact-n uniform sample without replacement, reproducible under any
    partitioning: order by a seeded hash of the id (TakeOrderedAndProject)."""
    return (
        tickets.withColumn("sample_key", sample_key(id_col, seed))
        .orderBy("sample_key", id_col)
        .limit(n)
    )


def stratified_sample(tickets: DataFrame, per_stratum: int, stratum: str = "current_label",
                      id_col: str = "ticket_id", seed: int = SAMPLE_SEED) -> DataFrame:
    """SMP2 (documented backlog): first ``k`` per stratum by the seeded hash.
    WindowGroupLimit keeps a hot stratum from reaching one task whole."""
    w = Window.partitionBy(stratum).orderBy("sample_key", id_col)
    return (
        tickets.withColumn("sample_key", sample_key(id_col, seed))
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= per_stratum)
        .drop("_rn")
    )


def suggest_terms(
    sample: DataFrame,
    k: int = 10,
    min_len: int = 4,
    text_cols=("issue_description", "current_label"),
    stop_words=STOP_WORDS,
) -> DataFrame:
    """DEC4 (lexical): propose category seeds as the top-k tokens by document
    frequency in the sample, stop words and short tokens removed.

    explode → partial+final hash aggregate → top-k (TakeOrderedAndProject).
    """
    text = F.concat_ws(" ", *[F.col(c) for c in text_cols])
    terms = (
        sample.select(F.explode(F.array_distinct(tokens(text))).alias("term"))
        .filter((F.length("term") >= min_len) & ~F.col("term").isin(list(stop_words)))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    return terms.orderBy(F.desc("df"), "term").limit(k)
