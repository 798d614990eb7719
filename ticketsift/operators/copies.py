"""Exact-copy collapse before an expensive decider.

Tickets whose description, label and notes are identical get one decision:
the first copy (lowest position) stands for its group, only those
representatives are batched and sent to the decider, and the decision is
joined back onto every copy.

* The copy key is a 128-bit md5 of the three texts, so distinct tickets do
  not collide at any realistic row count.
* Representatives come from ``min_by(struct(...), pos)`` per key: a partial
  aggregate, so a group holding a large share of the rows is combined
  map-side and never reaches one task whole.
* The join back salts the hot keys only: a key with more than
  ``rows / partitions`` copies (at most ``partitions`` such keys exist) has
  its rows spread over ``partitions`` salts and its single decision row
  replicated once per salt; every other key joins on salt 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_partitions

COPY_KEY = "_copy"
COPIES = "_copies"
SALT = "_salt"
# --- fixed values -----------------------------------------------------------
FIELD_SEP = "\x1f"        # unit separator between the texts of the copy key
# -----------------------------------------------------------------------------


def copy_key(cols=("issue_description", "current_label", "resolution_notes")) -> Column:
    return F.md5(F.concat_ws(FIELD_SEP, *[F.coalesce(F.col(c), F.lit("")) for c in cols]))


def first_copies(keyed: DataFrame, order_col: str = "pos", key: str = COPY_KEY) -> DataFrame:
    """One row per copy key: the columns of its first copy plus ``_copies``."""
    others = [c for c in keyed.columns if c not in (key, order_col)]
    first = F.min_by(F.struct(*[F.col(c) for c in others]), F.col(order_col)).alias("_r")
    agg = keyed.groupBy(key).agg(F.min(order_col).alias(order_col), first, F.count(F.lit(1)).alias(COPIES))
    return agg.select(key, COPIES, order_col, *[F.col(f"_r.{c}").alias(c) for c in others])


def hot_keys(reps: DataFrame, parts: int, key: str = COPY_KEY) -> list[str]:
    """Keys holding more than ``rows / parts`` copies: at most ``parts`` of them."""
    total = reps.agg(F.sum(COPIES)).first()[0] or 0
    rows = reps.filter(F.col(COPIES) * parts > total).select(key).limit(parts + 1).collect()
    return sorted(r[0] for r in rows)


def spread_back(rows: DataFrame, decided: DataFrame, hot: list[str], parts: int,
                order_col: str = "pos", key: str = COPY_KEY) -> DataFrame:
    """Join the per-key decisions onto every copy, salting the hot keys."""
    if not hot:
        return rows.join(decided, key, "left")
    is_hot = F.col(key).isin(hot)
    rows_s = rows.withColumn(SALT, F.when(is_hot, F.pmod(F.xxhash64(F.col(order_col)), F.lit(parts))).otherwise(F.lit(0)))
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    dec_s = decided.withColumn(SALT, F.explode(salts))
    return rows_s.join(dec_s, [key, SALT], "left").drop(SALT)


def collapse_parts(spark) -> int:
    return max(1, shuffle_partitions(spark))
