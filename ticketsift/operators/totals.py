"""RPT8 totals taken while the data is written (``Observation``), and mergeable
distinct counts (AGG4) from HyperLogLog sketches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .normalise import UNCATEGORISED
from .responses import ERROR_PREFIX

#: log2 of a sketch's registers; the standard error is 1.04 / sqrt(registers).
SKETCH_BITS = 12
#: Standard errors within which an estimate must lie.
SKETCH_SIGMAS = 4


def observed(labelled: DataFrame, col: str = "new_category") -> tuple[DataFrame, Observation]:
    """The same rows, and totals that are complete after the first action over them:
    no second scan.  Read ``observation.get`` after the write."""
    seen = Observation(f"totals-{uuid.uuid4().hex}")
    return labelled.observe(
        seen,
        F.count(F.lit(1)).alias("tickets"),
        F.count_if(F.col(col) == UNCATEGORISED).alias("uncategorised"),
        F.count_if(F.col(col).isNull()).alias("unlabelled"),
        F.count_if(F.col("confidence") == "Low").alias("low_confidence"),
        F.count_if(F.col("reasoning").startswith(ERROR_PREFIX)).alias("failed"),
    ), seen


def batch_sketches(df: DataFrame, keys: list[str], batch: str, value: str, bits: int = SKETCH_BITS) -> DataFrame:
    """AGG4: per key and batch a sketch of the distinct values and their number of
    rows; a batch that comes later adds rows, nothing is counted again."""
    return df.groupBy(*keys, batch).agg(F.hll_sketch_agg(value, bits).alias("sketch"), F.count(F.lit(1)).alias("rows"))


def united(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The batches' sketches as one per key: ``estimate``, ``rows``."""
    one = sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("rows").alias("rows"))
    return one.select(*keys, F.hll_sketch_estimate("sketch").alias("estimate"), "rows")


def within_bound(estimate, exact, bits: int = SKETCH_BITS):
    """Whether an estimate is as near to the exact count as the sketch promises."""
    bound = SKETCH_SIGMAS * 1.04 / (1 << bits) ** 0.5
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), exact * F.lit(bound))
