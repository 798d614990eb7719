"""Ordering and batching (ORD1-ORD5) and a distributed running total.

Spark has no row order, so every "file order" rule of the reference needs a
declared, unique order key.  Dense positions and running totals are computed
without a single-partition window:

0. write the narrow ``(key, value)`` table once (one pass over the upstream);
1. cut the key range into ``n`` buckets at quantiles of a key sample (about
   32 keys per bucket reach the driver, result = ``n-1`` numbers);
2. total per bucket (partial + final hash aggregate, result = ``n`` rows);
3. prefix offsets of those totals on the driver (``n`` numbers) as a literal;
4. ``offset[bucket] + running sum within bucket`` with a window partitioned
   by bucket, so each task holds about ``rows / n`` rows.

The buckets are a pure function of the key, so a recomputed task after an
executor loss lands every row in the same bucket again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, shuffle_partitions

BATCH_SIZE = 10
_CASE_LIMIT = 64


SAMPLE_PER_BUCKET = 32
SAMPLE_MAX = 1_000_000


def _bounds(keys: DataFrame, key: str, n: int) -> list:
    """``n - 1`` increasing bucket bounds from a key sample on the driver.

    About ``SAMPLE_PER_BUCKET`` keys per bucket (at most ``SAMPLE_MAX``)
    reach the driver, as in Spark's own range partitioning.  A global
    ``percentile_approx`` is avoided on purpose: its per-task sketches all
    merge in one task, and at the accuracy thousands of buckets need they
    keep nearly every key.  Balanced buckets only matter for speed; the
    positions are exact whatever the bounds.
    """
    if n <= 1:
        return []
    total = keys.count()
    if total == 0:
        return []
    frac = min(1.0, min(SAMPLE_PER_BUCKET * n, SAMPLE_MAX) / total)
    sample = sorted(r[0] for r in keys.select(key).sample(fraction=frac, seed=17).where(F.col(key).isNotNull()).collect())
    out = []
    for q in (sample[int(i / n * len(sample))] for i in range(1, n)) if sample else ():
        if not out or q > out[-1]:
            out.append(q)
    return out


def bucket_of(key: Column, bounds: list) -> Column:
    """Index of the quantile bucket holding ``key`` (number of bounds <= key)."""
    if not bounds:
        return F.lit(0)
    if len(bounds) <= _CASE_LIMIT:
        expr = None
        for i, b in enumerate(bounds):
            expr = F.when(key < F.lit(b), F.lit(i)) if expr is None else expr.when(key < F.lit(b), F.lit(i))
        return expr.otherwise(F.lit(len(bounds)))
    # many bounds on a non-numeric key: two levels of about sqrt(n) bounds.
    # The key's chunk is the number of chunk heads <= key; every bound of the
    # earlier chunks is <= key and none of the later ones, so the bucket is
    # chunk * size + the bounds <= key inside that chunk: O(sqrt n) per row.
    size = math.isqrt(len(bounds) - 1) + 1
    chunks = [bounds[i:i + size] for i in range(0, len(bounds), size)]
    heads = F.array(*[F.lit(c[0]) for c in chunks[1:]])
    chunk = F.size(F.filter(heads, lambda h: h <= key))
    inner = F.element_at(F.array(*[F.array(*[F.lit(b) for b in c]) for c in chunks]), chunk + 1)
    return chunk * F.lit(size) + F.size(F.filter(inner, lambda b: b <= key))


def tag_buckets(df: DataFrame, key: str, bounds: list, out: str = "_bkt") -> tuple[DataFrame, int]:
    """Add the quantile bucket of ``key``; returns the frame and the bucket count.

    Few bounds: a ``CASE`` chain.  Many bounds on a numeric key (a large
    cluster has thousands of shuffle partitions): ``Bucketizer``'s binary
    search, O(log n) per row instead of a scan over every bound.  The key is
    compared as a double there; the cast is monotone, so the bucket is still a
    non-decreasing pure function of the key (equal doubles share a bucket).
    """
    numeric = isinstance(df.schema[key].dataType, T.NumericType)
    if len(bounds) <= _CASE_LIMIT or not numeric:
        return df.withColumn(out, bucket_of(F.col(key), bounds)), len(bounds) + 1
    from pyspark.ml.feature import Bucketizer

    splits = sorted({float(b) for b in bounds})
    tmp = f"{out}_key"
    bz = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol=tmp, outputCol=out, handleInvalid="keep")
    tagged = bz.transform(df.withColumn(tmp, F.col(key).cast("double")))
    return tagged.withColumn(out, F.col(out).cast("int")).drop(tmp), len(splits) + 1


def running_total(df: DataFrame, key: str, value: Column | str | None = None, out: str = "running",
                  buckets: int | None = None, written: bool = False) -> DataFrame:
    """Inclusive running sum of ``value`` (default 1 = running count) by ``key``.

    ``key`` must be unique and non-null.  ``written``: ``df`` is already a
    narrow table read from files, so its keys are not written again.
    """
    return _running(df, key, value, out, buckets, written)[0].drop(BUCKET)


BUCKET = "_bkt"


def _running(df: DataFrame, key: str, value, out: str, buckets: int | None,
             written: bool = False) -> tuple[DataFrame, list[int]]:
    """The running total with the bucket column kept, and the bucket offsets."""
    n = buckets or shuffle_partitions(df.sparkSession)
    val = F.lit(1).cast("long") if value is None else (F.col(value) if isinstance(value, str) else value).cast("long")
    # the narrow (key, value) table is written once: the count, the key
    # sample and the bucket totals read it instead of re-running the
    # upstream (often a scan of whole texts) three more times
    keys = df.select(F.col(key), val.alias("_val"))
    if not written:
        keys = materialize(keys, "order_keys")
    bounds = _bounds(keys, key, n)
    counted, n_buckets = tag_buckets(keys, key, bounds)
    totals = {r["_bkt"]: (r["t"] or 0) for r in counted.groupBy("_bkt").agg(F.sum("_val").alias("t")).collect()}
    tagged = tag_buckets(df, key, bounds)[0].withColumn("_val", val)
    offsets, acc = [], 0
    for b in range(n_buckets):
        offsets.append(acc)
        acc += totals.get(b, 0)
    w = Window.partitionBy("_bkt").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    off = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets]), F.col("_bkt") + 1)
    return tagged.withColumn(out, off + F.sum("_val").over(w)).drop("_val"), offsets


def assign_positions(df: DataFrame, key: str, out: str = "pos", buckets: int | None = None,
                     written: bool = False) -> DataFrame:
    """ORD1: dense 0-based position in ``key`` order (``written``: see ``running_total``)."""
    return running_total(df, key, None, out, buckets, written).withColumn(out, F.col(out) - 1)


def positions_by_bucket(df: DataFrame, key: str, out: str = "pos", buckets: int | None = None) -> tuple[DataFrame, list[int]]:
    """ORD1 keeping the quantile bucket column ``_bkt``, plus the position at
    which every bucket starts.

    After the position window the rows stay hash-partitioned by ``_bkt``, so a
    grouping on ``(_bkt, ...)`` needs no second exchange; the offsets tell
    which batches cross a bucket border (see ``straddling_batches``).
    """
    pos, offsets = _running(df, key, None, out, buckets)
    return pos.withColumn(out, F.col(out) - 1), offsets


def straddling_batches(offsets: list[int], size: int = BATCH_SIZE) -> list[int]:
    """Batches holding rows of two or more buckets: the batch of each bucket
    start that is not a multiple of ``size`` (at most one per bucket)."""
    return sorted({o // size for o in offsets[1:] if o % size})


def assign_batches(df: DataFrame, size: int = BATCH_SIZE, pos: str = "pos") -> DataFrame:
    """ORD2: ``batch_id = pos div size``, ``batch_pos = pos mod size``."""
    return df.withColumns(
        {"batch_id": F.expr(f"`{pos}` div {int(size)}").cast("long"), "batch_pos": (F.col(pos) % size).cast("int")}
    )


def group_hash(key: Column) -> Column:
    """A 32-bit hash of a key from its md5 (the first 8 hex digits), the same
    in any SQL engine, so a batching built on it can be checked outside Spark."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")


def assign_batches_unordered(df: DataFrame, size: int = BATCH_SIZE, spread: int | None = None,
                             key: str = "ticket_id") -> DataFrame:
    """ORD3: order-free batching for scale.  Rows are spread over ``spread``
    hash groups; inside a group, ``size`` consecutive rows (by ``key``) form a
    batch.  Nothing global is sorted; a group holds ``rows / spread`` rows
    (the key is unique, so no group is hot), and a batch never spans two
    groups, so grouping texts by ``batch_id`` afterwards can reuse the
    window's partitioning.  ``batch_id = group * 2^32 + index in group``."""
    spread = spread or shuffle_partitions(df.sparkSession)
    g = F.pmod(group_hash(F.col(key)), F.lit(spread))
    w = Window.partitionBy("_grp").orderBy(key)
    rn = F.row_number().over(w) - 1
    return (
        df.withColumn("_grp", g)
        .withColumn("_rn", rn)
        .withColumn("batch_id", F.col("_grp") * F.lit(1 << 32) + F.floor(F.col("_rn") / size).cast("long"))
        .withColumn("batch_pos", (F.col("_rn") % size).cast("int"))
        .drop("_grp", "_rn")
    )
