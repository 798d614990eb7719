"""Embedding whitening from polarised covariances (operator 11).

Entries become integers ``floor(256 * c)``.  The fit list holds each distinct
integer vector once.  Its sums per dimension give the integer nearest to each
mean; values are centred on it, and Spark adds up the exact squares of every
centred dimension and of every sum of two centred dimensions, no product of two
dimensions.  With ``var(a + b) - var(a) - var(b) = 2 cov(a, b)`` the differences
of these variances are the cross-covariances.  Sums travel as limbs of 30 bits,
so they are exact at any number of rows; what the integer centre leaves of the
mean is taken off in integers as well, and each covariance is rounded once.

The covariance matrix (dimensions squared, whatever the rows) goes to ``eigh``
on the driver.  Rows are projected on the leading components and scaled to unit
variance; ``identity_error`` is measured by a pass over the fit list.

Rows: a null vector, or one with null or non-finite entries, is left out, as is
an empty one (it has no components).  Entries whose integer is beyond 2**61
saturate there.  Null ids are kept, and so are repeated
rows (one vector of the fit list).  Vectors of different lengths are fitted
apart.  Components without variance (one distinct vector, constant or dependent
dimensions) give a null ``whitened`` and count nowhere in ``identity_error``,
which is null if there is no other.  A ``deviation`` beyond a long is null;
``deviation_exact`` always has it.  Extra columns are not read.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import lean, small_batches

#: Components that are returned, and the factor before the floor.
COMPONENTS, SCALE = 4, 256
#: Exact sums travel in limbs of this many bits.
LIMB = 30
#: Entries below this size keep squares and their sums over a batch inside a long.
NARROW = 1 << 22
#: Integers saturate here, so that differences of two stay longs.
WIDEST = 2.0**61
#: A component whose variance is below this share of the largest has none (rounding of eigh).
NO_VARIANCE = 1e-12
#: The integer types that a vector is written in, the smallest that holds it.
KINDS = ("<i2", "<i4", "<i8")


def encode(x: np.ndarray) -> bytes:
    """An integer vector as bytes; equal vectors give equal bytes."""
    most = int(np.abs(x).max()) if len(x) else 0
    k = 0 if most < 1 << 15 else 1 if most < 1 << 31 else 2
    return bytes([k]) + x.astype(KINDS[k]).tobytes()


def decode(b: bytes) -> np.ndarray:
    return np.frombuffer(b, dtype=KINDS[b[0]], offset=1).astype(np.int64)


def decode_rows(column: pd.Series) -> np.ndarray:
    """The vectors of a batch (all of one length) as a matrix."""
    return np.stack([decode(b) for b in column])


def integers(vector) -> np.ndarray | None:
    """``floor(256 * c)`` of each entry, or None for a vector that takes no part."""
    if vector is None or not len(vector):
        return None
    x = np.array([np.nan if c is None else c for c in vector], dtype=np.float64)
    if not np.isfinite(x).all():
        return None
    return np.clip(np.floor(x * SCALE), -WIDEST, WIDEST).astype(np.int64)


def limbs(key: int, value: int) -> Iterator[tuple[int, int, int]]:
    """An integer as ``(key, place, signed limb)``."""
    sign, value, place = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield key, place, sign * (value & (1 << LIMB) - 1)
        value >>= LIMB
        place += 1


def exact_sums(rows: DataFrame, partial, width: int) -> list[int]:
    """Sums over all rows of ``partial(matrix)`` (``width`` integers a batch): added
    up as integers inside each task, then by Spark limb by limb."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                got = [int(v) for v in partial(decode_rows(b["x"]))]
                total = got if total is None else [p + q for p, q in zip(total, got, strict=True)]
        out = [t for k, v in enumerate(total or []) for t in limbs(k, v)]
        if out:
            yield pd.DataFrame(out, columns=["k", "place", "v"])

    sums = [0] * width
    per_limb = rows.select("x").mapInPandas(lean(task), "k long, place long, v long").groupBy("k", "place").agg(F.sum("v").alias("v"))
    for r in per_limb.collect():  # a few limbs for each of the `width` sums, however many rows
        sums[r["k"]] += r["v"] << LIMB * r["place"]
    return sums


def centred(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """Entries less the integer centre; Python integers if squares could leave a long."""
    y = x - np.array(centre, dtype=np.int64)
    return y if not len(y) or np.abs(y).max() < NARROW else y.astype(object)


def pair_squares(y: np.ndarray) -> Iterator[int]:
    """Column sums of ``y_a ** 2`` for every dimension, then of ``(y_a + y_b) ** 2`` for ``a < b``."""
    yield from (y**2).sum(axis=0)
    for a in range(y.shape[1] - 1):
        yield from ((y[:, a : a + 1] + y[:, a + 1 :]) ** 2).sum(axis=0)


class Fit:
    """Exact sums of a fit list and what follows from them."""

    def __init__(self, n: int, sums: list[int], centre: list[int], squares: list[int]):
        d = len(sums)
        self.n, self.sums, self.centre = n, sums, centre
        self.rest = [s - n * c for s, c in zip(sums, centre, strict=True)]  # sums of the centred values
        # n times a sum of centred squares: n * sum(y^2) - (sum y)^2
        single = [n * squares[a] - self.rest[a] ** 2 for a in range(d)]
        self.cov = np.zeros((d, d))
        at = d
        for a in range(d):
            self.cov[a, a] = Fraction(single[a], n * n)
            for b in range(a + 1, d):
                both = n * squares[at] - (self.rest[a] + self.rest[b]) ** 2
                self.cov[a, b] = self.cov[b, a] = Fraction(both - single[a] - single[b], 2 * n * n)
                at += 1
        values, vectors = np.linalg.eigh(self.cov)
        order = np.argsort(-values, kind="stable")
        self.values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
        # either sign is right; take the one whose largest entry is positive
        self.vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
        self.trace = float(sum(Fraction(v, n * n) for v in single))
        self.taken = min(COMPONENTS, d)
        self.varies = self.values[: self.taken] > NO_VARIANCE * max(self.values[0], 0.0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Leading components of the rows at unit variance; NaN where there is none."""
        y = (x - np.array(self.centre, dtype=np.int64)).astype(np.float64) - np.array([r / self.n for r in self.rest])
        scale = np.sqrt(np.where(self.varies, self.values[: self.taken], np.nan))
        return y @ self.vectors[:, : self.taken] / scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """``sum((n * x - S) ** 2)`` over the dimensions of each row, exact."""
        y, n = centred(x, self.centre), self.n
        rest = np.array(self.rest, dtype=np.int64 if y.dtype != object and 2 * n * len(self.rest) * NARROW < 1 << 62 else object)
        own, cross, fixed = (y**2).sum(axis=1), (y * rest).sum(axis=1), sum(r * r for r in self.rest)
        return [n * n * int(p) - 2 * n * int(q) + fixed for p, q in zip(own, cross, strict=True)]


def fit(distinct: DataFrame, dim: int) -> Fit:
    """The fit of a list of distinct vectors ``x`` of one length."""
    counted = exact_sums(distinct, lambda m: [len(m), *(m if np.abs(m).max() < NARROW else m.astype(object)).sum(axis=0)], dim + 1)
    n, sums = counted[0], counted[1:]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    squares = exact_sums(distinct, lambda m: pair_squares(centred(m, centre)), dim * (dim + 1) // 2)
    return Fit(n, sums, centre, squares)


def identity_error(distinct: DataFrame, model: Fit) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance less the identity."""
    use = np.flatnonzero(model.varies)
    if not len(use):
        return None
    k = len(use)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(k * k + k)
        for b in batches:
            if len(b):
                w = model.whitened(decode_rows(b["x"]))[:, use]
                total += np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])
        yield pd.DataFrame({"k": range(len(total)), "v": total})

    got = np.zeros(k * k + k)
    for r in distinct.select("x").mapInPandas(lean(task), "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        got[r["k"]] = r["v"] / model.n
    mean = got[k * k :]
    return float(np.abs(got[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per remaining row and leading component: id, ``component``, ``n``, ``deviation``,
    ``whitened``, ``explained``, ``identity_error``, ``deviation_exact``."""
    spark = vectors.sparkSession
    small_batches(spark)
    id_type = vectors.schema[id_col].dataType.simpleString()

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [integers(v) for v in b["v"]]
            b["dim"] = [0 if x is None else len(x) for x in found]
            b["x"] = [None if x is None else encode(x) for x in found]
            yield b[["id", "dim", "x"]][b["dim"] > 0]

    source = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = materialize(source.mapInPandas(lean(prepare), f"id {id_type}, dim int, x binary"), "whitening_rows")
    distinct = materialize(rows.select("dim", "x").distinct(), "whitening_list")
    columns = f"{id_col} {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    out = spark.createDataFrame([], columns)
    for dim in sorted(r["dim"] for r in distinct.select("dim").distinct().collect()):
        own = distinct.where(F.col("dim") == dim)
        model = fit(own, dim)
        out = out.unionAll(_project(rows.where(F.col("dim") == dim), model, identity_error(own, model), id_col, columns))
    return out


def _project(rows: DataFrame, model: Fit, error: float | None, id_col: str, columns: str) -> DataFrame:
    taken = model.taken
    explained = np.divide(model.values[:taken], model.trace, out=np.zeros(taken), where=model.trace > 0)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = decode_rows(b["x"])
            deviation = model.deviations(x)
            out = pd.DataFrame({id_col: b["id"].repeat(taken).reset_index(drop=True)})
            out["component"] = np.tile(np.arange(1, taken + 1), len(b))
            out["n"] = model.n
            exact = [v for v in deviation for _ in range(taken)]
            out["deviation"] = pd.Series([v if v < 1 << 63 else None for v in exact], dtype="Int64")
            w = model.whitened(x).ravel()
            out["whitened"] = pd.Series(np.where(np.isnan(w), None, w), dtype=object)
            out["explained"] = np.tile(explained, len(b))
            out["identity_error"] = pd.Series([error] * len(out), dtype=object if error is None else float)
            out["deviation_exact"] = [Decimal(v) if v < 10**38 else None for v in exact]
            yield out

    return rows.select("id", "x").mapInPandas(lean(project), columns)
