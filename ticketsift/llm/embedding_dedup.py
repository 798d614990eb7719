"""Embedding near-duplicates by spherical-cap filters (operator 9).

Filter directions are structured: the (randomly rotated) space is cut into
blocks, each block has its own small random code, and a filter is one code word
per block, so ``words ** blocks`` directions need only ``words * blocks`` inner
products.  Every vector is list-decoded to all filters whose score exceeds a
threshold (never fewer than its best ``LEAST``); close vectors share filters,
so vectors are joined on them and compared exactly, in double precision.

Copies are collapsed first.  A filter's vectors are compared in blocks of at
most ``BLOCK`` by ``BLOCK``; a pair that shares several filters counts in the
smallest only, and a block returns link counts and a spanning forest, never the
pairs.  Links are complete up to the recall of the filters (measured in the
tests); none below the threshold is made.

Rows: vectors that are null, empty, zero or hold null or non-finite components,
and rows with a null label or id, link with nothing and stay their own
component (null for a null id).  Vectors of other lengths are not compared.
Repeated rows are copies of each other.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import components, small_batches

#: Mean number of filters of a random vector, and the number every vector has at least.
MEAN, LEAST = 14, 8
#: Vectors that a filter has on average in the largest label, if they were spread evenly.
FILL = 64
#: A filter's vectors are compared in squares of this side.
BLOCK = 1500
SEED = 20_240_917


class CapFilters:
    """Structured random product code for one dimension."""

    def __init__(self, dim: int, filters: int):
        rng = np.random.default_rng((SEED, dim, filters))
        self.blocks = max(1, min(dim, 2 if filters <= 1 << 20 else 3))
        self.words = max(2, round(max(filters, 16) ** (1 / self.blocks)))
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cuts = np.linspace(0, dim, self.blocks + 1).astype(int)
        self.codes = []
        for a, b in zip(self.cuts, self.cuts[1:], strict=False):
            code = rng.standard_normal((self.words, b - a))
            self.codes.append(code / np.linalg.norm(code, axis=1, keepdims=True) / np.sqrt(self.blocks))
        # the threshold at which random unit vectors have MEAN filters
        probe = rng.standard_normal((200, dim))
        scores = [np.sort(self._all_scores(s))[::-1] for s in self._block_scores(probe / np.linalg.norm(probe, axis=1, keepdims=True))]
        self.least = min(LEAST, self.words**self.blocks)
        top = np.sort(np.concatenate([s[: 40 * MEAN] for s in scores]))[::-1]
        self.threshold = float(top[min(len(top) - 1, MEAN * len(scores) - 1)])

    def _block_scores(self, unit: np.ndarray) -> Iterator[list[np.ndarray]]:
        turned = unit @ self.rotation
        per_block = [turned[:, a:b] @ c.T for a, b, c in zip(self.cuts, self.cuts[1:], self.codes, strict=False)]
        for k in range(len(unit)):
            yield [p[k] for p in per_block]

    @staticmethod
    def _all_scores(scores: list[np.ndarray]) -> np.ndarray:
        total = scores[0]
        for s in scores[1:]:
            total = (total[:, None] + s[None, :]).ravel()
        return total

    def _decode(self, scores: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """All filters that reach the threshold: block after block, dropping the
        beginnings that the best rest could not lift over it."""
        rest = [sum(s.max() for s in scores[k:]) for k in range(1, len(scores) + 1)] if len(scores) > 1 else [0.0]
        keys = np.flatnonzero(scores[0] + rest[0] >= threshold) if len(scores) > 1 else np.flatnonzero(scores[0] >= threshold)
        sums = scores[0][keys]
        for k, s in enumerate(scores[1:], 1):
            after = rest[k] if k + 1 < len(scores) else 0.0
            total = sums[:, None] + s[None, :]
            i, j = np.nonzero(total + after >= threshold)
            keys, sums = keys[i] * self.words + j, total[i, j]
        return keys, sums

    def filters(self, unit: np.ndarray) -> list[np.ndarray]:
        """Per unit vector its filters, ascending."""
        out = []
        for scores in self._block_scores(unit):
            threshold = self.threshold
            while True:
                keys, sums = self._decode(scores, threshold)
                if len(keys) >= self.least:
                    break
                threshold -= 0.1 * abs(self.threshold) + 1e-6
            if threshold < self.threshold and len(keys) > self.least:
                keys = keys[np.argsort(-sums, kind="stable")[: self.least]]
            out.append(np.sort(keys))
        return out


@lru_cache(maxsize=8)
def cap_filters(dim: int, filters: int) -> CapFilters:
    return CapFilters(dim, filters)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of ``a`` reach the cosine threshold with which rows of ``b``.
    Rows are scaled by their largest component first, so squares stay finite."""
    a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b))
    return (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]) >= threshold


def forest(link: np.ndarray) -> np.ndarray:
    """Smallest index reachable by a symmetric link matrix."""
    n = len(link)
    root = np.arange(n)
    while True:
        near = np.where(link, root[None, :], n).min(axis=1)
        new = np.minimum(root, near)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def compare_block(g: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links inside one square of one filter: per vector the number of vectors it
    links with (pairs whose smallest shared filter this is), and its root."""
    g = g.sort_values("node", ignore_index=True)
    f, same = int(g["f"].iat[0]), int(g["bi"].iat[0]) == int(g["bj"].iat[0])
    v = _matrix(g["v"])
    link = linked(v, v, threshold)
    np.fill_diagonal(link, False)
    if not same:
        own = g["block"].to_numpy()
        link &= own[:, None] != own[None, :]
    if not link.any():
        return pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")
    link |= link.T
    smaller = sorted({int(k) for ks in g["fs"] for k in ks if k < f})
    counted = link
    if smaller:
        at = {k: i for i, k in enumerate(smaller)}
        member = np.zeros((len(g), len(smaller)), dtype=np.float32)
        for row, ks in enumerate(g["fs"]):
            member[row, [at[int(k)] for k in ks if k < f]] = 1
        counted = link & (member @ member.T < 0.5)
    node = g["node"].to_numpy()
    out = pd.DataFrame({"node": node, "links": counted @ g["n"].to_numpy(), "root": node[forest(link)]})
    return out[link.any(axis=1)]


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row: id, ``n_links``, ``component_id``, ``kept``."""
    small_batches(vectors.sparkSession)
    id_type = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("i"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ok = F.col("i").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    keyed = rows.select("i", "label", "v", ok.alias("ok"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(SEED), "v").alias("h2"))
    copies = keyed.where("ok").groupBy("label", "h1", "h2").agg(F.min("i").alias("node"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    copies = materialize(copies.withColumn("dim", F.size("v")), "vectors")
    largest = copies.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
    filters = max(256, largest * MEAN // FILL)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["fs"] = None
            for dim, part in b.groupby("dim"):
                v = _matrix(part["v"])
                v /= np.abs(v).max(axis=1, keepdims=True)
                found = cap_filters(int(dim), filters).filters(v / np.linalg.norm(v, axis=1, keepdims=True))
                b.loc[part.index, "fs"] = pd.Series(found, index=part.index)
            yield b[["label", "dim", "node", "n", "v", "fs"]]

    label_type = vectors.schema[label_col].dataType.simpleString()
    coded = materialize(copies.select("label", "dim", "node", "n", "v").mapInPandas(decode, f"label {label_type}, dim int, node {id_type}, n long, v array<double>, fs array<long>"), "filters")
    # filters with more vectors than a block, and into how many blocks they are cut
    key = ["label", "dim", "f"]
    sizes = coded.select("label", "dim", F.explode("fs").alias("f")).groupBy(*key).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    sizes = materialize(sizes.select(*key, F.ceil(F.col("c") / BLOCK).cast("int").alias("cuts")), "filter_sizes")
    dealt = coded.withColumn("f", F.explode("fs")).join(sizes, key)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    dealt = dealt.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")}).drop("other", "cuts")
    found = dealt.groupBy(*key, "bi", "bj").applyInPandas(lambda g: compare_block(g, threshold), f"node {id_type}, links long, root {id_type}")
    found = materialize(found, "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "roots")
    per_copy = copies.select("label", "h1", "h2", "node", "n").join(links, "node", "left").join(roots, "node", "left")
    per_copy = per_copy.select("label", "h1", "h2", F.lit(True).alias("ok"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("l"), F.coalesce("root", "node").alias("r"))
    out = keyed.select("i", "label", "h1", "h2", "ok").join(per_copy, ["label", "h1", "h2", "ok"], "left")
    component = F.coalesce("r", "i")
    return out.select(F.col("i").alias(id_col), F.coalesce("l", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("i"), F.lit(True)).alias("kept"))
