"""Hard negatives from a multiway hyperplane tree (operator 12).

Vectors become integers ``floor(256 * x)``; the score of two rows is their inner
product.  With one more coordinate that lifts every vector to the largest norm
``M`` (and is 0 for an anchor) a score is a distance: ``d(q, v)^2 = |q|^2 + M^2 -
2 s``, so a window of scores around an anchor is an annulus.

The tree is a GNAT: a node has up to FANOUT split points, a row belongs to the
split point nearest to it (the hyperplanes between them), and each split point
stores the range of its distances to the rows of each sibling subtree.  The split
points come from a bounded sample; all rows are routed and all of them make the
ranges.  An anchor's window eliminates a sibling if, for some split point, no
distance of the stored range can lie inside the annulus.  What is left is compared
exactly: leaves are cut into blocks of at most about BLOCK rows, and a block meets
the anchors that need it in one matrix of integer scores.

Search goes twice over the tree.  Positives: an anchor's own leaf gives a lower
bound for its K-th best row of the same label, then all leaves that may hold a
better one are read.  Negatives: each positive opens a window of its own (from
``LOW / 100`` of its score up to it), whose lower bound is raised in the own leaf
in the same way.

Of rows with equal vector and label only the K + 1 smallest ids can be among the
first K of any anchor; the others leave before the tree is built, without a change
of the result, so a vector that a third of the rows share costs nothing.

Rows: a null label or id, a null or empty vector, and null or non-finite
components take no part.  Rows that repeat id, label and vector are one row; an
anchor is never its own positive, nor is another row of its id.  An anchor without
positives, and a positive without rows in its window (as when its score is
negative), give no rows.  Vectors are compared with those of their length.  Ties
go to the smaller id.  Scores are exact below 2**53 and saturate at 2**62.  Extra columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import lean, small_batches
from .whitening import decode, decode_rows, encode, integers

#: Rows that are returned per window, and the window's lower end in per cent of the positive's score.
K, LOW = 5, 80
#: Split points of a node; sampled rows that the tree is made from; rows a leaf should have.
FANOUT, SAMPLE, LEAF_ROWS = 16, 16_384, 2000
#: A leaf is compared in blocks of about so many rows, and anchors in groups of so many.
BLOCK, ANCHORS = 2000, 256
#: Neighbouring leaves share a tile, of which there are so many: anchors are sent to tiles, so they are not copied more often in a larger tree.
TILES = 256
#: Nodes of the tree lie at most so deep.
DEPTH = 8
#: Distances are compared with this share of the largest norms to spare, so rounding eliminates nothing.
MARGIN = 1e-6
#: Scores saturate here (they are exact below 2**53).
WIDEST = 2.0**62
#: Below this, sums of integers are exact in single precision.
SINGLE = 2.0**24
#: With more cells a row than this, those below its K-th score are left out before the others are sorted.
MANY = 64


@dataclass
class Node:
    """Split points (lifted), and per split point a child node or a leaf number."""

    number: int
    points: np.ndarray
    children: list  # Node or int


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the coordinate that gives them all the norm whose square is ``top``."""
    v = x.astype(np.float64)
    return np.column_stack([v, np.sqrt(np.maximum(top - (v**2).sum(axis=1), 0.0))])


def anchored(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x.astype(np.float64), np.zeros(len(x))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def split_points(v: np.ndarray, most: int, rng: np.random.Generator) -> np.ndarray:
    """Up to ``most`` points far from each other, out of three times as many drawn ones."""
    drawn = v[rng.permutation(len(v))[: 3 * most]]
    taken, gap = [0], distances(drawn, drawn[:1])[:, 0]
    while len(taken) < most and gap.max() > 0:
        taken.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(drawn, drawn[taken[-1:]])[:, 0])
    return drawn[taken]


def grow(sample: np.ndarray, rows: int) -> tuple[Node | None, int]:
    """The tree over a sample of a table of so many rows, and its number of leaves."""
    rng, counts = np.random.default_rng(12), {"node": 0, "leaf": 0}
    share = rows / max(len(sample), 1)

    def leaf() -> int:
        counts["leaf"] += 1
        return counts["leaf"] - 1

    def build(v: np.ndarray, depth: int) -> Node | int:
        parts = min(FANOUT, round(len(v) * share / LEAF_ROWS))  # a small node has few split points
        if parts < 2 or depth == DEPTH or len(v) < 2 * parts:
            return leaf()
        points = split_points(v, parts, rng)
        if len(points) == 1:
            return leaf()
        node = Node(counts["node"], points, [])
        counts["node"] += 1
        own = distances(v, points).argmin(axis=1)
        node.children = [build(v[own == j], depth + 1) for j in range(len(points))]
        return node

    root = build(sample, 0)
    return (None, 1) if isinstance(root, int) else (root, counts["leaf"])


def route(root: Node | None, v: np.ndarray) -> np.ndarray:
    """Leaf of every row."""
    out = np.zeros(len(v), dtype=np.int64)
    open_ = [(root, np.arange(len(v)))] if root else []
    while open_:
        node, at = open_.pop()
        own = distances(v[at], node.points).argmin(axis=1)
        for j, child in enumerate(node.children):
            inside = at[own == j]
            if isinstance(child, int):
                out[inside] = child
            elif len(inside):
                open_.append((child, inside))
    return out


def paths(root: Node | None) -> dict[int, list[tuple[Node, int]]]:
    """Per leaf the nodes above it, each with the number of the branch taken."""
    out, open_ = {}, [(root, [])] if root else []
    while open_:
        node, above = open_.pop()
        for j, child in enumerate(node.children):
            if isinstance(child, int):
                out[child] = [*above, (node, j)]
            else:
                open_.append((child, [*above, (node, j)]))
    return out


def measure(above: dict, leaf: np.ndarray, v: np.ndarray, low: dict, high: dict) -> None:
    """Widen the ranges ``(node, branch)``, a number for each split point, by rows of these leaves."""
    for k in np.unique(leaf).tolist():
        inside = v[leaf == k]
        for node, j in above[k]:
            d, key = distances(inside, node.points), (node.number, j)
            low[key] = np.minimum(low.get(key, np.inf), d.min(axis=0))
            high[key] = np.maximum(high.get(key, 0.0), d.max(axis=0))


class Gnat:
    """The tree with its ranges."""

    def __init__(self, root: Node | None, leaves: int, top: float, low: dict, high: dict):
        self.root, self.leaves, self.top, self.low, self.high = root, leaves, top, low, high
        self.width = -(-leaves // TILES)  # leaves of a tile, which has the number of its first one

    def visits(self, q: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which anchors (rows) need which leaves (columns): windows of scores
        ``least .. most`` per anchor and slot (an empty one has least > most)."""
        need = np.zeros((len(q), self.leaves), dtype=bool)
        wanted = (least <= most).any(axis=1)
        if self.root is None:
            need[wanted] = True
            return need
        v = anchored(q)
        reach = (v**2).sum(axis=1)[:, None] + self.top
        spare = MARGIN * (1 + np.sqrt(reach))
        near = np.sqrt(np.maximum(reach - 2 * most, 0.0)) - spare
        far = np.sqrt(np.maximum(reach - 2 * least, 0.0)) + spare
        slots = least <= most
        open_ = [(self.root, np.flatnonzero(wanted))]
        while open_:
            node, at = open_.pop()
            d = distances(v[at], node.points)
            for j, child in enumerate(node.children):
                key = (node.number, j)
                if key not in self.low:
                    continue  # no row lies there
                # distances of the subtree's rows from each anchor, by the best split point
                nearest = np.maximum(d - self.high[key], self.low[key] - d).max(axis=1)[:, None]
                furthest = (d + self.high[key]).min(axis=1)[:, None]
                inside = at[(slots[at] & (nearest <= far[at]) & (furthest >= near[at])).any(axis=1)]
                if len(inside):
                    if isinstance(child, int):
                        need[inside, child] = True
                    else:
                        open_.append((child, inside))
        return need


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products, as floats."""
    a, b = q.astype(np.float64), x.astype(np.float64)
    norms = [np.sqrt((m**2).sum(axis=1).max(initial=0.0)) for m in (a, b)]
    if norms[0] * norms[1] < SINGLE:  # it bounds every partial sum
        return a.astype(np.float32) @ b.astype(np.float32).T
    s = a @ b.T
    return np.clip(s, -WIDEST, WIDEST, out=s)


def first_rows(r: np.ndarray, c: np.ndarray, s: np.ndarray, ids: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of cells (row, column, score) the first ``k`` of each row by falling score and
    rising id, and per row the k-th score (-inf if there are fewer)."""
    if len(r) > MANY * rows:  # those below a row's k-th need no sorting
        masked = np.full((rows, len(ids)), -np.inf, dtype=s.dtype)
        masked[r, c] = s
        keep = s >= np.partition(masked, len(ids) - k, axis=1)[r, -k]
        r, c, s = r[keep], c[keep], s[keep]
    order = np.lexsort((ids[c], -s, r))
    r, c, s = r[order], c[order], s[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    kth = np.full(rows, -np.inf)
    kth[r[rank == k - 1]] = s[rank == k - 1]
    return r[rank < k], c[rank < k], s[rank < k], kth


class Best:
    """Lower bounds that a task has met for its anchors; forgotten when there are
    many, which costs work and no result."""

    def __init__(self, most: int = 50_000):
        self.bounds: dict[int, np.ndarray] = {}
        self.most = most

    def raise_(self, anchor: np.ndarray, least: np.ndarray) -> np.ndarray:
        if len(self.bounds) > self.most:
            self.bounds.clear()
        out = least.copy()
        for k, a in enumerate(anchor.tolist()):
            if a in self.bounds:
                out[k] = np.maximum(out[k], self.bounds[a])
        return out

    def learn(self, anchor: np.ndarray, slot: int, slots: int, kth: np.ndarray) -> None:
        for k in np.flatnonzero(kth > -np.inf).tolist():
            a = int(anchor[k])
            own = self.bounds.setdefault(a, np.full(slots, -np.inf))
            own[slot] = max(own[slot], kth[k])


def searched(pairs: DataFrame, same: bool, slots: int, id_type: str) -> DataFrame:
    """Candidates of joined blocks (columns of ``anchor groups`` and ``leaf blocks``):
    ``anchor, slot, id, score``, at most K per anchor, slot and block."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best()
        for b in batches:
            for g in b.itertuples(index=False):
                k = np.flatnonzero(np.frombuffer(g.need, dtype=bool).reshape(-1, len(g.leaves))[:, np.searchsorted(g.leaves, g.leaf)])
                anchor, label = (np.frombuffer(v, dtype=np.int64) for v in (g.anchor, g.alabel))
                q = decode(g.ax).reshape(len(anchor), -1)[k]
                anchor, label = anchor[k], label[k]
                least, most = (np.frombuffer(v, dtype=np.float64).reshape(-1, slots)[k] for v in (g.least, g.most))
                least = best.raise_(anchor, least)
                ids, labels = np.frombuffer(g.ids, dtype=np.int64), np.frombuffer(g.labels, dtype=np.int64)
                s = scores(q, decode(g.x).reshape(len(ids), -1))
                # few cells lie in a window: the slots go over these only
                low, high = least.min(axis=1).astype(s.dtype), most.max(axis=1).astype(s.dtype)
                r, c = np.divmod(np.flatnonzero((s >= low[:, None]) & (s <= high[:, None])), len(ids))
                fit = ((label[r] == labels[c]) == same) & (anchor[r] != ids[c])
                r, c = r[fit], c[fit]
                s = s[r, c]
                for slot in range(slots):
                    ok = (s >= least[r, slot]) & (s <= most[r, slot])
                    if not ok.any():
                        continue
                    row, column, score, kth = first_rows(r[ok], c[ok], s[ok], ids, len(anchor), K)
                    best.learn(anchor, slot, slots, kth)
                    yield pd.DataFrame({"anchor": anchor[row], "slot": slot, "id": ids[column], "score": score.astype(np.int64)})

    return pairs.mapInPandas(lean(compare), "anchor long, slot int, id long, score long")


def first_of(found: DataFrame) -> DataFrame:
    """The first K of each anchor and slot (a limit inside each task comes before the shuffle)."""
    w = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= K)


def leaf_blocks(rows: DataFrame) -> DataFrame:
    """One row per block of a leaf: ``leaf, ids, labels, x`` as bytes."""
    sizes = rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("cuts"))  # a row per leaf
    dealt = rows.join(F.broadcast(sizes), "leaf").withColumn("block", F.pmod(F.xxhash64("id"), F.col("cuts")))

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        ids, labels = (g[c].to_numpy(dtype=np.int64).tobytes() for c in ("id", "label"))
        return pd.DataFrame({"leaf": g["leaf"].iloc[:1], "ids": [ids], "labels": [labels], "x": [encode(decode_rows(g["x"]).ravel())]})

    return dealt.select("leaf", "block", "id", "label", "x").groupBy("leaf", "block").applyInPandas(pack, "leaf long, ids binary, labels binary, x binary")


def groups_of(anchors: DataFrame, tree, slots: int, own_leaf: bool) -> DataFrame:
    """Anchors ``(id, label, x, leaf, least, most)`` in groups of at most ANCHORS, once per tile
    with a leaf that they need (``need``: anchors x ``leaves`` of the tile): their own leaf, or
    all others that their windows leave over."""
    columns = ["tile", "leaves", "need", "anchor", "alabel", "ax", "least", "most"]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gnat = tree.value
        for b in batches:
            for at in range(0, len(b), ANCHORS):
                part = b.iloc[at : at + ANCHORS]
                q, home = decode_rows(part["x"]), part["leaf"].to_numpy()
                least, most = (np.array(part[c].tolist(), dtype=np.float64).reshape(len(part), slots) for c in ("least", "most"))
                ids, labels = (part[c].to_numpy(dtype=np.int64) for c in ("id", "label"))
                if own_leaf:
                    need = np.zeros((len(part), gnat.leaves), dtype=bool)
                    need[np.arange(len(part)), home] = True
                else:
                    need = gnat.visits(q, least, most)
                    need[np.arange(len(part)), home] = False
                out = []
                used = np.flatnonzero(need.any(axis=0))
                for leaves in np.split(used, np.flatnonzero(np.diff(used // gnat.width)) + 1) if len(used) else []:
                    own = need[:, leaves]
                    k = np.flatnonzero(own.any(axis=1))
                    out.append((leaves[0] - leaves[0] % gnat.width, leaves, own[k].tobytes(), ids[k].tobytes(), labels[k].tobytes(), encode(q[k].ravel()), least[k].tobytes(), most[k].tobytes()))
                    if len(out) == 64:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=columns)

    return anchors.mapInPandas(lean(deal), "tile long, leaves array<long>, need binary, anchor binary, alabel binary, ax binary, least binary, most binary")


def paired(groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """Groups with the blocks of the leaves they need.  A merge join: Spark judges the groups by
    the size of the anchors, which are in them once per tile, and would broadcast them."""
    return groups.join(blocks.hint("merge"), "tile").where(F.array_contains("leaves", F.col("leaf")))


def search(anchors: DataFrame, blocks: DataFrame, tree, same: bool, slots: int) -> DataFrame:
    """The first K rows of each anchor and slot: first in the anchor's own leaf,
    then, with the bounds found there, in every leaf that is not eliminated."""
    home = materialize(first_of(searched(paired(groups_of(anchors, tree, slots, True), blocks), same, slots, "long")), "negatives_home")
    bounds = home.where(F.col("rank") == K).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth"))  # at most `slots` entries
    raised = anchors.join(bounds, anchors["id"] == bounds["anchor"], "left").drop("anchor")
    slot_numbers = F.array(*[F.lit(k) for k in range(slots)])
    least = F.transform(slot_numbers, lambda k: F.greatest(F.get("least", k), F.coalesce(F.element_at("kth", k).cast("double"), F.lit(float("-inf")))))
    rest = searched(paired(groups_of(raised.withColumn("least", least).drop("kth"), tree, slots, False), blocks), same, slots, "long")
    return materialize(first_of(home.drop("rank").unionByName(rest)), "negatives_found")


def shifted_label(label: Column, id_col: Column) -> Column:
    """The label that a row is mined under: that of ids divisible by 7 is the next one."""
    return F.when(id_col % 7 == 0, F.pmod(label + 1, F.lit(10))).otherwise(label)


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """For every row for which ``anchor`` holds and each of its first K positives the
    first K hard negatives: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    spark = vectors.sparkSession
    small_batches(spark)

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [integers(v) for v in b["v"]]
            b["dim"] = [0 if x is None else len(x) for x in found]
            b["norm"] = [0.0 if x is None else float((x.astype(np.float64) ** 2).sum()) for x in found]
            b["x"] = [None if x is None else encode(x) for x in found]
            yield b.loc[b["dim"] > 0, ["id", "label", "anchor", "dim", "norm", "x"]]

    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vec_col).cast("array<double>").alias("v"))
    known = source.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    rows = materialize(known.mapInPandas(lean(prepare), "id long, label long, anchor boolean, dim int, norm double, x binary"), "negatives_rows")
    copies = Window.partitionBy("dim", "label", "x").orderBy("id")
    single = rows.select("dim", "norm", "label", "x", "id").withColumn("copy", F.dense_rank().over(copies)).where(F.col("copy") <= K + 1)
    single = materialize(single.drop("copy").distinct(), "negatives_index")
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for r in single.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top")).orderBy("dim").collect():
        own = F.col("dim") == r["dim"]
        out = out.unionAll(_mine(rows.where(own & F.col("anchor")).select("id", "label", "x").distinct(), single.where(own), r["n"], r["top"]))
    return out


def planted_tree(index: DataFrame, n: int, top: float) -> tuple[Node | None, int]:
    """The tree, its split points from a bounded sample, and its number of leaves."""
    share = min(1.0, SAMPLE / max(n, 1))
    drawn = index.where(F.pmod(F.xxhash64("id", "label"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("x").limit(2 * SAMPLE)
    drawn = sorted(bytes(r["x"]) for r in drawn.collect())
    return grow(lifted(decode_rows(drawn), top) if drawn else np.zeros((0, 1)), n)


def with_ranges(root: Node | None, leaves: int, routed: DataFrame, top: float) -> Gnat:
    """The tree with the ranges of all rows ``(leaf, x)``."""
    low, high = {}, {}
    if root is None:
        return Gnat(root, leaves, top, low, high)

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high, above = {}, {}, paths(root)
        for b in batches:
            if len(b):
                measure(above, b["leaf"].to_numpy(), lifted(decode_rows(b["x"]), top), low, high)
        out = [(*k, i, a, z) for k in low for i, (a, z) in enumerate(zip(low[k], high[k], strict=True))]
        if out:
            yield pd.DataFrame(out, columns=["node", "branch", "point", "low", "high"])

    found = routed.select("leaf", "x").mapInPandas(lean(ranges), "node long, branch long, point long, low double, high double")
    found = found.groupBy("node", "branch", "point").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    for r in found.orderBy("node", "branch", "point").collect():  # at most FANOUT numbers per split point of the bounded tree
        low.setdefault((r["node"], r["branch"]), []).append(r["low"])
        high.setdefault((r["node"], r["branch"]), []).append(r["high"])
    return Gnat(root, leaves, top, {k: np.array(v) for k, v in low.items()}, {k: np.array(v) for k, v in high.items()})


def _mine(anchors: DataFrame, index: DataFrame, n: int, top: float) -> DataFrame:
    spark = anchors.sparkSession
    root, n_leaves = planted_tree(index, n, top)
    plain = spark.sparkContext.broadcast(root)  # bounded by the sample

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                b["leaf"] = route(plain.value, lifted(decode_rows(b["x"]), top))
                yield b[["id", "label", "x", "leaf"]]

    schema = "id long, label long, x binary, leaf long"
    placed = materialize(index.select("id", "label", "x").mapInPandas(lean(leaves), schema), "negatives_leaves")
    gnat = with_ranges(root, n_leaves, placed, top)
    tree = spark.sparkContext.broadcast(gnat)  # as bounded
    blocks = materialize(leaf_blocks(placed), "negatives_blocks").withColumn("tile", F.col("leaf") - F.col("leaf") % gnat.width)
    # neighbours in one group: they need the same leaves
    routed = anchors.select("id", "label", "x").mapInPandas(lean(leaves), schema)
    routed = materialize(routed.repartitionByRange("leaf", "id").sortWithinPartitions("leaf", "id"), "negatives_anchors")
    open_end = routed.withColumns({"least": F.array(F.lit(float("-inf"))), "most": F.array(F.lit(float("inf")))})
    positives = search(open_end, blocks, tree, True, 1)
    # 80 * p <= 100 * s <= 100 * p in integers (a negative p leaves an empty window)
    ends = F.struct(F.expr(f"({LOW} * score + 99) div 100").cast("double").alias("least"), F.col("score").cast("double").alias("most"))
    ranked = positives.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct(F.col("rank") - 1, ends))).alias("p"))  # K entries
    slots = F.array(*[F.lit(k) for k in range(K)])
    windows = routed.join(ranked, routed["id"] == ranked["anchor"]).drop("anchor")
    # an anchor with fewer positives has empty windows
    least = F.transform(slots, lambda k: F.coalesce(F.element_at("p", k)["least"], F.lit(float("inf"))))
    most = F.transform(slots, lambda k: F.coalesce(F.element_at("p", k)["most"], F.lit(float("-inf"))))
    windows = materialize(windows.withColumns({"least": least, "most": most}).drop("p").sortWithinPartitions("leaf", "id"), "negatives_windows")
    negatives = search(windows, blocks, tree, False, K)
    named = positives.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negatives.join(named, ["anchor", "slot"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
