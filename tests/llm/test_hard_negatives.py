"""Operator 12: mined negatives against brute force, and what the tree eliminates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketsift.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, score string"
EVERY = 5


def mined(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(5)
    out = hn.mine(df, F.col("vec_id") % EVERY == 0)
    return sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def brute(rows):
    ok = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(c is None or not np.isfinite(c) for c in v):
            continue
        ok[i, label, tuple(int(np.floor(256 * float(np.float32(c)))) for c in v)] = None
    out = []
    for i, label, x in ok:
        if i % EVERY:
            continue
        others = [(-sum(a * b for a, b in zip(x, y)), j, other) for j, other, y in ok if j != i and len(x) == len(y)]
        for p, j, _ in sorted(o for o in others if o[2] == label)[:5]:
            near = sorted(o for o in others if o[2] != label and 80 * -p <= 100 * -o[0] <= 100 * -p)[:5]
            out += [(i, j, k + 1, m, -p, -s) for k, (s, m, _) in enumerate(near)]
    return sorted(out)


def clusters(n, dim, centres, seed, spread):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, dim))
    v = middle[rng.integers(centres, size=n)] + spread * rng.standard_normal((n, dim))
    return [(k, (x / np.linalg.norm(x)).tolist(), int(rng.integers(3))) for k, x in enumerate(v)]


@pytest.mark.parametrize(("dim", "spread"), [(3, 0.05), (12, 0.4)])
def test_matches_brute_force_over_a_deep_tree(spark, monkeypatch, dim, spread):
    for name, value in (("LEAF_ROWS", 12), ("BLOCK", 7), ("FANOUT", 4), ("ANCHORS", 9)):
        monkeypatch.setattr(hn, name, value)
    rows = clusters(400, dim, 8, 1, spread)
    assert mined(spark, rows) == brute(rows)


def test_copies_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(hn, "LEAF_ROWS", 20)
    nan = float("nan")
    rows = clusters(120, 4, 3, 2, 0.2)
    rows += [(200 + k, rows[5][1], rows[5][2]) for k in range(90)]  # one vector, one label
    rows += [(300 + k, rows[6][1], k % 3) for k in range(60)]  # one vector, all labels
    rows += [(400, None, 1), (405, [], 1), (410, [1.0, None, 0.0, 0.0], 1), (415, [nan, 0.0, 0.0, 0.0], 1), (420, rows[0][1], None)]
    rows += [(425, [0.0] * 4, 1), (430, [0.5, 0.5], 1), (435, [0.5, 0.4], 2), (436, [0.5, 0.3], 1), (440, [-0.5, -0.5], 9), (None, rows[0][1], 1)]
    assert mined(spark, rows + rows[:30]) == brute(rows)


def test_empty_table_and_one_row(spark):
    one = [(5, [0.1, 0.2], 1)]
    assert mined(spark, one) == [] and mined(spark, one + [(6, None, 1)]) == []
    empty = spark.createDataFrame([], SCHEMA)
    assert hn.mine(empty, F.lit(True)).count() == 0


def test_tree_eliminates_siblings_and_loses_none():
    rows = clusters(3000, 4, 12, 3, 0.03)
    x = np.array([np.floor(256 * np.array(v)) for _, v, _ in rows]).astype(np.int64)
    top = float((x.astype(float) ** 2).sum(axis=1).max())
    v = hn.lifted(x, top)
    hn_rows, hn.LEAF_ROWS = hn.LEAF_ROWS, 60
    try:
        root, leaves = hn.grow(v[::2], len(v))
    finally:
        hn.LEAF_ROWS = hn_rows
    leaf, low, high = hn.route(root, v), {}, {}
    hn.measure(hn.paths(root), leaf, v, low, high)
    tree = hn.Gnat(root, leaves, top, low, high)
    q = x[:200]
    s = hn.scores(q, x)
    best = np.sort(s, axis=1)[:, -20]
    least, most = (0.9 * best)[:, None], best[:, None]
    need = tree.visits(q, least, most)
    r, c = np.nonzero((s >= least) & (s <= most))
    assert need[r, leaf[c]].all() and leaves > 20
    assert need.mean() < 0.6
    assert not tree.visits(q, np.full((200, 1), np.inf), np.full((200, 1), -np.inf)).any()


def test_shifted_label(spark):
    df = spark.createDataFrame([(7, 9), (14, 3), (8, 9), (0, None)], "i long, l int")
    assert [r[0] for r in df.select(hn.shifted_label(F.col("l"), F.col("i"))).collect()] == [0, 4, 9, None]


def test_groups_of_anchors_are_not_broadcast(spark, monkeypatch):
    """Spark takes them for as small as the anchors, and they hold these once per tile, not per leaf."""
    for name, value in (("LEAF_ROWS", 12), ("FANOUT", 4), ("TILES", 5), ("MANY", 3)):
        monkeypatch.setattr(hn, name, value)
    written, plans, dealt = hn.materialize, {}, hn.groups_of
    copies = []

    def spied(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    def counted(anchors, tree, slots, own_leaf):
        groups = dealt(anchors, tree, slots, own_leaf)
        copies.append((tree.value.leaves, groups.select("tile").distinct().count()))
        return groups

    monkeypatch.setattr(hn, "materialize", spied)
    monkeypatch.setattr(hn, "groups_of", counted)
    rows = clusters(200, 3, 8, 1, 0.05)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100m")
    try:
        assert mined(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    for plan in plans["negatives_home"] + plans["negatives_found"]:
        assert "SortMergeJoin [tile" in plan and "BroadcastHashJoin [tile" not in plan
    assert copies and all(leaves > 10 and 1 < tiles <= 5 for leaves, tiles in copies)


@pytest.mark.parametrize("wide", [1, 1 << 13])
def test_first_rows_of_many_and_few_cells(wide):
    rng = np.random.default_rng(7)
    q, x = rng.integers(-9, 10, (6, 5)) * wide, rng.integers(-9, 10, (300, 5)) * wide
    s, ids = hn.scores(q, x), rng.permutation(300)
    assert s.astype(np.int64).tolist() == (q @ x.T).tolist()
    for share in (0.01, 0.1, 0.9):
        r, c = np.nonzero(rng.random(s.shape) < share)
        row, column, score, kth = hn.first_rows(r, c, s[r, c], ids, 6, 5)
        for k in range(6):
            own = sorted((-s[k, j], ids[j]) for j in c[r == k])
            assert list(zip(-score[row == k], ids[column[row == k]], strict=True)) == own[:5]
            assert kth[k] == (-own[4][0] if len(own) > 4 else -np.inf)
