"""Operator 9: recall of the filters and links against brute force."""

import numpy as np

from ticketsift.llm import embedding_dedup as ed


def table(seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    base = rng.standard_normal((60, 32))
    for k, b in enumerate(base):
        for _ in range(rng.integers(1, 7)):
            rows.append((len(rows), (b + 0.11 * rng.standard_normal(32)).astype(np.float32).tolist(), k % 3))
    hot = rng.standard_normal(32)
    rows += [(len(rows) + k, (hot + 0.05 * rng.standard_normal(32)).astype(np.float32).tolist(), 1) for k in range(150)]
    rows += [(len(rows) + k, hot.astype(np.float32).tolist(), 1) for k in range(80)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 32, 1), (n + 2, [float("nan")] * 32, 1), (n + 3, [1e38] * 32, 1), (n + 4, [None] * 32, 1), (n + 5, hot.astype(np.float32).tolist(), None), (n + 6, [1.0, 2.0], 1), (n + 7, [], 1), (None, hot.astype(np.float32).tolist(), 1)]
    return rows


def brute(rows):
    ok = [(i, np.array(v, dtype=np.float64), y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, _, _ in rows if i is not None}
    for a, (i, v, y) in enumerate(ok):
        for j, w, z in ok[:a]:
            if y == z and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= 0.98:
                links[i].add(j)
                links[j].add(i)
    root = {}
    for i in sorted(links):
        if i not in root:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in root:
                    root[k] = i
                    todo += links[k]
    return links, root


def test_links_and_components_match_brute_force(spark, monkeypatch):
    rows = table()
    links, root = brute(rows)
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, node int")
    got = ed.near_duplicates(df).collect()
    assert len(got) == len(rows)
    named = [r for r in got if r["vec_id"] is not None]
    total = sum(map(len, links.values()))
    assert sum(r["n_links"] for r in named) >= 0.99 * total  # recall of the filters
    assert all(r["n_links"] <= len(links[r["vec_id"]]) for r in named)
    assert [r["component_id"] for r in named if r["component_id"] != root[r["vec_id"]]] == []
    assert all(r["kept"] == (r["component_id"] == r["vec_id"]) for r in named)
    nameless = [r for r in got if r["vec_id"] is None]
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in nameless] == [(0, None, True)]


def test_blocks_give_the_same_links():
    import pandas as pd

    rng = np.random.default_rng(0)
    v = rng.standard_normal(16) + 0.02 * rng.standard_normal((40, 16))
    g = pd.DataFrame({"node": range(40), "n": 1, "v": list(v), "fs": [np.array([5])] * 40, "f": 5, "block": [k % 2 for k in range(40)]})
    whole = ed.compare_block(g.assign(bi=0, bj=0), 0.98).set_index("node")["links"]
    parts = [ed.compare_block(g[g["block"] == b].assign(bi=b, bj=b), 0.98) for b in (0, 1)] + [ed.compare_block(g.assign(bi=0, bj=1), 0.98)]
    total = pd.concat(parts).groupby("node")["links"].sum()
    assert (total == whole).all() and len(total) == 40


def test_list_decoding_finds_all_filters():
    code = ed.cap_filters(24, 900)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((20, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for fs, scores in zip(code.filters(x), code._block_scores(x), strict=True):
        every = code._all_scores(scores)
        above = np.flatnonzero(every >= code.threshold)
        best = np.argsort(-every)[: code.least]
        assert set(fs) == (set(above) if len(above) >= code.least else set(best))


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert ed.near_duplicates(df).count() == 0
