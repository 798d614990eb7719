"""Operator 4: similarity, registers and classes against brute force."""

import random

import numpy as np

from ticketsift.llm import minhash as mh


def exact(a, b):
    wa, wb = dict(zip(a[0].tolist(), mh.weights(a[1]), strict=True)), dict(zip(b[0].tolist(), mh.weights(b[1]), strict=True))
    total = 0.0
    for d in wa.keys() & wb.keys():
        total += 1 / sum(max(wa.get(e, 0) / wa[d], wb.get(e, 0) / wb[d]) for e in wa.keys() | wb.keys())
    return total


def words(rng, n):
    return [f"w{rng.randint(0, 5000)}" for _ in range(n)]


def edited(rng, ws, k):
    ws = list(ws)
    for _ in range(k):
        ws[rng.randrange(len(ws))] = f"x{rng.randint(0, 10**6)}"
    return ws


def test_similarity_and_register_agreement():
    rng = random.Random(1)
    agree, want = [], []
    for _ in range(60):
        a = words(rng, 300) + ["lorem", "ipsum", "dolor", "sit", "amet", "elit"] * rng.randint(0, 5)
        b = edited(rng, a, rng.randint(0, 25))
        sa, sb = mh.shingles([a, b])
        s = exact(sa, sb)
        assert abs(mh.similarity(mh.restored(*mh.stored(sa)), mh.restored(*mh.stored(sb))) - s) < 1e-9
        sig = mh.signatures([sa, sb])
        agree.append((sig[0] == sig[1]).mean())
        want.append(s)
    assert abs(np.mean(agree) - np.mean(want)) < 0.015 and np.abs(np.array(agree) - want).max() < 0.2


def brute_classes(rows):
    sets = {k: s for k, s in enumerate(mh.shingles([mh.words_of(t) for _, t in rows]))}
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a][0]) and len(sets[b][0]) and mh.similarity(sets[a], sets[b]) >= mh.THRESHOLD:
                parent[find(a)] = find(b)
    low = {}
    for k, (i, t) in enumerate(rows):
        r = find(k)
        low[r] = min(low.get(r, i), i)
    return {i: low[find(k)] for k, (i, _) in enumerate(rows)}


def corpus(seed=2):
    rng = random.Random(seed)
    texts = [" ".join(words(rng, 80)) for _ in range(40)]
    hot = words(rng, 120)
    texts += [" ".join(hot)] * 30 + [" ".join(edited(rng, hot, 1)) for _ in range(60)]
    chain = words(rng, 200)
    for _ in range(12):  # neighbours are similar, the ends are not
        chain = edited(rng, chain, 4)
        texts.append(" ".join(chain))
    shared = words(rng, 60)
    texts += [" ".join(shared + words(rng, 40)) for _ in range(50)]  # much in common, below the threshold
    texts += ["one two three", "One, two THREE!", "alpha beta", "", "...", "long " * 30_000]
    rng.shuffle(texts)
    return list(enumerate(texts, 100))


def test_classes_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mh, "BLOCK", 7)  # the squares of a hot band
    rows = corpus()
    df = spark.createDataFrame([(i, t, "s", b"n") for i, t in rows] + [(None, rows[0][1], "s", b"n"), (999, None, "s", b"n")], "doc_id long, text string, sig string, node binary")
    got = mh.near_duplicates(df).collect()
    assert len(got) == len(rows) + 2
    want = brute_classes(rows) | {999: 999}
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == want
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got if r["doc_id"] is not None)
    kept = mh.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_repeated_rows_nulls_and_empty(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (2, None), (None, "p q r"), (None, "p q r"), (3, "p q r s t u v")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = mh.drop_near_duplicates(df).collect()
    assert sorted(map(str, kept)) == sorted(map(str, [rows and r for r in spark.createDataFrame([(1, "a b c d e f"), (2, None), (2, None), (None, "p q r"), (3, "p q r s t u v")], "doc_id long, text string").collect()]))
    assert mh.near_duplicates(df).count() == len(rows)
    empty = df.where("false")
    assert mh.near_duplicates(empty).count() == 0 and mh.drop_near_duplicates(empty).count() == 0
