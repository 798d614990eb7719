"""Operator 5: marginals against enumeration, held-out accuracy, edge cases."""

import itertools
import random

import numpy as np

from ticketsift.llm import toxicity as tx


def test_marginals_match_enumeration():
    m = tx.ToxicModel({"bad": 4.0, "^wor": 2.0, "ok": -1.0}, -3.0, np.array([[1.2, 0.3], [0.7, 2.0]]), np.array([1.0, 0.4]))
    texts = ["a b bad worst c d e ok bad f".split(), ["bad"], ["x", "y"], "q bad".split(), []]
    for ws, (at, p) in zip(texts, m.marginals(texts), strict=True):
        total, norm = np.zeros(len(ws)), 0.0
        for tags in itertools.product((0, 1), repeat=len(ws)):
            w = m.start[tags[0]] if tags else 1.0
            for k, x in enumerate(ws):
                w *= (m.moves[tags[k - 1], tags[k]] if k else 1.0) * (np.exp(m.weight(x) + m.bias) if tags[k] else 1.0)
            norm += w
            total += w * np.array(tags)
        assert np.allclose((total / norm)[at], p)


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    vocab = [f"{a}{b}{c}" for a in ("ta", "re", "mi", "so") for b in ("lo", "na", "ki", "pu") for c in ("st", "n", "m", "r")]
    bad = ["grobble", "snarfing", "vexu"]
    rows, labels = [], []
    for i in range(n):
        ws = [rng.choice(vocab) for _ in range(rng.randint(5, 80))]
        y = int(rng.random() < 0.2)
        if y:
            for _ in range(rng.randint(1, 3)):
                w = rng.choice(bad)
                ws.insert(rng.randrange(len(ws)), w + (rng.choice(vocab) if w == "vexu" else ""))
        rows.append((i, " ".join(ws)))
        labels.append((i, y))
    return rows, labels


def test_held_out_accuracy_and_spans(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(None, None, "x"), (5000, "", "x"), (5001, "word " * 60_000, "x"), (0, rows[0][1], "x")], "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (1, None), (2, 7), (None, 1)], "doc_id long, toxic int")
    model = tx.train(docs, marks)
    got = tx.score(docs, model).withColumn("held", tx.held_out("doc_id")).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r["_score"] <= 1 for r in got)
    y = dict(labels)
    test = [r for r in got if r["held"] and r["doc_id"] in y]
    assert len(test) > 100
    right = np.mean([(r["_score"] >= 0.5) == bool(y[r["doc_id"]]) for r in test])
    assert right >= 0.97
    hits = [(r["text"][a:b]) for r in got for a, b in r["_spans"]]
    assert hits and all(h.startswith(("grobble", "snarfing", "vexu")) for h in hits)
    quiet = [r for r in got if r["doc_id"] in (None, 5000, 5001)]
    assert len(quiet) == 3 and all(r["_score"] < 0.5 and r["_spans"] == [] for r in quiet)


def test_labels_are_no_inputs_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {round(r["_score"], 6) for r in tx.score(docs, tx.train(docs, none)).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert len({r["_score"] for r in tx.score(docs, tx.train(docs, one)).collect()}) == 1
    empty = docs.where("false")
    assert tx.score(empty, tx.train(empty, none)).count() == 0


def test_every_chunk_trains_the_field(monkeypatch):
    lists = [["so", "bad"]] * 200 + [["so", "fine"]] * 8000
    tags = [[0, 1]] * 200 + [[0, 0]] * 8000
    few, more = (tx.train_crf(lists + [["quite", "bad"]] * n, tags + [[0, 0]] * n, {"bad"}) for n in (0, 150))
    assert more.weights["bad"] < few.weights["bad"] - 0.1
    monkeypatch.setattr(tx, "BLOCK_CHUNKS", 999)
    small = tx.train_crf(lists, tags, {"bad"})
    assert np.isclose(small.weights["bad"], few.weights["bad"]) and np.allclose(small.moves, few.moves)


def test_spans_beside_a_dotted_capital_i(spark):
    model = tx.ToxicModel({"bad": 12.0, "i\u0307stanbul": 12.0}, -3.0)
    texts = ["\u0130stanbul is bad", "x \u0130zmir bad y", "Bad"]
    got = tx.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert {r["doc_id"]: [r["text"][a:b] for a, b in r["_spans"]] for r in got} == {0: ["\u0130stanbul", "bad"], 1: ["bad"], 2: ["Bad"]}
    every = " ".join(f"a{chr(c)}b" for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    assert len(tx.words_of(every)) == len(tx.WORD.findall(every))
    plain = every.replace("\u0130", "")
    assert len(tx.words_of(plain)) == len(tx.WORD.findall(plain))
