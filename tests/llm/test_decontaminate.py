"""Operator 7: retrieval and checks against brute force on planted passages."""

import random
from collections import Counter

import numpy as np

from ticketsift.llm import decontaminate as dc


def corpus(seed=5):
    rng = random.Random(seed)
    syll = ["ka", "lo", "mi", "re", "tu", "sa", "ne", "vo", "pi", "du"]
    word = lambda: "".join(rng.choice(syll) for _ in range(rng.randint(2, 4)))
    common = [word() for _ in range(15)]
    text = lambda n: [rng.choice(common) if rng.random() < 0.5 else word() for _ in range(n)]
    items = [(k, text(rng.randint(15, 60))) for k in range(30)]
    docs, hit = [], set()
    for i in range(250):
        ws = text(rng.randint(20, 400))
        if i % 5 == 0:
            k, item = items[rng.randrange(len(items))]
            copy = list(item)
            if i % 10 == 0:  # a paraphrase: some words changed, the end kept
                for _ in range(max(1, len(copy) // 8)):
                    copy[rng.randrange(len(copy) * 2 // 3)] = word()
            at = rng.randrange(len(ws))
            ws[at:at] = copy
            hit.add((i, k))
        docs.append((i, " ".join(ws).capitalize() + "."))
    return docs, [(k, " ".join(ws)) for k, ws in items], hit


def test_planted_items_are_found(spark, monkeypatch):
    monkeypatch.setattr(dc, "ITEM_BLOCK", 16)  # several blocks
    docs, items, hit = corpus()
    df = spark.createDataFrame([(i, t, 0) for i, t in docs] + [(None, docs[0][1], 0), (900, None, 0), (901, "", 0), (902, "de " * 30_000, 0)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*items, (77, None), (78, ""), (None, "x y z"), items[0]], "item_id long, text string")
    found = dc.contaminated(df.drop("item_id"), bench).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in found if r["doc_id"] is not None}
    assert pairs == hit
    assert any(r["doc_id"] is None for r in found)
    kept = dc.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in hit} | {900, 901, 902}


def test_items_of_many_documents_and_of_everyday_words_are_found(spark):
    rng = random.Random(8)
    syll = ["ka", "lo", "mi", "re", "tu", "sa", "ne", "vo", "pi", "du"]
    word = lambda: "".join(rng.choice(syll) for _ in range(4))
    common = [f"c{k}" for k in range(60)]
    text = lambda n: [rng.choice(common) if rng.random() < 0.5 else word() for _ in range(n)]
    often = [[word() for _ in range(n)] for n in (18, 45)]
    everyday = [rng.choice(common) for _ in range(30)]
    items = [*often, everyday, [word() for _ in range(25)]]
    docs, hit = [], set()
    for i in range(500):
        ws = text(rng.randint(20, 300))
        for k, own in enumerate(items):
            if i % 5 < 2 if k < 2 else i % 100 == 7 + k:
                at = rng.randrange(len(ws))
                copy = list(own)
                if i % 10 == 0:  # a paraphrase
                    for _ in range(len(copy) // 8):
                        copy[rng.randrange(len(copy) * 2 // 3)] = word()
                if k == 1 and 0 in (h for d, h in hit if d == i):
                    at = len(ws)
                ws[at:at] = copy
                hit.add((i, k))
        docs.append((i, " ".join(ws)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(ws)) for k, ws in enumerate(items)], "item_id long, text string")
    got = dc.contaminated(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == hit
    assert dc.drop_contaminated(df, bench).count() == len(docs) - len({i for i, _ in hit})


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "other words")], "item_id long, text string")
    assert dc.contaminated(df.where("false"), bench).count() == 0
    assert dc.contaminated(df, bench.where("false")).count() == 0
    assert dc.drop_contaminated(df, bench.where("false")).count() == 1


def test_lcs_matches_the_table_method():
    rng = np.random.default_rng(1)
    for _ in range(100):
        a, b = rng.integers(0, 6, rng.integers(1, 20)).tolist(), rng.integers(0, 6, rng.integers(0, 30)).tolist()
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y and x else max(row[k + 1], new[k]))
            row = new
        assert dc.lcs(a, b) == row[-1]


def test_gram_product_matches_the_matrix():
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 50, n) for n in (5, 16, 17, 40, 100)]
    idf = rng.random(50).astype(np.float32) + 0.5
    idf[0] = 0
    q = rng.standard_normal((50, 7)).astype(np.float32)
    got = np.zeros((50, 7), dtype=np.float32)
    rows = []
    for x in texts:
        dc.gram_product(x, 2.0, (idf, (idf**2)[:, None], q * idf[:, None]), got)
        steps = [x[k : k + dc.STEP] for k in range(0, len(x), dc.STEP)]
        for p in [np.concatenate(s) for s in zip(steps, steps[1:], strict=False)] or steps:
            row = np.bincount(p, minlength=50) * idf
            rows.append(2.0 * row / np.sqrt((idf[p] ** 2).sum()))
    a = np.array(rows)
    assert np.allclose(got, a.T @ (a @ q), rtol=1e-3, atol=1e-3)


def test_texts_without_words_alone_in_a_partition(spark):
    schema = "doc_id long, text string"
    bench = spark.createDataFrame([(1, "seven words that nobody would ever write")], "item_id long, text string")
    for odd in (None, "", "?! ... --"):
        docs = spark.createDataFrame([(1, odd)], schema).unionAll(spark.createDataFrame([(2, "he said seven words that nobody would ever write")], schema))
        assert [(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs, bench).collect()] == [(2, 1)]
        assert [r["doc_id"] for r in dc.drop_contaminated(docs, bench).collect()] == [1]


def test_counts_and_space_cover_all_documents(spark, monkeypatch):
    monkeypatch.setattr(dc, "CORPUS_DOCS", 40, raising=False)
    monkeypatch.setattr(dc, "SAMPLE_DOCS", 40, raising=False)
    monkeypatch.setattr(dc, "VOCABULARY", 600)
    docs, items, hit = corpus()
    seen = []
    build = dc.latent_space
    monkeypatch.setattr(dc, "latent_space", lambda rows, *a: seen.append(rows.count()) or build(rows, *a))
    words = []
    number = dc.Vocabulary.__init__
    monkeypatch.setattr(dc.Vocabulary, "__init__", lambda self, ws: words.append(ws) or number(self, ws))
    found = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id long, text string")).collect()
    count = Counter(w for _, t in docs for w in set(dc.words_of(t)))
    top = sorted(count, key=lambda w: (-count[w], w))[:600]
    own = sorted({w for _, t in items for w in dc.words_of(t)})
    assert words == [own + [w for w in top if w not in own][: max(0, 600 - len(own))]]
    assert seen == [len(docs)]
    assert {(r["doc_id"], r["item_id"]) for r in found} == hit


def test_words_are_counted_once_a_document(spark, monkeypatch):
    monkeypatch.setattr(dc, "COUNTED_WORDS", 3)
    texts = ["A b, a! (b) c_d", None, "", "b\x1cB e\x85f", "x" * 100 + " b", "?!"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    want = Counter(w for t in texts for w in set(dc.words_of(t)))
    assert {r["w"]: r["n"] for r in dc.word_counts(rows).collect()} == want
    v = dc.Vocabulary(["b", "e"])
    for t in texts:
        assert np.frombuffer(v.writer()(t), dtype=v.kind).tolist() == [v.at.get(w, 0) for w in dc.words_of(t)]


def test_segment_sums():
    rng = np.random.default_rng(3)
    table = rng.standard_normal((30, 5))
    for sizes in ([1], [16, 17, 1, 300, 2], rng.integers(1, 40, 50).tolist()):
        rows = rng.integers(0, 30, sum(sizes))
        starts = np.cumsum([0, *sizes[:-1]])
        assert np.allclose(dc.segment_sums(table, rows, starts), np.add.reduceat(table[rows], starts, axis=0))


def test_inner_product_is_that_of_the_gram_product():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 50, n) for n in (5, 0, 16, 17, 40, 1, 100)]
    idf = rng.random(50).astype(np.float32) + 0.5
    idf[[0, 3]] = 0
    q = rng.standard_normal((50, 7)).astype(np.float32)
    tables = (idf, (idf**2)[:, None], q * idf[:, None])
    want, got = np.zeros((50, 7), dtype=np.float32), np.zeros((7, 7), dtype=np.float32)
    dc.gram_product(texts, 0.5, tables, want)
    dc.inner_product(texts, 0.5, tables, got)
    assert np.allclose(got, q.T @ want, rtol=1e-3, atol=1e-3)


def test_words_by_hash_are_those_of_words_of(monkeypatch):
    rng = random.Random(6)
    pieces = ["a", "B", " ", "\n", "\x1c", "_", "É", "ß", "İ", "ΑΣ", "日本", "½", "²", "12", "'s", "-", "x" * 70, "🙂", "\x00", "\ud800"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 20))) for _ in range(400)] + [None, "", "\n"]
    for chars in (1, 100, 1 << 20):
        monkeypatch.setattr(dc, "GROUP_CHARS", chars)
        found = [[g.joined[a:b] for a, b in zip(g.starts[s:e], g.ends[s:e], strict=True)] for g in dc.hashed(texts) for s, e in zip(g.offsets, g.offsets[1:], strict=False)]
        assert found == [dc.words_of(t) for t in texts]
        by_hash = {h: g.joined[a:b] for g in dc.hashed(texts) for h, a, b in zip(g.hashes.tolist(), g.starts, g.ends, strict=True)}
        words = {w for t in texts for w in dc.words_of(t)}
        assert set(by_hash.values()) == words and len(by_hash) == len(words)
        v = dc.Vocabulary(sorted(words)[::2])
        assert [np.frombuffer(x, dtype=v.kind).tolist() for x in v.numbers(texts)] == [[v.at.get(w, 0) for w in dc.words_of(t)] for t in texts]


def test_regions_of_hidden_items():
    rng = np.random.default_rng(5)
    items = [rng.integers(1, 12, n) for n in (1, 6, 9, 20)]
    texts = [rng.integers(0, 30, n) for n in [*rng.integers(0, 60, 80).tolist(), 400]]
    hidden = dc.HiddenItems([0, 1, 3], items, 30)
    want = {}
    for k, ids in enumerate(texts):
        for i in hidden.which:
            need, size = -(-550 * len(items[i]) // 1000), dc.stretch_words(items[i])
            if sum(w in set(ids.tolist()) for w in items[i].tolist()) < need:
                continue
            at = np.flatnonzero(np.isin(ids, items[i]))
            at = [a for a, b in zip(at.tolist(), at[need - 1 :].tolist(), strict=False) if b - a < size]
            parts = []
            for a in at:
                if parts and a - parts[-1][1] <= size:
                    parts[-1][1] = a
                else:
                    parts.append([a, a])
            for a, b in parts:
                want.setdefault(k, []).append((i, a, b + size))
    assert hidden.regions(texts) == want and len(want) > 20
    assert hidden.regions([]) == {} == dc.HiddenItems([], items, 30).regions(texts)
