"""Operator 6: the hash, the chunks' resistance to shifts, passages against brute force."""

import random

import numpy as np

from ticketsift.llm import chunk_dedup as cd


def test_gear_hash_and_bounds():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 500).astype(np.uint8)
    h, want = 0, []
    for b in data.tolist():
        h = (2 * h + int(cd.GEAR[b])) & 0xFFFF
        want.append(h)
    assert cd.gear_hash(data).tolist() == want
    for text in ("", "a", "de " * 5000, "x" * 1000, "".join(map(chr, rng.integers(97, 123, 3000)))):
        ends = cd.chunk_ends(np.frombuffer(text.encode(), dtype=np.uint8))
        sizes = np.diff([0, *ends])
        assert (ends[-1:] or [0])[0] == len(text.encode()) and (sizes <= cd.MOST).all() and (sizes[:-1] >= cd.LEAST).all()


def test_insertions_move_few_chunks():
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(2000))
    before = set(cd.chunks(text))
    after = set(cd.chunks(text[:700] + "Ünsert " + text[700:]))
    assert len(before - after) < 8


def word_windows(text, n):
    ws = text.split()
    return {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)}


def test_passages_match_brute_force(spark):
    rng = random.Random(3)
    syll = ["ka", "lo", "mi", "ré", "tu", "sa", "ne", "vo"]
    text = lambda n: " ".join("".join(rng.choice(syll) for _ in range(rng.randint(1, 4))) for _ in range(n))
    passages = [text(rng.randint(51, 90)) for _ in range(12)]
    docs = []
    for i in range(160):
        t = text(rng.randint(30, 300))
        if i % 4 == 0:
            t = f"{t} {rng.choice(passages)} {text(40)}"
        docs.append((i, t))
    docs += [(200, "og " * 3000), (201, "x og " + "og " * 90), (202, ""), (203, None), (204, docs[1][1]), (204, docs[1][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs] + [(None, docs[1][1], 1)], "doc_id long, text string, k int")
    got = cd.repeated_passages(df).collect()
    sets = {}
    for i, t in docs:
        for w in word_windows(t or "", 50):
            sets.setdefault(w, set()).add(i)
    want = {i for s in sets.values() if len(s) > 1 for i in s}
    assert {r["doc_id"] for r in got} == want
    texts = dict(docs)
    for r in got:
        part = texts[r["doc_id"]][r["start"] : r["end"]]
        assert len(part.split()) == r["n_words"] >= cd.PASSAGE_WORDS and r["kept"] == (r["first_doc"] == r["doc_id"])
        assert any(part[5:60] in (texts[o] or "") for o in texts if o != r["doc_id"])
    assert cd.repeated_passages(df.where("false")).count() == 0


def phrases(seed):
    rng = random.Random(seed)
    return lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.choice((1, 2, 3, 3, 4, 5, 6, 8)))) for _ in range(n))


def test_planted_passages_are_always_met():
    text = phrases(5)
    for _ in range(1500):
        passage = text(51)
        a, b = (set(cd.text_row(f"{text(30)} {passage} {text(30)}")[1].tolist()) for _ in range(2))
        assert a & b


def test_stock_phrases_are_no_passage_and_each_passage_is_kept_once(spark):
    text = phrases(6)
    stock = [text(12) for _ in range(8)]
    docs = [(k, f"{text(40)} {s} {text(40)}") for k, s in enumerate(stock)]
    docs.append((20, f"{text(30)} {' '.join(stock)} {text(30)}"))
    boiler, other = text(80), text(80)
    docs += [(30, f"{text(30)} {boiler} {text(30)}"), (31, f"{text(30)} {boiler} {other}"), (32, f"{text(30)} {boiler} {other}"), (33, other)]
    got = cd.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {30, 31, 32, 33}
    texts = dict(docs)
    assert {r["doc_id"] for r in got if r["kept"]} == {30, 31}
    for r in got:
        assert texts[r["doc_id"]][r["start"] : r["end"]] in texts[r["first_doc"]]


def test_shorter_passages_are_left_alone_and_longer_ones_found_whole(spark):
    text = phrases(8)
    short, long = [text(k) for k in (25, 35, 45, 49)], [text(k) for k in (50, 60, 120, 300)]
    docs = [(10 * k + j, f"{text(20)} {s} {text(20)}") for k, s in enumerate(short) for j in range(3)]
    docs += [(100 + 10 * k + j, f"{text(20)}\u00e9 {s} {text(20)}") for k, s in enumerate(long) for j in range(3)]
    got = cd.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    texts = dict(docs)
    assert sorted((r["doc_id"], texts[r["doc_id"]][r["start"] : r["end"]]) for r in got) == sorted((100 + 10 * k + j, s) for k, s in enumerate(long) for j in range(3))
    assert all(r["first_doc"] == r["doc_id"] // 10 * 10 and r["kept"] == (r["doc_id"] % 10 == 0) for r in got)


def test_two_texts_of_one_id_and_repeated_rows(spark):
    text = phrases(9)
    p, q = text(70), text(80)
    docs = [(1, f"{text(25)} {p}"), (1, f"{text(60)} {q} {text(5)}"), (2, f"{text(7)} {p} {text(9)}"), (2, ""), (3, f"{text(12)} {q}"), (4, f"{p} {text(3)} {p}")]
    docs[3] = docs[2]
    got = cd.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    found = sorted((r["doc_id"], r["n_words"], r["first_doc"]) for r in got)
    assert found == [(1, 70, 1), (1, 80, 1), (2, 70, 1), (3, 80, 1), (4, 70, 1), (4, 70, 1)]
    for r in got:
        assert any(t[r["start"] : r["end"]] in (p, q) for i, t in docs if i == r["doc_id"])


def test_what_is_kept_of_a_text():
    for t in ("", " ", "a", "\u00e9 b\n\tc\u00a0d  ", "x" * 5000, "word " * 40, "\U0001f642 " * 40):
        data = cd.as_bytes(t)
        words = cd.Words(data)
        assert [t[a:b] for a, b in zip(words.low, words.high)] == [w for w in __import__("re").split("[\x00-\x20]+", t) if w]
        row = cd.text_row(t)
        assert (row is None) == (len(words) < cd.SEED_WORDS)
        if row:
            assert [t[a:b] for a, b in zip(*cd.places(row[4], row[5]))] == t.split()
            assert len(row[3]) == len(words) and 0 not in row[3]
    assert cd.unpacked(cd.packed(np.array([1, 300, 70_000]))).tolist() == [1, 300, 70_000]


def test_common_words():
    kinds = bytes(range(1, 201))
    a = np.frombuffer(cd.around(kinds, 10), dtype=np.uint8)[None]
    b = np.frombuffer(cd.around(kinds[5:30] + bytes([7]) + kinds[31:], 5), dtype=np.uint8)[None]
    left, right = cd.common_words(a, b)
    assert (left[0], right[0]) == (5, 20)
