"""Operator 1: ids against the library, an exact round trip, BM25 by hand."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from ticketsift.llm import packing as pk

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "B", " ", "\n", "'LL", "'re", "s", "É", "ü", "ß", "日本", "12", "!!", "<|endoftext|>", "<|END", "Hello", "wörld", "\x1c", "é", "🙂", "İ", "Σ", "½", "²", "ª", "µ", "\x85", "\xa0", "x" * 40, "'"]


def library_ids(texts):
    return [np.array(e.ids, dtype="<u4") for e in pk.encoder(PATH).library.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_the_librarys():
    rng = random.Random(2)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(1500)] + [chr(c) + "a" + chr(c) + "1 B" + chr(c) for c in range(0x250)]
    enc = pk.encoder(PATH)
    got = [np.frombuffer(x, dtype=enc.kind).astype("<u4") for x in enc.encode(texts)]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(got, library_ids(texts), strict=True))


def test_bm25_scores():
    docs = [np.array(x) for x in ([1, 2, 2, 3], [2, 4], [5], [1, 1, 1, 2, 3, 3])]
    df = Counter(t for d in docs for t in set(d.tolist()))
    idf = np.array([math.log1p((4 - df[t] + 0.5) / (df[t] + 0.5)) for t in range(6)])
    mean = np.mean([len(d) for d in docs])
    got = pk.Index(docs, idf, mean).scores(np.array([2, 3, 3, 9 % 6]))
    for d, s in zip(docs, got, strict=True):
        tf = Counter(d.tolist())
        want = sum(idf[t] * tf[t] * (pk.K1 + 1) / (tf[t] + pk.K1 * (1 - pk.B + pk.B * len(d) / mean)) for t in {2, 3})
        assert s == pytest.approx(want, rel=1e-5)


def test_neighbours_fill_the_window(monkeypatch):
    monkeypatch.setattr(pk, "WINDOW", 12)
    docs = [np.array(x) for x in ([1, 2, 3, 4, 5], [9, 9, 9, 8, 7], [1, 2, 3, 4, 6], [7, 8, 9, 9, 9])]
    windows = list(pk.fill(docs, np.ones(10), 5.0))
    assert windows == [[(0, 0, 5), (2, 0, 5), (1, 0, 2)], [(1, 2, 3), (3, 0, 5)]]


@pytest.mark.parametrize("shard", [1 << 19, 9000])
def test_every_id_lies_in_one_piece(spark, monkeypatch, shard):
    monkeypatch.setattr(pk, "SHARD_TOKENS", shard)
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("ban", "kor", "lim", "tas") for b in ("der", "ul", "op", "in")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 200, 900, 9000]))) for _ in range(60)] + [None, ""] + ["same text again"] * 40
    rows = [(k, t, "c") for k, t in enumerate(texts)]
    got = pk.pack(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH, 2).collect()
    want = {k: np.append(ids, np.uint32(2)).astype("<u4") for k, ids in enumerate(library_ids([t or "" for t in texts]))}
    by, seqs = defaultdict(list), defaultdict(list)
    kind = pk.encoder(PATH).kind
    for r in got:
        by[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    assert set(by) == set(want)
    for k, rs in by.items():
        at = 0
        for r in sorted(rs, key=lambda r: r["start"]):
            part = want[k][at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(want[k]) and r["ids_crc32"] == zlib.crc32(part.tobytes())
            assert (np.frombuffer(r["ids"], dtype=kind) == part).all()
            at += r["length"]
        assert at == len(want[k])
    padding = 0
    for rs in seqs.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= pk.WINDOW
        padding += 0 if at & (at - 1) == 0 else pk.WINDOW - at
    assert padding == 0


def test_repeated_and_nameless_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    got = pk.pack(df, PATH, 2, with_ids=False).collect()
    assert Counter(r["doc_id"] for r in got if r["start"] == 0) == {1: 2, None: 1}
    assert pk.pack(df.where("false"), PATH, 2).count() == 0


def test_words_beyond_the_cache(monkeypatch):
    monkeypatch.setattr(pk, "CACHE_WORDS", 6)
    enc = pk.WordEncoder(PATH)
    batches = [["one two three", "two four", ""], ["five two six seven one", "<|endoftext|> one"], ["one two", "eight"]]
    for texts in batches:
        got = [np.frombuffer(x, dtype=enc.kind).astype("<u4").tolist() for x in enc.encode(texts)]
        assert got == [ids.tolist() for ids in library_ids(texts)]
        assert len(enc.cache) <= 6


def test_document_frequencies_count_an_id_once_a_document(spark):
    docs = [[1, 2, 2, 3, 1], [2], [9, 9, 9], [3, 0, 3], []]
    rows = spark.createDataFrame([(bytearray(np.array(d, dtype="<u2").tobytes()),) for d in docs], "ids binary")
    want = Counter(t for d in docs for t in set(d))
    assert pk.document_frequencies(rows, np.dtype("<u2"), 10).tolist() == [want[t] for t in range(10)]


def test_index_lists_documents_by_term():
    docs = [np.array(x, dtype="<u2") for x in ([65535, 2, 2], [2, 65535], [], [7])]
    index = pk.Index(docs, np.ones(65536), 2.0)
    assert index.doc.tolist() == [0, 1, 3, 0, 1]
    assert index.ends[[2, 3, 7, 8, 65535, 65536]].tolist() == [0, 2, 2, 3, 3, 5]


def test_a_word_is_looked_up_once_a_batch():
    class Counting(dict):
        asked = Counter()

        def get(self, w, *rest):
            self.asked[w] += 1
            return super().get(w, *rest)

    enc = pk.WordEncoder(PATH)
    enc.cache = Counting()
    texts = ["the end, the END.", " the\x1cend\r\n'll 's ''s 12", "", "\n", "Ünd the end,", "the 日本 the"] * 20
    got = [np.frombuffer(x, dtype=enc.kind).astype("<u4").tolist() for x in enc.encode(texts)]
    assert got == [ids.tolist() for ids in library_ids(texts)]
    assert enc.cache.asked["end"] and set(enc.cache.asked.values()) == {1}
    assert [enc.encode(x) for x in ([], [""], [" "], ["日"])] == [[], [b""], [b""], [library_ids(["日"])[0].astype(enc.kind).tobytes()]]
