"""Lexical retrieval packing (operator 1).

Documents become token ids once (written as 16- or 32-bit ids), with corpus-wide
document frequencies of the vocabulary's ids.  A routing key, the smallest hash
of a document's token triples, brings likely neighbours together: the ids
are range-partitioned and sorted by it, so any number of equal documents spreads
over partitions.  Each partition is read in shards of about ``SHARD_TOKENS``
tokens.  A shard has a BM25 inverted index; a seed document opens a window, the
index returns its unused neighbours in order of score, and they greedily fill
the window.  The document that does not fit is cut, and its rest seeds the next
window, so windows are full; what is left at a shard's end opens the next
shard, and a partition's last window is dealt to powers of two.

Rows: a null text counts as empty (its one piece holds the end id alone); null
ids stay null; repeated rows are packed each; extra columns are not read.  An
empty table gives no sequences.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import materialize
from .common import distinct_pieces, expand, hold, lean, small_batches

WINDOW = 4096
#: Tokens of a shard (one index), and of a partition of shards.
SHARD_TOKENS, PARTITION_TOKENS = 1 << 19, 1 << 22
K1, B = 1.2, 0.75
CACHE_WORDS = 700_000
#: Characters that Python and the library treat alike in case, class and composition.
PLAIN = r"[^\x00-\x7e¡-©«-±¶-¸»¿-ÿ]"
#: The vocabulary's words (a fixed value of the file) in such a text, in lower case,
#: and its line ends.
WORD = r"\n|[a-zß-öø-ÿ]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^ \t-\ra-z0-9ß-öø-ÿ]+"


class WordEncoder:
    """Token ids of whole texts for a vocabulary with word ends: every word is
    encoded by the library once and remembered; texts with special strings or
    rarer characters go to the library whole."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.size = self.library.get_vocab_size()
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.words = re.compile(WORD).findall
        self.rare = re.compile(PLAIN).search
        ends = [k for w, k in self.library.get_vocab().items() if w.endswith("</w>")]
        self.ends_word = np.isin(np.arange(self.size), ends)
        self.cache: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian numbers of ``kind``."""
        cut, whole = [], []
        for k, t in enumerate(texts):
            (whole if not t.isascii() and self.rare(t) or any(s in t for s in self.specials) else cut).append(k)
        out = [b""] * len(texts)
        words, places, texts_of = distinct_pieces([texts[k].lower() for k in cut], self.words)
        own = self.known(words)
        starts = np.cumsum([0, *map(len, own)]) // self.kind.itemsize
        ids, ends = expand(*expand(np.frombuffer(b"".join(own), dtype=self.kind), starts, places), texts_of)
        raw, ends = ids.tobytes(), (ends * self.kind.itemsize).tolist()
        for k, a, b in zip(cut, ends, ends[1:], strict=False):
            out[k] = raw[a:b]
        for k, e in zip(whole, self.library.encode_batch_fast([texts[k] for k in whole], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, dtype=self.kind).tobytes()
        return out

    def known(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words; what is new is encoded as one text, in which each word
        ends with the one token that ends a word."""
        out = list(map(self.cache.get, words))
        places = [k for k, x in enumerate(out) if x is None]
        new = [words[k] for k in places]
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
        ids = np.array(self.library.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, dtype=self.kind)
        cuts = np.flatnonzero(self.ends_word[ids]) + 1
        if len(cuts) != len(new):
            raise ValueError("the vocabulary's word ends don't match its words")
        raw, cuts = ids.tobytes(), (cuts * self.kind.itemsize).tolist()
        for k, w, a, b in zip(places, new, [0, *cuts], cuts, strict=False):
            self.cache[w] = out[k] = raw[a:b]
        return out


def encoder(path: str) -> WordEncoder:
    return hold(("word encoder", path), lambda: WordEncoder(path))


def route(ids: np.ndarray) -> int:
    """Smallest hash of the document's token triples (of its ids, if shorter)."""
    if len(ids) < 3:
        return int(ids[0]) if len(ids) else 0
    x = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        h = (x[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (x[2:] * np.uint64(0x165667B19E3779F9))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return int((h ^ (h >> np.uint64(29))).min() >> np.uint64(1))


def tokenise(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """``i, ids, n, route``: the ids of each document with the end id."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in batches:
            end = np.array([end_id], dtype=enc.kind).tobytes()
            ids = [x + end for x in enc.encode([t or "" for t in b["t"]])]
            keys = [route(np.frombuffer(x, dtype=enc.kind)) for x in ids]
            yield pd.DataFrame({"i": b["i"], "ids": ids, "n": [len(x) // enc.kind.itemsize for x in ids], "route": keys})

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInPandas(lean(rows, keeps=True), f"i {id_type}, ids binary, n long, route long")


def document_frequencies(tokens: DataFrame, kind: np.dtype, size: int) -> np.ndarray:
    """In how many documents each id occurs, over all documents; the driver gets
    one number for each id of the vocabulary."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, last = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        for b in batches:
            for x in b["ids"]:
                ids = np.frombuffer(x, dtype=kind)
                place = np.arange(len(ids))
                last[ids] = place
                df[ids[last[ids] == place]] += 1  # each id where it stands last
        at = np.flatnonzero(df)
        yield pd.DataFrame({"id": at, "df": df[at]})

    total = tokens.select("ids").mapInPandas(lean(rows, keeps=True), "id long, df long").groupBy("id").agg(F.sum("df").alias("df"))
    out = np.zeros(size, dtype=np.int64)
    for r in total.collect():
        out[r["id"]] = r["df"]
    return out


class Index:
    """BM25 inverted index over the documents of one shard."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        size = len(idf)
        lengths = np.array([len(d) for d in docs])
        key = np.sort(np.concatenate(docs).astype(np.int64) * len(docs) + np.repeat(np.arange(len(docs)), lengths))
        first = np.flatnonzero(np.diff(key, prepend=-1))
        tf = np.diff(first, append=len(key))
        term, doc = np.divmod(key[first], len(docs))
        norm = K1 * (1 - B + B * lengths / mean)
        self.doc, self.impact = doc, (idf[term] * tf * (K1 + 1) / (tf + norm[doc])).astype(np.float32)
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=size))])
        self.n = len(docs)

    def scores(self, query: np.ndarray) -> np.ndarray:
        """BM25 of every document for the distinct terms of a query."""
        terms = np.unique(query).astype(np.int64)
        start, stop = self.ends[terms], self.ends[terms + 1]
        size = stop - start
        at = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.bincount(self.doc[at], weights=self.impact[at], minlength=self.n)


def fill(docs: list[np.ndarray], idf: np.ndarray, mean: float, carried: tuple[list[tuple[int, int, int]], int] | None = None) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of ``(document, start, length)``; the last one may be short.
    ``carried``: the open window left by the shard before."""
    index = Index(docs, idf, mean)
    free = np.ones(len(docs), dtype=bool)
    window, room = carried or ([], WINDOW)
    cut, at = None, 0  # the rest of a document that did not fit; the first document that may be unused
    while True:
        if cut:
            seed, start = cut
        else:
            while at < len(docs) and not free[at]:
                at += 1
            if at == len(docs):
                break
            seed, start = at, 0
            free[seed] = False
        current, neighbours = seed, None
        while True:
            take = min(room, len(docs[current]) - start)
            window.append((current, start, take))
            room -= take
            cut = (current, start + take) if start + take < len(docs[current]) else None
            if not room:
                yield window
                window, room = [], WINDOW
                break
            if neighbours is None:
                score = index.scores(docs[seed])
                neighbours = iter(np.argsort(-score, kind="stable").tolist())
            current, start = next((d for d in neighbours if free[d]), None), 0
            if current is None:
                break
            free[current] = False
    if window:
        yield window


def pack(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per piece: id, ``start, length, ids_crc32, doc_tokens, sequence_id, offset``
    and, with ``with_ids``, ``ids`` (binary, as the vocabulary's ``kind``)."""
    spark = docs.sparkSession
    small_batches(spark)
    enc = encoder(path)
    kind, size = enc.kind, enc.size
    tokens = materialize(tokenise(docs, path, end_id, id_col, text_col), "packing_ids")
    total = tokens.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()
    df = document_frequencies(tokens, kind, size)
    idf = np.log1p((total["n"] - df + 0.5) / (df + 0.5))
    mean = max(total["t"] / max(total["n"], 1), 1.0)
    parts = max(1, -(-total["t"] // PARTITION_TOKENS))
    statistics = spark.sparkContext.broadcast(idf)  # one number for each id of the vocabulary
    id_type = docs.schema[id_col].dataType.simpleString()

    def sequences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, done = TaskContext.get().partitionId(), 0
        names: list = []
        texts: list[np.ndarray] = []
        held, open_window = 0, None

        def rows(windows: list[list[tuple]]) -> pd.DataFrame:
            nonlocal done
            out = []
            for w in windows:
                offset = 0
                for name, n, start, ids in w:
                    out.append((name, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, (part << 40) + done, offset, ids.tobytes() if with_ids else None))
                    offset += len(ids)
                done += 1
            frame = pd.DataFrame(out, columns=["i", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
            frame["i"] = pd.array(frame["i"], dtype="object")
            return frame if with_ids else frame.drop(columns="ids")

        def pieces(w: list[tuple[int, int, int]]) -> list[tuple]:
            return [p if len(p) == 4 else (names[p[0]], len(texts[p[0]]), p[1], texts[p[0]][p[1] : p[1] + p[2]]) for p in w]

        def shard() -> pd.DataFrame:
            nonlocal open_window
            carried = (list(open_window), WINDOW - sum(len(p[3]) for p in open_window)) if open_window else None
            windows = [pieces(w) for w in fill(texts, statistics.value, mean, carried)]
            open_window = windows.pop() if windows and sum(len(p[3]) for p in windows[-1]) < WINDOW else None
            return rows(windows)

        for b in batches:
            for name, x in zip(b["i"], b["ids"], strict=True):
                names.append(None if pd.isna(name) else name)
                texts.append(np.frombuffer(x, dtype=kind))
                held += len(texts[-1])
                if held >= SHARD_TOKENS:
                    yield shard()
                    names, texts, held = [], [], 0
        if texts:
            yield shard()
        if open_window:
            yield rows(powers_of_two(open_window))

    dealt = tokens.select("i", "ids", "route").repartitionByRange(parts, "route", F.xxhash64("i")).sortWithinPartitions("route", "i")
    schema = f"i {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return dealt.select("i", "ids").mapInPandas(lean(sequences), schema).withColumnRenamed("i", id_col)


def powers_of_two(window: list[tuple]) -> list[list[tuple]]:
    """A short window cut into sequences whose lengths are powers of two, largest first."""
    left, out = list(window), []
    total = sum(len(p[3]) for p in left)
    while total:
        room, seq = 1 << (total.bit_length() - 1), []
        total -= room
        while room:
            name, n, start, ids = left.pop(0)
            take = min(room, len(ids))
            seq.append((name, n, start, ids[:take]))
            room -= take
            if take < len(ids):
                left.insert(0, (name, n, start + take, ids[take:]))
        out.append(seq)
    return out
