"""Repeated passages by content-defined chunking (operator 6).

A gear rolling hash over the bytes of a text puts a chunk border where the hash
of the last 16 bytes has its top bits zero (never closer than ``LEAST`` bytes
and never further than ``MOST``), so borders depend on the content around them
and an insertion moves only the chunks that it touches.  From every chunk on, the
shortest sequence of chunks that holds ``SEED_WORDS`` whole words has a digest; of
``WINDOW`` neighbouring sequences the one of the least digest is a seed.  A passage
of ``PASSAGE_WORDS`` words holds that many sequences, so wherever it stands the same
seed of it is taken, and two documents meet in its digest.

What meets is then compared word by word with one place of the seed in the
document of the smallest id that holds it, ``REACH`` words to either side (by one byte a word); only passages of
``PASSAGE_WORDS`` words or more are reported, however many documents share phrases.
Neighbouring seeds of the same first document are one passage; where another
document is the first to hold what follows, a passage of its own begins (the two
may overlap).

Rows: null and empty texts have no chunks; rows with a null id are left out, as
a passage needs documents to repeat across.  An id names one document: repeated rows
are one, each of several texts under one id has its own offsets, and passages that
repeat only inside one document are not reported.  Extra columns are not read.  An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, shuffle_partitions
from .common import lean, small_batches

#: Border where the top bits of the 16-bit gear hash are zero; bounds of a chunk in
#: bytes.  The upper one is a prime, so cuts in a text that repeats one word come
#: at all its phases, and such texts still share chunks.
TOP_BITS, LEAST, MOST = 3, 8, 61
#: Words of a seed, neighbouring sequences of which one is a seed, least words of a passage.
SEED_WORDS, WINDOW, PASSAGE_WORDS = 14, 4, 50
#: Words to either side of a seed that are compared: the shortest passage lies inside,
#: wherever it holds the seed, and the reaches of neighbouring seeds overlap.
REACH = PASSAGE_WORDS - SEED_WORDS
#: Odd base of the digests and its inverse (modulo 2 to the power of 64), and how many powers are kept.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
KEPT_POWERS = 1 << 18
GEAR = np.random.default_rng(6).integers(0, 1 << 16, 256).astype(np.uint16)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(max(n - 1, 0), base, dtype=np.uint64)))


POWERS, INVERSES = _powers(BASE, KEPT_POWERS), _powers(INVERSE, KEPT_POWERS)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n - 1 of the base and of its inverse."""
    return (POWERS[:n], INVERSES[:n]) if n <= KEPT_POWERS else (_powers(BASE, n), _powers(INVERSE, n))


def gear_hash(data: np.ndarray) -> np.ndarray:
    """Low 16 bits of the gear hash ``h = 2 h + GEAR[byte]`` at every byte: the
    sum over the last 16 bytes, by doubling."""
    h = GEAR[data]
    for reach in (1, 2, 4, 8):
        h[reach:] += h[:-reach] << np.uint16(reach)
    return h


def chunk_ends(data: np.ndarray) -> list[int]:
    """Ends of the chunks of a text's bytes, the last one its length."""
    if not len(data):
        return []
    ends, last = [], 0
    for c in (np.flatnonzero(gear_hash(data) >> np.uint16(16 - TOP_BITS) == 0) + 1).tolist():
        while c - last > MOST:
            last += MOST
            ends.append(last)
        if c - last >= LEAST:
            ends.append(c)
            last = c
    while len(data) - last > MOST:
        last += MOST
        ends.append(last)
    if last < len(data):
        ends.append(len(data))
    return ends


class Digests:
    """Digests of any stretches of a text's bytes: differences of running sums of
    ``byte * BASE ** place``, moved to place 0 and mixed."""

    def __init__(self, data: np.ndarray):
        self.forth, self.back = powers(len(data) + 1)
        self.sums = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.forth[: len(data)]))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        x = (x ^ (x >> np.uint64(31))) * _MIX
        return x ^ (x >> np.uint64(29))


def as_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)


def chunks(text: str) -> list[int]:
    """Digests of the chunks."""
    data = as_bytes(text)
    ends = np.array(chunk_ends(data), dtype=np.int64)
    return Digests(data).of(np.append(0, ends[:-1]), ends).view(np.int64).tolist() if len(ends) else []


class Words:
    """The words (runs of bytes above blank) of a text."""

    def __init__(self, data: np.ndarray):
        solid = data > 32
        edges = np.flatnonzero(np.diff(solid.view(np.int8), prepend=0, append=0))
        self.starts, self.ends = edges[::2], edges[1::2]
        if len(data) and data.max() > 127:  # offsets count code points
            points = np.append(0, np.cumsum(data & 0xC0 != 0x80))
            self.low, self.high = points[self.starts], points[self.ends]
        else:
            self.low, self.high = self.starts, self.ends

    def __len__(self) -> int:
        return len(self.starts)


def sequences(data: np.ndarray, words: Words, digests: Digests) -> tuple[np.ndarray, np.ndarray]:
    """Digest and first whole word of the shortest sequence of chunks with SEED_WORDS
    whole words, from each chunk on (as long as there is one)."""
    ends = np.array(chunk_ends(data), dtype=np.int64)
    starts = np.append(0, ends[:-1])
    first = np.searchsorted(words.starts, starts)
    there = first + SEED_WORDS <= len(words)
    starts, first = starts[there], first[there]
    stop = ends[np.searchsorted(ends, words.ends[first + SEED_WORDS - 1])]
    return digests.of(starts, stop), first


def seeds(data: np.ndarray, words: Words, digests: Digests) -> tuple[np.ndarray, np.ndarray]:
    """Digest and first word of the seeds: of every WINDOW neighbouring sequences the
    one of the least digest (of all, if there are fewer)."""
    d, first = sequences(data, words, digests)
    if not len(d):
        return d.view(np.int64), first
    least = np.lib.stride_tricks.sliding_window_view(d, min(WINDOW, len(d))).argmin(axis=1)
    at = np.unique(least + np.arange(len(least)))
    return d[at].view(np.int64), first[at]


def packed(values: np.ndarray) -> bytes:
    """Non-negative integers, a byte each if they all fit."""
    return b"\1" + values.astype("<u1").tobytes() if not len(values) or values.max() < 256 else b"\4" + values.astype("<u4").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{raw[0]}", offset=1).astype(np.int64)


def places(gaps: bytes, sizes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (code points) of each word, from the gaps before the words and their sizes."""
    gap, size = unpacked(gaps), unpacked(sizes)
    ends = np.cumsum(gap + size)
    return ends - size, ends


def text_row(text: str) -> tuple | None:
    """What is kept of a text: a digest of it, its seeds and their first words, a byte
    for each word (never 0), and where the words stand; None without seeds."""
    data = as_bytes(text)
    words, digests = Words(data), Digests(data)
    d, first = seeds(data, words, digests)
    if not len(d):
        return None
    kinds = (digests.of(words.starts, words.ends) >> np.uint64(40)) % np.uint64(255) + np.uint64(1)
    whole = int(digests.of(np.array([0]), np.array([len(data)])).view(np.int64)[0])
    return whole, d, first.astype(np.int32), kinds.astype(np.uint8).tobytes(), packed(words.low - np.append(0, words.high[:-1])), packed(words.high - words.low)


def around(kinds: bytes, first: int) -> bytes:
    """The words REACH before a seed's first word to SEED_WORDS + REACH behind it, 0 where the text has none."""
    low, high = first - REACH, first + SEED_WORDS + REACH
    return bytes(max(0, -low)) + kinds[max(0, low) : high] + bytes(max(0, high - max(len(kinds), max(0, low))))


def common_words(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words are the same before and from the seed's first word on, row by row."""
    same = (a == b) & (a != 0)
    count = lambda m: np.where(m.all(axis=1), m.shape[1], m.argmin(axis=1))
    return count(same[:, REACH - 1 :: -1]), count(same[:, REACH:])


def passages(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Stretches ``(first document, first word, end)`` of one document, those of the same
    first document that overlap as one."""
    out: list[list[int]] = []
    for doc, a, b in sorted(set(found)):
        if out and out[-1][0] == doc and a <= out[-1][2]:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([doc, a, b])
    return [tuple(r) for r in out]


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per repeated passage of a document: id, ``start, end`` (code points,
    end exclusive), ``n_words``, ``first_doc`` (smallest id that holds it) and ``kept`` (this document is it)."""
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *r) for i, t in zip(b["i"], b["t"], strict=True) if (r := text_row(t))]
            yield pd.DataFrame(rows, columns=["i", "t", "d", "p", "kinds", "gaps", "sizes"])

    texts = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    cuts = texts.mapInPandas(lean(cut), f"i {id_type}, t long, d array<long>, p array<int>, kinds binary, gaps binary, sizes binary")
    cuts = materialize(cuts.withColumn("t", F.xxhash64("i", "t")), "chunks")  # one text of one id
    each = cuts.select("i", F.explode(F.array_distinct("d")).alias("d"))
    shared = each.groupBy("d").agg(F.min("i").alias("first"), F.max("i").alias("last")).where("first <> last").select("d", "first")
    shared = materialize(shared, "shared_seeds")
    # the shared seeds of a text meet its words
    hits = cuts.select("t", F.explode(F.arrays_zip("d", "p")).alias("s")).select("t", "s.d", "s.p").join(shared, "d")
    hits = hits.groupBy("t").agg(F.collect_set(F.struct("d", "p", "first")).alias("hits"))
    # repeated rows are one; dealt by the text, as the join below is
    words = cuts.select("i", "t", "kinds").repartition(shuffle_partitions(spark), "t").dropDuplicates(["i", "t"])

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, t, h["first"], h["d"], h["p"], around(kinds, h["p"])) for i, t, kinds, hit in zip(b["i"], b["t"], b["kinds"], b["hits"], strict=True) for h in hit]
            frame = pd.DataFrame(rows, columns=["i", "t", "first", "d", "p", "c"])
            frame["edge"] = [0 in c for c in frame["c"]]  # the text begins or ends within reach
            yield frame

    met = materialize(words.join(hits, "t").mapInPandas(lean(contexts), f"i {id_type}, t long, first {id_type}, d long, p int, c binary, edge boolean"), "seed_contexts")
    # the smallest document's side: one place of the seed in it (the first away from the
    # text's edges), so every other place of the seed is compared once, however often a
    # line stands in one document
    there = met.where("i = first").groupBy("d").agg(F.min(F.struct("edge", "p", "t", "c")).alias("at")).select("d", F.col("at.c").alias("c2"), F.col("at.t").alias("t2"), F.col("at.p").alias("p2"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            a, c = (np.frombuffer(b"".join(b[x]), dtype=np.uint8).reshape(len(b), -1) for x in ("c", "c2"))
            left, right = common_words(a, c)
            ok = (right >= SEED_WORDS) & (left + right >= PASSAGE_WORDS)
            b, left, right = b[ok], left[ok], right[ok]
            for i, t, p in (("i", "t", "p"), ("first", "t2", "p2")):
                yield pd.DataFrame({"i": b[i], "t": b[t], "first": b["first"], "a": b[p] - left, "z": b[p] + right})

    pairs = met.where("i <> first").select("i", "t", "first", "d", "p", "c").join(there, "d")
    stretches = pairs.mapInPandas(lean(compare), f"i {id_type}, t long, first {id_type}, a long, z long")
    # what many documents share comes once to its first document
    per_text = stretches.distinct().groupBy("i", "t").agg(F.collect_list(F.struct("first", "a", "z")).alias("found"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, found, gaps, sizes in zip(b["i"], b["found"], b["gaps"], b["sizes"], strict=True):
                low, high = places(gaps, sizes)
                rows += [(i, low[a], high[z - 1], z - a, first) for first, a, z in passages([(f["first"], f["a"], f["z"]) for f in found])]
            if rows:
                yield pd.DataFrame(rows, columns=["i", "start", "end", "n_words", "first_doc"])

    per_text = materialize(per_text, "passages")
    offsets = cuts.select("i", "t", "gaps", "sizes").join(per_text.select("i", "t"), ["i", "t"], "left_semi").dropDuplicates(["i", "t"])
    out = per_text.join(offsets, ["i", "t"]).mapInPandas(lean(merge), f"i {id_type}, start long, end long, n_words long, first_doc {id_type}")
    return out.withColumn("kept", F.col("i") == F.col("first_doc")).withColumnRenamed("i", id_col)
