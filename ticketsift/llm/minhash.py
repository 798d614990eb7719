"""Near-duplicate documents by ProbMinHash (operator 4).

A document is the weighted set of its five-word shingles, a shingle that occurs
``c`` times weighing ``1 + ln c``.  Every shingle sends arrivals of a Poisson
process with its weight as rate, each to a random register; a register keeps its
earliest arrival, and a shingle stops as soon as its next arrival comes after
the latest register.  Two documents agree in a register with probability equal
to their probability Jaccard similarity (for weights of one, the Jaccard
similarity).  Registers are banded; documents that share a band are verified
exactly, and those with a similarity of ``THRESHOLD`` or more are linked.

Equal word sequences are collapsed first.  A band's documents are compared with
its smallest member, not with each other; only where that leaves a band in
several classes are its members compared across the classes, by registers, in
bounded blocks, until nothing more links.

Rows: texts are compared by their lower-case words.  A text without words (null,
empty, punctuation) is alone in its class.  A null id takes no part in naming a
class: rows without an id are grouped with equal texts only.  Repeated rows are
copies.  Extra columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import components, free_name, join_list, lean, small_batches

SHINGLE, THRESHOLD = 5, 0.8
#: 26 bands of 5 registers: a pair at the threshold is found with probability 0.99997.
BANDS, ROWS = 26, 5
REGISTERS = BANDS * ROWS
#: Pairs whose registers agree less are not verified: four standard deviations below the threshold.
LIKELY = 0.66
#: Documents of one band are compared in squares of this side.
BLOCK = 400
WORDS = re.compile(r"[^\W_]+").findall
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def words_of(text: str | None) -> list[str]:
    return WORDS((text or "").lower())


def digest(words: list[str]) -> bytes | None:
    """Identity of a word sequence; None without words."""
    return hashlib.blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=16).digest() if words else None


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(word_lists: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per document its distinct shingle hashes, ascending, and their counts."""
    flat = [w for ws in word_lists for w in ws]
    hashed = pd.util.hash_array(np.array(flat, dtype=object), categorize=True) if flat else np.zeros(0, dtype=np.uint64)
    rolled = np.zeros(len(hashed), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):  # position i: the words from i on, as far as the table goes
            m = max(len(hashed) - k, 0)
            rolled[:m] = rolled[:m] * _MIX[0] + mix(hashed[k:])
        out, at = [], 0
        for ws in word_lists:
            n = len(ws)
            if n >= SHINGLE:
                own = rolled[at : at + n - SHINGLE + 1]
            else:  # a short text is one shingle
                own = np.zeros(min(n, 1), dtype=np.uint64)
                for h in hashed[at : at + n]:
                    own = own * _MIX[0] + mix(np.atleast_1d(h) + np.uint64(n))
            out.append(np.unique(own, return_counts=True))
            at += n
    return out


def weights(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Registers (16 bits of the winning shingle's hash), a row per document."""
    docs = len(sets)
    first = np.full(docs * REGISTERS, np.inf)
    winner = np.zeros(docs * REGISTERS, dtype=np.uint64)
    item = np.concatenate([s[0] for s in sets]) if docs else np.zeros(0, dtype=np.uint64)
    rate = np.concatenate([weights(s[1]) for s in sets]) if docs else np.zeros(0)
    doc = np.repeat(np.arange(docs), [len(s[0]) for s in sets])
    time = np.zeros(len(item))
    turn = np.uint64(0)
    with np.errstate(over="ignore"):
        while len(item):
            turn += np.uint64(1)
            x = mix(item + turn * _MIX[0])
            time = time - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
            at = doc * REGISTERS + (mix(x + _MIX[0]) % np.uint64(REGISTERS)).astype(np.int64)
            np.minimum.at(first, at, time)
            won = first[at] == time
            winner[at[won]] = item[won]
            latest = first.reshape(docs, REGISTERS).max(axis=1)
            on = time < latest[doc]  # an item whose arrivals are late already cannot win any more
            item, rate, doc, time = item[on], rate[on], doc[on], time[on]
        return (mix(winner) >> np.uint64(48)).astype("<u2").reshape(docs, REGISTERS)


Weighted = tuple[np.ndarray, np.ndarray]


def similarity(a: Weighted, b: Weighted) -> float:
    """Exact probability Jaccard similarity of two weighted shingle sets
    (ascending hashes and counts; no counts: all are one)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    shared = b[0][at] == a[0]
    n = int(shared.sum())
    if not len(a[1]) and not len(b[1]):
        return n / (len(a[0]) + len(b[0]) - n)
    wa, wb = (weights(x[1]) if len(x[1]) else np.ones(len(x[0])) for x in (a, b))
    pairs = np.column_stack([wa[shared], wb[at[shared]]])
    alone_b = np.ones(len(wb), dtype=bool)
    alone_b[at[shared]] = False
    rest_a, rest_b = wa[~shared].sum(), wb[alone_b].sum()
    kinds, times = np.unique(pairs, axis=0, return_counts=True)
    return float(sum(c / (np.maximum(pairs[:, 0] / p, pairs[:, 1] / q).sum() + rest_a / p + rest_b / q) for (p, q), c in zip(kinds, times, strict=True)))


def stored(s: Weighted) -> tuple[bytes, bytes]:
    """A shingle set as bytes, without counts where all are one."""
    return s[0].astype("<u8").tobytes(), s[1].astype("<u4").tobytes() if (s[1] > 1).any() else b""


def restored(h: bytes, c: bytes) -> Weighted:
    return np.frombuffer(h, dtype="<u8"), np.frombuffer(c, dtype="<u4")


def sign(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``i, node, sig``: the word sequence's identity (null without words) and registers."""
    id_type = df.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lists = [words_of(t) for t in b["t"]]
            sig = signatures(shingles(lists))
            yield pd.DataFrame({"i": b["i"], "node": [digest(ws) for ws in lists], "sig": [s.tobytes() if ws else None for s, ws in zip(sig, lists, strict=True)]})

    return df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInPandas(lean(rows), f"i {id_type}, node binary, sig binary")


def _registers(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<u2").reshape(-1, REGISTERS)


def likely_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of ``(a, b)`` those whose registers agree often enough."""
    sig = nodes.select("node", "sig")
    with_sigs = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                same = (_registers(p["sa"]) == _registers(p["sb"])).mean(axis=1)
                yield p.loc[same >= LIKELY, ["a", "b"]]

    return with_sigs.mapInPandas(lean(keep), "a binary, b binary")


def shingle_sets(ends: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``node, h, c`` of the listed nodes, from their smallest id's text."""
    listed = materialize(nodes.select("node", F.col("rep").alias("i")).join(ends.distinct(), "node"), "minhash_ends")
    texts = join_list(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), listed, ["i"])

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lists = [words_of(t) for t in b["t"]]
            # of rows that share an id, those of this text
            rows = [(n, *stored(s)) for n, ws, s in zip(b["node"], lists, shingles(lists), strict=True) if digest(ws) == n]
            yield pd.DataFrame(rows, columns=["node", "h", "c"])

    return materialize(texts.mapInPandas(lean(sets), "node binary, h binary, c binary").dropDuplicates(["node"]), "minhash_sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of ``(a, b)`` those whose exact similarity reaches the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("h").alias("ha"), F.col("c").alias("ca"))
    right = sets.select(F.col("node").alias("b"), F.col("h").alias("hb"), F.col("c").alias("cb"))

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            ok = [similarity(restored(ha, ca), restored(hb, cb)) >= THRESHOLD for ha, ca, hb, cb in zip(p["ha"], p["ca"], p["hb"], p["cb"], strict=True)]
            yield p.loc[np.array(ok, dtype=bool), ["a", "b"]]

    return materialize(pairs.join(left, "a").join(right, "b").mapInPandas(lean(reach), "a binary, b binary"), "minhash_links")


def across_classes(g: pd.DataFrame) -> pd.DataFrame:
    """Links across the classes of one square of a band, verified here: of the
    likely pairs whose first shared band this is, most likely first, those that
    join two classes.  Gives a spanning forest, fewer rows than documents."""
    g = g.sort_values("node", ignore_index=True)
    sig, band = _registers(g["sig"]), int(g["band"].iat[0])
    group, names = pd.factorize(g["root"])
    may = group[:, None] != group[None, :]
    if g["bi"].iat[0] != g["bj"].iat[0]:
        own = g["block"].to_numpy()
        may &= own[:, None] != own[None, :]
    agree = np.zeros((len(g), len(g)), dtype=np.uint8)
    for b in range(BANDS):
        same = np.zeros_like(agree)
        for r in range(b * ROWS, (b + 1) * ROWS):
            same += sig[:, r][:, None] == sig[:, r][None, :]
        agree += same
        if b < band:  # pairs that share an earlier band are compared there
            may &= same < ROWS
    x, y = np.nonzero(np.triu(may & (agree >= LIKELY * REGISTERS), 1))
    order = np.argsort(-agree[x, y].astype(int), kind="stable")
    sets = [restored(h, c) for h, c in zip(g["h"], g["c"], strict=True)]
    parent = list(range(len(names)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    links = []
    for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
        p, q = find(group[i]), find(group[j])
        if p != q and similarity(sets[i], sets[j]) >= THRESHOLD:
            parent[p] = q
            links.append((g["node"].iat[j], g["node"].iat[i]))
    return pd.DataFrame(links, columns=["a", "b"])


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(members, roots)``: per row ``i, node``; per linked word sequence its
    ``node, root``.  Unlinked sequences are their own root."""
    small_batches(docs.sparkSession)
    members = materialize(sign(docs, id_col, text_col), "minhash_signatures")
    nodes = materialize(members.where("node is not null").groupBy("node").agg(F.min("i").alias("rep"), F.max("sig").alias("sig")), "minhash_nodes")
    width = 2 * ROWS
    band = [F.xxhash64(F.lit(k), F.substring("sig", k * width + 1, width)) for k in range(BANDS)]
    bands = nodes.select("node", F.posexplode(F.array(*band)).alias("band", "key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("centre")).where("n > 1")
    buckets = materialize(bands.join(shared, "key"), "minhash_bands")
    pairs = buckets.where(F.col("node") != F.col("centre")).select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    pairs = materialize(likely_pairs(pairs, nodes), "minhash_pairs")
    ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node")))
    links = verified(pairs, shingle_sets(ends, nodes, docs, id_col, text_col))
    roots = materialize(components(links, "minhash_components"), "minhash_roots")
    # bands whose members (three or more: two were compared) are still in several classes
    now = buckets.where("n > 2").join(roots, "node", "left").select("key", "band", "node", "n", F.coalesce("root", "node").alias("root"))
    now = materialize(now, "minhash_classes")
    mixed = now.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
    left = materialize(now.join(mixed, "key").withColumn("cuts", F.ceil(F.col("n") / BLOCK).cast("int")), "minhash_open")
    left = left.withColumn("block", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    sets = shingle_sets(left.select("node"), nodes, docs, id_col, text_col).join(nodes.select("node", "sig"), "node")
    left = left.join(sets, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    left = left.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")}).drop("other", "cuts", "n")
    more = left.groupBy("key", "bi", "bj").applyInPandas(across_classes, "a binary, b binary")
    links = links.unionAll(materialize(more, "minhash_links"))
    return members, materialize(components(links, "minhash_components"), "minhash_roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``class_id`` (smallest id of the class; the row's own id for
    texts without words), ``kept`` (this row's id names the class)."""
    members, roots = classes(docs, id_col, text_col)
    per_node = members.where("node is not null").groupBy("node").agg(F.min("i").alias("low"))
    tagged = per_node.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = tagged.groupBy("root").agg(F.min("low").alias("class_id"))
    named = tagged.join(names, "root").select("node", "class_id")
    out = members.select("i", "node").join(named, "node", "left")
    name = F.coalesce("class_id", "i")
    return out.select(F.col("i").alias(id_col), name.alias("class_id"), F.coalesce(name == F.col("i"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every class: one of its smallest id.  Texts
    without words all stay; so does one row of a class that has no id at all."""
    members, roots = classes(docs, id_col, text_col)
    per_node = members.where("node is not null").groupBy("node").agg(F.min("i").alias("low"))
    tagged = per_node.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    order = F.struct(F.col("low").isNull(), "low", "node")
    own, low = free_name(docs.columns, "_node"), free_name([*docs.columns, id_col], "_low")
    winners = materialize(tagged.groupBy("root").agg(F.min(order).alias("w")).select(F.col("w.node").alias(own), F.col("w.low").alias(low)), "minhash_kept")

    @F.pandas_udf("binary")
    def node_of(texts: pd.Series) -> pd.Series:
        return pd.Series([digest(words_of(t)) for t in texts], dtype=object)

    marked = docs.withColumn(own, node_of(F.col(text_col)))
    named = winners.where(F.col(low).isNotNull()).withColumnRenamed(low, id_col)
    first = join_list(marked.where(F.col(id_col).isNotNull()), named, [id_col, own])
    if not members.where("i is not null and node is not null").groupBy("i", "node").count().where("count > 1").isEmpty():
        first = first.dropDuplicates([id_col, own])
    nameless = marked.where(F.col(id_col).isNull()).join(winners.where(F.col(low).isNull()).select(own), own).dropDuplicates([own])
    # texts without words: only those without a plain letter or digit can be
    alone = docs.where(F.col(text_col).isNull() | ~F.col(text_col).rlike("[A-Za-z0-9]")).withColumn(own, node_of(F.col(text_col))).where(F.col(own).isNull())
    parts = [p.select(*docs.columns) for p in (first, nameless, alone)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])
