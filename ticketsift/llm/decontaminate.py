"""Benchmark decontamination by latent semantic retrieval (operator 7).

Documents become numbers of a vocabulary (all words of the benchmark, filled up
with the words most documents share) and are cut into overlapping passages.  A
randomised singular value decomposition of the TF-IDF passages of all documents,
its products summed over Spark partitions, gives a latent space; benchmark passages
and those of all documents are projected into it and compared by cosine.  Of
each candidate a longest common subsequence with the benchmark item is taken,
over stretches not much longer than the item; a document contains the item if
``LCS_SHARE`` of its words are met in order, or ``PARAPHRASE_SHARE`` with
``ANSWER_SHARE`` of its answer (the last sentence).

Words of many documents weigh nothing in the latent space.  Items that are
hidden there, because their words are everyday ones or occur in so many documents
themselves, are searched without it: every stretch of every document that holds
enough words of such an item is compared, so none is missed however often it
occurs (its ``cosine`` is null).

The benchmark is the query set: it is taken in blocks of ``ITEM_BLOCK`` items,
each against all documents.  The decomposition is fitted on the block and all
documents (which together weigh as much as ``CORPUS_DOCS`` of them, so the space
does not drift from the items as the corpus grows); document frequencies and the
search cover all as well.

Rows: null texts and texts without words match nothing, nor do items without
words; a null document id gives rows with a null id; repeated documents give
repeated rows; repeated items are one item; extra columns are not read.  An
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import free_name, join_list, lean, small_batches
from .minhash import words_of

#: A passage is two steps of words; the next one starts a step later.
STEP = 16
DIMENSIONS, EXTRA, POWERS = 192, 24, 2
VOCABULARY, CORPUS_DOCS = 12_000, 3000
#: Words of more documents than this share (and a few) say nothing about a passage.
COMMON, COMMON_DOCS = 0.1, 25
#: Benchmark passages weigh so much more than the documents' in the decomposition,
#: so that the space is spanned by them and shaped by the corpus.
ITEM_WEIGHT = 30.0
ITEM_BLOCK = 400
#: Least cosine inside the latent space, and least cosine with the whole passage
#: relative to that of the item with itself.
COSINE, RELATIVE = 0.6, 0.45
LCS_SHARE, PARAPHRASE_SHARE, ANSWER_SHARE = 0.7, 0.55, 0.8
#: An item is hidden if fewer of its words have a weight, or if rare words beside it in
#: a passage can press its part of the length below this share (RELATIVE and a margin).
LIVE_SHARE, VISIBLE = 0.5, 0.5
SLACK = 1.25
#: Rows of a summed product that travel as one value; each of its partial sums is over
#: about so many words, in SUM_PARTS partitions at least.
SUM_ROWS, SUM_WORDS, SUM_PARTS = 2048, 1 << 24, 4
#: Words that a task counts before it passes the counts on.
COUNTED_WORDS = 200_000
#: Characters whose words are hashed at once, and the odd base of the hash.
GROUP_CHARS, BASE = 1 << 20, 0x9E3779B97F4A7C15


@cache
def letters() -> np.ndarray:
    """Which characters stand in words (those of ``words_of``)."""
    return np.fromiter(map(str.isalnum, map(chr, range(0x110000))), bool, 0x110000)


@lru_cache(2)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2^64."""
    both = [np.cumprod(np.full(size, b, dtype=np.uint64)) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return both[0], both[1]


class HashedWords:
    """The words of several texts by 64-bit polynomial hashes, computed for all characters
    at once: word ``k`` is ``joined[starts[k] : ends[k]]``, text ``t`` has the words from
    ``offsets[t]`` to the next offset."""

    def __init__(self, texts: list[str | None]):
        lower = [(t or "").lower() for t in texts]
        self.joined = "\n".join(["", *lower, ""])
        points = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        inside = letters()[points]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.ends = edges[::2], edges[1::2]
        self.hashes = np.empty(len(self.starts), dtype=np.uint64)
        cuts = [*np.flatnonzero(np.diff(self.starts // GROUP_CHARS, prepend=-1)).tolist(), len(self.starts)]  # a long text in parts
        for a, b in zip(cuts, cuts[1:], strict=False):
            low, high = int(self.starts[a]) - 1, int(self.ends[b - 1])
            up, down = powers(1 << max(20, (high - low).bit_length()))
            sums = np.cumsum(points[low:high] * up[: high - low])
            starts = self.starts[a:b] - low
            self.hashes[a:b] = (sums[self.ends[a:b] - low - 1] - sums[starts - 1]) * down[starts]
        self.offsets = np.searchsorted(self.starts, np.cumsum([1, *(len(t) + 1 for t in lower)]))

    def document_counts(self) -> pa.Table:
        """``w, n``: the words, and in how many of the texts each occurs."""
        found = pa.array(self.hashes).dictionary_encode()
        codes, size = found.indices.to_numpy(), len(found.dictionary)
        count, last, place = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64), np.arange(len(codes))
        for a, b in zip(self.offsets.tolist(), self.offsets[1:].tolist(), strict=False):
            own, at = codes[a:b], place[a:b]
            last[own] = at
            count[own[last[own] == at]] += 1  # each word where it stands last
        words = [self.joined[a:b] for a, b in zip(self.starts[last].tolist(), self.ends[last].tolist(), strict=True)]
        return pa.table({"w": pa.array(words, type=pa.string()), "n": count})


def hashed(texts: list[str | None]) -> Iterator[HashedWords]:
    """The words of the texts, in groups of texts of about GROUP_CHARS characters."""
    at, chars = 0, 0
    for k, t in enumerate(texts):
        chars += len(t or "") + 1
        if chars >= GROUP_CHARS or k == len(texts) - 1:
            yield HashedWords(texts[at : k + 1])
            at, chars = k + 1, 0


class Vocabulary:
    """Word numbers from 1 on; 0 is any other word."""

    def __init__(self, words: list[str]):
        self.at = {w: k + 1 for k, w in enumerate(words)}
        self.size = len(words) + 1
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.hashes = HashedWords(words).hashes

    def numbers(self, texts: list[str | None]) -> list[bytes]:
        """The texts' numbers as bytes of ``kind``."""
        out, own = [], pa.array(self.hashes)
        for group in hashed(texts):
            at = pc.fill_null(pc.index_in(pa.array(group.hashes), value_set=own), -1).to_numpy()
            raw, offsets = (at + 1).astype(self.kind).tobytes(), (group.offsets * self.kind.itemsize).tolist()
            out += [raw[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
        return out

    def writer(self) -> Callable[[str | None], bytes]:
        """A function that gives one text's numbers."""
        return lambda text: self.numbers([text])[0]


#: Words whose vectors are added up at once.
GROUP_WORDS = 1 << 17
#: Passages that are compared with the items at once.
NEAR_ROWS = 1 << 12
#: Rows of a segment that are added one by one, before segments of its parts are summed
#: again, and segments that are added up at once.
SEGMENT, AT_ONCE = 16, 512


def segment_sums(table: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the table's ``rows`` over the segments that begin at ``starts`` (none empty):
    whole rows are added to many segments at once, the first ones, the second ones and so on."""
    sizes = np.diff(starts, append=len(rows))
    if len(sizes) and sizes.max() > SEGMENT:  # long segments in pieces, whose sums are summed
        pieces = -(-sizes // SEGMENT)
        ends = np.cumsum(pieces)
        place = np.arange(ends[-1]) - np.repeat(ends - pieces, pieces)
        return segment_sums(segment_sums(table, rows, np.repeat(starts, pieces) + place * SEGMENT), np.arange(ends[-1]), ends - pieces)
    out = np.empty((len(starts), table.shape[1]), dtype=table.dtype)
    order = np.argsort(-sizes, kind="stable")
    for a in range(0, len(order), AT_ONCE):
        own = order[a : a + AT_ONCE]
        begin, size = starts[own], sizes[own]
        sums = np.take(table, rows[begin], axis=0)
        for k in range(1, size[0]):
            n = np.searchsorted(-size, -k, side="left")  # segments of more than k rows come first
            sums[:n] += np.take(table, rows[begin[:n] + k], axis=0)
        out[own] = sums
    return out


class Passages:
    """The passages of several texts (word numbers), as steps of one long row, so
    that short texts share their array operations and long ones are taken in parts."""

    def __init__(self, texts: list[np.ndarray]):
        lengths = np.array([len(x) for x in texts], dtype=np.int64)
        self.ids = np.concatenate(texts) if texts else np.zeros(0, dtype=np.int64)
        steps = np.maximum(1, -(-lengths // STEP))
        ends = np.cumsum(steps)
        self.n_steps = int(ends[-1]) if len(ends) else 0
        place = np.arange(len(self.ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.step = np.repeat(ends - steps, lengths) + place // STEP
        # a passage is a step and the next one; the last step of a text begins none, unless it is alone
        begins, pair = np.ones(self.n_steps, dtype=bool), np.ones(self.n_steps, dtype=bool)
        begins[ends[steps > 1] - 1] = False
        pair[ends - 1] = False
        self.first = np.flatnonzero(begins)
        self.paired = np.flatnonzero(pair[self.first])
        self.text = np.repeat(np.arange(len(texts)), steps)[self.first]
        self.within = self.first - (ends - steps)[self.text]  # number of the passage in its text

    def _both(self, sums: np.ndarray) -> np.ndarray:
        """Of the steps' sums those of the passages (``sums`` is used up)."""
        alone = np.ones(self.n_steps, dtype=bool)
        alone[self.first[self.paired]] = False
        own = sums[alone]
        sums[:-1] += sums[1:]
        sums[alone] = own
        return sums[self.first]

    def weighted(self, table: np.ndarray, live: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``vectors`` times ``share``, each at the step where it begins (zeros where none
        does), and the steps that are no passage's first of two."""
        weight = np.zeros((self.n_steps, 1), dtype=table.dtype)
        weight[self.first, 0] = share
        out = self.step_sums(table, live)
        alone = np.ones(self.n_steps, dtype=bool)
        alone[self.first[self.paired]] = False
        ends = np.flatnonzero(alone)
        own = out[ends]
        out[:-1] += out[1:]
        out[ends] = own
        out *= weight
        return out, ends

    def gram_steps(self, table: np.ndarray, live: np.ndarray, share: np.ndarray) -> np.ndarray:
        """``spread`` of the ``vectors`` times ``share``."""
        out, ends = self.weighted(table, live, share)
        own = out[ends]
        out[ends] = 0  # no other step holds these
        both = out.copy()
        both[1:] += out[:-1]
        both[ends] += own
        return both

    def vectors(self, table: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Sums of the table's rows over the passages; ``live`` tells which have one."""
        return self._both(self.step_sums(table, live))

    def step_sums(self, table: np.ndarray, live: np.ndarray) -> np.ndarray:
        """The same over the steps."""
        sums = np.zeros((self.n_steps, table.shape[1]), dtype=table.dtype)
        at = np.flatnonzero(live[self.ids])
        for k in range(0, len(at), GROUP_WORDS):
            part = at[k : k + GROUP_WORDS]
            step = self.step[part]
            first = np.flatnonzero(np.diff(step, prepend=-1))
            sums[step[first]] += segment_sums(table, self.ids[part], first)
        return sums

    def lengths(self, squares: np.ndarray) -> np.ndarray:
        """Square root of the sums of one number a word over the passages."""
        return np.sqrt(self._both(np.bincount(self.step, weights=squares[self.ids], minlength=self.n_steps)))

    def spread(self, rows: np.ndarray) -> np.ndarray:
        """Per step the sum of the rows of the passages that hold it."""
        out = np.zeros((self.n_steps, rows.shape[1]), dtype=rows.dtype)
        out[self.first] = rows
        out[self.first[self.paired] + 1] += rows[self.paired]
        return out


def grouped(texts: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The texts in groups of about GROUP_WORDS words, with the place of the first one."""
    at, words = 0, 0
    for k, x in enumerate(texts):
        words += len(x)
        if words >= GROUP_WORDS:
            yield at, texts[at : k + 1]
            at, words = k + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def passage_vectors(ids: np.ndarray, table: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Sums of the table's rows over passages: step k and step k + 1.  ``live``
    tells which numbers have a row other than zeros."""
    steps = max(1, -(-len(ids) // STEP))
    sums = np.zeros((steps, table.shape[1]), dtype=table.dtype)
    at = np.flatnonzero(live[ids])
    if len(at):
        step = at // STEP
        first = np.flatnonzero(np.diff(step, prepend=-1))
        sums[step[first]] = np.add.reduceat(table[ids[at]], first, axis=0)
    return sums[:-1] + sums[1:] if steps > 1 else sums


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def gram_product(texts: list[np.ndarray] | np.ndarray, weight: float, tables: tuple[np.ndarray, np.ndarray, np.ndarray], out: np.ndarray) -> None:
    """Add ``A' A q`` of texts' (or one text's) TF-IDF passages (unit rows, weighted) to
    ``out``; tables: idf, its square (a column) and the rows of ``q`` times idf."""
    idf, squares, weighted = tables
    live = idf > 0
    for _, group in grouped([texts] if isinstance(texts, np.ndarray) else texts):
        own = Passages(group)
        at = np.flatnonzero(live[own.ids])
        if not len(at):
            continue
        size = own.lengths(squares[:, 0]) ** 2
        share = np.divide(weight**2, size, out=np.zeros_like(size), where=size > 0)
        per_step = own.gram_steps(weighted, live, share)
        ids = own.ids[at]
        order = np.argsort(ids, kind="stable")
        found, first = np.unique(ids[order], return_index=True)
        out[found] += segment_sums(per_step, own.step[at[order]], first) * idf[found][:, None]


def inner_product(texts: list[np.ndarray], weight: float, tables: tuple[np.ndarray, np.ndarray, np.ndarray], out: np.ndarray) -> None:
    """Add ``q' A' A q`` to ``out``, arguments as of ``gram_product``: the products of the
    passages' own vectors, so nothing is spread over the vocabulary."""
    idf, squares, weighted = tables
    for _, group in grouped(texts):
        own = Passages(group)
        size = own.lengths(squares[:, 0])
        share = np.divide(weight, size, out=np.zeros_like(size), where=size > 0)
        rows = own.weighted(weighted, idf > 0, share)[0]
        out += rows.T @ rows


def gram(docs: DataFrame, weight: float, items: list[np.ndarray], idf: np.ndarray, q: np.ndarray, kind: np.dtype, product: Callable = gram_product) -> np.ndarray:
    """``A' A q`` (or the other ``product``) over all documents (summed by Spark) and the items."""
    tables = (idf, (idf**2)[:, None], q * idf[:, None])
    shared = docs.sparkSession.sparkContext.broadcast(tables)  # vocabulary x dimensions, both fixed
    size = q.shape if product is gram_product else (q.shape[1], q.shape[1])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = shared.value
        out = np.zeros(size, dtype=np.float32)
        for b in batches:
            product([np.frombuffer(x, dtype=kind) for x in b["w"]], weight, tables, out)
        for k in range(0, size[0], SUM_ROWS):
            yield pd.DataFrame({"at": [k], "v": [out[k : k + SUM_ROWS].tobytes()]})

    def total(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for g in groups:
            for k, x in zip(g["at"], g["v"], strict=True):
                v = np.frombuffer(x, dtype=np.float32)
                sums[k] = sums[k] + v if k in sums else v.astype(np.float64)
        for k, v in sums.items():
            yield pd.DataFrame({"at": [k], "v": [v.astype(np.float32).tobytes()]})

    out = np.zeros(size, dtype=np.float32)
    for r in docs.select("w").mapInPandas(lean(partial), "at long, v binary").repartition("at").mapInPandas(lean(total), "at long, v binary").collect():
        v = np.frombuffer(r["v"], dtype=np.float32).reshape(-1, size[1])
        out[r["at"] : r["at"] + len(v)] = v
    shared.destroy()
    product(items, ITEM_WEIGHT, tables, out)
    return out


def latent_space(docs: DataFrame, weight: float, items: list[np.ndarray], idf: np.ndarray, kind: np.dtype) -> np.ndarray:
    """IDF-weighted right singular vectors, a row per vocabulary number (randomised
    SVD: a random start, POWERS products with orthogonalisation, a small exact one)."""
    width = min(DIMENSIONS + EXTRA, len(idf))
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((len(idf), width), dtype=np.float32))[0]
    for _ in range(POWERS):
        q = np.linalg.qr(gram(docs, weight, items, idf, q, kind))[0].astype(np.float32)
    inner = gram(docs, weight, items, idf, q, kind, inner_product)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    best = np.argsort(-values)[:DIMENSIONS]
    return (q @ vectors[:, best].astype(np.float32)) * idf[:, None]


def lcs(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence (bit-parallel); number 0 matches nothing."""
    where: dict[int, int] = {}
    for k, w in enumerate(item):
        if w:
            where[w] = where.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    row = full
    for w in text:
        hit = row & where.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(item) - row.bit_count()


def best_stretch(item: list[int], text: list[int], low: int, high: int) -> tuple[int, int, int]:
    """Largest LCS with a stretch of the text near words ``low .. high`` (and where)."""
    size = stretch_words(item)
    hop = max(1, (size - len(item)) or 1)
    best = (0, 0, 0)
    start = max(0, low - len(item))
    while True:
        part = text[start : start + size]
        n = lcs(item, part)
        if n > best[0]:
            best = (n, start, start + len(part))
        start += hop
        if start >= min(high, len(text)):
            return best


def stretch_words(item: list[int] | np.ndarray) -> int:
    """Words of the stretches that an item is compared with."""
    return int(len(item) * SLACK) + 2


def is_hidden(item: np.ndarray, squares: np.ndarray, other: float) -> bool:
    """Whether the latent search may miss an item wherever it stands."""
    own = squares[item, 0]
    if (own > 0).mean() < LIVE_SHARE:
        return True
    n = len(item)
    inside = n if n <= STEP + 1 else min(2 * STEP, (n + STEP) / 2)  # words of it in the passage that holds most
    weight, beside = own.mean() * inside, max(0.0, 2 * STEP - inside) * other**2
    return weight < VISIBLE**2 * (weight + beside)


class HiddenItems:
    """Items that are searched by counting their words in every stretch."""

    def __init__(self, which: list[int], items: list[np.ndarray], size: int):
        self.which = which
        self.need = np.array([-(-int(PARAPHRASE_SHARE * 1000) * len(items[k]) // 1000) for k in which])
        self.stretch = np.array([stretch_words(items[k]) for k in which])
        self.times = np.zeros((size, len(which)), dtype=np.float32)  # occurrences of a word in an item
        for c, k in enumerate(which):
            np.add.at(self.times[:, c], items[k], 1)
        self.some = self.times.any(axis=1)
        self.own = np.cumsum(self.some) - 1  # the items' words, numbered anew
        self.times = self.times[self.some]
        self.holds = np.ascontiguousarray(self.times.T > 0)

    def regions(self, texts: list[np.ndarray]) -> dict[int, list[tuple[int, int, int]]]:
        """Per text that may hold items: items and the regions (first word, end) in which
        stretches hold enough of their words."""
        out: dict[int, list[tuple[int, int, int]]] = {}
        if not self.which or not texts:
            return out
        lengths, ids = np.array(list(map(len, texts))), np.concatenate(texts)
        some = np.flatnonzero(self.some[ids])
        text, word = np.repeat(np.arange(len(texts)), lengths)[some], self.own[ids[some]]
        present = np.zeros((len(texts), len(self.times)), dtype=np.float32)
        present[text, word] = 1
        enough = present @ self.times >= self.need  # whole numbers, far below those that lose digits
        # the texts one after the other, so far apart that no stretch reaches over two
        gap = int(self.stretch.max())
        begin, place = np.cumsum(lengths + gap) - lengths - gap, some + text * gap
        for c in np.flatnonzero(enough.any(axis=0)).tolist():
            hit = np.flatnonzero(self.holds[c][word])
            at, size, others = place[hit], int(self.stretch[c]), max(0, int(self.need[c]) - 1)
            first = hit[np.flatnonzero(at[others:] - at[: max(0, len(at) - others)] < size)]  # the last word that is needed stands in the stretch as well
            first = first[enough[text[first], c]]
            if len(first):
                for part in np.split(first, np.flatnonzero(np.diff(place[first]) > size) + 1):
                    k = int(text[part[0]])
                    out.setdefault(k, []).append((self.which[c], int(place[part[0]] - begin[k]), int(place[part[-1]] - begin[k]) + size))
        return out


class Space:
    """The latent space with the benchmark passages in it."""

    def __init__(self, space: np.ndarray, idf: np.ndarray, other: float, items: list[np.ndarray]):
        self.table = space
        self.live = np.abs(space).max(axis=1) > 0
        squares = idf.astype(np.float32) ** 2
        squares[0] = other**2  # words outside the vocabulary are rare ones
        self.squares, self.weighs = squares[:, None], squares > 0
        parts = [passage_vectors(x, space, self.live) for x in items]
        norms = [np.sqrt(passage_vectors(x, self.squares, self.weighs))[:, 0] for x in items]
        of_item = np.repeat(np.arange(len(items)), [len(p) for p in parts])
        p, n = (np.concatenate(parts), np.concatenate(norms)) if parts else (np.zeros((0, space.shape[1])), np.zeros(0))
        size = np.linalg.norm(p, axis=1)
        some = size > 0  # the others are hidden or have a passage that is not
        self.hidden = HiddenItems([k for k, x in enumerate(items) if is_hidden(x, self.squares, other)], items, len(space))
        self.queries, self.of_item, self.captured = unit(p[some]).astype(np.float32), of_item[some], (size[some] / n[some]).astype(np.float32)

    def candidates(self, texts: list[np.ndarray]) -> dict[int, list[tuple[int, int, float]]]:
        """Per text that may hold items: passage, item and latent cosine."""
        out: dict[int, list[tuple[int, int, float]]] = {}
        if not len(self.queries):
            return out
        for base, group in grouped(texts):
            own = Passages(group)
            latent = own.vectors(self.table, self.live)
            whole, size = own.lengths(self.squares[:, 0]), np.linalg.norm(latent, axis=1)
            ratio = np.divide(size, whole, out=np.zeros_like(size), where=whole > 0)
            near = np.flatnonzero((ratio >= RELATIVE * self.captured.min()) & (ratio > 0))  # others cannot reach RELATIVE
            for a in range(0, len(near), NEAR_ROWS):
                part = near[a : a + NEAR_ROWS]
                cosine = (latent[part] / size[part, None]) @ self.queries.T
                k, q = np.nonzero(cosine >= COSINE)
                c = cosine[k, q]
                enough = c * ratio[part[k]] >= RELATIVE * self.captured[q]
                for p, i, v in zip(part[k[enough]], q[enough], c[enough], strict=True):
                    out.setdefault(base + int(own.text[p]), []).append((int(own.within[p]), int(self.of_item[i]), float(v)))
        return out


def matches(ids: np.ndarray, near: list[tuple[int, int, float]], hidden: list[tuple[int, int, int]], space: Space, items: list[np.ndarray], answers: list[np.ndarray]) -> list[tuple[int, float | None, float, float, int, int]]:
    """Items that a text contains: item, cosine, LCS share, answer share, first and last
    word; ``near``: its candidates from the latent space; ``hidden``: the regions of hidden items."""
    if not near and not hidden:
        return []
    found, text = [], ids.tolist()
    spans: dict[int, list[list]] = {}
    for p, i, c in sorted(near):
        own = spans.setdefault(i, [])
        low, high = p * STEP, (p + 2) * STEP
        if own and low <= own[-1][1]:
            own[-1][1], own[-1][2] = max(own[-1][1], high), max(own[-1][2], c)
        else:
            own.append([low, high, c])
    for i, low, high in hidden:
        spans.setdefault(i, []).append([low, high, None])
    for i, regions in spans.items():
        item, answer = items[i].tolist(), answers[i].tolist()
        for low, high, c in regions:
            present = set(text[max(0, low - len(item)) : high + 2 * len(item)])
            if sum(w in present for w in item) < PARAPHRASE_SHARE * len(item):
                continue  # no stretch can reach the share
            n, a, b = best_stretch(item, text, low, high)
            share = n / len(item)
            if share < PARAPHRASE_SHARE:
                continue
            answered = lcs(answer, text[a : b + len(answer)]) / len(answer)
            if share >= LCS_SHARE or answered >= ANSWER_SHARE:
                found.append((i, c, share, answered, a, b))
                break
    return found


def item_rows(benchmark: DataFrame, id_col: str, text_col: str, block: int, blocks: int) -> list[tuple[int, list[str], list[str]]]:
    """Items of one block (at most about ITEM_BLOCK): id, words, words of the answer."""
    own = benchmark.where(F.col(id_col).isNotNull() & (F.pmod(F.xxhash64(id_col), F.lit(blocks)) == block)).select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("t")).distinct()
    out = []
    for i, t in sorted((r[0], r[1]) for r in own.collect()):
        sentences = [ws for ws in map(words_of, re.split(r"[.!?]\s|\n", t)) if ws]
        if sentences:
            out.append((i, words_of(t), sentences[-1]))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row per document and benchmark item that it contains: ids, ``cosine``
    (null where the item was found without the latent space), ``lcs_share``, ``answer_share``, ``first_word``, ``last_word`` (exclusive)."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    found = search(texts, benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("t")), ["i"])
    return found.withColumnRenamed("i", id_col).withColumnRenamed("item_id", item_col)


def added(tables: list[pa.Table]) -> pa.Table:
    """Counts ``w, n``, added up by word."""
    out = pa.concat_tables(tables).group_by("w", use_threads=False).aggregate([("n", "sum")])
    return pa.table({"w": out["w"], "n": out["n_sum"]})


def word_counts(texts: DataFrame) -> DataFrame:
    """``w, n``: in how many of all texts ``t`` each word occurs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            held += [group.document_counts() for group in hashed(b.column(0).to_pylist())]
            if sum(map(len, held)) > 4 * COUNTED_WORDS:
                held = [added(held)]
                if len(held[0]) > COUNTED_WORDS:
                    yield from held.pop().to_batches(COUNTED_WORDS)
        if held:
            yield from added(held).to_batches(COUNTED_WORDS)

    counted = texts.select("t").mapInArrow(lean(rows), "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return materialize(counted, "word_counts")


def search(texts: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """Matches of the texts ``t``, with their columns ``keep``."""
    spark = texts.sparkSession
    n_items, n_docs = benchmark.count(), texts.count()
    blocks = max(1, -(-n_items // ITEM_BLOCK))
    types = dict(texts.dtypes) | dict(benchmark.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in keep) + f", item_id {types['item_id']}, cosine double, lcs_share double, answer_share double, first_word long, last_word long"
    out = spark.createDataFrame([], schema)
    counts = word_counts(texts)
    common = {r["w"]: r["n"] for r in counts.orderBy(F.desc("n"), "w").limit(VOCABULARY).collect()}
    for block in range(blocks):
        rows = item_rows(benchmark, "item_id", "t", block, blocks)
        if rows:
            out = out.unionAll(_search_block(texts, rows, counts, common, n_docs, keep, schema))
    return out


def _search_block(texts: DataFrame, rows: list[tuple[int, list[str], list[str]]], counts: DataFrame, common: dict[str, int], n_docs: int, keep: list[str], schema: str) -> DataFrame:
    spark = texts.sparkSession
    own = sorted({w for _, ws, _ in rows for w in ws})
    known = set(own)
    vocabulary = Vocabulary(own + [w for w in common if w not in known][: max(0, VOCABULARY - len(own))])
    kind, size = vocabulary.kind, vocabulary.size
    shared = spark.sparkContext.broadcast(vocabulary)  # the block's words and VOCABULARY more at most

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["w"] = shared.value.numbers(b["t"].tolist())
            yield b[[*keep, "w"]]

    types = dict(texts.dtypes)
    head = ", ".join(f"{c} {types[c]}" for c in keep)
    docs = materialize(texts.select(*keep, "t").mapInPandas(lean(numbers), f"{head}, w binary"), "latent_words")
    shared.destroy()
    # the vocabulary's document frequencies, in all documents
    df = common | {r["w"]: r["n"] for r in counts.join(F.broadcast(spark.createDataFrame([(w,) for w in own], "w string")), "w").collect()}
    idf = np.full(size, np.log1p(n_docs), dtype=np.float32)
    for w, k in vocabulary.at.items():
        if w in df:
            idf[k] = np.log((n_docs + 1) / (df[w] + 1)) + 1e-3
    idf[idf < np.log((n_docs + 1) / (COMMON * n_docs + COMMON_DOCS))] = 0.0
    idf[0] = 0.0  # other words have no place in the space
    items = [np.array([vocabulary.at[w] for w in ws], dtype=np.int64) for _, ws, _ in rows]
    answers = [np.array([vocabulary.at[w] for w in ws], dtype=np.int64) for _, _, ws in rows]
    # all documents in partitions of many words: each sends one dense product
    words = docs.agg(F.coalesce(F.sum(F.octet_length("w")), F.lit(0))).first()[0] // kind.itemsize
    parts = docs.select("w").coalesce(max(SUM_PARTS, -(-words // SUM_WORDS)))
    weight = min(1.0, CORPUS_DOCS / max(n_docs, 1)) ** 0.5
    space = Space(latent_space(parts, weight, items, idf, kind), idf, float(np.log(n_docs + 1)), items)
    names = [i for i, _, _ in rows]
    model = spark.sparkContext.broadcast((space, items, answers, names))  # bounded by the block and the vocabulary

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, items, answers, names = model.value
        columns = [*keep, "item_id", "cosine", "lcs_share", "answer_share", "first_word", "last_word"]
        for b in batches:
            got = []
            texts = [np.frombuffer(x, dtype=kind) for x in b["w"]]
            keys = list(b[keep].itertuples(index=False, name=None))
            near = space.candidates(texts)
            hidden = space.hidden.regions(texts)
            for k in sorted(near.keys() | hidden.keys()):
                for i, *rest in matches(texts[k], near.get(k, []), hidden.get(k, []), space, items, answers):
                    got.append((*(None if pd.isna(v) else v for v in keys[k]), names[i], *rest))
            if got:
                yield pd.DataFrame(got, columns=columns).astype({"cosine": "float64"})

    return docs.select(*keep, "w").mapInPandas(lean(find), schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the documents whose text contains a benchmark item."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h1"), F.xxhash64(F.lit(7), text_col).alias("h2"))
    found = search(texts, benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("t")), ["h1", "h2"])
    bad = materialize(found.select("h1", "h2").distinct(), "contaminated")
    h1, h2 = free_name(docs.columns, "_h1"), free_name(docs.columns, "_h2")
    tagged = docs.withColumns({h1: F.xxhash64(text_col), h2: F.xxhash64(F.lit(7), text_col)})
    return join_list(tagged, bad.toDF(h1, h2), [h1, h2], "left_anti").select(*docs.columns)
