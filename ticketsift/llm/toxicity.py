"""Toxic spans and document scores by a linear-chain CRF (operator 5).

Labels are given for documents, so token labels come first: in labelled toxic
documents, tokens with a word or word beginning that is strongly associated
with the label are tagged.  A two-tag linear-chain conditional random field is
trained on them (word and prefix features, transitions) by its exact
forward-backward gradient.  Scoring runs forward-backward over whole texts: most
tokens have no feature, and a run of them is one precomputed power of the same
2 x 2 matrix, so only tokens with features are visited, exactly.  The marginals
give the offending spans and, through a calibrated logistic map, the score.

Fitted on at most ``TRAIN_TOXIC + TRAIN_OTHER`` labelled rows (those smallest by
a hash of the id) of at most ``TRAIN_CHARS`` characters each; all their tokens
train the field.  A text is scored
from its words alone.

Rows: a null text counts as empty, a text without words gets the score of no
evidence; labels other than 0 and 1 are not used, of several labels of an id
the largest; without usable labels of both kinds every score is the smoothed
share of toxic labels (0 without any).  A null id is never held out.  Repeated
rows and extra columns pass through.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import minhash
from .common import free_name, lean, small_batches

#: Bounds of the rows that the model is fitted on.
TRAIN_TOXIC, TRAIN_OTHER, TRAIN_CHARS = 1500, 3000, 20_000
PREFIXES = (3, 4, 5, 6)
#: A feature is kept from this association on; a token is tagged from that precision on.
LEAST_DOCS, LEAST_LOG_ODDS, LEAST_Z, TAG_PRECISION, TAG_Z = 5, 1.0, 3.0, 0.7, 4.0
EPOCHS, RATE, RIDGE, CHUNK = 40, 0.4, 1e-3, 64
#: Chunks whose part of the gradient is taken at once, which bounds its memory.
BLOCK_CHUNKS = 4000
FOLDS = 5
CACHE_WORDS = 300_000
#: Longest run of featureless tokens with a power of its own; longer ones have converged.
LONGEST_RUN = 512
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """The words at the places of WORD, in lower case.  Only a dotted capital I makes
    other words of a text put in lower case as a whole."""
    return [w.lower() for w in WORD.findall(text)] if "\u0130" in text else minhash.words_of(text)


def features_of(word: str) -> list[str]:
    """The word itself and its beginnings (``^abc``)."""
    return [word, *(f"^{word[:k]}" for k in PREFIXES if len(word) > k)]


@dataclass
class ToxicModel:
    """Feature weights (log-odds of the toxic tag), transitions, calibration."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    moves: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))  # from, to; tags other, toxic
    start: np.ndarray = field(default_factory=lambda: np.ones(2))
    calibration: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def __post_init__(self):
        self._cache: dict[str, float] = {}
        plain = np.diag([1.0, np.exp(self.bias)])
        step = plain @ self.moves
        self._before = [np.eye(2)]  # (plain moves)^g: g featureless tokens, then a move
        after = [np.eye(2)]  # (moves plain)^g: a move, then g featureless tokens
        for _ in range(LONGEST_RUN):
            for powers, m in ((self._before, step), (after, self.moves @ plain)):
                nxt = powers[-1] @ m
                powers.append(nxt / nxt.max())
        self._before, self._after = np.array(self._before), np.array(after)

    def to_json(self) -> str:
        return json.dumps({"weights": self.weights, "bias": self.bias, "moves": self.moves.tolist(), "start": self.start.tolist(), "calibration": self.calibration})

    @classmethod
    def from_json(cls, text: str) -> ToxicModel:
        m = json.loads(text)
        return cls(m["weights"], m["bias"], np.array(m["moves"]), np.array(m["start"]), tuple(m["calibration"]))

    def weight(self, word: str) -> float:
        """Sum of a word's feature weights; 0 where it has none."""
        known = self._cache.get(word)
        if known is None:
            if len(self._cache) >= CACHE_WORDS:
                self._cache.clear()
            get = self.weights.get
            known = self._cache[word] = float(np.clip(sum(get(f, 0.0) for f in features_of(word)), -25, 25))
        return known

    def marginals(self, lists: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per document: positions of the tokens with features, and their
        marginal probability of the toxic tag (forward-backward)."""
        places, values = [], []
        for ws in lists:
            w = np.fromiter(map(self.weight, ws), dtype=np.float64, count=len(ws))
            at = np.flatnonzero(w)
            places.append(at)
            values.append(np.exp(w[at] + self.bias))
        order = sorted((d for d in range(len(lists)) if len(places[d])), key=lambda d: -len(places[d]))
        forward = [np.empty((len(p), 2)) for p in places]
        cap = LONGEST_RUN
        size = np.array([len(places[d]) for d in order])
        out = [(p, np.empty(len(p))) for p in places]
        a = b = None
        for t in range(size[0] if len(size) else 0):
            live = order[: int((size > t).sum())]
            emit = np.array([values[d][t] for d in live])
            run = np.array([places[d][t] - (places[d][t - 1] + 1 if t else 0) for d in live])
            power = self._before[np.minimum(run, cap)]
            a = np.tile(self.start, (len(live), 1)) if not t else a[: len(live)] @ self.moves
            a = np.einsum("ni,nij->nj", a, power)
            a[:, 1] *= emit
            a /= a.sum(axis=1, keepdims=True)
            for k, d in enumerate(live):
                forward[d][t] = a[k]
        for t in range((size[0] if len(size) else 0) - 1, -1, -1):
            live = order[: int((size > t).sum())]
            new = np.ones((len(live), 2))
            if b is not None:
                new[: len(b)] = b
            b = new
            # b holds what follows each document's next visited token (or its end)
            run = np.array([(places[d][t + 1] if t + 1 < len(places[d]) else len(lists[d])) - places[d][t] - 1 for d in live])
            last = np.array([t + 1 == len(places[d]) for d in live])
            emit = np.array([1.0 if t + 1 == len(places[d]) else values[d][t + 1] for d in live])
            b[:, 1] *= emit
            tail = np.einsum("nij,nj->ni", self._after[np.minimum(run, cap)], np.ones_like(b))
            inner = np.einsum("nij,nj->ni", self._before[np.minimum(run, cap)], b) @ self.moves.T
            b = np.where(last[:, None], tail, inner)
            b /= b.sum(axis=1, keepdims=True)
            for k, d in enumerate(live):
                both = forward[d][t] * b[k]
                out[d][1][t] = both[1] / both.sum()
        return out

    def evidence(self, lists: list[list[str]]) -> np.ndarray:
        """Two numbers per document: the (log) expected offence and the largest log-odds."""
        rows = np.zeros((len(lists), 2))
        for k, (_, p) in enumerate(self.marginals(lists)):
            p = np.clip(p, 1e-9, 1 - 1e-9)
            rows[k] = np.log1p(-np.log1p(-p).sum()), (np.log(p / (1 - p)).max() if len(p) else -10.0)
        rows[:, 1] = np.clip(rows[:, 1], -10, 10) / 10
        return rows

    def scores(self, lists: list[list[str]]) -> np.ndarray:
        c = self.calibration
        z = c[0] + self.evidence(lists) @ np.array(c[1:])
        return 1 / (1 + np.exp(-z))


def distinct_documents(lists: list[list[str]], labels: list[int]) -> list[int]:
    """Indices of the documents that are no near copy of an earlier one (half of
    their smallest shingles are new), so that one copied text isn't evidence many times."""
    seen: set[int] = set()
    keep = []
    for k, (h, _) in enumerate(minhash.shingles(lists)):
        low = h[:8].tolist()
        if sum(x in seen for x in low) * 2 <= len(low):
            keep.append(k)
        seen.update(low)
    return keep


def choose_features(lists: list[list[str]], labels: list[int]) -> tuple[set[str], set[str]]:
    """``(features, tagging)``: those associated with the label, and those that tag a token."""
    df: tuple[Counter, Counter] = (Counter(), Counter())
    for kind in (1, 0):  # other documents: only what enough toxic ones have
        often = {f for f, n in df[1].items() if n >= LEAST_DOCS}
        for ws, y in zip(lists, labels, strict=True):
            if y == kind:
                found = {f for w in set(ws) for f in features_of(w)}
                df[y].update(found if kind else found & often)
    n0, n1 = labels.count(0), labels.count(1)
    features, tagging = set(), set()
    for f, a in df[1].items():
        if a < LEAST_DOCS:
            continue
        b = df[0].get(f, 0)
        odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
        z = odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (n1 - a + 0.5) + 1 / (n0 - b + 0.5))
        if odds >= LEAST_LOG_ODDS and z >= LEAST_Z:
            features.add(f)
            if z >= TAG_Z and a / n1 / (a / n1 + b / n0) >= TAG_PRECISION:
                tagging.add(f)
    return features, tagging


@dataclass
class Block:
    """Some chunks: which places hold tokens, their tags, and the features of their tokens."""

    real: np.ndarray
    y: np.ndarray
    tok: np.ndarray
    feat: np.ndarray


def blocks_of(lists: list[list[str]], tags: list[list[int]], at: dict[str, int]) -> Iterator[Block]:
    """All chunks of CHUNK tokens, BLOCK_CHUNKS at a time."""
    chunks = ((ws[i : i + CHUNK], ys[i : i + CHUNK]) for ws, ys in zip(lists, tags, strict=True) for i in range(0, len(ws), CHUNK))
    known: dict[str, list[int]] = {}
    while part := list(islice(chunks, BLOCK_CHUNKS)):
        n = len(part)
        real, y = np.zeros((CHUNK, n), dtype=bool), np.zeros((CHUNK, n), dtype=bool)
        tok, feat = [], []
        for k, (ws, ys) in enumerate(part):
            real[: len(ws), k] = True
            y[: len(ws), k] = ys
            for t, w in enumerate(ws):
                ids = known.get(w)
                if ids is None:
                    ids = known[w] = [at[f] for f in features_of(w) if f in at]
                if ids:
                    tok.extend([t * n + k] * len(ids))
                    feat.extend(ids)
        yield Block(real, y, np.array(tok, dtype=np.int32), np.array(feat, dtype=np.int32))


def block_gradient(theta: np.ndarray, size: int, block: Block) -> np.ndarray:
    """Gradient of the negative log-likelihood of a block's chunks (forward-backward)."""
    real, y, tok, feat = block.real, block.y, block.tok, block.feat
    n, pair = real.shape[1], real[1:]
    truth_pairs = np.array([[(pair & (y[:-1] == i) & (y[1:] == j)).sum() for j in (0, 1)] for i in (0, 1)], dtype=float)
    e = theta[size] + np.bincount(tok, theta[feat], minlength=CHUNK * n).reshape(CHUNK, n)
    psi, m, s = np.exp(np.clip(e, -30, 30)), np.exp(theta[size + 1 : size + 5].reshape(2, 2)), np.exp(theta[size + 5 :])
    a = np.empty((CHUNK, n, 2))
    b = np.ones((CHUNK, n, 2))
    for t in range(CHUNK):
        x = np.tile(s, (n, 1)) if not t else a[t - 1] @ m
        x[:, 1] *= psi[t]
        a[t] = x / x.sum(axis=1, keepdims=True)
    for t in range(CHUNK - 2, -1, -1):
        x = b[t + 1].copy()
        x[:, 1] *= psi[t + 1]
        x = x @ m.T
        x /= x.sum(axis=1, keepdims=True)
        b[t] = np.where(real[t + 1][:, None], x, 1.0)
    both = a * b
    p = np.where(real, both[:, :, 1] / both.sum(axis=2), 0.0)
    grad = np.zeros_like(theta)
    off = (p - y) * real
    grad[:size] = np.bincount(feat, off.ravel()[tok], minlength=size)
    grad[size] = off.sum()
    ahead = b[1:].copy()
    ahead[:, :, 1] *= psi[1:]
    xi = a[:-1, :, :, None] * m * ahead[:, :, None, :]
    xi /= xi.sum(axis=(2, 3), keepdims=True)
    grad[size + 1 : size + 5] = (xi[pair].sum(axis=0) - truth_pairs).ravel()
    grad[size + 5 :] = [(1 - p[0]).sum() - (1 - y[0]).sum(), off[0].sum()]
    return grad


def train_crf(lists: list[list[str]], tags: list[list[int]], features: set[str]) -> ToxicModel:
    """Maximum likelihood by AdaGrad over all chunks of CHUNK tokens."""
    names = sorted(features)
    size = len(names)
    blocks = list(blocks_of(lists, tags, {f: k for k, f in enumerate(names)}))
    n = max(1, sum(b.real.shape[1] for b in blocks))
    theta = np.zeros(size + 1 + 4 + 2)  # features, bias, moves, start
    theta[size] = -3.0
    total = np.full_like(theta, 1e-6)
    for _ in range(EPOCHS):
        grad = sum((block_gradient(theta, size, b) for b in blocks), np.zeros_like(theta)) / n + RIDGE * theta
        total += grad**2
        theta -= RATE * grad / np.sqrt(total)
    return ToxicModel(dict(zip(names, theta[:size].tolist(), strict=True)), float(theta[size]), np.exp(theta[size + 1 : size + 5].reshape(2, 2)), np.exp(theta[size + 5 :]))


def calibrate(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float, float]:
    """Weighted logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + 0.1 * beta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        beta -= np.clip(np.linalg.solve(hess, grad), -3, 3)
    return tuple(beta.tolist())


def fit(texts: list[str], labels: list[int], shares: tuple[float, float] = (1.0, 1.0)) -> ToxicModel:
    """A model from labelled texts; ``shares``: which part of the rows of each
    label the sample holds (the calibration undoes it)."""
    lists = [words_of(t) for t in texts]
    n0, n1 = labels.count(0) / shares[0], labels.count(1) / shares[1]
    if not n0 or not n1:
        rate = (n1 + 0.5) / (n0 + n1 + 1) if n0 + n1 else 1e-9
        return ToxicModel(calibration=(float(np.log(rate / (1 - rate))), 0.0, 0.0))
    keep = distinct_documents(lists, labels)
    lists, labels = [lists[k] for k in keep], [labels[k] for k in keep]
    features, tagging = choose_features(lists, labels)
    memo: dict[str, int] = {}

    def tag(w: str) -> int:
        if w not in memo:
            memo[w] = int(any(f in tagging for f in features_of(w)))
        return memo[w]

    tags = [[tag(w) if y else 0 for w in ws] for ws, y in zip(lists, labels, strict=True)]
    model = train_crf(lists, tags, features)
    y = np.array(labels)
    model.calibration = calibrate(model.evidence(lists), y, np.where(y == 1, 1 / shares[1], 1 / shares[0]))
    return model


def held_out(id_col: str) -> Column:
    """Rows that training never sees: one fold of FOLDS by a checksum of the id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicModel:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    small_batches(docs.sparkSession)
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
    marks = marks.where(~held_out(id_col)).withColumn("_h", F.xxhash64(F.lit(5), F.col(id_col)))
    counts = {r["_y"]: r["n"] for r in marks.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    bounds = {0: TRAIN_OTHER, 1: TRAIN_TOXIC}
    picked = [marks.where(F.col("_y") == y).orderBy("_h", id_col).limit(most) for y, most in bounds.items()]
    sample = F.broadcast(picked[0].unionAll(picked[1]).select(F.col(id_col).alias("_id"), "_y"))  # at most the bounds
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).where(F.length("_t") <= TRAIN_CHARS)
    shares = tuple(min(1.0, bounds[y] / max(counts.get(y, 0), 1)) for y in (0, 1))

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat([pd.DataFrame({"_id": [], "_t": [], "_y": []}), *batches]).sort_values(["_id", "_t"])
        yield pd.DataFrame({"model": [fit(got["_t"].tolist(), got["_y"].astype(int).tolist(), shares).to_json()]})

    # the bounded sample is fitted in one task, away from the driver's memory
    model = rows.join(sample, "_id").repartition(1).mapInPandas(lean(fitted), "model string").collect()
    return ToxicModel.from_json(model[0]["model"]) if model else fit([], [], shares)


def score(docs: DataFrame, model: ToxicModel, text_col: str = "text", spans: bool = True, score_col: str = "_score", spans_col: str = "_spans") -> DataFrame:
    """``docs`` with ``_score`` and, with ``spans``, ``_spans`` (names that it does not
    have): start and end (code points, end exclusive) of each word whose marginal is 0.5 or more."""
    small_batches(docs.sparkSession)
    kind = "struct<score: double, spans: array<array<int>>>" if spans else "struct<score: double>"

    def judged_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            texts = [t or "" for t in texts]
            lists = [words_of(t) for t in texts]
            out = pd.DataFrame({"score": model.scores(lists)})
            if spans:
                found = []
                for t, (at, p) in zip(texts, model.marginals(lists), strict=True):
                    bad = set(at[p >= 0.5].tolist())
                    places = [m.span() for m in WORD.finditer(t)] if bad else []
                    found.append([list(places[k]) for k in sorted(bad)])
                out["spans"] = found
            yield out

    @F.pandas_udf(kind)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from lean(judged_batches)(batches)

    own = free_name([*docs.columns, score_col, spans_col], "_judged")
    judged = docs.withColumn(own, judge(F.col(text_col)))
    cols = {score_col: F.col(own)["score"]} | ({spans_col: F.col(own)["spans"]} if spans else {})
    return judged.withColumns(cols).drop(own)
