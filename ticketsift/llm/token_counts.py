"""Token counts at every prefix of a text (operator 3).

Byte-pair encoding never lets a merge cross a pre-token border, and inside a
pre-token the encoding of a prefix is fixed by its last token: the encoding of
``w[:i]`` is the encoding of ``w[:j]`` plus the token ``w[j:i]`` for the one
``j`` at which the two tokens stay apart when encoded together.  So one
left-to-right dynamic program over a pre-token gives the count of each of its
prefixes.  A document's counts are the running sum of its pre-tokens' steps,
written as one small integer per character, compressed: the number of tokens of
any prefix, or the longest prefix within a budget, is then read off that table
without encoding again (``count_store`` writes it, ``answers`` reads it).

Rows: a null text counts as empty (0 bytes, 0 tokens); a null id stays null;
repeated rows each give a row; extra columns are not read.  An empty table gives
an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import materialize
from .common import hold, lean, small_batches

#: Pre-tokens whose steps a worker remembers in each of two generations: when the young one
#: is full it becomes the old one, and what is met again moves to the next young one.
CACHE_WORDS = 500_000
#: Word beginnings whose last token and count a worker remembers at most.
STATES = 800_000

# --- fixed values: the pre-token rule of byte-level vocabularies ---------------
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
PRETOKEN = r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^ \t-\rA-Za-z0-9À-ÖØ-öø-ÿ]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
# ------------------------------------------------------------------------------
#: Texts with characters beyond these (ASCII and Latin-1 letters and signs) are cut into pre-tokens by the library.
FAMILIAR = r"[^\x00-\x7e¡-©«-±¶-¸»¿-ÿ]"
BLANK = re.compile(r"[ \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+").fullmatch
TWO_BLANKS = re.compile(r"[ \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2}").search
#: Rank of a merge that never comes.
NEVER = 1 << 40


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file:
    itself where it is printable Latin-1, else the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, free = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(free)
            free += 1
    return [table[b] for b in range(256)]


class PrefixCounter:
    """Exact prefix token counts for one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: k for k, m in enumerate(merges)}
        self.vocab = set(model["vocab"])
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.findall = re.compile(PRETOKEN).findall
        self.foreign = re.compile(FAMILIAR).search
        self.special_split = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.pre_tokenizer = Tokenizer.from_file(path).pre_tokenizer
        self.spine: dict[str, tuple[list, list] | None] = {}
        self.states: dict[str, tuple[int, str]] = {}
        self.apart: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: length of the longest token by its last two characters
        self.reach: dict[str, int] = {}
        for token in self.vocab:
            self.reach[token[-2:]] = max(len(token), self.reach.get(token[-2:], 1))

    def _spines(self, token: str) -> tuple[list, list] | None:
        """How plain byte-pair encoding builds a token: the parts at its right
        and its left edge, smallest first, each with the merge rank that ends
        it (none for the token itself).  None if the string isn't one token."""
        parts = [(c, None) for c in token]
        rank = self.rank
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: rank.get((parts[k][0], parts[k + 1][0]), NEVER))
            left, right = parts[best], parts[best + 1]
            if (left[0], right[0]) not in rank:
                return None
            parts[best : best + 2] = [(left[0] + right[0], (left, right, rank[left[0], right[0]]))]
        edges = []
        for side in (1, 0):
            node, ends, spine = parts[0], NEVER, []
            while node:
                spine.append((node[0], ends))
                node, ends = (node[1][side], node[1][2]) if node[1] else (None, 0)
            edges.append(spine[::-1])
        return edges[0], edges[1]

    def _stay_apart(self, left: str, right: str) -> bool:
        """Whether two tokens side by side are what their bytes encode to: at no
        time does a merge across the border outrank the merges that are still to
        come at either side of it.  ``left`` empty: whether ``right`` is a token."""
        key = (left, right)
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > 2 * CACHE_WORDS:
                self.apart.clear()
            known = self.apart[key] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: str, right: str) -> bool:
        for token in (left, right):
            if token and token not in self.spine:
                self.spine[token] = self._spines(token)
        if self.spine[right] is None or not left:
            return self.spine[right] is not None
        a, b, i, j = self.spine[left][0], self.spine[right][1], 0, 0
        while True:
            (p, p_ends), (q, q_ends) = a[i], b[j]
            cross = self.rank.get((p, q), NEVER)
            if cross < p_ends and cross <= q_ends and cross < NEVER:
                return False
            if p_ends == q_ends == NEVER:
                return True
            if p_ends <= q_ends:
                i += 1
            else:
                j += 1

    def prefix_counts(self, mapped: str) -> list[int]:
        """Token count of ``mapped[:i]`` for i = 0 .. len, by the prefix program."""
        n, vocab, known, apart, reach, states = len(mapped), self.vocab, self.apart.get, self._stay_apart, self.reach.get, self.states
        count, last = [0] * (n + 1), [""] * (n + 1)
        if len(states) > STATES:
            states.clear()
        for i in range(1, n + 1):
            prefix = mapped[:i] if i <= 24 else ""
            if (seen := states.get(prefix)) is not None:  # another pre-token began like this
                count[i], last[i] = seen
                continue
            most = reach(mapped[i - 2 : i], 1) if i > 1 else 1
            for j in range(i - most if i > most else 0, i):
                token = mapped[j:i]
                if token in vocab:
                    pair = (last[j], token)
                    if (fits := known(pair)) is None:
                        fits = apart(*pair)
                    if fits:
                        count[i], last[i] = count[j] + 1, token
                        break
            else:
                raise ValueError("the vocabulary lacks a single byte")
            if prefix:
                states[prefix] = (count[i], token)
        return count

    def _steps(self, word: str) -> bytes:
        """Per character of a pre-token: by how much its prefix count changes."""
        if len(self.cache) >= CACHE_WORDS:
            self.cache, self.old = {}, self.cache
        if (out := self.cache.get(word) or self.old.get(word)) is not None:
            self.cache[word] = out
            return out
        raw = word.encode("utf-8", "replace")
        mapped = raw.decode("latin-1").translate(self.alphabet)
        count = self.prefix_counts(mapped)
        if word in CONTRACTIONS:  # a cut contraction is an apostrophe and a letter run
            letters = [self.prefix_counts(word[1:k])[-1] for k in range(2, len(word))]
            at = [0, 1, *[1 + x for x in letters], count[-1]]
        elif len(raw) == len(word):
            at = count
        else:
            at = [0, *[count[i] for i in range(1, len(raw)) if raw[i] & 0xC0 != 0x80], count[-1]]
        out = array("h", [b - a for a, b in zip(at, at[1:], strict=False)]).tobytes()
        if len(word) <= 64:
            self.cache[word] = out
        return out

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings.  Python's and the
        library's Unicode tables differ in rare scripts: a text with characters
        beyond the familiar ones is cut by the library."""
        if self.foreign(text):
            return [text[a:b] for _, (a, b) in self.pre_tokenizer.pre_tokenize_str(text)]
        return self.findall(text)

    def _segment(self, text: str) -> tuple[bytes, list[str]]:
        words, known, steps = self.words(text), self.cache.get, self._steps
        out = b"".join([known(w) or steps(w) for w in words])
        if TWO_BLANKS(text):
            out = self._space_runs(out, words)
        return out, words

    def _space_runs(self, out: bytes, words: list[str]) -> bytes:
        """The last blank of a blank run opens the next pre-token in the whole
        text, but a prefix that ends with it holds the run in one piece."""
        step = np.frombuffer(out, dtype="<i2").astype(np.int64)
        end = 0
        for left, right in zip(words, words[1:], strict=False):
            end += len(left)
            if BLANK(left) and BLANK(right[0]):
                run = left + right[0]
                whole = int(np.frombuffer(self.cache.get(run) or self._steps(run), dtype="<i2").sum())
                change = whole - int(np.frombuffer(self.cache.get(left) or self._steps(left), dtype="<i2").sum()) - int(step[end])
                step[end] += change
                if end + 1 < len(step):
                    step[end + 1] -= change
        return step.astype("<i2").tobytes()

    def steps(self, text: str) -> np.ndarray:
        """Change of the token count at each character; its running sum at p is
        the count the library gives for ``text[:p]``."""
        if not text:
            return np.zeros(0, dtype=np.int16)
        if not self.special_split or not any(s in text for s in self.specials):
            return np.frombuffer(self._segment(text)[0], dtype="<i2")
        pieces, at = [], 0
        for m in self.special_split.finditer(text):
            out, words = self._segment(text[at : m.start()])
            pieces.append(np.frombuffer(out, dtype="<i2"))
            # prefixes that end inside the special string see it as plain text
            tail = "".join(words[-2:])
            before = int(self.steps(tail).sum())
            counts = [int(self.steps(tail + m[0][:k]).sum()) - before for k in range(1, len(m[0]))]
            pieces.append(np.diff(np.asarray([0, *counts, 1])).astype("<i2"))
            at = m.end()
        pieces.append(np.frombuffer(self._segment(text[at:])[0], dtype="<i2"))
        return np.concatenate(pieces)


def counter(path: str) -> PrefixCounter:
    return hold(("prefix counter", path), lambda: PrefixCounter(path))


def pack_steps(steps: np.ndarray) -> bytes:
    return zlib.compress(np.asarray(steps, dtype="<i2").tobytes(), 1)


def unpack_counts(store: bytes) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, 2 ... characters."""
    steps = np.frombuffer(zlib.decompress(store), dtype="<i2")
    counts = np.zeros(len(steps) + 1, dtype=np.int64)
    np.cumsum(steps, out=counts[1:])
    return counts


def tokens_at(store: bytes, chars: int) -> int:
    """Truncation question: tokens of the first ``chars`` characters."""
    counts = unpack_counts(store)
    return int(counts[min(max(chars, 0), len(counts) - 1)])


def chars_within(store: bytes, budget: int) -> int:
    """Budget question: the longest prefix, in characters, of at most ``budget`` tokens."""
    return int(np.flatnonzero(unpack_counts(store) <= max(budget, 0))[-1])


def count_store(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written store: per row its id, ``n_bytes`` and ``prefix`` (the count at
    every prefix, see ``unpack_counts``).  Texts are encoded here and never again."""
    small_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(path)
        for b in batches:
            texts = [t or "" for t in b["t"]]
            sizes = [len(t.encode("utf-8", "replace")) for t in texts]
            yield pd.DataFrame({"i": b["i"], "n_bytes": sizes, "prefix": [pack_steps(c.steps(t)) for t in texts]})

    rows = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    store = materialize(rows.mapInPandas(lean(count, keeps=True), f"i {id_type}, n_bytes long, prefix binary"), "prefix_counts")
    return store.withColumnRenamed("i", id_col)


def answers(store: DataFrame, limit: int) -> DataFrame:
    """Both questions, read off a store: ``n_tokens`` (of the whole text) and
    ``cut_chars`` (its longest prefix of at most ``limit`` tokens)."""

    @F.pandas_udf("n_tokens long, cut_chars long")
    def read(prefix: pd.Series) -> pd.DataFrame:
        out = []
        for p in prefix:
            counts = unpack_counts(p)
            within = len(counts) - 1 if counts[-1] <= limit else int(np.flatnonzero(counts <= limit)[-1])
            out.append((int(counts[-1]), within))
        return pd.DataFrame(out, columns=["n_tokens", "cut_chars"])

    return store.select("*", read("prefix").alias("_read")).select(*store.columns, "_read.n_tokens", "_read.cut_chars")


def prefix_counts(df: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``n_bytes``, ``prefix``, ``n_tokens`` and ``cut_chars`` (see ``answers``)."""
    return answers(count_store(df, path, id_col, text_col), limit)
