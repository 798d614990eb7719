"""Secret scans by character Markov models (operator 10), in DataFrame functions.

Two first-order character models, of random strings and of ordinary
identifiers, are counted from labelled samples; a candidate token is a secret
when the log-likelihood ratio of its transitions reaches ``MIN_LLR``.  These
spans are added to the three fixed base kinds and never replace them: a token
that overlaps a base span is left to it.

Positions are code points, ends exclusive.  They come from the pieces between
the matches (``split``) and the matches themselves (``regexp_extract_all``), so
a scan is one projection over whole texts: no shuffle, no Python.

Rows: a null text counts as empty (no spans); null ids, repeated rows and extra
columns pass through untouched.  An empty sample gives models without a
preference (no token reaches ``MIN_LLR``).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

# --- fixed values: the base kinds, in their order ------------------------------
KINDS = ("assign", "access", "hex", "markov")
KEY_WORDS = ("password", "passwd", "secret", "token", "api_?key")
VALUE = r"[A-Za-z0-9+/_.=-]+"
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # AKIA and what follows, 18 characters or more
HEX = r"[0-9a-f]{16,}"
# ------------------------------------------------------------------------------
#: Shortest token the models judge, and the ratio (in nats) that makes it a secret.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
MIN_LLR = 12.0
#: The models are fitted on about so many documents and generated random strings.
SAMPLE_DOCS, SAMPLE_RANDOM = 4000, 3000
NAME_WEIGHT = 8
ALPHABET = [chr(c) for c in range(33, 127)]
SMOOTHING = 0.5
REDACTED = "[SECRET]"
#: Places that are summed up one by one, and code points of a block that a text is cut into.
WIDTH, PIECE = 32, 4096


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = f"({'|'.join(map(either_case, KEY_WORDS))})[\"']?\\x20*[:=]\\x20*[\"']?({VALUE})"


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once (a name in a lambda: what is
    written out inside a lambda is computed for every element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def before(values: Column, joined: Callable[[Column], Column], add: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """Per place of a non-empty array (a lambda's name) the joined values of all places
    before it.  Blocks of WIDTH are joined first and the same is done with their
    results, so the work is about WIDTH / 2 steps a place and not one for each pair;
    ``joined`` of an empty array must be neutral to ``add``."""
    if not levels:
        return F.transform(values, lambda _, i: joined(F.slice(values, 1, i)))
    blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / WIDTH).cast("int"))
    whole = F.transform(blocks, lambda k: joined(F.slice(values, k * WIDTH + 1, WIDTH)))
    place = lambda up: F.transform(values, lambda _, i: add(F.get(up, F.floor(i / WIDTH).cast("int")), joined(F.slice(values, i - i % WIDTH + 1, i % WIDTH))))
    return let(whole, lambda w: let(before(w, joined, add, levels - 1), place))


def sums_before(values: Column) -> Column:
    return before(values, _total, lambda a, b: a + b)


SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def match_spans(text: Column, pattern: str, kind: int) -> Column:
    """All leftmost non-overlapping matches as ``array<struct<start, kind, end>>``."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m).cast("long"))
    between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("long"))

    def placed(f: Column, g: Column) -> Column:
        span = lambda sums: F.transform(f, lambda size, i: F.struct((F.get(sums, i) + F.get(g, i)).alias("start"), F.lit(kind).alias("kind"), (F.get(sums, i) + F.get(g, i) + size).alias("end")))
        return let(F.zip_with(f, F.slice(g, 1, F.size(f)), lambda x, y: x + y), lambda steps: let(sums_before(steps), span))

    some = let(found, lambda f: let(between, lambda g: F.when(F.size(f) > 0, placed(f, g))))
    return F.coalesce(F.when(text.rlike(pattern), some), F.array().cast(SPANS))


def overlapping(spans: Column, base: Column) -> Column:
    """Per span (two lambda names, neither empty) how many of ``base`` it overlaps: those that
    start before its end, less those that end by its start; both counted by running
    sums over one sorted list of places."""

    def counted(own: str, other: str, base_first: bool) -> Column:
        asked = F.transform(spans, lambda s, i: F.struct(s[own].alias("at"), F.lit(int(base_first)).alias("order"), i.cast("long").alias("of"), F.lit(0).cast("long").alias("one")))
        there = F.transform(base, lambda s: F.struct(s[other].alias("at"), F.lit(int(not base_first)).alias("order"), F.lit(-1).cast("long").alias("of"), F.lit(1).cast("long").alias("one")))
        places = F.array_sort(F.concat(asked, there))

        def answers(p: Column) -> Column:
            return let(F.transform(p, lambda x: x["one"]), lambda ones: let(sums_before(ones), lambda n: F.array_sort(F.filter(
                F.transform(p, lambda x, i: F.struct(x["of"].alias("of"), F.get(n, i).alias("n"))), lambda x: x["of"] >= 0))))

        return let(places, answers)

    return F.zip_with(counted("end", "start", False), counted("start", "end", True), lambda x, y: x["n"] - y["n"])


def base_spans(text: Column) -> tuple[Column, Column, Column]:
    """Spans of the three base kinds; an assignment needs a value of ASSIGN_LEAST characters."""
    values = F.when(text.rlike(ASSIGN), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)))
    assign = F.zip_with(match_spans(text, ASSIGN, 0), values, lambda s, v: F.when(F.length(v) >= ASSIGN_LEAST, s))
    return F.coalesce(F.filter(assign, lambda s: s.isNotNull()), match_spans(F.lit(""), HEX, 0)), match_spans(text, ACCESS, 1), match_spans(text, HEX, 2)


def _pairs(token: Column) -> Column:
    """Codes of a token's transitions, ``128 * first + second``."""
    code = F.transform(F.split(token, ""), F.ascii)
    return F.zip_with(F.slice(code, 1, F.greatest(F.size(code) - 1, F.lit(0))), F.slice(code, 2, F.size(code)), lambda a, b: a * 128 + b)


def train(samples: DataFrame, text_col: str = "token", label_col: str = "random") -> list[float]:
    """Log-likelihood ratio of every character transition, ``128 * 128`` numbers.

    ``samples``: tokens with label 1 (random string) or 0 (ordinary identifier);
    other labels and null tokens are ignored.  Only transition counts reach the
    driver, at most the square of the alphabet for each label."""
    rows = samples.where(F.col(label_col).isin(0, 1) & (F.length(text_col) >= 2))
    pairs = rows.select(F.col(label_col).cast("int").alias("y"), F.explode(_pairs(F.col(text_col))).alias("p"))
    counts = {(r["y"], r["p"]): r["n"] for r in pairs.groupBy("y", "p").agg(F.count(F.lit(1)).alias("n")).collect()}
    codes = [ord(c) for c in ALPHABET]
    table = [0.0] * (128 * 128)
    for a in codes:
        logs = []
        for y in (1, 0):
            row = [counts.get((y, a * 128 + b), 0) + SMOOTHING for b in codes]
            total = math.log(sum(row))
            logs.append([math.log(x) - total for x in row])
        for b, r, o in zip(codes, *logs, strict=True):
            table[a * 128 + b] = r - o
    return table


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labelled tokens from about SAMPLE_DOCS documents (by a hash of the id, so
    the same rows every time): values of base spans are random strings, other
    long tokens ordinary, and so are the names of Spark's own functions in the
    usual spellings of identifiers (NAME_WEIGHT times each); SAMPLE_RANDOM generated strings stand for the
    alphabets that secrets of these documents happen not to use."""
    n = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(n, 1))
    picked = docs.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    values = F.concat(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("t", F.lit(f"({ACCESS})"), F.lit(1)), F.regexp_extract_all("t", F.lit(f"({HEX})"), F.lit(1)))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), ACCESS, " "), HEX, " ")
    random = picked.select(F.explode(F.filter(values, lambda v: F.length(v) >= ASSIGN_LEAST)).alias("token"), F.lit(1).alias("random"))
    plain = picked.select(F.explode(F.regexp_extract_all(rest, F.lit(r"([A-Za-z0-9_-]{5,})"), F.lit(1))).alias("token"), F.lit(0).alias("random"))
    bits = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    names = docs.sparkSession.sql("SHOW FUNCTIONS").where(F.col("function").rlike("^[a-z][a-z0-9_]{3,}$"))
    spaced = F.translate("function", "_", " ")
    forms = [F.col("function"), F.translate(F.initcap(spaced), " ", ""), F.upper("function"), F.translate(spaced, " ", "-")]
    weighed = names.select(F.explode(F.array_repeat(F.concat(*[F.array(f) for f in forms]), NAME_WEIGHT)).alias("forms"))
    names = weighed.select(F.explode("forms").alias("token"), F.lit(0).alias("random"))
    made = docs.sparkSession.range(SAMPLE_RANDOM).select(F.regexp_replace(F.base64(bits), "=", "").alias("token"), F.lit(1).alias("random"))
    return random.unionAll(plain).unionAll(names).unionAll(made)


def scan(docs: DataFrame, model: list[float], text_col: str = "text", base_col: str = "_base", spans_col: str = "_spans") -> DataFrame:
    """``docs`` with two more columns (of names that it does not have): ``_base`` and
    ``_spans`` (base and added ones), each ``array<struct<start, kind, end>>`` in order of start and kind."""
    weights = F.from_json(F.lit(str(model)), "array<double>")
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign, access, hexes = base_spans(text)
    out = docs.withColumn(base_col, F.array_sort(F.concat(assign, access, hexes)))

    tokens = F.regexp_extract_all(text, F.lit(f"({CANDIDATE})"), F.lit(1))
    ratio = lambda t: F.aggregate(_pairs(t), F.lit(0.0), lambda a, p: a + F.element_at(weights, p + 1))
    judged = F.zip_with(match_spans(text, CANDIDATE, 3), F.when(text.rlike(CANDIDATE), tokens), lambda s, t: F.when(ratio(t) >= MIN_LLR, s))
    likely = F.coalesce(F.filter(judged, lambda s: s.isNotNull()), F.array().cast(SPANS))
    free = lambda s, b: F.transform(F.filter(F.arrays_zip(s.alias("s"), overlapping(s, b).alias("n")), lambda x: x["n"] == 0), lambda x: x["s"])
    added = let(likely, lambda s: let(F.col(base_col), lambda b: F.when((F.size(s) > 0) & (F.size(b) > 0), free(s, b)).otherwise(s)))
    return out.withColumn(spans_col, F.array_sort(F.concat(F.col(base_col), added)))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redact(docs: DataFrame, model: list[float], text_col: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by ``REDACTED`` (overlapping spans
    by one); rows without spans, null texts included, are unchanged."""
    base_col, spans_col = free_name(docs.columns, "_base"), free_name(docs.columns, "_spans")
    text = F.col(text_col)
    # the text in blocks, so that a piece is cut out without counting from the text's beginning
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / PIECE).cast("int")), lambda k: F.substring(text, k * PIECE + 1, F.lit(PIECE)))
    furthest = lambda ends: F.coalesce(F.array_max(ends), F.lit(0).cast("long"))

    def part(cut: Column, a: Column, b: Column) -> Column:
        """Code points ``a .. b`` of the text."""
        block = F.sequence(F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int"))
        return F.array_join(F.transform(block, lambda k: F.substring(F.get(cut, k), F.greatest(a - k * PIECE, F.lit(0)).cast("int") + 1, (F.least(b - k * PIECE, F.lit(PIECE)) - F.greatest(a - k * PIECE, F.lit(0))).cast("int"))), "")

    def whole(cut: Column, spans: Column, ends: Column) -> Column:
        def joined(done: Column) -> Column:
            piece = F.transform(spans, lambda s, i: F.when(s["start"] >= F.get(done, i), F.concat(part(cut, F.get(done, i), s["start"]), F.lit(REDACTED))).otherwise(""))
            return F.concat(F.array_join(piece, ""), part(cut, furthest(ends), F.length(text).cast("long")))

        return let(before(ends, furthest, F.greatest), joined)

    redacted = let(F.col(spans_col), lambda s: let(F.transform(s, lambda x: x["end"]), lambda e: let(blocks, lambda cut: whole(cut, s, e))))
    found = scan(docs, model, text_col, base_col, spans_col)
    return found.withColumn(text_col, F.when(F.size(spans_col) > 0, redacted).otherwise(text)).drop(base_col, spans_col)
