"""Scalar string helpers, all built from JVM-side ``pyspark.sql.functions``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Whitespace that Python's str.strip() removes (str.isspace): tab, LF, VT, FF,
# CR, the four information separators 0x1C-0x1F, space, NEL, NBSP, Ogham space
# mark, the U+2000..U+200A spaces, line and paragraph separators, narrow NBSP,
# medium mathematical space and the ideographic space.
WS_CHARS = (
    "\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x85\\xA0\\u1680\\u2000-\\u200A"
    "\\u2028\\u2029\\u202F\\u205F\\u3000"
)
# Missing-value tokens of a default CSV read (pandas' default NA strings).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
# Tokeniser: lower-case, split on every run of characters outside a-z.
TOKEN_SPLIT = "[^a-z]+"
# ---------------------------------------------------------------------------

WS_CLASS = "[" + WS_CHARS + "]"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ustrip(c: Column | str) -> Column:
    """Strip leading/trailing whitespace with Python ``str.strip`` semantics.

    ``trim`` removes only blanks; descriptions carry tabs, NBSP and newlines.
    The regex runs only when the first or last character is whitespace: an
    end-anchored pattern is tried at every position of a long text, which
    made the strip cost more than the tokeniser.
    """
    c = _c(c)
    edge = F.substring(c, 1, 1).rlike(WS_CLASS) | F.substring(c, -1, 1).rlike(WS_CLASS)
    stripped = F.regexp_replace(F.regexp_replace(c, "^" + WS_CLASS + "+", ""), WS_CLASS + "+\\z", "")
    return F.when(edge, stripped).otherwise(c)


def is_blank(c: Column | str) -> Column:
    """True when the value is null or only whitespace."""
    c = _c(c)
    return c.isNull() | ~c.rlike("[^" + WS_CHARS + "]")


def tokens(c: Column | str) -> Column:
    """Array of lower-case ASCII word tokens (may contain '' at the edges)."""
    return F.split(F.lower(_c(c)), TOKEN_SPLIT)


def cut(c: Column | str, n: int, ellipsis: str = "...") -> Column:
    """First ``n`` characters plus ``...`` only when longer (display cut)."""
    c = _c(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(ellipsis))).otherwise(c)


def head_chars(c: Column | str, n: int) -> Column:
    """First ``n`` characters, no marker (prompt cuts)."""
    return F.substring(_c(c), 1, n)


def pct_half_even(part: Column | str, whole: Column | str) -> Column:
    """``round(part / whole * 100)`` with half-to-even rounding, as a long.

    Division first, then the multiplication, in double, as the page computes it.
    """
    return F.bround(_c(part).cast("double") / _c(whole).cast("double") * F.lit(100.0), 0).cast("long")


def na_to_null(c: Column | str, na_tokens=NA_TOKENS) -> Column:
    """SRC6: missing-value tokens of a default CSV read become null."""
    c = _c(c)
    if not na_tokens:
        return c
    return F.when(c.isin(list(na_tokens)), F.lit(None).cast("string")).otherwise(c)


def normalise_name(name: str) -> str:
    """Column-name rule: strip, lower-case, ASCII space to underscore."""
    return name.strip().lower().replace(" ", "_")
