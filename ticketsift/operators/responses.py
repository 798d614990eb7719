"""Reply parsing (PAR1-PAR5) and applying replies to rows (JON1-JON3, MTG2).

A list reply is parsed once, by ``json.loads`` in an Arrow-batched pandas UDF (one
call per reply, i.e. per batch of tickets, never per row), into the few fields that
are read later: trailing text, single quotes and cut-off replies fail, of repeated
keys the last one counts, ``NaN`` and ``Infinity`` are nulls.  The two object replies
(review, name list) are parsed with variants in the JVM.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ustrip
from .normalise import UNCATEGORISED

# --- fixed values -----------------------------------------------------------
FAILED_REASON = "Could not parse the reply for this batch."
ERROR_PREFIX = "Processing error: "
DEFAULTS = {"new_category": UNCATEGORISED, "confidence": "Low", "reasoning": ""}
# -----------------------------------------------------------------------------


def strip_fences(raw: Column | str) -> Column:
    """PAR1: only when the text starts with a fence, keep what lies between the
    first and second fence, drop a leading lower-case ``json``; then strip."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    inner = F.regexp_replace(F.split_part(raw, F.lit("```"), F.lit(2)), "^json", "")
    return ustrip(F.when(raw.startswith("```"), inner).otherwise(raw))


def one_json(text: Column) -> Column:
    """The text as a variant if it is exactly one JSON value, else null.  The
    parser itself ignores what follows a value, so the text must also be valid
    as the only element of an array and as the value of an object."""
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    inside = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    one = F.size(F.try_variant_get(alone, "$", "array<variant>")) == 1
    return F.when(one & inside.isNotNull(), F.try_variant_get(alone, "$[0]", "variant"))


ITEM = T.StructType([T.StructField(c, T.StringType()) for c in ("ticket_id", "new_category", "confidence", "reasoning", "multi_tags")])


class RawNumber(str):
    """A JSON number as it was written."""


def _text(value) -> str | None:
    """A JSON value as text: strings as they are, others as JSON."""
    if value is None or isinstance(value, str):
        return None if value is None else value.encode("utf-8", "replace").decode()
    return json.dumps(_plain(value), separators=(",", ":"))


def _plain(value):
    """Nested numbers back to numbers, so that they are not quoted."""
    if isinstance(value, RawNumber):
        return json.loads(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def _joined_tags(value) -> str | None:
    """``tags`` joined by `` | `` (a string letter by letter), None for a value that
    cannot be joined."""
    letters_or_list = list(value) if isinstance(value, (str, list)) and not isinstance(value, RawNumber) else None
    if letters_or_list is None or any(not isinstance(t, str) or isinstance(t, RawNumber) for t in letters_or_list):
        return None
    return _text(" | ".join(letters_or_list))


def _read_item(element: dict) -> dict:
    """JON2: an element's fields: an absent key gives the default, a null stays null."""
    own = {k: _text(element.get(k, d)) for k, d in DEFAULTS.items()}
    return {"ticket_id": _text(element.get("ticket_id")), **own, "multi_tags": _joined_tags(element.get("tags", ""))}


@F.pandas_udf(T.ArrayType(ITEM))
def reply_items(clean: pd.Series, n: pd.Series) -> pd.Series:
    """The items of an unfenced reply that is exactly a JSON array of ``n`` objects;
    null for any other reply."""
    decoder = json.JSONDecoder(parse_float=RawNumber, parse_int=RawNumber, parse_constant=lambda _: None)

    def items(text, size):
        try:
            value = decoder.decode(text)
            fits = isinstance(value, list) and len(value) == size and all(isinstance(v, dict) for v in value)
            return [_read_item(v) for v in value] if fits else None
        except (TypeError, ValueError, RecursionError):
            return None

    return pd.Series([items(t, int(k)) for t, k in zip(clean, n)], dtype=object)


def parse_replies(responses: DataFrame, requests: DataFrame) -> DataFrame:
    """PAR1+PAR2+PAR4 per batch: ``(batch_id, n_tickets, raw, error, items, ok)``.

    ``ok`` requires a reply that is exactly one JSON array of objects whose length
    equals the batch size (a non-object element fails the whole batch, as a ``.get``
    on it would).  ``items`` holds the fields of each element (``ITEM``)."""
    j = requests.select("batch_id", "n_tickets").join(responses, "batch_id", "left")
    j = j.withColumn("items", reply_items(F.when(F.col("error").isNull(), strip_fences(F.coalesce(F.col("raw"), F.lit("")))), "n_tickets"))
    return j.withColumn("ok", F.col("items").isNotNull())


#: There is one strictness; the name is kept for callers of the former lenient path.
parse_replies_strict = parse_replies


def _slots(parsed: DataFrame, items: Column, *more: Column) -> DataFrame:
    """A row per ticket slot of each batch: its element, or null in a failed batch."""
    blank = F.array_repeat(F.lit(None).cast(ITEM), F.col("n_tickets").cast("int"))
    return parsed.select(F.col("batch_id").alias("_b"), *more, F.posexplode(F.coalesce(items, blank)).alias("_i", "_elem"))


def apply_replies(batched: DataFrame, parsed: DataFrame, align: str = "position") -> DataFrame:
    """JON1-JON3: write reply element ``i`` of a batch to the row at ``batch_pos = i``.

    ``align='ticket_id'`` matches by the reply's ticket id instead.  A failed
    call marks every row ``Processing error: ...``; an unusable reply marks
    every row of the batch with the parse-failure reason.  In position mode
    the reply side is expanded to one row per ticket slot (element or batch
    state), so a single join on ``(batch_id, batch_pos)`` attaches everything;
    no key holds more than one row per side.
    """
    if align == "ticket_id":
        status = parsed.select(F.col("batch_id").alias("_b2"), F.col("error").alias("_berr"))
        elems = parsed.filter(F.col("ok")).select(F.col("batch_id").alias("_b"), F.explode("items").alias("_elem"))
        keyed = batched.join(elems, (F.col("batch_id") == F.col("_b")) & (F.col("ticket_id") == F.col("_elem.ticket_id")), "left")
        keyed = keyed.join(status, F.col("batch_id") == F.col("_b2"), "left")
    else:
        slots = _slots(parsed, F.col("items"), F.col("error").alias("_berr"))
        keyed = batched.join(slots, (F.col("batch_id") == F.col("_b")) & (F.col("batch_pos") == F.col("_i")), "left")
    e, err = F.col("_elem"), F.col("_berr")
    failed = {**DEFAULTS, "reasoning": FAILED_REASON}
    cols = {
        k: F.when(err.isNotNull(), F.concat(F.lit(ERROR_PREFIX), err) if k == "reasoning" else F.lit(d))
        .when(e.isNotNull(), e[k]).otherwise(F.lit(failed[k]))
        for k, d in DEFAULTS.items()
    }
    return keyed.withColumns(cols).drop("_b", "_b2", "_i", "_elem", "_berr")


def apply_tag_replies(batched: DataFrame, parsed: DataFrame) -> DataFrame:
    """PAR4 + MTG2: ``multi_tags`` = the element's ``tags`` joined by `` | ``.

    The whole batch is blank when the reply fails or when any element's
    ``tags`` is null or not a list of strings (a join over it would raise).
    Absent ``tags`` gives ``""``; a string ``"abc"`` joins letter by letter.
    """
    usable = F.when(F.forall("items", lambda x: x["multi_tags"].isNotNull()), F.col("items"))
    j = batched.join(_slots(parsed, usable), (F.col("batch_id") == F.col("_b")) & (F.col("batch_pos") == F.col("_i")), "left")
    return j.withColumn("multi_tags", F.coalesce(F.col("_elem")["multi_tags"], F.lit(""))).drop("_b", "_i", "_elem")


def parse_review(raw: Column | str) -> Column:
    """PAR3: consolidation object; a failure gives empty maps / lists (no narrative)."""
    schema = (
        "narrative string, category_summaries map<string,string>, "
        "auto_merges array<struct<merge_these:array<string>, into:string>>, "
        "merge_flags array<string>, uncategorised_analysis array<string>"
    )
    clean = strip_fences(raw)
    parsed = F.from_json(F.when(F.schema_of_variant(one_json(clean)).startswith("OBJECT"), clean), schema)
    return F.struct(
        parsed["narrative"].alias("narrative"),
        F.coalesce(parsed["category_summaries"], F.create_map().cast("map<string,string>")).alias("category_summaries"),
        F.coalesce(parsed["auto_merges"], F.array().cast("array<struct<merge_these:array<string>,into:string>>")).alias("auto_merges"),
        F.coalesce(parsed["merge_flags"], F.array().cast("array<string>")).alias("merge_flags"),
        F.coalesce(parsed["uncategorised_analysis"], F.array().cast("array<string>")).alias("uncategorised_analysis"),
    )


def parse_name_list(raw: Column | str) -> Column:
    """PAR5: a JSON array of names; anything else → [].  Falsy *values* (null,
    false, 0, "", [] and {}) go before the strip, so ``"0"`` stays and ``"  "``
    survives as ``""``; other values keep their JSON text."""
    items = F.try_variant_get(one_json(strip_fences(raw)), "$", "array<variant>")

    def text(v: Column) -> Column:
        return F.variant_get(v, "$", "string")

    def truthy(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        number = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.variant_get(v, "$", "double") != 0)
        return F.coalesce(
            F.when(kind == "VOID", F.lit(False)).when(kind == "STRING", text(v) != "").when(kind == "BOOLEAN", text(v) == "true"),
            number, ~text(v).isin("[]", "{}"))

    return F.coalesce(F.transform(F.filter(items, truthy), lambda v: ustrip(text(v))), F.array().cast("array<string>"))
