"""JSON tickets and the layouts of common ticket systems (SRC10).

A JSON-lines file is read as text and each line parsed once as a variant, so
nested fields are paths (``fields.summary``) and no schema has to be inferred
over the whole input.  ``detect_layout`` finds a known export by its header
signature: the column names of a CSV export, or the field paths of a bounded
probe of JSON lines.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.normalise import TicketError
from ..operators.responses import one_json
from ..session import materialize
from .files import ReadReport, _literal, listed_files, with_row_key
from .tables import map_columns

# --- fixed values -----------------------------------------------------------
# Export layouts: ticket column -> column name or JSON field path, as the public
# export formats of these kinds of systems name them.
LAYOUTS = {
    "issue tracker csv": {
        "ticket_id": "Issue key", "issue_description": "Summary", "current_label": "Issue Type", "resolution_notes": "Resolution",
    },
    "issue tracker json": {
        "ticket_id": "key", "issue_description": "fields.summary", "current_label": "fields.issuetype.name",
        "resolution_notes": "fields.resolution.description",
    },
    "help desk csv": {
        "ticket_id": "Ticket ID", "issue_description": "Subject", "current_label": "Ticket type", "resolution_notes": "Resolution notes",
    },
    "help desk json": {
        "ticket_id": "id", "issue_description": "subject", "current_label": "type", "resolution_notes": "custom_fields.resolution",
    },
    "service desk csv": {
        "ticket_id": "number", "issue_description": "short_description", "current_label": "category", "resolution_notes": "close_notes",
    },
    "ticket template": {
        "ticket_id": "ticket_id", "issue_description": "issue_description", "current_label": "current_label", "resolution_notes": "resolution_notes",
    },
}
#: The columns that make a layout's signature; the other two may be missing.
SIGNATURE = ("ticket_id", "issue_description", "current_label")
#: Lines that are looked at to tell the layout of a JSON file.
PROBE_LINES = 100
# -----------------------------------------------------------------------------


def detect_layout(fields: Iterable[str]) -> str:
    """The layout whose signature fields are all there (the one with most fields
    present, then in the order listed); an unknown header names the known ones."""
    have = {f.strip().lower() for f in fields}

    def present(name: str) -> int:
        return sum(path.lower() in have for path in LAYOUTS[name].values())

    fits = [n for n, m in LAYOUTS.items() if all(m[c].lower() in have for c in SIGNATURE)]
    if not fits:
        raise TicketError([f"unknown export layout; known ones: {', '.join(LAYOUTS)}"])
    return max(fits, key=present)


def from_layout(df: DataFrame, layout: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """A table in an export layout (found by its columns unless named) as tickets:
    names match in any case, ids and labels are texts, a missing column is null."""
    mapping = LAYOUTS[layout or detect_layout(df.columns)]
    by_name = {c.strip().lower(): c for c in df.columns}

    def column(path: str) -> Column:
        own = by_name.get(path.lower())
        return F.lit(None).cast("string") if own is None else F.col(f"`{own}`").cast("string")

    return map_columns(df, {k: column(p) for k, p in mapping.items()}, keep)


def field_paths(value, above: str = "") -> set[str]:
    """The dotted paths of a JSON object's fields (of objects inside it, too)."""
    if not isinstance(value, dict):
        return set()
    out = set()
    for k, v in value.items():
        out |= {above + k} | field_paths(v, f"{above}{k}.")
    return out


def json_path(path: str) -> str:
    """A dotted path as a JSON path; names are quoted, so any character may stand in them."""
    return "$" + "".join("['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']" for p in path.split("."))


def probe_layout(lines: DataFrame) -> str:
    """The layout of JSON lines, by the fields of the first few (a bounded probe)."""
    found: set[str] = set()
    for r in lines.where(F.trim("value") != "").limit(PROBE_LINES).collect():
        try:
            found |= field_paths(json.loads(r["value"]))
        except (ValueError, RecursionError):
            continue
    return detect_layout(found)


def read_json_tickets(spark: SparkSession, paths, mapping: dict[str, str] | None = None, layout: str | None = None,
                      report: bool = False) -> DataFrame | tuple[DataFrame, ReadReport]:
    """JSON-lines files as tickets with their file order in ``_row``.

    ``mapping`` gives a field path per ticket column, else the (detected) layout
    does.  Blank lines are skipped.  A line that is not exactly one JSON object
    refuses the read, as a malformed CSV row does; with ``report=True`` such lines
    are counted and handed back apart.  Values that are no strings become their
    JSON text, nulls and absent fields are null.
    """
    files = listed_files(spark, [paths] if isinstance(paths, str) else list(paths))
    source = spark.read.text([_literal(f) for f in files])
    if mapping is None:
        mapping = LAYOUTS[layout or probe_layout(source)]
    lines = with_row_key(source, files).where(F.trim("value") != "")
    value = one_json(F.col("value"))
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    columns = {k: F.try_variant_get(F.col("_v"), json_path(p), "string") for k, p in mapping.items()}
    parsed = lines.select("_row", "value", F.when(is_object, value).alias("_v"))
    rows = materialize(parsed.select(*[c.alias(k) for k, c in columns.items()], "_row", F.when(F.col("_v").isNull(), F.col("value")).alias("_bad")), "json_tickets")
    n = rows.where(F.col("_bad").isNotNull()).count()
    if n and not report:
        raise TicketError([f"{n} lines are not one JSON object each; report=True hands them back apart"])
    good = rows.where(F.col("_bad").isNull()).drop("_bad")
    if report:
        return good, ReadReport(len(files), [], n, rows.where(F.col("_bad").isNotNull()).select(F.col("_bad").alias("line"), "_row"))
    return good
