"""Normalisation and validation of a ticket table (NRM*, PRJ1, FLT*)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, normalise_name, ustrip

KNOWN = ("ticket_id", "issue_description", "current_label", "resolution_notes")
REQUIRED = "issue_description"
UNCATEGORISED = "Uncategorised"


class TicketError(ValueError):
    """Validation failure with every problem found (not only the first)."""

    def __init__(self, problems: list[str]):
        self.problems = list(problems)
        super().__init__("; ".join(self.problems))


@dataclass
class Validation:
    rows: int | None = None
    problems: list[str] = field(default_factory=list)

    def raise_if_failed(self) -> None:
        if self.problems:
            raise TicketError(self.problems)


def normalise_columns(df: DataFrame) -> DataFrame:
    """NRM1: strip / lower / space→underscore every header; clashes are errors.

    Spark resolves names case-insensitively, so the clash check runs before
    ``toDF`` renames anything.
    """
    new = [normalise_name(c) for c in df.columns]
    seen: dict[str, str] = {}
    clashes = []
    for old, n in zip(df.columns, new):
        if n.lower() in seen:
            clashes.append(f"columns '{seen[n.lower()]}' and '{old}' both normalise to '{n}'")
        seen[n.lower()] = old
    if clashes:
        raise TicketError(clashes)
    return df.toDF(*new)


def check_required(df: DataFrame) -> list[str]:
    """NRM2: the description column must exist."""
    if REQUIRED not in df.columns:
        return [f"missing required column: {REQUIRED}"]
    return []


def drop_blank(df: DataFrame) -> DataFrame:
    """NRM3: drop rows whose description is null or blank after a Unicode strip."""
    return df.filter(~is_blank(F.col(REQUIRED).cast("string")))


def fill_defaults(df: DataFrame, pos_col: str | None = "pos") -> DataFrame:
    """NRM6/NRM7: add ``Row n`` ids and blank label / notes when absent.

    ``Row n`` numbering needs the dense 0-based ``pos`` column (ORD1).
    """
    adds = {}
    if "ticket_id" not in df.columns:
        if pos_col is None or pos_col not in df.columns:
            raise TicketError(["ticket_id absent and no position column to number rows"])
        adds["ticket_id"] = F.concat(F.lit("Row "), (F.col(pos_col) + 1).cast("string"))
    if "current_label" not in df.columns:
        adds["current_label"] = F.lit("")
    if "resolution_notes" not in df.columns:
        adds["resolution_notes"] = F.lit("")
    return df.withColumns(adds) if adds else df


def clean_known(df: DataFrame) -> DataFrame:
    """NRM8: null→'', to string, strip, on the four known columns only."""
    return df.withColumns(
        {c: ustrip(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in KNOWN if c in df.columns}
    )


def validate(df: DataFrame, max_rows: int | None = None) -> Validation:
    """NRM2/NRM4/NRM5 collected together.  Costs one ``count`` only if a cap is set,
    otherwise a ``limit(1)`` probe."""
    v = Validation()
    v.problems += check_required(df)
    if v.problems:
        return v
    if max_rows is not None:
        n = df.count()
        v.rows = n
        if n == 0:
            v.problems.append("no data rows left after dropping blank descriptions")
        elif n > max_rows:
            v.problems.append(f"the table has {n} rows; at most {max_rows} are allowed")
    elif df.limit(1).isEmpty():
        v.problems.append("no data rows left after dropping blank descriptions")
    return v


def normalise(df: DataFrame, order_key: str | None = None) -> DataFrame:
    """Full clean-up of a raw ticket table: NRM1, NRM2, NRM3, NRM6-8.

    When ``ticket_id`` is absent, rows are numbered ``Row 1..n`` after the
    blank rows are dropped, in ``order_key`` order (default: the ``_row``
    column the file reader adds, i.e. file order), via the distributed dense
    position (ORD1); the position is kept as ``pos``.
    """
    df = normalise_columns(df)
    problems = check_required(df)
    if problems:
        raise TicketError(problems)
    df = drop_blank(df)
    if "ticket_id" not in df.columns:
        key = order_key or ("_row" if "_row" in df.columns else None)
        if key is None:
            raise TicketError(["ticket_id absent: give an order key to number the rows"])
        from .ordering import assign_positions

        df = assign_positions(df, key)
    df = fill_defaults(df, "pos")
    return clean_known(df)


def check_context(context: str) -> list[str]:
    """NRM9: at least 10 characters after a strip."""
    return [] if len((context or "").strip()) >= 10 else ["context must have at least 10 characters"]


def clean_category_list(names) -> list[str]:
    """NRM10/NRM13: strip, drop blank, keep duplicates and order."""
    return [n.strip() for n in (names or []) if n is not None and n.strip()]


def check_manual_list(names) -> list[str]:
    """NRM10: between 2 and 15 names after clean-up."""
    n = len(clean_category_list(names))
    if n < 2:
        return ["at least 2 category names are needed"]
    if n > 15:
        return ["at most 15 category names are allowed"]
    return []


def check_auto_mode(rows: int, confirmed) -> list[str]:
    """NRM11: auto-suggest needs more than 50 rows and 2 confirmed names."""
    out = []
    if rows <= 50:
        out.append("auto-suggest needs more than 50 rows")
    if len(clean_category_list(confirmed)) < 2:
        out.append("confirm at least 2 suggested categories")
    return out


def named_only(df: DataFrame, col: str = "new_category") -> DataFrame:
    """FLT2."""
    return df.filter(F.col(col) != UNCATEGORISED)


def drill_down(df: DataFrame, category: str, col: str = "new_category") -> DataFrame:
    """FLT3 (documented backlog): rows of one category."""
    return df.filter(F.col(col) == category)
