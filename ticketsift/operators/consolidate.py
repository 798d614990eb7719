"""Consolidation (CNS0-CNS8) and the lexical review deciders (DEC5-DEC7).

Merges are decided on the per-category count table (one row per category),
never by passes over the rows.  A small taxonomy's merge list is folded on the
driver over those counts into one composed ``old → final`` map plus the merge
log and the summary upkeep, then applied to the rows with a single literal map
lookup; ``operators.merges`` does the same with tables for any number of names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .normalise import UNCATEGORISED
from .taxonomy import STOP_WORDS

# --- fixed values -----------------------------------------------------------
# Merge-log line: Merged: 'A' + 'B' → 'T' (n tickets)
LOG_FORMAT = "Merged: {labels} → '{target}' ({n} tickets)"
SUMMARY_JOIN = " / "
UNAVAILABLE = "Analysis unavailable: {error}"
SUMMARY_PREFIX = "Common terms: "
# lines of the model-free review
FLAG_FORMAT = "'{a}' and '{b}' may overlap ({pct}% of their words)"
THEME_FORMAT = "Tickets that mention '{term}'"
NARRATIVE = (
    "%d tickets were sorted into %d categories; the largest is '%s' with %d tickets (%d%%). %d tickets stayed Uncategorised."
)
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Merge:
    merge_these: tuple[str, ...]
    into: str


@dataclass
class MergePlan:
    mapping: dict[str, str] = field(default_factory=dict)     # original → final (changed only)
    log: list[str] = field(default_factory=list)
    applied: list[tuple[int, int]] = field(default_factory=list)  # (merge_no, tickets)
    summaries: dict[str, str] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)        # final counts
    table: object = None                                        # the mapping as a table (see operators.merges)


def fold_merges(counts: dict[str, int], merges, summaries: dict[str, str] | None = None,
                keep_target_summary: bool = False) -> MergePlan:
    """CNS5-CNS7 over a category → rows table.

    Merges apply in list order and see earlier results; a merge with no
    sources or no target is skipped; one that hits no row leaves no log line
    and no summary change.  ``n`` counts every row whose current category is a
    source, including rows already in the target when it is a source too.
    Summary upkeep: a target without summary gets its sources' summaries joined
    by `` / `` (source order); then every source's summary is removed, which
    also drops the target's own when the target is a source (parity), unless
    ``keep_target_summary``.
    """
    steps = [(no, *((m.merge_these, m.into) if isinstance(m, Merge) else m)) for no, m in enumerate(merges, start=1)]
    members = {c: (c,) for c in counts if c is not None}     # current name → original names now in it
    plan = MergePlan(summaries=dict(summaries or {}))
    for no, sources, target in steps:
        hit = [c for c in dict.fromkeys(sources) if c in members] if target else []
        moved = [o for c in hit for o in members.pop(c)]
        n = sum(counts[o] for o in moved)
        if not n:
            members.update({c: (c,) for c in hit if c in counts and counts[c] == 0})
            continue
        members[target] = (*members.get(target, ()), *moved)
        plan.applied.append((no, n))
        plan.log.append(LOG_FORMAT.format(labels=" + ".join(f"'{c}'" for c in sources), target=target, n=n))
        plan.summaries = summaries_after(plan.summaries, sources, target, keep_target_summary)
    plan.mapping = {o: c for c, os_ in members.items() for o in os_ if o != c}
    plan.counts = {c: sum(counts[o] for o in os_) for c, os_ in members.items()}
    return plan


def summaries_after(before: dict[str, str], sources, target: str, keep_target: bool) -> dict[str, str]:
    """CNS7 as one expression: what stays, and the target's own or joined text."""
    gone = set(sources) - ({target} if keep_target else set())
    joined = before.get(target, SUMMARY_JOIN.join(before[c] for c in sources if c in before))
    return {c: t for c, t in {**before, target: joined}.items() if c not in gone and (t or c in before)}


def apply_mapping(df: DataFrame, mapping: dict[str, str], col: str = "new_category") -> DataFrame:
    """Apply a composed category map in one projection (no join, no shuffle).

    The per-merge membership test of the sources (JON4, semi-membership) is
    folded into the map, so rows are touched once whatever the merge count."""
    if not mapping:
        return df
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(col, F.coalesce(F.element_at(m, F.col(col)), F.col(col)))


def collect_counts(labelled: DataFrame, col: str = "new_category", limit: int = 100_000) -> dict[str, int]:
    """Category counts to the driver; refuses to pull an unbounded table."""
    counts = labelled.filter(F.col(col).isNotNull()).groupBy(col).count()
    rows = counts.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} distinct categories; merge fold needs a bounded category table")
    return {r[0]: r[1] for r in rows}


def merge_log_rows(plan: MergePlan) -> list[tuple[int, str, int]]:
    """RPT5: the merge log as ``(merge_no, line, tickets)`` rows."""
    return [(no, line, n) for (no, n), line in zip(plan.applied, plan.log)]


# ------------------------------------------------------------ DEC6 / DEC7 ---

def term_table(labelled: DataFrame, min_len: int = 4, col: str = "new_category",
               text: str = "issue_description", stop_words=STOP_WORDS) -> DataFrame:
    """Per (category, term) the number of tickets containing the term, plus one
    row per category with a null term holding its ticket count.

    Tickets belong to exactly one category, so these counts add up when
    categories are folded or merged afterwards: thresholds and merges can be
    applied to this aggregated table instead of re-reading the texts.
    """
    terms = F.filter(F.array_distinct(tokens(text)), lambda t: (F.length(t) >= min_len) & ~t.isin(list(stop_words)))
    with_marker = F.concat(terms, F.array(F.lit(None).cast("string")))
    return (
        labelled.filter(F.col(col).isNotNull())
        .select(F.col(col).alias("category"), F.explode(with_marker).alias("term"))
        .groupBy("category", "term")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def remap_terms(terms: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Fold / merge categories on the aggregated term table (exact, see ``term_table``)."""
    if not mapping:
        return terms
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return (
        terms.withColumn("category", F.coalesce(F.element_at(m, F.col("category")), F.col("category")))
        .groupBy("category", "term")
        .agg(F.sum("df").alias("df"))
    )


def summaries_from_terms(terms: DataFrame, k: int = 3) -> DataFrame:
    """DEC6 from the term table: the ``k`` most frequent terms per category."""
    w = Window.partitionBy("category").orderBy(F.desc("df"), F.asc("term"))
    top = terms.filter(F.col("term").isNotNull()).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
    return top.groupBy("category").agg(
        F.concat(F.lit(SUMMARY_PREFIX), F.expr("listagg(term, ', ') WITHIN GROUP (ORDER BY rn)")).alias("summary")
    )


def run_facts(labelled: DataFrame, col: str = "new_category", order_col: str = "pos", merges: int = 0) -> DataFrame:
    """RPT9 / DEC7 facts: total, named categories, dominant named category and
    its share, Uncategorised and Low counts.  Category counts first (tiny),
    then one global aggregate over them."""
    return facts_of_counts(category_facts(labelled, col, order_col), merges)


def category_facts(labelled: DataFrame, col: str = "new_category", order_col: str = "pos") -> DataFrame:
    """Per category its tickets, first position and Low tickets: what reports of one
    row need, so that they read the texts once and write no rows."""
    return labelled.groupBy(F.col(col).alias("category")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(order_col).alias("first_pos"),
        F.count_if(F.col("confidence") == "Low").alias("low"),
    )


def fold_facts(per: DataFrame, min_bucket: int) -> DataFrame:
    """AGG2 on that table: named categories below the bucket size join Uncategorised."""
    small = (F.col("n") < min_bucket) & (F.col("category") != UNCATEGORISED)
    return per.withColumn("category", F.when(small, F.lit(UNCATEGORISED)).otherwise(F.col("category"))).groupBy("category").agg(
        F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"), F.sum("low").alias("low"))


def facts_of_counts(per: DataFrame, merges: int = 0) -> DataFrame:
    """RPT9 / DEC7 facts from the table of ``category_facts``."""
    named = F.col("category").isNotNull() & (F.col("category") != UNCATEGORISED)
    facts = per.agg(
        F.sum("n").alias("total"),
        F.count_if(named).alias("categories"),
        F.max_by(F.when(named, F.col("category")), F.when(named, F.struct(F.col("n"), -F.col("first_pos")))).alias("dominant"),
        F.max(F.when(named, F.col("n"))).alias("dominant_n"),
        F.coalesce(F.sum(F.when(F.col("category") == UNCATEGORISED, F.col("n"))), F.lit(0)).alias("uncategorised"),
        F.sum("low").alias("low_confidence"),
    )
    from ..functions.text import pct_half_even

    return facts.select(
        "total", "categories", "dominant", "dominant_n",
        pct_half_even("dominant_n", "total").alias("dominant_pct"),
        "uncategorised", "low_confidence", F.lit(merges).alias("merges"),
    )


def narrative_line(counts: dict[str, int]) -> str:
    """DEC7 from the (driver-held) category counts."""
    named = {c: n for c, n in counts.items() if c and c != UNCATEGORISED}
    total = sum(counts.values())
    best = min(named, key=lambda c: (-named[c], c), default=None)
    n = named.get(best, 0)
    return NARRATIVE % (total, len(named), best or "none", n, round(100 * n / total) if total else 0, counts.get(UNCATEGORISED, 0))


def narrative(facts: DataFrame) -> DataFrame:
    """DEC7: a plain briefing line from the facts row."""
    return facts.select(
        F.format_string(
            NARRATIVE,
            "total", "categories", F.coalesce(F.col("dominant"), F.lit("none")), F.coalesce(F.col("dominant_n"), F.lit(0)),
            F.coalesce(F.col("dominant_pct"), F.lit(0)), "uncategorised",
        ).alias("narrative")
    )
