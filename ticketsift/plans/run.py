"""``run``: the end-to-end categorisation of a ticket table.

tickets → positions → batches → [rounds: requests → decider → parse → apply →
accumulate taxonomy] → threshold → consolidation (summaries, merges) →
optional multi-tag pass → facts.

Deciders:

* ``lexical``  – keyword scoring, pure Spark (no rounds needed: the taxonomy
  is fixed, or discovered up front from the sample's frequent terms).
* ``replay``   – recorded replies: ``responses(batch_id, raw, error)`` for
  the primary pass, ``tag_responses`` for the theme pass and
  ``review_response`` (one string) for the consolidation.
* ``callable`` – ``call_factory() -> (prompt -> reply)`` run in ``mapInPandas``.

Accumulation (ACC1) runs in rounds: every batch of a round sees the names
found by earlier rounds.  ``round_batches=1`` reproduces the one-batch-at-a-
time order exactly; the default grows rounds geometrically (1, 2, 4, ...
batches), so the number of Spark jobs is logarithmic in the row count while
the early rounds still shape the taxonomy.  Every round's replies and labels
are written under the checkpoint folder, so a retried task never re-calls the
model and later rounds read files instead of recomputing lineage.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..operators import consolidate as cns
from ..operators.deciders import call_requests, label_lexical, replay_requests
from ..operators.merges import MERGE_SCHEMA, MergeTables, apply_merge_map
from ..operators.name_table import NameTable, ranked, seed_names, unseen
from ..operators.normalise import UNCATEGORISED, TicketError, check_auto_mode, check_context, check_manual_list, clean_category_list
from ..operators.ordering import BATCH_SIZE, assign_batches, assign_positions
from ..operators.prompts import categorise_requests, review_request, suggest_request, tag_requests
from ..operators.reports import category_samples, uncategorised_head
from ..operators.responses import (
    apply_replies, apply_tag_replies, parse_name_list, parse_replies, parse_review,
)
from ..operators.taxonomy import (
    MIN_BUCKET, Category, Taxonomy, fold_counts, fold_small, fold_small_table, low_to_uncategorised, sample_size,
    small_categories, suggest_terms, suggestion_sample,
)
from ..operators.ordering import bucket_of
from ..operators.themes import join_tags
from ..operators.totals import observed
from ..session import materialize, scratch_scope
from ..sources.files import export_csv, write_run

RESULT_COLUMNS = ("new_category", "confidence", "reasoning", "multi_tags")
INTERNAL_COLUMNS = ("_row", "pos")        # order keys added by the reader and by normalise
MODES = ("no_suggestions", "manual_list", "auto_suggest")


@dataclass
class RunConfig:
    batch_size: int = BATCH_SIZE
    min_bucket: int = MIN_BUCKET
    min_fraction: float = 0.0
    round_batches: int | None = None      # None: geometric rounds 1, 2, 4, ...
    align: str = "position"
    keep_target_summary: bool = False
    order_key: str = "pos"
    discover_terms: int = 10              # lexical discovery: categories from top terms
    merge_similarity: float = 0.8         # lexical review: auto-merge names at this Jaccard
    flag_similarity: float = 0.5          # lexical review: flag names at this Jaccard
    uncategorised_terms: int = 3          # lexical review: terms named for the Uncategorised rows
    collapse_copies: bool = False         # model deciders: one request slot per exact copy group
    low_to_uncategorised: bool = False    # rows of low confidence leave their category before the threshold
    concurrency: int | None = None        # model deciders: parallel calls (default: cluster parallelism)


@dataclass
class RunResult:
    labelled: DataFrame
    names: NameTable | Taxonomy
    merges: cns.MergePlan
    review: dict = field(default_factory=dict)
    themed: DataFrame | None = None
    scratch: str | None = None            # folder of the run's written intermediate tables
    columns: list[str] = field(default_factory=list)   # the caller's columns, in order

    @property
    def taxonomy(self) -> Taxonomy:
        """The category list of the run (read from its table when asked for)."""
        return self.names if isinstance(self.names, Taxonomy) else self.names.taxonomy()

    @property
    def export(self) -> DataFrame:
        """The caller's columns and the four result columns, nothing internal."""
        out = self.themed if self.themed is not None else self.labelled.withColumn("multi_tags", F.lit(""))
        results = [c for c in RESULT_COLUMNS if c not in self.columns]
        return out.select(*[F.col(f"`{c}`") for c in [*self.columns, *results]])


    def save_csv(self, path: str) -> dict:
        """Write the export and return its totals, taken while it was written."""
        rows, seen = observed(self.export)
        export_csv(rows, path)
        return seen.get

    def save_run(self, path: str, run_id: str) -> dict:
        """Save the export as a run (a rerun replaces itself) and return its totals."""
        rows, seen = observed(self.export)
        write_run(rows, path, run_id)
        return seen.get


# ----------------------------------------------------------------- helpers --

def _rounds(n_batches: int, round_batches: int | None) -> list[tuple[int, int]]:
    out, lo, size = [], 0, 1
    while lo < n_batches:
        step = round_batches if round_batches else size
        out.append((lo, min(n_batches, lo + step)))
        lo += step
        size *= 2
    return out


def _decide(requests: DataFrame, decider: str, responses: DataFrame | None, call_factory,
            concurrency: int | None = None) -> DataFrame:
    if decider == "replay":
        if responses is None:
            raise TicketError(["replay decider needs a responses table"])
        return replay_requests(requests, responses)
    if decider == "callable":
        if call_factory is None:
            raise TicketError(["callable decider needs call_factory"])
        return call_requests(requests, call_factory, concurrency)
    raise TicketError([f"unknown decider: {decider}"])


def name_words(name: str) -> tuple[str, ...]:
    """Keywords of a bare category name: its lower-case ASCII words."""
    import re

    from ..operators.taxonomy import STOP_WORDS

    return tuple(dict.fromkeys(w for w in re.split("[^a-z]+", name.lower()) if len(w) > 2 and w not in STOP_WORDS))


def name_pairs(names, threshold: float) -> list[tuple[str, str, float]]:
    """Token-set Jaccard ≥ threshold among the driver-held category names.

    The same exact prefix filter as ``quality.similar_names`` (the Spark form
    for name tables of any size): tokens ordered rarest first, and only names
    sharing a token of their prefixes become candidates, so a common token
    never pairs every name with every other.
    """
    import math
    import re
    from collections import Counter, defaultdict

    toks = {n: {t for t in re.split("[^a-z0-9]+", n.lower()) if t} for n in set(names)}
    toks = {n: t for n, t in toks.items() if t}
    freq = Counter(t for ts in toks.values() for t in ts)
    order = {n: sorted(ts, key=lambda t: (freq[t], t)) for n, ts in toks.items()}

    def prefix(n: str, share: float) -> list[str]:
        k = len(order[n])
        return order[n][: k - math.ceil(share * k - 1e-9) + 1]

    index = defaultdict(list)                       # prefix token -> names (index side)
    for n in order:
        for t in prefix(n, 2 * threshold / (1 + threshold)):
            index[t].append(n)
    cand = set()
    for y in order:                                 # probe side: the longer (or equal) set
        for t in prefix(y, threshold):
            for x in index.get(t, ()):
                if x != y and len(toks[x]) <= len(toks[y]) and len(toks[x]) >= threshold * len(toks[y]) - 1e-9:
                    cand.add((min(x, y), max(x, y)))
    out = []
    for a, b in sorted(cand):
        inter, union = len(toks[a] & toks[b]), len(toks[a] | toks[b])
        if inter >= threshold * union - 1e-12:
            out.append((a, b, inter / union))
    return out


def _discover(tickets: DataFrame, taxonomy: Taxonomy, k: int) -> Taxonomy:
    """Lexical discovery (DEC4): one category per frequent term, by document
    frequency over all tickets (the sample belongs to auto-suggest only)."""
    terms = suggest_terms(tickets, k=k).collect()
    cats = list(taxonomy.categories)
    have = {c.name for c in cats}
    for r in terms:
        name = f"Term: {r['term']}"
        if name not in have:
            cats.append(Category(name, (r["term"],), 1, "discovered"))
    return Taxonomy(cats)


def _positioned(tickets: DataFrame, order_key: str, dense: bool) -> DataFrame:
    """Tickets with their order in ``pos``: by the order key, else in file order
    (``_row``).  Model replies are matched by slot, so their deciders need dense
    positions whatever the key's gaps; the lexical one only needs the order."""
    key = order_key if order_key in tickets.columns else "_row"
    if key not in tickets.columns:
        raise TicketError([f"no order key: the table has neither '{order_key}' nor the reader's '_row'"])
    if not dense and isinstance(tickets.schema[key].dataType, IntegralType):
        return tickets if key == "pos" else tickets.withColumn("pos", F.col(key).cast("long"))
    if key == "pos":
        tickets, key = tickets.withColumnRenamed("pos", "_key"), "_key"
    return assign_positions(tickets, key, "pos").drop("_key")


# --------------------------------------------------------------------- run --

def run(tickets: DataFrame, *args, **kwargs) -> RunResult:
    """Categorise a normalised ticket table; see ``_run`` for the arguments.

    Every intermediate table of the run is written below one folder of the
    checkpoint folder (``RunResult.scratch``); drop it once the results are
    exported.
    """
    with scratch_scope(tickets.sparkSession, "run") as folder:
        res = _run(tickets, *args, **kwargs)
    res.scratch = folder
    return res


def _run(
    tickets: DataFrame,
    context: str,
    mode: str = "manual_list",
    categories=None,
    depth: str = "primary",
    decider: str = "lexical",
    taxonomy: Taxonomy | None = None,
    responses: DataFrame | None = None,
    tag_responses: DataFrame | None = None,
    review_response: str | None = None,
    call_factory: Callable[[], Callable[[str], str]] | None = None,
    config: RunConfig | None = None,
) -> RunResult:
    """Categorise a normalised ticket table (see ``operators.normalise``).

    NRM12 mode dispatch: ``no_suggestions`` starts from an empty list (the
    lexical decider discovers terms), ``manual_list`` / ``auto_suggest`` seed
    the list with ``categories`` (or a keyword ``taxonomy``); the request
    rule text differs only between ``no_suggestions`` and the rest.
    """
    cfg = config or RunConfig()
    problems = check_context(context)
    if mode not in MODES:
        problems.append(f"unknown mode: {mode}")
    if mode == "manual_list" and taxonomy is None:
        problems += check_manual_list(categories)
    if depth not in ("primary", "full"):
        problems.append(f"unknown depth: {depth}")
    if mode == "auto_suggest" and taxonomy is None:
        problems += check_auto_mode(tickets.count(), categories)
    if problems:
        raise TicketError(problems)

    seed = taxonomy or Taxonomy.from_names(clean_category_list(categories) if mode != "no_suggestions" else [])
    columns = [c for c in tickets.columns if c not in INTERNAL_COLUMNS or c == cfg.order_key != "pos"]
    batched = assign_batches(_positioned(tickets, cfg.order_key, dense=decider != "lexical"), cfg.batch_size)

    if decider == "lexical":
        if taxonomy is not None:
            tax = taxonomy
        elif mode == "no_suggestions":
            tax = _discover(batched, Taxonomy([]), cfg.discover_terms)
        else:
            tax = Taxonomy([Category(c.name, name_words(c.name), 1, c.source) for c in seed.categories])
        # the lexical labels are a projection of each row: only the category
        # column is written (for the count table); the labelled rows stay a
        # projection of the source, recomputed by each reader or retried task
        # instead of writing a second copy of every text
        labels = label_lexical(batched, tax, with_tags=(depth == "full"))
        if cfg.low_to_uncategorised:
            labels = low_to_uncategorised(labels)
        # one pass over the texts gives the aggregated (category, term) table
        # with one null-term row per category holding its ticket count: the
        # threshold is decided on those rows and the summaries come from the
        # folded table (exact: a ticket has one category, so counts add)
        terms = materialize(cns.term_table(labels), "terms")
        rows = terms.filter(F.col("term").isNull()).limit(len(tax.categories) + 3).collect()
        if len(rows) > len(tax.categories) + 2:
            raise TicketError(["the lexical decider produced names outside its taxonomy"])
        raw_counts = {r["category"]: r["df"] for r in rows}
        # AGG2 on the count table: every label is a name of the caller's
        # taxonomy or Uncategorised; the decision is applied as a literal fold
        # over the labels (no join, no second write of the texts)
        small = small_categories(raw_counts, cfg.min_bucket, cfg.min_fraction)
        labelled = fold_small(labels, small)
        review, plan = _lexical_review(terms, small, fold_counts(raw_counts, small), cfg)
        labelled = cns.apply_mapping(labelled, plan.mapping)
    else:
        # a model may name a category per ticket, so names, counts, threshold and
        # merges stay tables; the labels of the rounds are written already
        rounds = _collapsed_rounds if cfg.collapse_copies else _model_rounds
        tax, labels = rounds(batched, context, mode, seed, decider, responses, call_factory, cfg)
        if cfg.low_to_uncategorised:
            labels = low_to_uncategorised(labels)
        labelled, counts = fold_small_table(labels, cfg.min_bucket, cfg.min_fraction)
        review, plan = _consolidate(labelled, context, decider, review_response, call_factory, cfg, counts)
        if plan.table is not None:
            labelled = apply_merge_map(labelled, plan.table)

    themed = None
    if depth == "full":
        if decider == "lexical":
            themed = join_tags(labelled)
        else:
            names = materialize(ranked(unseen(labelled, seed_names(tickets.sparkSession, Taxonomy([]))), 0), "themes")
            if cfg.collapse_copies:
                themed = _collapsed_tags(labelled, context, names, decider, tag_responses, call_factory, cfg)
            else:
                req = tag_requests(labelled, context, names)
                resp = materialize(_decide(req, decider, tag_responses, call_factory, cfg.concurrency), "tag_replies")
                parsed = parse_replies(resp, req)
                themed = apply_tag_replies(labelled, parsed)
    return RunResult(labelled=labelled, names=tax, merges=plan, review=review, themed=themed, columns=columns)


ROUND_COL = "acc_round"


def _round_of(batch_id, rounds: list[tuple[int, int]], round_batches: int | None):
    """Round index of a batch: ``batch_id div round_batches`` for fixed rounds,
    else the bucket of the geometric round bounds (a few dozen at most)."""
    if round_batches:
        return F.floor(batch_id / F.lit(round_batches)).cast("int")
    return bucket_of(batch_id, [lo for lo, _ in rounds[1:]])


def _model_rounds(batched, context, mode, seed, decider, responses, call_factory, cfg):
    last = batched.agg(F.max("batch_id")).first()[0]
    n_batches = 0 if last is None else last + 1
    names = NameTable(batched.sparkSession, seed)
    if not n_batches:
        return names, batched.withColumns(
            {c: F.lit(None).cast("string") for c in ("new_category", "confidence", "reasoning")})
    rounds = _rounds(n_batches, cfg.round_batches)
    # the positioned tickets are written once, one folder per round: a round
    # reads its own folder (partition pruning) instead of re-running the
    # position window over the whole table
    staged = materialize(batched.withColumn(ROUND_COL, _round_of(F.col("batch_id"), rounds, cfg.round_batches)),
                         "batched", partition_by=ROUND_COL)
    # recorded replies (replay) are staged the same way, so a round reads
    # only its own replies instead of scanning the whole log again
    recorded = None
    if responses is not None:
        recorded = materialize(responses.withColumn(ROUND_COL, _round_of(F.col("batch_id"), rounds, cfg.round_batches)),
                               "recorded", partition_by=ROUND_COL)
    parts = []
    for i, (lo, hi) in enumerate(rounds):
        part = staged.filter(F.col(ROUND_COL) == i).drop(ROUND_COL)
        req = categorise_requests(part, context, mode, names.table)
        mine = recorded.filter(F.col(ROUND_COL) == i).drop(ROUND_COL) if recorded is not None else None
        resp = _decide(req, decider, mine, call_factory, cfg.concurrency)
        resp = materialize(resp, "replies")          # the record: retries never re-call the model
        parsed = parse_replies(resp, req)
        applied = materialize(apply_replies(part, parsed, cfg.align), "round")
        parts.append(applied)
        names.add(applied)
    labels = parts[0]
    for p in parts[1:]:
        labels = labels.unionByName(p)
    return names, labels


def _collapsed_rounds(batched, context, mode, seed, decider, responses, call_factory, cfg):
    """The model rounds over the first copy of every exact-copy group; the
    decisions are joined back onto all copies (``operators.copies``).
    Batches are formed over the representatives in first-copy order, so
    ``responses`` of a replay run refer to those batches."""
    from ..operators import copies as cp

    parts = cp.collapse_parts(batched.sparkSession)
    keyed = batched.drop("batch_id", "batch_pos").withColumn(cp.COPY_KEY, cp.copy_key())
    reps = materialize(cp.first_copies(keyed, "pos"), "first_copies")
    hot = cp.hot_keys(reps, parts)
    rep_batches = assign_batches(
        assign_positions(reps.withColumnRenamed("pos", "_first_pos"), "_first_pos", "pos", written=True), cfg.batch_size
    )
    names, rep_labels = _model_rounds(rep_batches, context, mode, seed, decider, responses, call_factory, cfg)
    decided = rep_labels.select(cp.COPY_KEY, "new_category", "confidence", "reasoning")
    rows = assign_batches(keyed, cfg.batch_size)
    return names, materialize(cp.spread_back(rows, decided, hot, parts).drop(cp.COPY_KEY), "labels")


def _collapsed_tags(labelled, context, names, decider, tag_responses, call_factory, cfg):
    """MTG1 over the first copy of every exact-copy group; the tags are joined
    back onto all copies (same key and salting as the primary pass)."""
    from ..operators import copies as cp

    parts = cp.collapse_parts(labelled.sparkSession)
    keyed = labelled.withColumn(cp.COPY_KEY, cp.copy_key())
    reps = materialize(cp.first_copies(keyed.select(cp.COPY_KEY, "pos", "ticket_id", "issue_description"), "pos"),
                       "first_copies")
    hot = cp.hot_keys(reps, parts)
    rep_batches = assign_batches(
        assign_positions(reps.withColumnRenamed("pos", "_first_pos"), "_first_pos", "pos", written=True), cfg.batch_size
    )
    req = tag_requests(rep_batches, context, names)
    resp = materialize(_decide(req, decider, tag_responses, call_factory, cfg.concurrency), "tag_replies")
    parsed = parse_replies(resp, req)
    tags = apply_tag_replies(rep_batches, parsed).select(cp.COPY_KEY, "multi_tags")
    return cp.spread_back(keyed, tags, hot, parts).drop(cp.COPY_KEY)


def name_groups(pairs) -> list[tuple[str, ...]]:
    """Connected groups of the paired names, each sorted, in order of their first name."""
    group: dict[str, set] = {}
    for a, b, *_ in pairs:
        both = group.get(a, {a}) | group.get(b, {b})
        group.update(dict.fromkeys(both, both))
    return sorted({tuple(sorted(g)) for g in group.values()})


def _lexical_review(terms: DataFrame, small: list[str], counts: dict, cfg: RunConfig):
    """DEC5-DEC7 without a model, all from the aggregated (category, term) table.

    Names in one similarity group merge into the group's first name, in one
    step, so a chain of similar names ends in one category.  Summaries are
    taken from the term table after the final mapping.  Pairs that are similar
    but below the merge threshold are flagged."""
    names = sorted(c for c in counts if c and c != UNCATEGORISED)
    merged = name_groups(name_pairs(names, cfg.merge_similarity))
    plan = cns.fold_merges(counts, [(g, g[0]) for g in merged])
    folded = cns.remap_terms(cns.remap_terms(terms, {c: UNCATEGORISED for c in small}), plan.mapping)
    summaries = {r["category"]: r["summary"] for r in cns.summaries_from_terms(folded).collect()}
    top = [r["term"] for r in folded.where((F.col("category") == UNCATEGORISED) & F.col("term").isNotNull())
           .orderBy(F.desc("df"), "term").limit(cfg.uncategorised_terms).collect()]
    plan.summaries = summaries
    done = {frozenset(p) for g in merged for p in itertools.combinations(g, 2)}
    flags = [cns.FLAG_FORMAT.format(a=a, b=b, pct=round(100 * j)) for a, b, j in name_pairs(names, cfg.flag_similarity)
             if frozenset((a, b)) not in done]
    return {
        "narrative": cns.narrative_line(plan.counts),
        "category_summaries": plan.summaries,
        "merge_flags": flags,
        "uncategorised_analysis": [cns.THEME_FORMAT.format(term=t) for t in top],
        "transparency_log": plan.log,
    }, plan


def suggest_categories(tickets: DataFrame, context: str, decider: str = "lexical", response: str | None = None,
                       call_factory=None, k: int = 10, id_col: str = "ticket_id") -> list[str]:
    """Auto-suggest: sample the tickets (SMP1), ask the decider for a starting
    list (PRM4, or the sample's most frequent terms), parse it (PAR5).  A failed
    or unusable reply gives no names."""
    problems = check_context(context)
    if problems:
        raise TicketError(problems)
    n = sample_size(tickets.count())
    sample = suggestion_sample(tickets, n, id_col)
    if decider == "lexical":
        return [f"Term: {r['term']}" for r in suggest_terms(sample, k=k).collect()]
    request = suggest_request(sample, context, n).withColumn("batch_id", F.lit(0).cast("long"))
    if decider == "callable":
        got = call_requests(request, call_factory, 1).select("raw")
    elif decider == "replay":
        got = request.select(F.lit(response).cast("string").alias("raw"))
    else:
        raise TicketError([f"unknown decider: {decider}"])
    return list(got.select(parse_name_list(F.coalesce("raw", F.lit(""))).alias("names")).first()["names"])


class BlankSummaries(Mapping):
    """An empty summary for every category of a count table, which is read only
    when somebody looks at them."""

    def __init__(self, counts: DataFrame):
        self.counts = counts

    @cached_property
    def _names(self) -> dict:
        return {r["category"]: "" for r in self.counts.select("category").collect()}

    def __getitem__(self, name):
        return self._names[name]

    def __iter__(self):
        return iter(self._names)

    def __len__(self):
        return len(self._names)


def _consolidate(labelled: DataFrame, context: str, decider: str, review_response, call_factory, cfg,
                 counts: DataFrame | None = None):
    """CNS0: counts (CNS1; counted here unless passed in as a table), first samples
    per category and first Uncategorised rows (CNS2), one review request, then the
    merges as tables (``operators.merges``).  A failed call gives no merges, empty
    summaries and one "unavailable" note (CNS3); malformed merge entries parse to
    empty sources and are skipped (CNS4)."""
    if counts is None:
        counts = materialize(cns_counts_df(labelled), "counts")
    samples = category_samples(labelled, 3, order_col="pos")
    unc = uncategorised_head(labelled, 10, order_col="pos").select("pos", "issue_description")
    req = review_request(counts, samples, unc, context).withColumn("batch_id", F.lit(0).cast("long"))
    if decider == "replay":
        if review_response is None:
            resp = req.select("batch_id", F.lit(None).cast("string").alias("raw"), F.lit("no recorded response").alias("error"))
        else:
            resp = req.select("batch_id", F.lit(review_response).alias("raw"), F.lit(None).cast("string").alias("error"))
    else:
        resp = call_requests(req, call_factory, cfg.concurrency)
    row = resp.select("error", parse_review(F.coalesce(F.col("raw"), F.lit(""))).alias("v")).first()
    if row["error"] is not None:
        blank = BlankSummaries(counts)
        review = {"category_summaries": blank, "merge_flags": [],
                  "uncategorised_analysis": [cns.UNAVAILABLE.format(error=row["error"])]}
        return review, cns.MergePlan(summaries=blank)
    v = row["v"]
    plan = cns.MergePlan(summaries=dict(v["category_summaries"] or {}))
    # the merges of one reply
    merges = [(no, list(m["merge_these"] or ()), m["into"] or "") for no, m in enumerate(v["auto_merges"] or [], start=1)]
    if merges:
        tables = MergeTables(counts.select("category", "n"), labelled.sparkSession.createDataFrame(merges, MERGE_SCHEMA))
        plan.table = tables.mapping
        for r in tables.log().orderBy("merge_no").collect():
            _, sources, target = merges[r["merge_no"] - 1]
            plan.log.append(r["log"])
            plan.applied.append((r["merge_no"], r["tickets"]))
            plan.summaries = cns.summaries_after(plan.summaries, sources, target, cfg.keep_target_summary)
    review = {
        "narrative": v["narrative"],
        "category_summaries": plan.summaries,
        "merge_flags": list(v["merge_flags"] or []),
        "uncategorised_analysis": list(v["uncategorised_analysis"] or []),
        "transparency_log": plan.log,
    }
    return review, plan


def cns_counts_df(labelled: DataFrame) -> DataFrame:
    return (
        labelled.filter(F.col("new_category").isNotNull())
        .groupBy(F.col("new_category").alias("category"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    )
