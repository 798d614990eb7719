"""The registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame
over the driver tables, built from the operators of this package.

Tickets come from ``documents`` (id ``DOC-<doc_id>``, description = text,
label = source, order key = doc_id); already-labelled reports also run over
``events`` (category = event_type, order = event_id, batch = event_id div 10).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import cut
from ..operators import consolidate as cns
from ..operators import quality as qlt
from ..operators import reports as rpt
from ..operators import themes as thm
from ..operators.deciders import label_lexical
from ..operators.normalise import UNCATEGORISED
from ..operators.ordering import BUCKET, assign_batches, assign_positions, positions_by_bucket, straddling_batches
from ..operators.prompts import categorise_requests, tag_requests
from ..operators.responses import apply_replies, parse_replies, parse_replies_strict
from ..operators.taxonomy import (
    MIN_BUCKET, Taxonomy, apply_threshold, first_seen, fold_small, sample_size, small_categories, suggest_terms,
    suggestion_sample,
)
from ..session import materialize
from ..sources.tables import conversation_tickets, document_tickets, table

# --- fixed values -----------------------------------------------------------
CONTEXT = "Invented multilingual documents from a synthetic crawl, read as support tickets"
MODE = "manual_list"
# Literal merge list for the merge queries: a chain, a merge into one of its
# own sources, a plain merge, unknown sources, and an empty target.
MERGES = (
    (("German Text", "French Text"), "Continental Text"),
    (("Continental Text", "Spanish Text"), "Continental Text"),
    (("Licence Notice", "Contact Data"), "Notice Or Contact"),
    (("No Such Category",), "Ghost"),
    (("English Text",), ""),
)
SIMILARITY = 0.5
DISPLAY_HEAD = 101        # longest description cut shown or sent (100) plus one
MERGE_AT = 0.8
MAX_FLAGS = 3
PROFILE_OVERLAP = 0.1     # Jaccard of two vocabularies reported as an overlap
# -----------------------------------------------------------------------------

ORDER = "doc_id"


def taxonomy() -> Taxonomy:
    return Taxonomy.starter()


def tickets(spark: SparkSession, d: str) -> DataFrame:
    return document_tickets(spark, d)


def lexical(spark: SparkSession, d: str, tags: bool = False) -> DataFrame:
    return label_lexical(tickets(spark, d), taxonomy(), with_tags=tags)


def fold_list(lab: DataFrame) -> list[str]:
    """AGG2 decision on the count table: named categories below the threshold.

    The count table has at most |taxonomy| + 1 rows (the lexical decider only
    emits taxonomy names or Uncategorised), so it is safe on the driver.
    """
    return small_categories(cns.collect_counts(lab, limit=len(taxonomy().categories) + 1), MIN_BUCKET)


fold = fold_small


def narrow(spark: SparkSession, d: str, tags: bool = False) -> DataFrame:
    """Thresholded labels without the text: the texts are tokenised once, the
    narrow result is written under the checkpoint folder and read back, and
    the count table and the rows both come from that copy.

    ``desc_head`` keeps the first ``DISPLAY_HEAD`` characters of the
    description: every display or prompt cut of the reports (80 or 100
    characters, with ``...`` when longer) is taken exactly from it, so no
    report scans the texts a second time.  Labels use the whole texts."""
    cols = ["doc_id", "ticket_id", "current_label", "new_category", "confidence", "reasoning"] + (["tags"] if tags else [])
    head = F.substring("issue_description", 1, DISPLAY_HEAD).alias("desc_head")
    lab = materialize(lexical(spark, d, tags).select(*cols, head), "labels")
    return fold(lab, fold_list(lab))


def facts_table(spark: SparkSession, d: str) -> DataFrame:
    """Per category after the threshold: tickets, first position, Low tickets.  Scan,
    label, aggregate, and the threshold on the count table: no row is written."""
    return cns.fold_facts(cns.category_facts(lexical(spark, d), order_col=ORDER), MIN_BUCKET)


def shown(lab: DataFrame) -> DataFrame:
    """The narrow labels with the description head in the description's place
    (for the display and prompt cuts only)."""
    return lab.withColumnRenamed("desc_head", "issue_description")


def batched(spark: SparkSession, d: str) -> DataFrame:
    return assign_batches(assign_positions(tickets(spark, d), ORDER))


def bucketed_batches(spark: SparkSession, d: str) -> tuple[DataFrame, list[int]]:
    """Batches that keep their position bucket, and the batches crossing a
    bucket border: request texts are joined inside the position window's
    partitioning, so the texts cross one exchange, not two."""
    pos, offsets = positions_by_bucket(tickets(spark, d), ORDER)
    return assign_batches(pos), straddling_batches(offsets)


# ------------------------------------------------------------------ queries --

def q_normalise_tickets(spark, d):
    return tickets(spark, d)


def q_conversation_tickets(spark, d):
    return conversation_tickets(spark, d)


def q_batch_assignment(spark, d):
    return batched(spark, d).select("ticket_id", "pos", "batch_id", "batch_pos")


# --- fixed values -----------------------------------------------------------
GROUP_ROWS = 1000         # rows of a hash group of the order-free batching query (about)
# -----------------------------------------------------------------------------


def q_unordered_batches(spark, d):
    """ORD3: order-free batches over every ticket (hash group of the id, then
    10 consecutive ids within the group); no global order, no hot group."""
    from ..operators.ordering import assign_batches_unordered

    t = tickets(spark, d)
    return assign_batches_unordered(t, spread=max(1, -(-t.count() // GROUP_ROWS))).select("ticket_id", "batch_id", "batch_pos")


def q_categorise_requests(spark, d):
    b, cross = bucketed_batches(spark, d)
    req = categorise_requests(b, CONTEXT, MODE, taxonomy().names, part=BUCKET, straddlers=cross)
    return req.select("batch_id", "n_tickets", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("prompt_chars"))


def q_tag_requests(spark, d):
    """PRM2: the final category list (first-seen order of the thresholded
    labels, one row per category) is the driver scalar of every request."""
    lab = narrow(spark, d)
    names = [r["category"] for r in first_seen(lab, order_col=ORDER).orderBy("ordinal").collect()]
    b, cross = bucketed_batches(spark, d)
    req = tag_requests(b, CONTEXT, names, part=BUCKET, straddlers=cross)
    return req.select("batch_id", "n_tickets", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("prompt_chars"))


def q_lexical_primary(spark, d):
    return lexical(spark, d).select("ticket_id", "new_category", "confidence", "reasoning")


def q_threshold_labels(spark, d):
    """DEC2 + AGG2 through the generic path: narrow labels written once, counts
    from them, small categories broadcast (bounded by the taxonomy size)."""
    narrow = materialize(lexical(spark, d).select("ticket_id", ORDER, "new_category", "confidence", "reasoning"), "labels")
    out = apply_threshold(narrow, order_col=ORDER, max_categories=len(taxonomy().categories) + 1)
    return out.select("ticket_id", "new_category", "confidence", "reasoning")


def q_category_distribution(spark, d):
    return rpt.distribution_of_counts(facts_table(spark, d).where(F.col("category").isNotNull()))


def q_event_distribution(spark, d):
    ev = table(spark, d, "events").select(F.col("event_type").alias("new_category"), "event_id")
    return rpt.distribution(ev, order_col="event_id")


def q_low_confidence_view(spark, d):
    return rpt.results_table(shown(narrow(spark, d)), low_only=True)


def q_category_samples(spark, d):
    s = rpt.category_samples(shown(narrow(spark, d)), 3, order_col=ORDER)
    return s.select("category", "rn", "ticket_id", cut("issue_description", 80).alias("description"))


def q_uncategorised_head(spark, d):
    h = rpt.uncategorised_head(shown(narrow(spark, d)), 10, order_col=ORDER)
    return h.select("ticket_id", cut("issue_description", 100).alias("description"))


def _events_batched(spark, d):
    ev = table(spark, d, "events")
    return ev.select(
        F.col("event_type").alias("new_category"), "event_id",
        F.floor(F.col("event_id") / 10).cast("long").alias("batch_id"),
    )


def q_running_categories(spark, d):
    return rpt.running_categories(_events_batched(spark, d)).select("batch_id", "new_categories", "categories_so_far")


def q_taxonomy_first_seen(spark, d):
    return first_seen(_events_batched(spark, d), order_col="event_id").select("ordinal", "category", "first_pos", "n")


def _themed(spark, d):
    """Tags do not depend on the threshold: a projection of the scan."""
    return thm.join_tags(lexical(spark, d, tags=True).select("ticket_id", ORDER, "tags"))


def q_multi_tags(spark, d):
    return _themed(spark, d).select("ticket_id", "multi_tags")


def q_theme_counts(spark, d):
    return thm.theme_counts(_themed(spark, d), order_col=ORDER).select("theme", "n")


def q_top_themes(spark, d):
    return thm.top_themes(_themed(spark, d), 3, order_col=ORDER)


def _merge_plan(spark, d):
    lab = narrow(spark, d)
    counts = cns.collect_counts(lab)
    return lab, cns.fold_merges(counts, MERGES)


def q_apply_merges(spark, d):
    lab, plan = _merge_plan(spark, d)
    return cns.apply_mapping(lab, plan.mapping).select("ticket_id", "new_category")


def q_merge_log(spark, d):
    """CNS6: the fold runs on the count table; its few log lines are returned
    as a DataFrame derived from that table (no fixed input)."""
    lab, plan = _merge_plan(spark, d)
    rows = cns.merge_log_rows(plan)
    return spark.createDataFrame(rows, "merge_no int, log string, tickets long")


def folded_terms(spark, d):
    """Per (thresholded category, term) the number of tickets holding the term,
    from one tokenisation pass: the term table of the raw labels is written
    once, the threshold is decided on its per-category rows and applied to
    the aggregated table (exact, tickets belong to one category)."""
    terms = materialize(cns.term_table(lexical(spark, d)), "terms")
    counts = {r["category"]: r["df"] for r in terms.filter(F.col("term").isNull()).collect()}
    small = {c: UNCATEGORISED for c, n in counts.items() if c != UNCATEGORISED and n < MIN_BUCKET}
    return cns.remap_terms(terms, small)


def q_category_overlap(spark, d):
    """QLT4 / DEC5 by content: pairs of named categories whose vocabularies
    (all terms of all their tickets) overlap."""
    pairs = qlt.content_overlap(folded_terms(spark, d), PROFILE_OVERLAP)
    return pairs.select(F.col("name_a").alias("category_a"), F.col("name_b").alias("category_b"),
                        "shared", "union_size", "jaccard")


def q_category_breakdown(spark, d):
    """DEC6 + JON6/RPT4 in one tokenisation pass: terms are counted per raw
    category (null term = ticket count), the small aggregated table is
    written once, the threshold fold is decided on its counts and applied to
    it, then summaries and the breakdown are read off it."""
    folded = folded_terms(spark, d)
    per_cat = folded.filter(F.col("term").isNull()).select(F.col("category").alias("_cat"), F.col("df").alias("n"))
    return rpt.breakdown_from_counts(cns.summaries_from_terms(folded), per_cat)


def q_suggest_sample(spark, d):
    t = tickets(spark, d)
    n = sample_size(t.count())
    return suggestion_sample(t, n).select("ticket_id", "sample_key")


def q_suggest_terms(spark, d):
    t = tickets(spark, d)
    n = sample_size(t.count())
    terms = suggest_terms(suggestion_sample(t, n), k=10)
    return terms.select(F.row_number().over(_w_terms()).alias("rank"), "term", "df")


def _w_terms():
    from pyspark.sql import Window

    return Window.orderBy(F.desc("df"), "term")


def labelled_batches(spark: SparkSession, d: str, tags: bool = False) -> DataFrame:
    """Lexical labels of every ticket with positions and batches, written once.

    The texts are tokenised in one projection before anything is shuffled;
    positions are then taken on the narrow label table, so no text crosses
    the position window's exchange, and the replies, the request sizes and
    the ticket side of the apply all read this one copy."""
    cols = ["ticket_id", ORDER, "lang", "new_category", "confidence", "reasoning"] + (["tags"] if tags else [])
    # written before positioning: the label metrics node keeps the scorer
    # alive in every job over it, so the quantile and bucket-total jobs of
    # the positions read this narrow copy instead of re-tokenising the texts
    lab = materialize(label_lexical(tickets(spark, d), taxonomy(), with_tags=tags).select(*cols), "labels")
    return materialize(assign_batches(assign_positions(lab, ORDER, written=True)), "batch_labels")


def replies(spark, d):
    """Replies derived from the data: the lexical labels of each batch encoded
    as a JSON reply, varied by the language of the batch's first ticket:
    en plain, fr fenced with ``json``, de fenced without ``confidence`` keys,
    es one element short (a length mismatch)."""
    b = labelled_batches(spark, d)
    per = b.groupBy("batch_id").agg(
        F.min_by("lang", "batch_pos").alias("first_lang"),
        F.sort_array(F.collect_list(F.struct("batch_pos", "ticket_id", "new_category", "confidence", "reasoning"))).alias("_r"),
    )
    full = F.transform("_r", lambda x: F.struct(x["ticket_id"].alias("ticket_id"), x["new_category"].alias("new_category"),
                                               x["confidence"].alias("confidence"), x["reasoning"].alias("reasoning")))
    no_conf = F.transform("_r", lambda x: F.struct(x["ticket_id"].alias("ticket_id"), x["new_category"].alias("new_category"),
                                                  x["reasoning"].alias("reasoning")))
    raw = (
        F.when(F.col("first_lang") == "fr", F.concat(F.lit("```json\n"), F.to_json(full), F.lit("\n```")))
        .when(F.col("first_lang") == "de", F.concat(F.lit("```\n"), F.to_json(no_conf), F.lit("\n```")))
        .when(F.col("first_lang") == "es", F.to_json(F.slice(full, 1, F.size("_r") - 1)))
        .otherwise(F.to_json(full))
    )
    return b, per.select("batch_id", raw.alias("raw"), F.lit(None).cast("string").alias("error"))


# --- fixed values -----------------------------------------------------------
REPLAY_FAILED = "time out"
NAME_ITEMS = '"0", "", null, 0, 0.0, false, true, [], {}, "  ", 7'
# -----------------------------------------------------------------------------


def _replay_run(spark, d, key: str):
    """``run()`` with recorded replies over every ticket: new names are
    discovered (``From <source>``), every seventh batch failed, and every fifth
    one gives its first ticket an explicit null."""
    from .run import RunConfig, run

    # the run's own batches: ten tickets in the order of the key
    narrow_ = materialize(tickets(spark, d).select("ticket_id", ORDER, "current_label"), "replay_tickets")
    b = assign_batches(assign_positions(narrow_, ORDER, written=True))
    name = F.when((F.col("batch_id") % 5 == 2) & (F.col("batch_pos") == 0), F.lit(None)).otherwise(F.concat(F.lit("From "), "current_label"))
    obj = F.struct("batch_pos", F.col("ticket_id").alias("ticket_id"), name.alias("new_category"), F.lit("High").alias("confidence"), F.lit("r").alias("reasoning"))
    per = b.groupBy("batch_id").agg(F.sort_array(F.collect_list(obj)).alias("_r"))
    failed = F.col("batch_id") % 7 == 3
    raw = F.to_json(F.transform("_r", lambda x: x.dropFields("batch_pos")), {"ignoreNullFields": "false"})
    log = per.select("batch_id", F.when(~failed, raw).alias("raw"), F.when(failed, F.lit(REPLAY_FAILED)).alias("error"))
    t = tickets(spark, d)
    t = t.withColumn("gap_key", F.col(ORDER) * 7 + 3)
    res = run(t, CONTEXT, mode="no_suggestions", decider="replay", responses=log, config=RunConfig(order_key=key))
    return res.export.select("ticket_id", "new_category", "confidence", "reasoning")


def q_run_replay(spark, d):
    return _replay_run(spark, d, ORDER)


def q_run_sparse_key(spark, d):
    """The same run ordered by a key with gaps: replies still meet their slots."""
    return _replay_run(spark, d, "gap_key")


def q_parse_name_list(spark, d):
    """PAR5 over one reply per ticket: plain (en), fenced (de), with text after
    the list (fr), with single quotes (es)."""
    from ..operators.responses import parse_name_list

    body = F.concat(F.lit('["'), "ticket_id", F.lit(f'", {NAME_ITEMS}]'))
    raw = (F.when(F.col("lang") == "de", F.concat(F.lit("```json\n"), body, F.lit("\n```")))
           .when(F.col("lang") == "fr", F.concat(body, F.lit(" as asked")))
           .when(F.col("lang") == "es", F.replace(body, F.lit('"'), F.lit("'")))
           .otherwise(body))
    names = parse_name_list(raw)
    return tickets(spark, d).select("ticket_id", F.size(names).alias("n_names"), F.array_join(names, "|").alias("names"))


def _requests(b):
    return b.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_tickets"))


def q_parse_responses(spark, d):
    b, rep = replies(spark, d)
    return parse_replies(rep, _requests(b)).select("batch_id", "n_tickets", "ok")


def q_strict_json(spark, d):
    b, rep = replies(spark, d)
    return parse_replies_strict(rep, _requests(b)).select("batch_id", "n_tickets", "ok")


def q_apply_responses(spark, d):
    b, rep = replies(spark, d)
    parsed = parse_replies(rep, _requests(b))
    return apply_replies(b, parsed).select("ticket_id", "new_category", "confidence", "reasoning")


def _category_names(spark, d):
    """The category-like names of the data: every distinct ``p_name p_type``
    of the whole ``part`` table.  The scan and a partial-aggregated distinct
    grow with the table; the similarity join runs on the distinct names, so
    its pairs grow with the name vocabulary (as a taxonomy's do), not with
    the rows."""
    return table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("name")).distinct()


def q_near_duplicate_categories(spark, d):
    """QLT4: name pairs whose token sets reach the Jaccard threshold."""
    return qlt.similar_names(_category_names(spark, d), "name", SIMILARITY)


def q_merge_decisions(spark, d):
    """DEC5: near-identical names (Jaccard ≥ 0.8) merge, the three most
    similar of the uncertain band [0.5, 0.8) are flagged for review."""
    pairs = materialize(qlt.similar_names(_category_names(spark, d), "name", SIMILARITY), "pairs")
    return qlt.merge_decisions(pairs, hi=MERGE_AT, lo=SIMILARITY, max_flags=MAX_FLAGS)


def q_grouping_accuracy(spark, d):
    """QLT1: one contingency table over all tickets (a null label counts towards the
    threshold only), folded, then the labelled pairs."""
    gold = table(spark, d, "labels").select("doc_id", F.concat(F.lit("quality="), F.col("quality").cast("string")).alias("expected"), F.lit(1).alias("_in"))
    lab = lexical(spark, d).select("doc_id", "new_category").join(gold, "doc_id", "left")
    cont = lab.groupBy(F.col("new_category").alias("category"), "expected", "_in").agg(F.count(F.lit(1)).alias("k"))
    small = (F.sum("k").over(Window.partitionBy("category")) < MIN_BUCKET) & (F.col("category") != UNCATEGORISED)
    folded = cont.withColumn("category", F.when(small, F.lit(UNCATEGORISED)).otherwise(F.col("category"))).where("_in = 1")
    cont = folded.groupBy("category", "expected").agg(F.sum("k").alias("k"))
    return qlt.purity_of_counts(cont).select("category", "tickets", "majority", "majority_n", "purity_pct")


def q_run_facts(spark, d):
    return cns.facts_of_counts(facts_table(spark, d))


def q_uncategorised_rate(spark, d):
    return qlt.uncategorised_rate(facts_table(spark, d)).select("rows", "uncategorised", "rate_pct", "meets_target")


def q_confidence_mix(spark, d):
    return qlt.confidence_mix(lexical(spark, d))


def q_trend_by_day(spark, d):
    t = rpt.trend_by_day(table(spark, d, "events"))
    return t.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "category", "n", "change")


def q_stream_rounds(spark, d):
    from ..streaming.rounds import stream_categorise

    return stream_categorise(spark, d, taxonomy()).select("ticket_id", "new_category", "confidence", "reasoning")


def q_stream_category_counts(spark, d):
    """STR2: running category counts of the labelled document stream."""
    from ..streaming.rounds import stream_category_counts

    return stream_category_counts(spark, d, taxonomy())


def q_stream_event_windows(spark, d):
    from ..streaming.rounds import stream_window_counts

    return stream_window_counts(spark, d)


def q_review_request(spark, d):
    """PRM3: the one consolidation request over the thresholded labels."""
    from ..operators.prompts import review_request

    lab = shown(narrow(spark, d))
    counts = lab.filter(F.col("new_category").isNotNull()).groupBy(F.col("new_category").alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.min(ORDER).alias("first_pos"))
    samples = rpt.category_samples(lab, 2, order_col=ORDER).select("category", "rn", "issue_description")
    unc = rpt.uncategorised_head(lab, 10, order_col=ORDER).select(F.col(ORDER).alias("pos"), "issue_description")
    req = review_request(counts, samples, unc, CONTEXT)
    return req.select(F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("prompt_chars"))


def q_suggest_request(spark, d):
    """PRM4: the taxonomy-suggestion request built from the SMP1 sample."""
    from ..operators.prompts import suggest_request

    t = tickets(spark, d)
    n = sample_size(t.count())
    req = suggest_request(suggestion_sample(t, n), CONTEXT, n)
    return req.select(F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("prompt_chars"))


def q_stratified_sample(spark, d):
    """SMP2 (documented backlog): two tickets per current label."""
    from ..operators.taxonomy import stratified_sample

    return stratified_sample(tickets(spark, d), 2).select("ticket_id", "current_label", "sample_key")


def q_batch_metrics(spark, d):
    """RPT8: per batch tickets, failed rows and categories so far (before the threshold)."""
    lab = labelled_batches(spark, d).select("batch_id", "ticket_id", "new_category", "reasoning")
    return rpt.batch_metrics(lab).select("batch_id", "tickets", "failed", "new_categories", "categories_so_far")


def q_tag_total_check(spark, d):
    return thm.tag_total_check(_themed(spark, d))


def q_merge_safety(spark, d):
    """QLT5: agreement of each merge target with the expected quality label."""
    lab, plan = _merge_plan(spark, d)
    gold = table(spark, d, "labels").select("doc_id", F.concat(F.lit("quality="), F.col("quality").cast("string")).alias("expected"))
    return qlt.merge_safety(lab.join(gold, "doc_id"), plan.mapping, "expected")


def q_drill_down(spark, d):
    """FLT3 (documented backlog): the tickets of one category."""
    from ..operators.normalise import drill_down

    return drill_down(narrow(spark, d), "German Text").select("ticket_id", "confidence", "reasoning")


def q_conversation_labels(spark, d):
    """DEC2 over conversation tickets (descriptions plus resolution notes)."""
    return label_lexical(conversation_tickets(spark, d), taxonomy()).select("ticket_id", "new_category", "confidence", "reasoning")


def q_order_priority_distribution(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("new_category"), "o_orderkey")
    return rpt.distribution(o, order_col="o_orderkey")


def tag_replies(spark, d):
    """Theme replies derived from the data: each batch's lexical tags, varied
    by the first ticket's language: en plain, fr fenced, de tags as one string
    (joined letter by letter), es a null ``tags`` on the first element (the
    whole batch stays blank)."""
    b = labelled_batches(spark, d, tags=True)
    per = b.groupBy("batch_id").agg(
        F.min_by("lang", "batch_pos").alias("first_lang"),
        F.sort_array(F.collect_list(F.struct("batch_pos", "ticket_id", "tags"))).alias("_r"),
    )
    plain = F.transform("_r", lambda x: F.struct(x["ticket_id"].alias("ticket_id"), x["tags"].alias("tags")))
    as_str = F.transform("_r", lambda x: F.struct(x["ticket_id"].alias("ticket_id"), F.array_join(x["tags"], "").alias("tags")))
    nulled = F.transform("_r", lambda x: F.struct(
        x["ticket_id"].alias("ticket_id"),
        F.when(x["batch_pos"] == 0, F.lit(None).cast("array<string>")).otherwise(x["tags"]).alias("tags")))
    keep_nulls = {"ignoreNullFields": "false"}
    raw = (
        F.when(F.col("first_lang") == "fr", F.concat(F.lit("```json\n"), F.to_json(plain), F.lit("\n```")))
        .when(F.col("first_lang") == "de", F.to_json(as_str))
        .when(F.col("first_lang") == "es", F.to_json(nulled, keep_nulls))
        .otherwise(F.to_json(plain))
    )
    return b, per.select("batch_id", raw.alias("raw"), F.lit(None).cast("string").alias("error"))


def q_apply_tag_responses(spark, d):
    """MTG1 + PAR4 + MTG2 over replies derived from the data."""
    from ..operators.responses import apply_tag_replies

    b, rep = tag_replies(spark, d)
    return apply_tag_replies(b, parse_replies(rep, _requests(b))).select("ticket_id", "multi_tags")


def q_run_primary(spark, d):
    """The end-to-end ``run()`` at full depth with the lexical decider:
    labels, threshold, review (no name is similar enough to merge among the
    starter categories), themes.  The declared order key serves as the
    position (first-seen order and ties only need an order-preserving key),
    so no window moves the texts."""
    from ..plans.run import RunConfig, run

    res = run(tickets(spark, d), CONTEXT, MODE, taxonomy=taxonomy(), depth="full", config=RunConfig(order_key=ORDER))
    return res.export.select("ticket_id", "new_category", "confidence", "reasoning", "multi_tags")


def q_merged_facts(spark, d):
    """RPT9 + AGG8 after consolidation: facts over the merged labels and the
    number of merges applied (log lines)."""
    lab, plan = _merge_plan(spark, d)
    return cns.run_facts(cns.apply_mapping(lab, plan.mapping), order_col=ORDER, merges=len(plan.log))


def q_uncategorised_panel(spark, d):
    return rpt.uncategorised_panel(facts_table(spark, d))


# --- fixed values -----------------------------------------------------------
SEED_EVENT_CATEGORIES = ("click", "view")
# -----------------------------------------------------------------------------


def q_taxonomy_gaps(spark, d):
    """JON5: categories seen in the data but missing from a seed taxonomy
    (left anti join against the seed table, broadcast: its size is the seed
    list's), in first-seen order."""
    seed = Taxonomy.from_names(SEED_EVENT_CATEGORIES).to_df(spark).select(F.col("category").alias("new_category"))
    seen = first_seen(_events_batched(spark, d), order_col="event_id").withColumnRenamed("category", "new_category")
    gaps = seen.join(F.broadcast(seed), "new_category", "left_anti")
    return gaps.select(F.col("new_category").alias("category"), "first_pos", "n")


def q_run_narrative(spark, d):
    """DEC7: the facts briefing line (extractive stand-in for the model's prose)."""
    return cns.narrative(cns.facts_of_counts(facts_table(spark, d)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "normalise_tickets": q_normalise_tickets,
    "conversation_tickets": q_conversation_tickets,
    "batch_assignment": q_batch_assignment,
    "unordered_batches": q_unordered_batches,
    "categorise_requests": q_categorise_requests,
    "tag_requests": q_tag_requests,
    "lexical_primary": q_lexical_primary,
    "threshold_labels": q_threshold_labels,
    "category_distribution": q_category_distribution,
    "event_distribution": q_event_distribution,
    "low_confidence_view": q_low_confidence_view,
    "category_samples": q_category_samples,
    "uncategorised_head": q_uncategorised_head,
    "running_categories": q_running_categories,
    "taxonomy_first_seen": q_taxonomy_first_seen,
    "multi_tags": q_multi_tags,
    "theme_counts": q_theme_counts,
    "top_themes": q_top_themes,
    "apply_merges": q_apply_merges,
    "merge_log": q_merge_log,
    "category_breakdown": q_category_breakdown,
    "suggest_sample": q_suggest_sample,
    "suggest_terms": q_suggest_terms,
    "parse_responses": q_parse_responses,
    "strict_json": q_strict_json,
    "apply_responses": q_apply_responses,
    "near_duplicate_categories": q_near_duplicate_categories,
    "merge_decisions": q_merge_decisions,
    "category_overlap": q_category_overlap,
    "grouping_accuracy": q_grouping_accuracy,
    "run_facts": q_run_facts,
    "uncategorised_rate": q_uncategorised_rate,
    "confidence_mix": q_confidence_mix,
    "trend_by_day": q_trend_by_day,
    "run_replay": q_run_replay,
    "run_sparse_key": q_run_sparse_key,
    "parse_name_list": q_parse_name_list,
    "stream_rounds": q_stream_rounds,
    "stream_event_windows": q_stream_event_windows,
    "stream_category_counts": q_stream_category_counts,
    "review_request": q_review_request,
    "suggest_request": q_suggest_request,
    "stratified_sample": q_stratified_sample,
    "batch_metrics": q_batch_metrics,
    "tag_total_check": q_tag_total_check,
    "merge_safety": q_merge_safety,
    "drill_down": q_drill_down,
    "conversation_labels": q_conversation_labels,
    "order_priority_distribution": q_order_priority_distribution,
    "apply_tag_responses": q_apply_tag_responses,
    "run_primary": q_run_primary,
    "merged_facts": q_merged_facts,
    "uncategorised_panel": q_uncategorised_panel,
    "taxonomy_gaps": q_taxonomy_gaps,
    "run_narrative": q_run_narrative,
}
