"""Registered queries over table-based consolidation and taxonomy, agreement, topics,
JSON tickets, saved runs, totals, sketches, reviews and streams with state."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import consolidate as cns
from ..operators import quality as qlt
from ..operators import reports as rpt
from ..operators import topics as tpc
from ..operators import totals as tot
from ..operators.discovery import discover_by_label
from ..operators.merges import MergeTables, apply_merge_map, merged_counts
from ..operators.normalise import UNCATEGORISED, named_only
from ..operators.ordering import assign_batches, assign_positions
from ..operators.responses import apply_replies, apply_tag_replies, parse_replies
from ..operators.taxonomy import Category, Taxonomy, apply_threshold, low_to_uncategorised
from ..session import ensure_checkpoint_dir, materialize
from ..sources.files import export_csv, read_files, run_diff, write_run
from ..sources.json_tickets import from_layout, read_json_tickets
from ..sources.tables import table
from ..operators.normalise import normalise
from ..streaming.state import stream_category_state, stream_unique_windows
from .catalog import (
    CONTEXT, MODE, ORDER, REPLAY_FAILED, _requests, labelled_batches, lexical, narrow, taxonomy, tickets,
)
from .run import RunConfig, run

# --- fixed values -----------------------------------------------------------
SELF_EVERY = 7            # every so many customers merge with their parent into the parent itself
GHOST_EVERY = 11          # every so many customers' merge also names a category nobody has
LABEL_OVERLAP = 0.15      # Jaccard of two labels' vocabularies reported as an overlap
LABEL_TERMS = 3           # terms per label of the table function
RUN_THRESHOLDS = (5, 50)  # bucket thresholds of the two saved runs
STREAM_ROUNDS, STREAM_FILE_BYTES = 3, 64 << 20   # micro-batches of the document stream, text bytes of one of its files
REPEAT_EVERY, LATE_EVERY = 3, 5   # events of the last hour sent again, events of the first days sent late
# names of the starter categories in the review query, so that one pair is
# similar enough to merge and one to be flagged
REVIEW_NAMES = {"English Text": "English Text Page", "German Text": "German Text Page"}
REVIEW_MERGE, REVIEW_FLAG = 0.5, 0.3
# the recorded review of the replay query: a chain of merges, a merge into one of its
# sources, sources that nobody has, an empty target and a malformed entry
REVIEW_REPLY = {
    "narrative": "sources in groups",
    "category_summaries": {"From src0": "zero", "From src1": "one", "From src2": "two", "From src5": "five"},
    "auto_merges": [
        {"merge_these": ["From src0", "From src1"], "into": "Low Sources"},
        {"merge_these": ["From src2", "From src3"], "into": "From src2"},
        {"merge_these": ["Low Sources", "From src2"], "into": "Front Sources"},
        {"merge_these": ["From nowhere"], "into": "Ghost"},
        {"merge_these": ["From src4"], "into": ""},
        {"merge_these": "From src5", "into": "X"},
    ],
    "merge_flags": ["src8 and src9 look alike"],
    "uncategorised_analysis": ["failed batches"],
}
# -----------------------------------------------------------------------------


def scratch_folder(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "ticketsift", f"{name}-{uuid.uuid4().hex}")


# ------------------------------------------------------- merges as a table --

def customer_merges(spark: SparkSession, d: str) -> DataFrame:
    """A merge list as long as the customer table: customer ``i`` merges into
    customer ``i div 2``, larger ids first, so the chains have log n links."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("i")).where("i > 0")
    last = c.agg(F.max("i").alias("m")).first()["m"] or 0
    name = F.concat(F.lit("C"), F.col("i").cast("string"))
    parent = F.concat(F.lit("C"), F.expr("i div 2").cast("string"))
    ghost = F.concat(F.lit("Ghost"), F.col("i").cast("string"))
    sources = F.array_compact(F.array(name, F.when(F.col("i") % SELF_EVERY == 0, parent), F.when(F.col("i") % GHOST_EVERY == 0, ghost)))
    return c.select((F.lit(last + 1) - F.col("i")).cast("int").alias("merge_no"), sources.alias("merge_these"), parent.alias("into"))


def customer_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orders per customer as a category table."""
    return table(spark, d, "orders").groupBy(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def q_merge_map(spark, d):
    """CNS5: where every category that a merge names ends, and its last merge."""
    return MergeTables(customer_counts(spark, d), customer_merges(spark, d)).mapping


def q_merge_tickets(spark, d):
    """CNS6: tickets that each merge moved (the log's numbers)."""
    return MergeTables(customer_counts(spark, d), customer_merges(spark, d)).tickets()


def q_merge_rows(spark, d):
    """JON4: every order under its customer's final category."""
    orders = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("new_category"))
    return apply_merge_map(orders, q_merge_map(spark, d))


def q_merged_counts(spark, d):
    """AGG1 after the merges, from the category table alone."""
    counts = materialize(customer_counts(spark, d), "counts")
    return merged_counts(counts, MergeTables(counts, customer_merges(spark, d)).mapping)


# ----------------------------------------------------- taxonomy as a table --

def _own_name_run(spark, d):
    """``run()`` with recorded replies in which every ticket has a name of its own."""
    t = tickets(spark, d)
    b = assign_batches(assign_positions(materialize(t.select("ticket_id", ORDER), "replay_tickets"), ORDER, written=True))
    obj = F.struct("batch_pos", F.concat(F.lit("Only "), "ticket_id").alias("new_category"), F.lit("High").alias("confidence"), F.lit("r").alias("reasoning"))
    per = b.groupBy("batch_id").agg(F.sort_array(F.collect_list(obj)).alias("_r"))
    log = per.select("batch_id", F.to_json(F.transform("_r", lambda x: x.dropFields("batch_pos"))).alias("raw"), F.lit(None).cast("string").alias("error"))
    return run(t, CONTEXT, mode="no_suggestions", decider="replay", responses=log, config=RunConfig(order_key=ORDER, min_bucket=0))


def q_run_own_names(spark, d):
    """ACC1: one new name per ticket; the taxonomy of the run, in order of appearance."""
    return _own_name_run(spark, d).names.table.select("ordinal", "category", "source")


# ------------------------------------------------------------ reviews --

def review_rows(spark: SparkSession, review: dict) -> DataFrame:
    """A run's review as rows ``(part, name, value)``."""
    rows = [("summary", c, s) for c, s in review["category_summaries"].items()]
    rows += [("flag", "", f) for f in review["merge_flags"]] + [("uncategorised", "", a) for a in review["uncategorised_analysis"]]
    rows += [("log", "", line) for line in review.get("transparency_log", [])]
    return spark.createDataFrame([*rows, ("narrative", "", review.get("narrative"))], "part string, name string, value string")


def q_lexical_review(spark, d):
    """CNS0 without a model: summaries, merges of similar names, flags, the terms of
    the Uncategorised tickets and the narrative."""
    renamed = Taxonomy([Category(REVIEW_NAMES.get(c.name, c.name), c.keywords, c.weight, c.source) for c in taxonomy().categories])
    res = run(tickets(spark, d), CONTEXT, MODE, taxonomy=renamed,
              config=RunConfig(order_key=ORDER, merge_similarity=REVIEW_MERGE, flag_similarity=REVIEW_FLAG))
    return review_rows(spark, res.review)


def _replayed(spark, d, review: str | None):
    t = tickets(spark, d)
    b = assign_batches(assign_positions(materialize(t.select("ticket_id", ORDER, "current_label"), "replay_tickets"), ORDER, written=True))
    obj = F.struct("batch_pos", F.concat(F.lit("From "), "current_label").alias("new_category"), F.lit("High").alias("confidence"), F.lit("r").alias("reasoning"))
    per = b.groupBy("batch_id").agg(F.sort_array(F.collect_list(obj)).alias("_r"))
    failed = F.col("batch_id") % 7 == 3
    raw = F.to_json(F.transform("_r", lambda x: x.dropFields("batch_pos")))
    log = per.select("batch_id", F.when(~failed, raw).alias("raw"), F.when(failed, F.lit(REPLAY_FAILED)).alias("error"))
    return run(t, CONTEXT, mode="no_suggestions", decider="replay", responses=log, review_response=review, config=RunConfig(order_key=ORDER))


def q_replay_review(spark, d):
    """CNS0-CNS8, RPT5 over a recorded review: its log with counted tickets, flags,
    summaries after the merges, and the final category counts."""
    res = _replayed(spark, d, "```json\n" + json.dumps(REVIEW_REPLY) + "\n```")
    counts = res.labelled.groupBy("new_category").agg(F.count(F.lit(1)).alias("n"))
    return review_rows(spark, res.review).unionByName(counts.select(F.lit("count").alias("part"), F.col("new_category").alias("name"), F.col("n").cast("string").alias("value")))


def q_replay_review_failed(spark, d):
    """CNS3: without a usable review the labels stay, summaries are blank and the
    failure is noted."""
    return review_rows(spark, _replayed(spark, d, None).review)


def q_reply_strictness(spark, d):
    """PAR2 / PAR4 over replies that are odd by turns: plain, with words after the
    list, with repeated keys, with ``NaN``, with single quotes, one object, fenced."""
    b = labelled_batches(spark, d)
    quoted = F.concat(F.lit('"'), "new_category", F.lit('"'))
    turn = F.col("batch_id") % 7
    element = F.concat(
        F.lit('{"ticket_id": "'), "ticket_id", F.lit('", "new_category": '),
        F.when(turn == 2, F.concat(F.lit('"first", "new_category": '), quoted)).otherwise(quoted),
        F.lit(', "confidence": '), F.when(turn == 3, F.lit("NaN")).otherwise(F.lit('"High"')),
        F.lit(', "tags": '), F.when(turn == 2, F.lit('"ab", "tags": ["x", "y"]')).otherwise(F.lit('["t"]')), F.lit("}"))
    per = b.select("batch_id", "batch_pos", element.alias("e")).groupBy("batch_id").agg(
        F.expr("listagg(e, ', ') WITHIN GROUP (ORDER BY batch_pos)").alias("body"))
    listed = F.concat(F.lit("["), "body", F.lit("]"))
    raw = (F.when(turn == 1, F.concat(listed, F.lit(" as you asked")))
           .when(turn == 4, F.replace(listed, F.lit('"'), F.lit("'")))
           .when(turn == 5, F.col("body"))
           .when(turn == 6, F.concat(F.lit("```json\n"), listed, F.lit("\n``` that is all")))
           .otherwise(listed))
    parsed = parse_replies(per.select("batch_id", raw.alias("raw"), F.lit(None).cast("string").alias("error")), _requests(b))
    narrow_ = b.select("ticket_id", "batch_id", "batch_pos")
    out = apply_tag_replies(apply_replies(narrow_, parsed), parsed)
    return out.select("ticket_id", "new_category", "confidence", "reasoning", "multi_tags")


# ------------------------------------------------------------- quality --

def q_accuracy_summary(spark, d):
    """QLT1: categories against quality and toxicity labels, both sides and overall."""
    gold = table(spark, d, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")).alias("expected"))
    return qlt.accuracy_summary(narrow(spark, d).select("doc_id", "new_category").join(gold, "doc_id"), "expected")


def q_label_overlap(spark, d):
    """QLT4 by content: labels whose tickets share vocabulary."""
    t = tickets(spark, d).select(F.col("current_label").alias("new_category"), "issue_description")
    pairs = qlt.content_overlap(cns.term_table(t), LABEL_OVERLAP)
    return pairs.select(F.col("name_a").alias("label_a"), F.col("name_b").alias("label_b"), "shared", "union_size", "jaccard")


def q_named_tickets(spark, d):
    """FLT2: tickets that have a category."""
    return named_only(narrow(spark, d)).select("ticket_id", "new_category")


def q_distribution_with_zero(spark, d):
    """Categories of the list that no ticket has stay in the distribution, at 0 %."""
    names = [*taxonomy().names, "Nobody's Category", "Another Empty One"]
    return rpt.keep_zero(materialize(rpt.distribution(narrow(spark, d), order_col=ORDER), "distribution"), names)


def q_low_to_uncategorised(spark, d):
    """Rows of low confidence leave their category before the threshold."""
    lab = materialize(low_to_uncategorised(lexical(spark, d)).select("ticket_id", ORDER, "new_category", "confidence"), "labels")
    return apply_threshold(lab, order_col=ORDER, max_categories=len(taxonomy().categories) + 1).select("ticket_id", "new_category", "confidence")


# ----------------------------------------------------- topics, discovery --

def q_suggest_topics(spark, d):
    """DEC4 by topics: k-means over TF-IDF vectors of all tickets."""
    return tpc.topics(tickets(spark, d))[1]


def q_ticket_topics(spark, d):
    """The topic of every ticket."""
    return tpc.topics(tickets(spark, d))[0]


def q_label_terms(spark, d):
    """2.15: the terms of each label by a table function over a partitioned table."""
    return discover_by_label(tickets(spark, d), LABEL_TERMS)


# ------------------------------------------------- sources, saved runs --

def q_json_tickets(spark, d):
    """SRC10: JSON lines of an issue tracker's layout, derived from the documents,
    written to the scratch folder and read back by their nested fields."""
    folder = scratch_folder(spark, "json") + ".json"
    docs = table(spark, d, "documents")
    issue = F.struct(F.col("text").alias("summary"), F.struct(F.col("source").alias("name")).alias("issuetype"),
                     F.when(F.col("doc_id") % 3 == 0, F.struct(F.concat(F.lit(" closed "), "lang").alias("description"))).alias("resolution"))
    docs.select(F.to_json(F.struct(F.concat(F.lit("K-"), F.col("doc_id").cast("string")).alias("key"), issue.alias("fields"))).alias("value")).write.text(folder)
    t = normalise(read_json_tickets(spark, [folder]))
    return t.select("ticket_id", F.md5("issue_description").alias("text_md5"), "current_label", "resolution_notes")


def q_layout_tickets(spark, d):
    """SRC1 + SRC10: a help desk's CSV export, written, read and found by its header."""
    folder = scratch_folder(spark, "layout")
    p = table(spark, d, "part").select(
        F.concat(F.lit("H"), F.col("p_partkey").cast("string")).alias("Ticket ID"), F.concat(F.lit(' "'), "p_name", F.lit('", '), "p_brand").alias("Subject"),
        F.col("p_type").alias("Ticket type"), F.col("p_size").cast("string").alias("Resolution notes"), F.lit("x").alias("Group"))
    export_csv(p, folder)
    raw = read_files(spark, [folder + "/*.csv"])
    t = normalise(from_layout(raw, keep=("_row",)))
    return t.select("ticket_id", "issue_description", "current_label", "resolution_notes")


def q_run_diff(spark, d):
    """SNK3: two saved runs (the second one saved twice) and the tickets that differ."""
    folder = scratch_folder(spark, "runs")
    lab = materialize(lexical(spark, d).select("ticket_id", ORDER, "new_category"), "labels")
    low, high = RUN_THRESHOLDS
    write_run(apply_threshold(lab, low, order_col=ORDER), folder, "low")
    write_run(lab, folder, "high")  # replaced by the rerun
    write_run(apply_threshold(lab, high, order_col=ORDER).where(F.col(ORDER) % 10 != 0), folder, "high")
    return run_diff(spark, folder, "low", "high")


def q_observed_totals(spark, d):
    """RPT8: totals taken while the labels are written, beside counts of what was written."""
    rows, seen = tot.observed(lexical(spark, d).select("ticket_id", "new_category", "confidence", "reasoning"))
    written = materialize(rows, "labels")
    got = seen.get
    counted = written.agg(
        F.count(F.lit(1)).alias("tickets"), F.count_if(F.col("new_category") == UNCATEGORISED).alias("uncategorised"), F.count_if(F.col("confidence") == "Low").alias("low_confidence"))
    names = ("tickets", "uncategorised", "low_confidence")
    stacked = F.array(*[F.struct(F.lit(n).alias("metric"), F.lit(got[n]).cast("long").alias("observed"), F.col(n).alias("counted")) for n in names])
    return counted.select(F.inline(stacked))


def q_distinct_sketches(spark, d):
    """AGG4 mergeable: users per event type from daily sketches, beside the exact
    count and whether the estimate keeps its bound."""
    ev = table(spark, d, "events").select("event_type", F.to_date("ts").alias("day"), F.col("user_id").cast("long").alias("user_id"))
    sketched = tot.united(materialize(tot.batch_sketches(ev, ["event_type"], "day", "user_id"), "sketches"), ["event_type"])
    exact = ev.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    both = exact.join(sketched, "event_type")
    return both.select("event_type", "users", "rows", tot.within_bound(F.col("estimate"), F.col("users")).alias("within_bound"))


# ----------------------------------------------------------------- streams --

def q_stream_category_state(spark, d):
    """STR1 / STR2 with state of its own, over the documents in several files, a third
    of them a round; a file holds about STREAM_FILE_BYTES, so no task writes more."""
    folder = scratch_folder(spark, "stream_docs")
    docs = table(spark, d, "documents")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    files = max(STREAM_ROUNDS, -(-size // STREAM_FILE_BYTES))
    # rows that share an id or have none are told apart by their text
    docs.repartitionByRange(files, "doc_id", F.xxhash64("text")).write.parquet(os.path.join(folder, "documents.parquet"))
    return stream_category_state(spark, folder, taxonomy(), max_files=-(-files // STREAM_ROUNDS))


def q_stream_unique_windows(spark, d):
    """STR3: the events, then a file that repeats events of the last hour, one of others
    that are far behind the watermark, and one event that closes the windows."""
    folder = scratch_folder(spark, "stream_events")
    ev = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    ends = ev.agg(F.max("ts").alias("last"), F.max("event_id").alias("id")).first()
    if ends["last"] is None:
        return spark.createDataFrame([], "day string, category string, n long")
    last = F.lit(ends["last"])
    again = ev.where((F.col("ts") > last - F.expr("INTERVAL 1 HOUR")) & (F.col("event_id") % REPEAT_EVERY == 0))
    late = ev.where((F.col("ts") < last - F.expr("INTERVAL 2 DAYS")) & (F.col("event_id") % LATE_EVERY == 0))
    late = late.select((F.col("event_id") + ends["id"] + 1).alias("event_id"), "ts", "event_type")
    closing = ev.where(F.col("event_id") == ends["id"]).select((2 * F.col("event_id") + 2).alias("event_id"), (last + F.expr("INTERVAL 10 DAYS")).alias("ts"), "event_type")
    for part in (ev, again, late, closing):
        part.coalesce(1).write.mode("append").parquet(folder)
    out = stream_unique_windows(spark, folder)
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "category", "n")


QUERIES = {
    "merge_map": q_merge_map,
    "merge_tickets": q_merge_tickets,
    "merge_rows": q_merge_rows,
    "merged_counts": q_merged_counts,
    "run_own_names": q_run_own_names,
    "lexical_review": q_lexical_review,
    "replay_review": q_replay_review,
    "replay_review_failed": q_replay_review_failed,
    "reply_strictness": q_reply_strictness,
    "accuracy_summary": q_accuracy_summary,
    "label_overlap": q_label_overlap,
    "named_tickets": q_named_tickets,
    "distribution_with_zero": q_distribution_with_zero,
    "low_to_uncategorised": q_low_to_uncategorised,
    "suggest_topics": q_suggest_topics,
    "ticket_topics": q_ticket_topics,
    "label_terms": q_label_terms,
    "json_tickets": q_json_tickets,
    "layout_tickets": q_layout_tickets,
    "run_diff": q_run_diff,
    "observed_totals": q_observed_totals,
    "distinct_sketches": q_distinct_sketches,
    "stream_category_state": q_stream_category_state,
    "stream_unique_windows": q_stream_unique_windows,
}
