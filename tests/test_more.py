"""JSON tickets, layouts, saved runs, agreement, topics, totals, states of streams."""

import itertools
import json
import os
import random

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from ticketsift.operators import quality as qlt
from ticketsift.operators import reports as rpt
from ticketsift.operators import topics as tpc
from ticketsift.operators import totals as tot
from ticketsift.operators.discovery import discover_by_label
from ticketsift.operators.normalise import TicketError, normalise
from ticketsift.operators.responses import apply_replies, apply_tag_replies, parse_replies
from ticketsift.operators.taxonomy import Taxonomy, low_to_uncategorised
from ticketsift.plans import catalog_more as more
from ticketsift.plans.run import RunConfig, run
from ticketsift.sources.files import read_files, read_run, run_diff, write_run
from ticketsift.sources.json_tickets import LAYOUTS, detect_layout, from_layout, read_json_tickets
from ticketsift.sources.tables import document_tickets
from ticketsift.streaming.state import stream_category_state


def write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


# ------------------------------------------------------------------- sources --

def test_layouts_are_told_by_their_headers():
    for name, mapping in LAYOUTS.items():
        assert detect_layout([*mapping.values(), "Extra"]) == name
        assert detect_layout([f" {p.upper()} " for p in mapping.values()]) == name
    with pytest.raises(TicketError, match="known ones: issue tracker csv"):
        detect_layout(["Subject", "Body"])


def test_csv_export_of_a_help_desk(spark, tmp):
    write(f"{tmp}/x.csv", "Subject,Ticket ID,Group,Ticket Type\n Cannot log in ,007,a,Login\n,8,a,Login\nOther,9,a,\n")
    t = normalise(from_layout(read_files(spark, f"{tmp}/x.csv"), keep=("_row",)))
    assert [tuple(r) for r in t.select("ticket_id", "issue_description", "current_label", "resolution_notes").orderBy("_row").collect()] == [
        ("007", "Cannot log in", "Login", ""), ("9", "Other", "", "")]


def test_json_lines_with_nested_fields(spark, tmp):
    rows = [
        {"key": "A-1", "fields": {"summary": "first ✓\nline", "issuetype": {"name": "Bug"}, "resolution": None}},
        {"key": 7, "fields": {"summary": "second", "issuetype": {"name": "Task"}, "resolution": {"description": "done"}}},
        {"key": "A-3", "fields": {"summary": None, "issuetype": {}}},
        {"other": 1},
    ]
    write(f"{tmp}/a.json", "\n".join(map(json.dumps, rows)) + "\n\n")
    got = read_json_tickets(spark, f"{tmp}/a.json").orderBy("_row").collect()
    assert [(r["ticket_id"], r["issue_description"], r["current_label"], r["resolution_notes"]) for r in got] == [
        ("A-1", "first ✓\nline", "Bug", None), ("7", "second", "Task", "done"), ("A-3", None, None, None), (None, None, None, None)]
    own = read_json_tickets(spark, f"{tmp}/a.json", mapping={"ticket_id": "key", "issue_description": "fields.issuetype.name"})
    assert sorted(str(r["issue_description"]) for r in own.collect()) == ["Bug", "None", "None", "Task"]


def test_lines_that_are_no_json_object_refuse_the_read(spark, tmp):
    good = json.dumps({"key": "A", "fields": {"summary": "s", "issuetype": {"name": "n"}}})
    bad = ["[1]", good + " trailing", "{'key': 1}", good[:-3], "7"]
    write(f"{tmp}/a.json", "\n".join([good, *bad]))
    with pytest.raises(TicketError, match="5 lines"):
        read_json_tickets(spark, f"{tmp}/a.json")
    rows, report = read_json_tickets(spark, f"{tmp}/a.json", report=True)
    assert rows.count() == 1 and report.corrupt_rows == 5
    assert sorted(r["line"] for r in report.quarantine.collect()) == sorted(bad)


def test_file_order_over_many_files(spark, tmp):
    names = [f"{tmp}/f {k}+%.csv" for k in range(12)]
    for k, n in enumerate(names):
        write(n, "ticket_id,issue_description\n" + "".join(f"{k}-{i},text\n" for i in range(3)))
    random.Random(1).shuffle(names)
    got = [r["ticket_id"] for r in read_files(spark, names).orderBy("_row").collect()]
    assert got == [f"{n.split(' ')[1].split('+')[0]}-{i}" for n in names for i in range(3)]


def test_saved_runs_replace_themselves_and_compare(spark, tmp):
    def labels(rows):
        return spark.createDataFrame(rows, "ticket_id string, new_category string")

    write_run(labels([("a", "X"), ("b", "Y"), ("c", None)]), f"{tmp}/runs", "one")
    write_run(labels([("a", "Z"), ("q", "Z")]), f"{tmp}/runs", "two")
    write_run(labels([("a", "X"), ("b", "Z"), ("d", "Y"), ("c", None)]), f"{tmp}/runs", "two")
    assert read_run(spark, f"{tmp}/runs", "two").count() == 4 and read_run(spark, f"{tmp}/runs", "one").count() == 3
    assert {tuple(r) for r in run_diff(spark, f"{tmp}/runs", "one", "two").collect()} == {("b", "Y", "Z", "moved"), ("d", None, "Y", "added")}
    assert {tuple(r) for r in run_diff(spark, f"{tmp}/runs", "two", "one").collect()} == {("b", "Z", "Y", "moved"), ("d", "Y", None, "removed")}


def test_run_totals_are_taken_while_it_is_written(spark, tmp):
    res = run(document_tickets(spark, SF_SMALL), "invented documents", "manual_list", taxonomy=Taxonomy.starter(), config=RunConfig(order_key="doc_id"))
    rows = res.labelled.select("new_category", "confidence").collect()
    want = {"tickets": len(rows), "uncategorised": sum(r[0] == "Uncategorised" for r in rows), "unlabelled": 0,
            "low_confidence": sum(r[1] == "Low" for r in rows), "failed": 0}
    assert res.save_run(f"{tmp}/runs", "r1") == want == res.save_csv(f"{tmp}/out")


# ------------------------------------------------------------------- replies --

def test_one_strict_parse_for_all_replies(spark):
    batch = spark.createDataFrame([(b, 0, f"T{b}") for b in range(9)], "batch_id long, batch_pos int, ticket_id string")
    raws = [
        '[{"new_category": "A", "new_category": "B", "tags": ["x"], "tags": ["y", "z"]}]',
        '[{"new_category": "A"}] hope this helps',
        '[{"new_category": NaN, "confidence": Infinity, "reasoning": null}]',
        "[{'new_category': 'A'}]",
        '[{"new_category": 1.50, "confidence": {"a": [1, 2.5]}, "reasoning": true, "tags": {"a": 1}}]',
        '```\n[{"new_category": "\\ud800x", "tags": []}]\n``` and more',
        "[" * 100_000,
        '[{"new_category": "A", "tags": [1]}]',
        '[{"tags": "ab"}]',
    ]
    resp = spark.createDataFrame([(k, r, None) for k, r in enumerate(raws)], "batch_id long, raw string, error string")
    parsed = parse_replies(resp, batch.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_tickets")))
    assert {r["batch_id"] for r in parsed.where("ok").collect()} == {0, 2, 4, 5, 7, 8}
    got = {r["batch_id"]: (r["new_category"], r["confidence"], r["reasoning"]) for r in apply_replies(batch, parsed).collect()}
    assert got[0] == ("B", "Low", "") and got[2] == (None, None, None)
    assert got[4] == ("1.50", '{"a":[1,2.5]}', "true") and got[5][0] == "?x"
    tags = {r["batch_id"]: r["multi_tags"] for r in apply_tag_replies(batch, parsed).collect()}
    assert tags == {0: "y | z", 1: "", 2: "", 3: "", 4: "", 5: "", 6: "", 7: "", 8: "a | b"}


# ------------------------------------------------------------------- quality --

def test_agreement_matches_pair_counting(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ABC"), rng.choice(["x", "y", None])) for _ in range(60)] + [(None, "x"), ("A", None)]
    got = {(r["side"], r["name"]): r for r in qlt.accuracy_summary(spark.createDataFrame(rows, "new_category string, expected string"), "expected").collect()}
    known = [(a, b) for a, b in rows if a and b]
    for side, own, other in (("predicted", 0, 1), ("expected", 1, 0)):
        for name in {r[own] for r in known}:
            mine = [r[other] for r in known if r[own] == name]
            best = min(set(mine), key=lambda v: (-mine.count(v), v))
            r = got[side, name]
            assert (r["majority"], r["tickets"], r["matched"]) == (best, len(mine), mine.count(best))
    pairs = list(itertools.combinations(known, 2))
    same_a, same_b = (sum(p[0][k] == p[1][k] for p in pairs) for k in (0, 1))
    both = sum(p[0] == p[1] for p in pairs)
    chance = same_a * same_b / len(pairs)
    assert abs(got["overall", ""]["rand_index"] - (both - chance) / ((same_a + same_b) / 2 - chance)) < 1e-6


def test_agreement_of_trivial_and_empty_tables(spark):
    one = spark.createDataFrame([("A", "x")] * 3, "new_category string, expected string")
    r = qlt.accuracy_summary(one, "expected").where("side = 'overall'").first()
    assert (r["rand_index"], r["pct"], r["meets_target"]) == (1.0, 100, True)
    assert qlt.accuracy_summary(one.where("false"), "expected").count() == 0


def test_zero_rows_and_low_rows(spark):
    lab = spark.createDataFrame([(0, "A", "Low"), (1, "A", "High"), (2, "B", "High"), (3, None, "Low")], "pos long, new_category string, confidence string")
    assert [(r["rank"], r["category"], r["label"]) for r in rpt.keep_zero(rpt.distribution(lab), ["Z", "A", "Y", "Z"]).orderBy("rank").collect()] == [
        (1, "A", "2 (67%)"), (2, "B", "1 (33%)"), (3, "Z", "0 (0%)"), (4, "Y", "0 (0%)")]
    assert [r["new_category"] for r in low_to_uncategorised(lab).orderBy("pos").collect()] == ["Uncategorised", "A", "B", None]


def test_topics_match_plain_k_means(spark):
    words = [["alpha", "beta"], ["gamma", "delta"], ["omega", "sigma"]]
    rng = random.Random(2)
    texts = [" ".join(rng.choices(words[k % 3], k=4) + [rng.choice(["common", "other"])]) for k in range(60)] + ["", "zz"]
    rows = spark.createDataFrame([(f"T{k}", t) for k, t in enumerate(texts)], "ticket_id string, issue_description string")
    n, terms = tpc.vocabulary(rows, 8)
    assert n == 62 and len(terms) == 8
    placed, named = tpc.topics(rows, k=3, size=8, iterations=5)
    held = [[i for i, (t, _) in enumerate(terms) if t in x.split()] for x in texts]
    weights = [w for _, w in terms]
    centres = [[w if i == k else 0 for i, w in enumerate(weights)] for k in range(3)]
    near = lambda v: max(range(3), key=lambda k: (sum(2 * weights[i] * centres[k][i] for i in v) - sum(c * c for c in centres[k]), -k)) if v else None
    for _ in range(5):
        own = [near(v) for v in held]
        for k in range(3):
            members = [v for v, o in zip(held, own) if o == k]
            if members:
                centres[k] = [weights[i] * sum(i in v for v in members) // len(members) for i in range(8)]
    assert {r["ticket_id"]: r["topic"] for r in placed.collect()} == {f"T{k}": near(v) for k, v in enumerate(held)}
    assert sum(r["tickets"] for r in named.collect()) == 60
    assert tpc.topics(rows.where("false"))[1].count() == 0


def test_sketches_of_batches_unite(spark):
    df = spark.range(20_000).select((F.col("id") % 2).alias("k"), (F.col("id") % 7).alias("day"), (F.col("id") % 5_000).alias("user"))
    got = tot.united(tot.batch_sketches(df, ["k"], "day", "user"), ["k"])
    rows = got.withColumn("ok", tot.within_bound(F.col("estimate"), F.lit(2500))).collect()
    assert {(r["k"], r["rows"], r["ok"]) for r in rows} == {(0, 10_000, True), (1, 10_000, True)}


def test_table_function_gives_each_label_its_terms(spark):
    t = document_tickets(spark, SF_SMALL)
    from ticketsift.operators.taxonomy import suggest_terms

    got = {}
    for r in discover_by_label(t, 3).collect():
        got.setdefault(r["label"], []).append((r["rank"], r["term"], r["df"]))
    label = sorted(got)[0]
    own = suggest_terms(t.where(F.col("current_label") == label), k=3, text_cols=("issue_description",)).collect()
    assert sorted(got[label]) == [(k + 1, r["term"], r["df"]) for k, r in enumerate(own)]


# ------------------------------------------------------------------- streams --

def test_state_survives_a_restart(spark, tmp):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    folder, out = f"{tmp}/in/documents.parquet", f"{tmp}/out"
    docs.where("doc_id >= 100").coalesce(1).write.parquet(folder)
    first = {r["category"]: (r["first_doc"], r["n"]) for r in stream_category_state(spark, f"{tmp}/in", Taxonomy.starter(), out_dir=out).collect()}
    assert sum(n for _, n in first.values()) == docs.where("doc_id >= 100").count() and min(f for f, _ in first.values()) >= 100
    docs.where("doc_id < 100").coalesce(1).write.mode("append").parquet(folder)
    again = {r["category"]: (r["first_doc"], r["n"]) for r in stream_category_state(spark, f"{tmp}/in", Taxonomy.starter(), out_dir=out).collect()}
    assert sum(n for _, n in again.values()) == 200 and min(f for f, _ in again.values()) == 0
    assert os.path.isdir(f"{out}/_checkpoint/state")


def test_files_of_the_document_stream_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(more, "STREAM_FILE_BYTES", 50_000, raising=False)
    seen = []
    run = more.stream_category_state
    monkeypatch.setattr(more, "stream_category_state", lambda s, folder, seed, **kw: seen.append((folder, kw)) or run(s, folder, seed, **kw))
    got = {r["category"]: (r["first_doc"], r["n"]) for r in more.QUERIES["stream_category_state"](spark, SF_SMALL).collect()}
    (folder, kw), = seen
    size = sum(len((r["text"] or "").encode()) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect())
    files = [f for f in os.listdir(f"{folder}/documents.parquet") if f.endswith(".parquet")]
    assert len(files) > 3 and abs(len(files) - size / 50_000) <= 2
    assert kw["max_files"] == -(-max(3, -(-size // 50_000)) // 3)  # three rounds
    monkeypatch.setattr(more, "STREAM_FILE_BYTES", 1 << 40, raising=False)
    again = {r["category"]: (r["first_doc"], r["n"]) for r in more.QUERIES["stream_category_state"](spark, SF_SMALL).collect()}
    assert got == again
