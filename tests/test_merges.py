"""Merge lists and taxonomies as tables against plain Python."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ticketsift.operators.consolidate import fold_merges
from ticketsift.operators.merges import MERGE_SCHEMA, MergeTables, apply_merge_map, merged_counts, next_merges, valid_merges
from ticketsift.operators.name_table import NameTable, ranked, seed_names, unseen
from ticketsift.operators.prompts import categorise_head, categorise_header, tag_requests
from ticketsift.operators.taxonomy import Taxonomy, fold_small_table


def tables(spark, counts, merges):
    c = spark.createDataFrame(list(counts.items()), "category string, n long")
    return MergeTables(c, spark.createDataFrame([(k + 1, s, i) for k, (s, i) in enumerate(merges)], MERGE_SCHEMA))


def plain(counts, merges):
    """Every category walked through the list, one merge after the other."""
    at, last, moved = {c: c for c in counts}, {}, {}
    for no, (sources, into) in enumerate(merges, start=1):
        if not into or not sources:
            continue
        for c, now in at.items():
            if now in sources:
                moved[no] = moved.get(no, 0) + counts[c]
                at[c], last[c] = into, no
    return {(c, at[c], last[c]) for c in last}, {no: n for no, n in moved.items() if n}


CASES = [
    ({"A": 6, "B": 5, "C": 7}, [(["A", "B"], "D"), (["D", "C"], "E")]),
    ({"A": 6, "B": 5}, [(["A", "B"], "A"), (["A"], "A"), (["B"], "C")]),
    ({"A": 6, "Z": 0}, [(["X"], "Y"), (["A"], ""), ([], "Z"), (["A", None], "A"), (["Z"], "Q")]),
    ({f"C{k}": k for k in range(40)}, [([f"C{k}"], f"C{k - 1}") for k in range(39, 0, -1)]),
    ({"A": 1, "B": 2}, [(["A"], "B"), (["B"], "A"), (["A"], "B"), (["A", "B"], "C")]),
]


def test_chains_match_a_walk_and_the_fold(spark):
    for counts, merges in CASES:
        t = tables(spark, counts, merges)
        want, moved = plain(counts, merges)
        assert {tuple(r) for r in t.mapping.collect()} == want
        assert {r["merge_no"]: r["tickets"] for r in t.tickets().collect()} == moved
        fold = fold_merges(counts, [([s for s in src if s is not None], into) for src, into in merges])
        assert [r["log"] for r in t.log().orderBy("merge_no").collect()] == fold.log
        got = {r["category"]: r["n"] for r in merged_counts(spark.createDataFrame(list(counts.items()), "category string, n long"), t.mapping).collect()}
        assert {c: n for c, n in got.items() if n} == {c: n for c, n in fold.counts.items() if n}


@settings(max_examples=6, deadline=None)
@given(st.data())
def test_random_lists(spark, data):
    names = list("ABCDEF")
    counts = {n: data.draw(st.integers(0, 5)) for n in names}
    merge = st.tuples(st.lists(st.sampled_from([*names, "G"]), max_size=3), st.sampled_from([*names, "G", ""]))
    merges = data.draw(st.lists(merge, min_size=1, max_size=12))
    t = tables(spark, counts, merges)
    assert ({tuple(r) for r in t.mapping.collect()}, {r["merge_no"]: r["tickets"] for r in t.tickets().collect()}) == plain(counts, merges)


def test_rows_move_and_an_empty_list_changes_nothing(spark):
    rows = spark.createDataFrame([("t1", "A"), ("t2", None), ("t3", "B"), ("t4", "X")], "ticket_id string, new_category string")
    t = tables(spark, {"A": 1, "B": 1, "X": 1}, [(["A", "B"], "A")])
    assert {tuple(r) for r in apply_merge_map(rows, t.mapping).collect()} == {("t1", "A"), ("t2", None), ("t3", "A"), ("t4", "X")}
    none = MergeTables(spark.createDataFrame([("A", 1)], "category string, n long"), spark.createDataFrame([], MERGE_SCHEMA))
    assert none.mapping.count() == 0 and none.log().count() == 0


def test_links_only_point_to_later_merges(spark):
    merges = spark.createDataFrame([(k, [f"N{k % 5}", f"N{k % 3}"], f"N{k % 4}") for k in range(1, 60)], MERGE_SCHEMA)
    assert next_merges(valid_merges(merges)).where("next <= merge_no").isEmpty()


def test_name_table_grows_in_first_seen_order(spark):
    names = NameTable(spark, Taxonomy.from_names(["Old", "Uncategorised"]))
    labels = spark.createDataFrame([(5, "B"), (3, "A"), (9, "B"), (1, "Old"), (2, ""), (4, None), (6, "Uncategorised")], "pos long, new_category string")
    names.add(labels)
    names.add(labels)
    names.add(spark.createDataFrame([(20, "C"), (21, "A")], "pos long, new_category string"))
    assert [(r["ordinal"], r["category"]) for r in names.table.orderBy("ordinal").collect()] == [(0, "Old"), (1, "A"), (2, "B"), (3, "C")]
    assert names.taxonomy().names == ["Old", "A", "B", "C"] and names.size == 4
    empty = seed_names(spark, Taxonomy([]))
    assert [r["category"] for r in ranked(unseen(labels, empty), 0).orderBy("ordinal").collect()] == ["Old", "A", "B"]


def test_request_heads_from_a_table(spark):
    names = spark.createDataFrame([(1, "second"), (0, "it's"), (2, "a\\b")], "ordinal long, category string")
    for mode in ("manual_list", "no_suggestions"):
        for table_, listed in ((names, ["it's", "second", "a\\b"]), (names.where("false"), [])):
            assert spark.range(1).select(categorise_head("ctx", mode, table_)).first()[0] == categorise_header("ctx", mode, listed)
    batch = spark.createDataFrame([(0, 0, "T1", "text")], "batch_id long, batch_pos int, ticket_id string, issue_description string")
    a, b = (tag_requests(batch, "ctx", n).first()["prompt"] for n in (names, ["it's", "second", "a\\b"]))
    assert a == b


def test_threshold_over_a_count_table(spark):
    rows = [(k, "big") for k in range(7)] + [(10, "small"), (11, "Uncategorised"), (12, None), (13, "")]
    labelled, counts = fold_small_table(spark.createDataFrame(rows, "pos long, new_category string"), 5)
    assert {r["category"]: (r["n"], r["first_pos"]) for r in counts.collect()} == {"big": (7, 0), "Uncategorised": (3, 10)}
    assert sorted(str(r["new_category"]) for r in labelled.where("pos >= 10").collect()) == ["None", "Uncategorised", "Uncategorised", "Uncategorised"]


def test_run_with_many_names_holds_none_of_them(spark):
    """No cap on names: recorded replies that name every ticket, merges included."""
    from ticketsift.plans.run import RunConfig, run

    n = 300
    t = spark.range(n).select(F.concat(F.lit("T"), "id").alias("ticket_id"), F.lit("some text").alias("issue_description"), F.lit("").alias("current_label"),
                              F.lit("").alias("resolution_notes"), F.col("id").alias("pos"))
    log = [(b, json.dumps([{"new_category": f"N{b * 10 + k}", "confidence": "Low" if k == 9 else "High"} for k in range(10)]), None) for b in range(n // 10)]
    review = json.dumps({"category_summaries": {"N1": "one", "N2": "two"}, "auto_merges": [{"merge_these": ["N1", "N2"], "into": "N2"}, {"merge_these": ["N2"], "into": "M"}]})
    res = run(t, "context of the run", "no_suggestions", decider="replay", review_response=review,
              responses=spark.createDataFrame(log, "batch_id long, raw string, error string"), config=RunConfig(min_bucket=0, low_to_uncategorised=True))
    assert res.names.size == n and res.taxonomy.names[:3] == ["N0", "N1", "N2"]
    got = {r["ticket_id"]: r["new_category"] for r in res.labelled.collect()}
    assert (got["T0"], got["T1"], got["T2"], got["T9"]) == ("N0", "M", "M", "Uncategorised")
    assert res.merges.log == ["Merged: 'N1' + 'N2' → 'N2' (2 tickets)", "Merged: 'N2' → 'M' (2 tickets)"]
    assert res.review["category_summaries"] == {"M": "one"} or res.review["category_summaries"] == {"M": "two"} or res.review["category_summaries"] == {}
