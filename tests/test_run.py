import json
import re

from conftest import SF_SMALL
from pyspark.sql import functions as F

from ticketsift.operators.deciders import label_lexical
from ticketsift.operators.prompts import TAG_INTRO
from ticketsift.operators.ordering import assign_batches, assign_positions
from ticketsift.operators.taxonomy import Taxonomy
from ticketsift.plans.run import RunConfig, _rounds, run
from ticketsift.sources.tables import document_tickets

CTX = "Invented documents read as tickets"


def _tickets(spark):
    return assign_positions(document_tickets(spark, SF_SMALL), "doc_id")


def test_round_plan():
    assert _rounds(10, None) == [(0, 1), (1, 3), (3, 7), (7, 10)]
    assert _rounds(3, 1) == [(0, 1), (1, 2), (2, 3)]


def test_lexical_run_keeps_rows_and_threshold(spark):
    t = _tickets(spark)
    res = run(t, CTX, "manual_list", taxonomy=Taxonomy.starter(), depth="full")
    lab = res.labelled
    assert lab.count() == 200
    counts = {r[0]: r[1] for r in lab.groupBy("new_category").count().collect()}
    assert all(n >= 5 for c, n in counts.items() if c != "Uncategorised")
    assert {"ticket_id", "new_category", "confidence", "reasoning", "multi_tags"} <= set(res.export.columns)
    assert set(res.review["category_summaries"]) <= set(counts)


def _replies_from_lexical(spark, t):
    b = assign_batches(t)
    lab = label_lexical(b, Taxonomy.starter())
    per = lab.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("batch_pos", "ticket_id", "new_category", "confidence", "reasoning"))).alias("r"))
    return per.select("batch_id", F.to_json(F.transform("r", lambda x: x.dropFields("batch_pos"))).alias("raw"), F.lit(None).cast("string").alias("error")), lab


def test_replay_matches_lexical_in_any_round_plan(spark):
    t = _tickets(spark)
    replies, lab = _replies_from_lexical(spark, t)
    expected = {r.ticket_id: r.new_category for r in lab.collect()}
    review = json.dumps({"narrative": "n", "category_summaries": {"English Text": "e"},
                         "auto_merges": [{"merge_these": ["German Text", "French Text"], "into": "Continental"}],
                         "merge_flags": [], "uncategorised_analysis": []})
    outs = []
    for rb in (1, None):
        res = run(t, CTX, "no_suggestions", decider="replay", responses=replies, review_response=review,
                  config=RunConfig(round_batches=rb, min_bucket=0))
        got = {r.ticket_id: r.new_category for r in res.labelled.collect()}
        outs.append(got)
        assert res.review["transparency_log"][0].startswith("Merged: 'German Text' + 'French Text' → 'Continental'")
    assert outs[0] == outs[1]
    merged = {k: ("Continental" if v in ("German Text", "French Text") else v) for k, v in expected.items()}
    assert outs[0] == merged


def test_callable_decider_sees_accumulated_names(spark):
    t = _tickets(spark).filter(F.col("pos") < 30)

    def factory():
        def call(prompt):
            ids = re.findall(r"^id: (.+)$", prompt, re.M)
            known = len(re.findall(r"^  \* ", prompt, re.M))
            if "DOC-15" in ids:
                raise RuntimeError("model timeout")
            return json.dumps([{"ticket_id": i, "new_category": f"Group {int(i[4:]) // 10}", "confidence": "High",
                                "reasoning": f"known={known}"} for i in ids])
        return call

    res = run(t, CTX, "no_suggestions", decider="callable", call_factory=factory,
              config=RunConfig(round_batches=1, min_bucket=0))
    rows = {r.ticket_id: (r.new_category, r.reasoning) for r in res.labelled.collect()}
    assert rows["DOC-0"] == ("Group 0", "known=0")
    assert rows["DOC-25"] == ("Group 2", "known=1")          # batch 1 failed, so only Group 0 was known
    assert rows["DOC-12"] == ("Uncategorised", "Processing error: model timeout")
    assert res.taxonomy.names == ["Group 0", "Group 2"]


def test_round_column_matches_round_plan(spark):
    from ticketsift.plans.run import _round_of, _rounds

    ids = spark.range(0, 137).withColumnRenamed("id", "batch_id")
    for rb in (None, 1, 4, 50):
        plan = _rounds(137, rb)
        got = {r.batch_id: r.k for r in ids.select("batch_id", _round_of(F.col("batch_id"), plan, rb).alias("k")).collect()}
        exp = {b: i for i, (lo, hi) in enumerate(plan) for b in range(lo, hi)}
        assert got == exp


def test_name_pairs_prefix_filter_equals_brute_force():
    import itertools
    import random

    from ticketsift.plans.run import name_pairs

    def brute(names, t):
        toks = {n: {x for x in re.split("[^a-z0-9]+", n.lower()) if x} for n in set(names)}
        toks = {n: v for n, v in toks.items() if v}
        out = []
        for a, b in itertools.combinations(sorted(toks), 2):
            i, u = len(toks[a] & toks[b]), len(toks[a] | toks[b])
            if i >= t * u - 1e-12:
                out.append((a, b, i / u))
        return out

    rnd = random.Random(3)
    words = ["login", "payment", "refund", "delay", "failure", "error", "card", "app", "slow", "crash"]
    for _ in range(200):
        names = [" ".join(rnd.sample(words, rnd.randint(1, 5))) for _ in range(rnd.randint(2, 25))]
        for t in (0.3, 0.5, 0.8, 1.0):
            assert name_pairs(names, t) == brute(names, t)


def test_collapse_copies_equals_full_run_with_a_hot_copy_group(spark):
    from ticketsift.operators import copies as cp

    base = document_tickets(spark, SF_SMALL)
    first = base.agg(F.min("doc_id")).first()[0]
    one = base.filter(F.col("doc_id") == first)
    extra = one.select(F.explode(F.sequence(F.lit(0), F.lit(149))).alias("i"), *[c for c in base.columns]).select(
        *[F.concat(F.lit("COPY-"), F.col("i").cast("string")).alias(c) if c == "ticket_id"
          else (F.lit(100000) + F.col("i")).alias(c) if c == "doc_id" else F.col(c) for c in base.columns])
    t = assign_positions(base.unionByName(extra), "doc_id")       # one group holds 150 of ~350 rows

    keyed = t.withColumn(cp.COPY_KEY, cp.copy_key())
    assert len(cp.hot_keys(cp.first_copies(keyed), 8)) >= 1     # the salted join path is taken

    def factory():
        def call(prompt):
            out = []
            if prompt.startswith(TAG_INTRO):          # theme request: id and text blocks
                blocks = re.findall(r"^id: (.+?)\n  text: (.*?)(?=\n\nid: |\Z)", prompt.split("Tickets:\n", 1)[1], re.M | re.S)
                return json.dumps([{"ticket_id": tid, "tags": ["Words"] + (["Many"] if len(text) > 5000 else [])}
                                   for tid, text in blocks])
            for tid, text in re.findall(r"^id: (.+?)\n  text: (.*?)\n  label: ", prompt, re.M | re.S):
                out.append({"ticket_id": tid, "new_category": "Short" if len(text) < 2000 else "Long",
                            "confidence": "High", "reasoning": f"{len(text)} chars"})
            return json.dumps(out)
        return call

    got = []
    for collapse in (False, True):
        res = run(t, CTX, "no_suggestions", decider="callable", call_factory=factory, depth="full",
                  config=RunConfig(min_bucket=0, collapse_copies=collapse))
        got.append({r.ticket_id: (r.new_category, r.confidence, r.reasoning, r.multi_tags) for r in res.export.collect()})
    assert got[0] == got[1] and len(got[1]) == t.count()
    assert len({v for k, v in got[1].items() if k.startswith("COPY-")}) == 1
    assert {v[3] for v in got[1].values()} >= {"Words"}


def test_lexical_summaries_from_the_term_table_equal_summaries_of_the_labels(spark):
    from ticketsift.operators import consolidate as cns

    res = run(document_tickets(spark, SF_SMALL), CTX, "manual_list", taxonomy=Taxonomy.starter(), depth="full",
              config=RunConfig(order_key="doc_id"))
    direct = {r["category"]: r["summary"] for r in cns.summaries_from_terms(cns.term_table(res.labelled)).collect()}
    assert res.merges.summaries == direct and direct


def test_a_run_writes_its_intermediate_tables_below_one_folder(spark):
    t = _tickets(spark).filter(F.col("pos") < 30)

    def factory():
        def call(prompt):
            ids = re.findall(r"^id: (.+)$", prompt, re.M)
            return json.dumps([{"ticket_id": i, "new_category": "G", "confidence": "High", "reasoning": "r"} for i in ids])
        return call

    res = run(t, CTX, "no_suggestions", decider="callable", call_factory=factory, config=RunConfig(min_bucket=0))
    files = res.labelled.inputFiles()
    assert res.scratch and files and all(f.split(":", 1)[-1].lstrip("/").startswith(res.scratch.lstrip("/")) for f in files)
    assert spark.conf.get("ticketsift.scratch.scope", None) is None


def test_chains_of_similar_names_end_in_one_category():
    from ticketsift.operators.consolidate import fold_merges
    from ticketsift.plans.run import name_groups

    groups = name_groups([("a", "b", 0.8), ("b", "c", 0.8), ("x", "y", 0.9)])
    assert groups == [("a", "b", "c"), ("x", "y")]
    plan = fold_merges({"a": 3, "b": 4, "c": 5, "x": 1, "y": 1, "z": 2}, [(g, g[0]) for g in groups])
    assert plan.mapping == {"b": "a", "c": "a", "y": "x"} and plan.counts == {"a": 12, "x": 2, "z": 2}


def test_run_of_few_tickets_and_sparse_keys(spark):
    import json

    import pytest

    from ticketsift.operators.normalise import TicketError
    from ticketsift.plans.run import RunConfig, run, suggest_categories

    t = spark.createDataFrame([(7 * k + 2, f"T{k}", f"printer jam {k}", "", "") for k in range(5)],
                              "key long, ticket_id string, issue_description string, current_label string, resolution_notes string")
    reply = json.dumps([{"ticket_id": f"T{k}", "new_category": "Jam", "confidence": "High", "reasoning": "r"} for k in range(5)])
    log = spark.createDataFrame([(0, "\n```json\n" + reply + "\n```", None)], "batch_id long, raw string, error string")
    res = run(t, "Support tickets of a shop", mode="no_suggestions", decider="replay", responses=log, config=RunConfig(order_key="key"))
    assert {r.new_category for r in res.labelled.collect()} == {"Jam"}
    assert res.export.columns == [*t.columns, "new_category", "confidence", "reasoning", "multi_tags"]
    empty = run(t.where("false"), "Support tickets of a shop", mode="no_suggestions", decider="replay", responses=log, config=RunConfig(order_key="key"))
    assert empty.export.count() == 0
    with pytest.raises(TicketError, match="order key"):
        run(t, "Support tickets of a shop", mode="no_suggestions")
    with pytest.raises(TicketError, match="more than 50 rows"):
        run(t, "Support tickets of a shop", mode="auto_suggest", config=RunConfig(order_key="key"))
    assert suggest_categories(t, "Support tickets of a shop", "replay", '["Jam", "", null, "Toner "]') == ["Jam", "Toner"]
    assert suggest_categories(t, "Support tickets of a shop", "callable", call_factory=lambda: lambda prompt: '["Jam"] and more') == []
    assert "Term: printer" in suggest_categories(t, "Support tickets of a shop")
