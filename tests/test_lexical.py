from conftest import SF_MID, SF_SMALL
from pyspark.sql import functions as F

from ticketsift.operators.deciders import label_lexical
from ticketsift.operators.taxonomy import Category, Taxonomy, apply_threshold
from ticketsift.session import materialize
from ticketsift.sources.tables import document_tickets

# primary-category counts of the starter taxonomy (FIXTURES §3)
EXPECTED_SF0_01 = {"Licence Notice": 39, "Credential Exposure": 10, "Contact Data": 11, "English Text": 573,
                   "German Text": 122, "French Text": 131, "Spanish Text": 88, "Uncategorised": 26}


def test_starter_counts_and_confidence(spark):
    lab = label_lexical(document_tickets(spark, SF_MID), Taxonomy.starter())
    assert {r[0]: r[1] for r in lab.groupBy("new_category").count().collect()} == EXPECTED_SF0_01
    assert {r[0]: r[1] for r in lab.groupBy("confidence").count().collect()} == {"High": 928, "Medium": 45, "Low": 27}


def test_tie_breaks_and_reasons(spark):
    tax = Taxonomy([Category("A", ("alpha",), 1), Category("B", ("beta", "gamma"), 1)])
    df = spark.createDataFrame([("alpha beta",), ("beta gamma",), ("nothing",), ("Alpha!",)], "issue_description string")
    df = df.withColumn("resolution_notes", F.lit(""))
    got = [(r.new_category, r.confidence, r.reasoning, r.tags) for r in label_lexical(df, tax, with_tags=True).collect()]
    assert got == [
        ("A", "Low", "Matched: alpha", ["A", "B"]),
        ("B", "High", "Matched: beta, gamma", ["B"]),
        ("Uncategorised", "Low", "No category keyword matched.", []),
        ("A", "Medium", "Matched: alpha", ["A"]),
    ]


def test_lexical_plan_has_no_exchange_and_no_python(spark):
    plan = label_lexical(document_tickets(spark, SF_SMALL, spread_scan=False), Taxonomy.starter())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "ArrowEval" not in plan


def test_repartition_invariance_and_threshold(spark):
    base = document_tickets(spark, SF_SMALL)
    outs = []
    for n in (1, 2, 8):
        lab = label_lexical(base.repartition(n), Taxonomy.starter())
        outs.append(sorted((r.ticket_id, r.new_category) for r in lab.collect()))
    assert outs[0] == outs[1] == outs[2]
    narrow = materialize(label_lexical(base, Taxonomy.starter()).select("ticket_id", "doc_id", "new_category", "confidence"))
    th = apply_threshold(narrow, order_col="doc_id", max_categories=8)
    counts = {r[0]: r[1] for r in th.groupBy("new_category").count().collect()}
    assert all(n >= 5 for c, n in counts.items() if c != "Uncategorised")
    assert sum(counts.values()) == 200 and counts["Uncategorised"] == 14   # 11 + the folded 3
    assert "BroadcastHashJoin" in th._jdf.queryExecution().executedPlan().toString()


def test_similar_names_equals_brute_force(spark):
    import itertools
    import random
    import re

    from ticketsift.operators.quality import similar_names

    rnd = random.Random(7)
    words = ["standard", "tin", "copper", "brass", "steel", "nickel", "plated", "brushed", "burnished", "polished", "anodized"]
    names = sorted({" ".join(rnd.sample(words, rnd.randint(1, 4)) + (["standard"] if rnd.random() < 0.4 else [])) for _ in range(150)})
    toks = {n: set(t for t in re.split("[^a-z0-9]+", n.lower()) if t) for n in names}
    for t in (0.3, 0.5, 0.8):
        exp = {(a, b) for a, b in itertools.combinations(sorted(names), 2)
               if len(toks[a] & toks[b]) >= t * len(toks[a] | toks[b]) - 1e-12}
        got = {(r.name_a, r.name_b) for r in similar_names(spark.createDataFrame([(n,) for n in names], "name string"), "name", t).collect()}
        assert got == exp


def test_wide_taxonomy_path_matches_literal_path(spark):
    base = document_tickets(spark, SF_SMALL)
    tax = Taxonomy.starter()
    # the same starter plus unused categories, so the wide path is taken on its own
    wide_tax = Taxonomy(tax.categories + [Category(f"Filler {i}", (f"zzfill{i}",), 1) for i in range(70)])
    cols = ["ticket_id", "new_category", "confidence", "reasoning", "tags"]
    def rows(df):
        return {tuple(r[:4]) + (tuple(r[4]),) for r in df.select(*cols).collect()}

    lit = rows(label_lexical(base, tax, with_tags=True))
    wide = rows(label_lexical(base, wide_tax, with_tags=True))
    forced = rows(label_lexical(base, tax, with_tags=True, wide=True))
    assert len(lit) == 200 and lit == wide == forced
    tie = Taxonomy([Category("A", ("alpha",), 1), Category("B", ("alpha", "beta"), 1)])
    df = spark.createDataFrame([("alpha",), ("alpha beta",)], "issue_description string").withColumn("resolution_notes", F.lit(""))
    got = [(r.new_category, r.confidence, r.reasoning) for r in label_lexical(df, tie, wide=True).collect()]
    assert got == [("A", "Low", "Matched: alpha"), ("B", "High", "Matched: alpha, beta")]


def test_similar_names_with_one_hot_token_in_every_prefix(spark):
    # every name is "common <own word>": the hot token is in every prefix, the
    # answer at 0.3 is every pair; salting spreads those pairs over the tasks
    import itertools

    from ticketsift.operators.quality import similar_names

    names = [f"common w{i:03d}" for i in range(60)] + ["w001 w002 extra"]
    got = {(r.name_a, r.name_b) for r in similar_names(spark.createDataFrame([(n,) for n in names], "name string"), "name", 0.3).collect()}
    toks = {n: set(n.split()) for n in names}
    exp = {(a, b) for a, b in itertools.combinations(sorted(names), 2)
           if len(toks[a] & toks[b]) >= 0.3 * len(toks[a] | toks[b]) - 1e-12}
    assert got == exp and len(got) >= 60 * 59 // 2


def test_term_profiles_take_the_top_terms_with_ties_by_term(spark):
    from ticketsift.operators.quality import term_profiles

    rows = [("A", "zeta", 5), ("A", "alpha", 5), ("A", "beta", 4), ("A", "gamma", 1), ("A", None, 9),
            ("Uncategorised", "alpha", 7), ("B", "beta", 2), (None, "x", 3)]
    terms = spark.createDataFrame(rows, "category string, term string, df long")
    got = {r.name: r.toks for r in term_profiles(terms, 3).collect()}
    assert got == {"A": ["alpha", "beta", "zeta"], "B": ["beta"]}


def test_suggestion_sample_size_rule_and_partition_invariance(spark):
    from ticketsift.operators.taxonomy import sample_size, suggestion_sample

    assert [sample_size(n) for n in (51, 60, 100, 1000)] == [13, 15, 25, 25]
    t = document_tickets(spark, SF_SMALL)
    picks = [{r.ticket_id for r in suggestion_sample(t.repartition(p), 25).collect()} for p in (1, 3, 8)]
    assert all(len(x) == 25 for x in picks) and picks[0] == picks[1] == picks[2]
