"""Structured Streaming forms over several micro-batches (one file each)."""

from conftest import SF_SMALL
from pyspark.sql import functions as F

from ticketsift.operators.deciders import label_lexical
from ticketsift.operators.taxonomy import Taxonomy
from ticketsift.sources.tables import document_tickets
from ticketsift.streaming.rounds import stream_categorise, stream_category_counts


def _split_documents(spark, tmp, parts=3):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    docs.repartition(parts, "doc_id").write.parquet(f"{tmp}/docs")
    return f"{tmp}/docs"


def test_stream_counts_and_labels_carry_over_micro_batches(spark, tmp):
    src = _split_documents(spark, tmp)
    tax = Taxonomy.starter()
    batch = label_lexical(document_tickets(spark, SF_SMALL), tax)
    expected_counts = {r.new_category: r["count"] for r in batch.groupBy("new_category").count().collect()}
    got_counts = {r.category: r.n for r in stream_category_counts(spark, src, tax, pattern="part-*.parquet").collect()}
    assert got_counts == expected_counts
    expected = {r.ticket_id: r.new_category for r in batch.collect()}
    labels = stream_categorise(spark, src, tax, pattern="part-*.parquet")
    assert labels.select("round").distinct().count() == 3          # one round per file
    assert {r.ticket_id: r.new_category for r in labels.collect()} == expected
    assert labels.groupBy("ticket_id").count().filter(F.col("count") > 1).count() == 0


def test_stream_rounds_with_a_model_decider_accumulate_names(spark, tmp):
    import json
    import re

    src = _split_documents(spark, tmp)

    def factory():
        def call(prompt):
            known = len(re.findall(r"^  \* ", prompt, re.M))
            ids = re.findall(r"^id: (.+)$", prompt, re.M)
            return json.dumps([{"ticket_id": i, "new_category": f"Group {int(i[4:]) % 3}", "confidence": "High",
                                "reasoning": f"known={known}"} for i in ids])
        return call

    labels = stream_categorise(spark, src, Taxonomy([]), pattern="part-*.parquet", decider="callable",
                               context="Invented documents read as tickets", mode="no_suggestions", call_factory=factory)
    rows = labels.select("round", "ticket_id", "new_category", "reasoning").collect()
    assert len(rows) == document_tickets(spark, SF_SMALL).count()
    first = min(r["round"] for r in rows)
    assert {r.reasoning for r in rows if r["round"] == first} == {"known=0"}
    assert all(r.reasoning == "known=3" for r in rows if r["round"] != first)   # all three names seen in round one
    assert all(r.new_category == f"Group {int(r.ticket_id[4:]) % 3}" for r in rows)


def test_stream_rounds_replay_their_recorded_replies(spark, tmp):
    import json
    import re

    src = _split_documents(spark, tmp)

    def factory():
        def call(prompt):
            known = len(re.findall(r"^  \* ", prompt, re.M))
            ids = re.findall(r"^id: (.+)$", prompt, re.M)
            return json.dumps([{"ticket_id": i, "new_category": f"Group {int(i[4:]) % 2}", "confidence": "Low",
                                "reasoning": f"known={known}"} for i in ids])
        return call

    common = dict(pattern="part-*.parquet", context="Invented documents read as tickets", mode="no_suggestions")
    first = stream_categorise(spark, src, Taxonomy([]), decider="callable", call_factory=factory,
                              out_dir=f"{tmp}/run1", **common)
    record = spark.read.parquet(f"{tmp}/run1/replies")
    again = stream_categorise(spark, src, Taxonomy([]), decider="replay", responses=record,
                              out_dir=f"{tmp}/run2", **common)
    key = lambda df: {(r.ticket_id, r.new_category, r.reasoning) for r in df.collect()}
    assert key(first) == key(again) and len(key(first)) == document_tickets(spark, SF_SMALL).count()
