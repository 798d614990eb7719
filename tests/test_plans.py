"""Plan shapes that matter at scale (checked on sf0.001 plans)."""

import re

from conftest import SF_SMALL

from ticketsift.plans.catalog import QUERIES


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _exchange_inputs(plan: str) -> list[str]:
    """The output column list of the node right below every Exchange."""
    lines = plan.splitlines()
    out = []
    for i, line in enumerate(lines):
        if re.search(r"Exchange (hashpartitioning|rangepartitioning)", line) and i + 1 < len(lines):
            out.append(lines[i + 1])
    return out


def test_reply_apply_shuffles_no_text_and_positions_once(spark):
    plan = _plan(QUERIES["apply_responses"](spark, SF_SMALL))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 2
    assert "Window" not in plan                      # positions come from the written batch table
    assert not any("issue_description" in x or "text#" in x for x in _exchange_inputs(plan))


def test_run_threshold_is_a_projection(spark):
    # the labelled rows are a projection of the source (only the round-robin
    # spread of a single-split test file may appear); the threshold, the
    # merges and the tags add no shuffle and no join
    plan = _plan(QUERIES["run_primary"](spark, SF_SMALL))
    assert not re.search(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition)", plan)
    assert "Join" not in plan


def test_reports_read_the_texts_once_and_aggregate_before_the_exchange(spark):
    for name in ("category_distribution", "confidence_mix", "run_facts", "grouping_accuracy"):
        plan = _plan(QUERIES[name](spark, SF_SMALL))
        assert plan.count("documents.parquet") == 1    # one scan, no label row is written
        assert "partial_count" in plan                 # map-side combine of hot categories


def test_first_rows_per_category_limit_before_the_shuffle(spark):
    plan = _plan(QUERIES["category_samples"](spark, SF_SMALL))
    assert "WindowGroupLimit" in plan


def test_bucketed_requests_equal_plain_requests(spark):
    # batches crossing bucket borders are stitched from their parts; any
    # bucket count (also buckets smaller than a batch) gives the same prompts
    from ticketsift.operators.ordering import (
        BUCKET, assign_batches, assign_positions, positions_by_bucket, straddling_batches,
    )
    from ticketsift.operators.prompts import categorise_requests
    from ticketsift.sources.tables import document_tickets

    t = document_tickets(spark, SF_SMALL)
    plain = {r.batch_id: (r.n_tickets, r.prompt) for r in
             categorise_requests(assign_batches(assign_positions(t, "doc_id")), "ctx", "manual_list", ["A"]).collect()}
    for buckets in (3, 16, 64):
        pos, offsets = positions_by_bucket(t, "doc_id", buckets=buckets)
        req = categorise_requests(assign_batches(pos), "ctx", "manual_list", ["A"], part=BUCKET,
                                  straddlers=straddling_batches(offsets))
        assert {r.batch_id: (r.n_tickets, r.prompt) for r in req.collect()} == plain


def test_requests_shuffle_texts_once(spark):
    df = QUERIES["categorise_requests"](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    own = [line for line in plan.splitlines() if "Exchange hashpartitioning(_bkt" in line and "ReusedExchange" not in line]
    assert len(own) == 1


def test_copy_join_back_salts_hot_keys_only(spark):
    from pyspark.sql import functions as F

    from ticketsift.operators import copies as cp

    rows = spark.range(400).select(F.col("id").alias("pos"), F.when(F.col("id") < 200, F.lit("hot"))
                                   .otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias(cp.COPY_KEY))
    reps = rows.groupBy(cp.COPY_KEY).agg(F.count(F.lit(1)).alias(cp.COPIES))
    hot = cp.hot_keys(reps, 8)
    assert hot == ["hot"]
    decided = reps.select(cp.COPY_KEY, F.lit("X").alias("new_category"))
    joined = cp.spread_back(rows, decided, hot, 8)
    assert "_salt" in _plan(joined)
    assert joined.count() == 400 and joined.filter(F.col("new_category") == "X").count() == 400
