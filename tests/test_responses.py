import json

from pyspark.sql import functions as F

from ticketsift.operators.responses import (
    ERROR_PREFIX, FAILED_REASON, apply_replies, apply_tag_replies, parse_name_list, parse_replies,
    parse_replies_strict, parse_review, strip_fences,
)


def _batch(spark, n, batch_id=0):
    rows = [(f"T{i}", batch_id, i) for i in range(n)]
    return spark.createDataFrame(rows, "ticket_id string, batch_id long, batch_pos int")


def _req(spark, sizes):
    return spark.createDataFrame(list(sizes.items()), "batch_id long, n_tickets long")


def _resp(spark, rows):
    return spark.createDataFrame(rows, "batch_id long, raw string, error string")


def _items(n, **override):
    return [dict({"ticket_id": f"T{i}", "new_category": f"C{i}", "confidence": "High", "reasoning": "r"}, **override) for i in range(n)]


def test_strip_fences(spark):
    cases = ["```json\n[1]\n```", "```\n[2]\n```", "  [3] ", "note ```json [4]```", "```json"]
    df = spark.createDataFrame([(c.strip(),) for c in cases], "r string")
    got = [r[0] for r in df.select(strip_fences("r")).collect()]
    assert got == ["[1]", "[2]", "[3]", "note ```json [4]```", ""]


def test_positional_apply_and_failures(spark):
    b = _batch(spark, 3, 0).unionByName(_batch(spark, 2, 1)).unionByName(_batch(spark, 2, 2)).unionByName(_batch(spark, 2, 3))
    b = b.withColumn("ticket_id", F.concat(F.col("batch_id").cast("string"), F.lit("-"), "ticket_id"))
    reordered = list(reversed(_items(3)))
    resp = _resp(spark, [
        (0, "```json\n" + json.dumps(reordered) + "\n```", None),   # applied by position
        (1, json.dumps(_items(3)), None),                            # too long -> failure
        (2, None, "quota exceeded"),                                 # call failed
        (3, json.dumps([{"ticket_id": "x"}, {"new_category": None, "confidence": "Low"}]), None),
    ])
    parsed = parse_replies(resp, _req(spark, {0: 3, 1: 2, 2: 2, 3: 2}))
    out = {r.ticket_id: (r.new_category, r.confidence, r.reasoning) for r in apply_replies(b, parsed).collect()}
    assert out["0-T0"] == ("C2", "High", "r") and out["0-T2"] == ("C0", "High", "r")
    assert out["1-T0"] == ("Uncategorised", "Low", FAILED_REASON)
    assert out["2-T1"] == ("Uncategorised", "Low", ERROR_PREFIX + "quota exceeded")
    assert out["3-T0"] == ("Uncategorised", "Low", "")          # absent keys -> defaults
    assert out["3-T1"] == (None, "Low", "")                     # explicit null stays null


def test_non_object_element_fails_batch(spark):
    b = _batch(spark, 2)
    resp = _resp(spark, [(0, json.dumps([_items(1)[0], "oops"]), None)])
    out = apply_replies(b, parse_replies(resp, _req(spark, {0: 2}))).collect()
    assert {r.reasoning for r in out} == {FAILED_REASON}


def test_align_by_ticket_id(spark):
    b = _batch(spark, 2)
    resp = _resp(spark, [(0, json.dumps(list(reversed(_items(2)))), None)])
    out = {r.ticket_id: r.new_category for r in apply_replies(b, parse_replies(resp, _req(spark, {0: 2})), align="ticket_id").collect()}
    assert out == {"T0": "C0", "T1": "C1"}


def test_strict_parse_rejects_trailing_text(spark):
    req = _req(spark, {0: 1, 1: 1})
    resp = _resp(spark, [(0, json.dumps(_items(1)) + " trailing", None), (1, json.dumps(_items(1)), None)])
    ok = {r.batch_id: r.ok for r in parse_replies_strict(resp, req).collect()}
    assert ok == {0: False, 1: True}


def test_tag_replies(spark):
    b = _batch(spark, 3, 0).unionByName(_batch(spark, 1, 1)).unionByName(_batch(spark, 1, 2))
    b = b.withColumn("ticket_id", F.concat(F.col("batch_id").cast("string"), F.lit("-"), "ticket_id"))
    resp = _resp(spark, [
        (0, json.dumps([{"tags": ["A", "B"]}, {"tags": "ab"}, {"x": 1}]), None),
        (1, json.dumps([{"tags": None}]), None),
        (2, json.dumps([{"tags": [1, "A"]}]), None),
    ])
    parsed = parse_replies(resp, _req(spark, {0: 3, 1: 1, 2: 1}))
    out = {r.ticket_id: r.multi_tags for r in apply_tag_replies(b, parsed).collect()}
    assert out == {"0-T0": "A | B", "0-T1": "a | b", "0-T2": "", "1-T0": "", "2-T0": ""}


def test_review_and_name_list(spark):
    good = json.dumps({"narrative": "n", "category_summaries": {"A": "a"}, "auto_merges": [{"merge_these": ["A", "B"], "into": "C"}],
                       "merge_flags": ["f"], "uncategorised_analysis": ["u"]})
    df = spark.createDataFrame([(good,), ("not json",)], "r string").select(parse_review("r").alias("v"))
    rows = df.collect()
    assert rows[0].v.auto_merges[0].into == "C" and rows[0].v.category_summaries == {"A": "a"}
    assert rows[1].v.narrative is None and rows[1].v.auto_merges == [] and rows[1].v.merge_flags == []
    names = spark.createDataFrame([('["  A ", "", "B"]',), ('{"a": 1}',), ("```json\n[\"  \"]\n```",)], "r string")
    assert [r[0] for r in names.select(parse_name_list("r")).collect()] == [["A", "B"], [], [""]]


def test_truncated_single_quoted_object_and_string_replies_fail_the_batch_on_both_paths(spark):
    good = json.dumps(_items(2))
    single = good.replace('"', "'")
    obj = json.dumps(_items(1)[0])                       # an object where a one-element array is due
    strings = json.dumps(["a", "b"])
    resp = _resp(spark, [(0, good[:-5], None), (1, single, None), (2, good, None), (3, obj, None), (4, strings, None)])
    req = _req(spark, {0: 2, 1: 2, 2: 2, 3: 1, 4: 2})
    for parse in (parse_replies, parse_replies_strict):
        ok = {r.batch_id: r.ok for r in parse(resp, req).collect()}
        assert ok == {0: False, 1: False, 2: True, 3: False, 4: False}


def test_model_calls_are_spread_over_the_task_slots(spark):
    from ticketsift.operators.deciders import call_requests

    # a grouped request table of small prompts: adaptive execution alone would
    # coalesce it into one partition and the calls would run one by one
    req = spark.range(300).select((F.col("id") % 100).alias("batch_id"), F.lit("p").alias("prompt")).groupBy(
        "batch_id").agg(F.first("prompt").alias("prompt"))
    out = call_requests(req, lambda: (lambda p: "[]"))
    assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert out.count() == 100 and out.filter(F.col("error").isNotNull()).count() == 0
