"""Operator 13: the digest index against a plain grouping, over batches and sessions."""

import hashlib

from ticketsift.llm import exact_dedup as xd

SCHEMA = "doc_id long, text string, digest string, n int"


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    out = []
    for i, t in rows:
        own = groups[low(t)]
        keep = max((k for k in own if k is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


ROWS = [
    (1, "Alpha beta"), (2, "alpha BETA"), (3, "alpha  beta"), (4, None), (5, ""), (6, "ÄRGER"), (7, "ärger"), (8, "İstanbul"),
    (9, "x" * 200_000), (10, "X" * 200_000), (None, "Alpha beta"), (None, "nobody"), (None, "nobody"), (11, " "), (12, "K"), (13, "k"), (2, "alpha BETA"), (-5, "same"), (90, "SAME"),
]


def test_matches_a_plain_grouping(spark):
    hot = [(100 + k, "copy " if k % 2 else "COPY ") for k in range(400)]
    out = xd.deduplicate(frame(spark, ROWS + hot).repartition(6))
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert got(out) == plain(ROWS + hot)


def test_string_ids_and_empty_table(spark):
    df = spark.createDataFrame([("b", "T"), ("a", "t"), ("c", "u")], "doc_id string, text string")
    assert [(r[0], r[1], r[2], r[3]) for r in sorted(xd.deduplicate(df).collect())] == [("a", "b", 2, False), ("b", "b", 2, True), ("c", "c", 1, True)]
    assert xd.deduplicate(df.where("false")).count() == 0


def test_index_outlives_its_table_entry_and_takes_a_batch_once(spark, tmp):
    path = f"{tmp}/index"
    first = xd.open_index(spark, path, buckets=4)
    a = xd.digests(frame(spark, [(1, "one"), (2, "two"), (3, "ONE")]))
    first.add(a, "monday")
    spark.sql(f"DROP TABLE {first.table}")  # as in a new session; the folder stays
    index = xd.open_index(spark, path, buckets=99)
    assert (index.buckets, index.has("monday"), index.has("tuesday")) == (4, True, False)
    index.add(a, "monday")
    b = xd.digests(frame(spark, [(10, "Two"), (11, "three"), (12, "three")]))
    index.add(b, "tuesday")
    out = {r["id"]: (r["keep_id"], r["group_size"]) for r in xd.decisions(b, index).collect()}
    assert out == {10: (2, 2), 11: (12, 2), 12: (12, 2)}  # across batches the first stays
    assert index.groups().count() == 3


def test_a_batch_that_was_cut_off_is_added_again(spark, tmp):
    index = xd.open_index(spark, f"{tmp}/index", buckets=3)
    rows = xd.digests(frame(spark, [(1, "one"), (2, "two"), (3, "ONE")]))
    index.add(rows, "monday")
    index.entries().limit(1).count()
    done = index.path + "_done"
    spark.createDataFrame([], "batch string").write.mode("overwrite").json(done)  # the mark never came
    index.add(rows, "monday")
    assert {r["id"]: (r["keep_id"], r["group_size"]) for r in xd.decisions(rows, index).collect()} == {1: (3, 2), 2: (2, 1), 3: (3, 2)}


def test_index_is_read_without_an_exchange(spark, tmp):
    index = xd.open_index(spark, f"{tmp}/index", buckets=8)
    index.add(xd.digests(frame(spark, ROWS)), "all")
    plan = index.groups()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
