"""The pipeline on the smallest tables: stages in order, decisions take effect."""

from pyspark.sql import functions as F

import corpus_pipeline as cp
from ticketsift.llm import decontaminate, minhash, secret_scan

SF_SMALL = "/root/testdata/sf0.001"


def test_stages_and_result(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    for name, stage in cp.STAGES[:-1]:
        before, docs = docs, cp.materialize(stage(spark, docs, SF_SMALL), name)
        assert docs.columns == columns
        sizes.append(docs.count())
        assert docs.select("doc_id").exceptAll(before.select("doc_id")).isEmpty()
    assert sizes[-1] == sizes[-2] < sizes[0]
    assert minhash.near_duplicates(docs).where("not kept").isEmpty()
    assert decontaminate.contaminated(docs, spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")).isEmpty()
    model = secret_scan.train(secret_scan.labelled_samples(docs))
    assert secret_scan.scan(docs, model).where("size(_spans) > 0").isEmpty()
    pieces = cp.STAGES[-1][1](spark, docs, SF_SMALL)
    assert {r["doc_id"] for r in pieces.collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_empty_documents(spark, tmp):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").where("false").write.parquet(f"{tmp}/{name}.parquet")
    assert cp.run(spark, tmp).count() == 0


def test_odd_rows_pass(spark, tmp):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(20)
    odd = spark.createDataFrame([(None, None, None, None, None), (7000, "", "en", "s", 0), (7001, "word " * 20_000, "en", "s", 1), (7001, "word " * 20_000, "en", "s", 1)], docs.schema)
    docs.unionAll(odd).withColumn("_score", F.lit("clash")).write.parquet(f"{tmp}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").write.parquet(f"{tmp}/{name}.parquet")
    got = cp.run(spark, tmp).collect()
    assert {None, 7000, 7001} <= {r["doc_id"] for r in got}
    assert len([r for r in got if r["doc_id"] == 7001 and r["start"] == 0]) == 1


def test_columns_of_clashing_names_come_through(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(30)
    names = ["_score", "_spans", "_judged", "_base", "_node", "_low", "_h1", "_h2"]
    odd = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for name, stage in cp.STAGES[:-1]:
        odd = cp.materialize(stage(spark, odd, SF_SMALL), name)
        assert odd.columns == [*docs.columns, *names]
    rows = odd.collect()
    assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)


def test_wordless_texts_alone_in_a_partition(spark):
    schema = spark.read.parquet(f"{SF_SMALL}/documents.parquet").schema
    rows = [(9000, None, None, None, None), (9001, "", "en", "s", 0), (9002, "?! ...", "en", "s", 6)]
    docs = spark.createDataFrame(rows[:1], schema)
    for r in rows[1:]:
        docs = docs.unionAll(spark.createDataFrame([r], schema))
    for name, stage in cp.STAGES[:-1]:
        docs = cp.materialize(stage(spark, docs, SF_SMALL), name)
        assert docs.count() == 3
    pieces = cp.STAGES[-1][1](spark, docs, SF_SMALL).collect()
    assert {r["doc_id"] for r in pieces} == {9000, 9001, 9002}


def test_the_driver_gives_memory_back_after_each_stage(spark, monkeypatch):
    done = []
    monkeypatch.setattr(cp, "give_back", lambda: done.append("back"), raising=False)
    monkeypatch.setattr(cp, "STAGES", [(n, lambda s, docs, d, n=n: done.append(n) or docs.limit(2)) for n in ("one", "two")])
    assert cp.run(spark, SF_SMALL).count() == 2
    assert done == ["one", "back", "two", "back"]
