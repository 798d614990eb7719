import glob
import json
import os

import pytest

from ticketsift.operators.normalise import TicketError, normalise
from ticketsift.sources.files import export_csv, read_files, write_template


def _write(path, text, encoding="utf-8"):
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)
    return path


def test_csv_quotes_newlines_and_ids(spark, tmp):
    p = _write(os.path.join(tmp, "a.CSV"),
               'Ticket ID,Issue Description,extra\n007,"Printer, on floor 2, says ""jam""",x\n'
               '008,"line one\nline two",y\n')
    df = normalise(read_files(spark, p))
    rows = sorted((r.ticket_id, r.issue_description, r.extra) for r in df.collect())
    assert rows == [("007", 'Printer, on floor 2, says "jam"', "x"), ("008", "line one\nline two", "y")]


def test_windows_1252_next_to_utf8(spark, tmp):
    a = _write(os.path.join(tmp, "u.csv"), "issue_description\ncafé au lait spilled\n")
    b = _write(os.path.join(tmp, "w.csv"), "issue_description\nnaïve “quote” issue\n", encoding="windows-1252")
    df, rep = read_files(spark, [a, b], report=True)
    assert sorted(r[0] for r in df.collect()) == ["café au lait spilled", "naïve “quote” issue"]
    assert len(rep.windows_1252) == 1 and rep.windows_1252[0].endswith("w.csv")


def test_pipe_txt_padded(spark, tmp):
    p = _write(os.path.join(tmp, "t.txt"), " ticket_id | issue_description \n A1 |  disk full  \n")
    df = normalise(read_files(spark, p))
    assert [(r.ticket_id, r.issue_description) for r in df.collect()] == [("A1", "disk full")]


def test_unknown_extension(spark, tmp):
    with pytest.raises(TicketError, match="unsupported"):
        read_files(spark, os.path.join(tmp, "x.json"))


def test_na_tokens_dropped(spark, tmp):
    p = _write(os.path.join(tmp, "n.csv"), "issue_description,current_label\nNone,a\nN/A,b\nreal,NA\n")
    df = normalise(read_files(spark, p))
    assert [(r.issue_description, r.current_label) for r in df.collect()] == [("real", "")]
    kept = normalise(read_files(spark, p, na_tokens=()))
    assert kept.count() == 3


def test_malformed_rows(spark, tmp):
    body = "ticket_id,issue_description,current_label\n1,short\n2,ok,l\n3,long,l,surplus\n4,long,,extra\n5,blank end,\n"
    p = _write(os.path.join(tmp, "m.csv"), body)
    df, rep = read_files(spark, p, report=True)
    assert sorted((r.ticket_id, r.current_label) for r in df.collect()) == [("1", None), ("2", "l"), ("5", None)]
    assert rep.corrupt_rows == 2
    assert sorted(r.line for r in rep.quarantine.collect()) == ["3,long,l,surplus", "4,long,,extra"]
    with pytest.raises(TicketError, match="2 rows"):
        read_files(spark, p)


def test_encoding_is_found_behind_globs_uris_and_folders(spark, tmp):
    os.makedirs(os.path.join(tmp, "in dir"))
    _write(os.path.join(tmp, "in dir", "b.csv"), "ticket_id,issue_description\n1,plain é\n")
    with open(os.path.join(tmp, "in dir", "a.csv"), "wb") as f:
        f.write("ticket_id,issue_description\n2,caf\xe9 \x80 5\n".encode("latin-1"))
    want = [("1", "plain é"), ("2", "café € 5")]
    folder = os.path.join(tmp, "in dir")
    for paths in (f"{folder}/*.csv", folder, f"file://{folder}/*.csv", [f"{folder}/b.csv", f"file://{folder}/a.csv"]):
        got = read_files(spark, paths)
        assert sorted((r.ticket_id, r.issue_description) for r in got.collect()) == want
    ordered = read_files(spark, [f"{folder}/b.csv", f"{folder}/a.csv"]).orderBy("_row").collect()
    assert [r.ticket_id for r in ordered] == ["1", "2"]


def test_file_order_reaches_the_run_and_the_export_has_no_internal_columns(spark, tmp):
    from ticketsift.plans.run import run

    rows = "".join(f"T-{k},login fails {k},x\n" for k in range(1, 13))
    p = _write(os.path.join(tmp, "t.csv"), "ticket_id,issue_description,team\n" + rows)
    tickets = normalise(read_files(spark, p))
    replies = [(0, json.dumps([{"ticket_id": f"T-{k}", "new_category": f"C{k}", "confidence": "High", "reasoning": "r"} for k in range(1, 11)]), None),
               (1, json.dumps([{"ticket_id": f"T-{k}", "new_category": f"C{k}", "confidence": "High", "reasoning": "r"} for k in (11, 12)]), None)]
    res = run(tickets, "Support tickets of a shop", mode="no_suggestions", decider="replay",
              responses=spark.createDataFrame(replies, "batch_id long, raw string, error string"))
    assert [r.ticket_id for r in res.labelled.orderBy("pos").collect()] == [f"T-{k}" for k in range(1, 13)]
    assert not any("parse" in r.reasoning for r in res.labelled.collect())
    assert res.export.columns == ["ticket_id", "issue_description", "team", "current_label", "resolution_notes",
                                  "new_category", "confidence", "reasoning", "multi_tags"]


def test_export_round_trip_and_template(spark, tmp):
    src = spark.createDataFrame([("1", 'a "quoted", text\nsecond line', "", "r")],
                                "ticket_id string, issue_description string, current_label string, resolution_notes string")
    out = os.path.join(tmp, "out")
    export_csv(src, out, single_file=True)
    files = glob.glob(os.path.join(out, "*.csv"))
    text = open(files[0], encoding="utf-8").read()
    assert text.startswith("ticket_id,issue_description,current_label,resolution_notes,multi_tags\n")
    assert '"a ""quoted"", text\nsecond line"' in text and ',,r,\n' in text
    back = read_files(spark, files[0], na_tokens=()).drop("_row")
    assert back.collect()[0].issue_description == 'a "quoted", text\nsecond line'
    t = os.path.join(tmp, "tpl")
    write_template(spark, t)
    body = open(glob.glob(os.path.join(t, "*.csv"))[0]).read()
    assert body.strip() == "ticket_id,issue_description,current_label,resolution_notes"


def test_row_ids_in_file_order(spark, tmp):
    p = _write(os.path.join(tmp, "o.csv"), "issue_description\nfirst\n \nsecond\nthird\n")
    df = normalise(read_files(spark, p))
    assert sorted((r.ticket_id, r.issue_description) for r in df.collect()) == [
        ("Row 1", "first"), ("Row 2", "second"), ("Row 3", "third")]


def test_builtin_datasets(spark):
    from conftest import SF_SMALL

    from ticketsift.sources.tables import dataset, dataset_context

    assert dataset(spark, SF_SMALL, "documents").count() == 200
    assert len(dataset_context("conversations")) >= 10
    with pytest.raises(ValueError, match="conversations, documents"):
        dataset(spark, SF_SMALL, "nope")


def test_checkpoint_folder_is_read_from_the_session_and_never_local_on_a_cluster():
    import pytest

    from ticketsift.session import ensure_checkpoint_dir

    class Conf(dict):
        def get(self, k, d=None):
            return dict.get(self, k, d)

        def set(self, k, v):
            self[k] = v

    class Ctx:
        def __init__(self, master):
            self.master, self.dir = master, None

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return self.dir

        def setCheckpointDir(self, d):
            self.dir = d

    class Session:
        def __init__(self, master, conf):
            self.conf, self.sparkContext = Conf(conf), Ctx(master)

    shared = Session("yarn", {"spark.checkpoint.dir": "hdfs://shared/ckpt"})
    assert ensure_checkpoint_dir(shared) == "hdfs://shared/ckpt" and shared.sparkContext.dir == "hdfs://shared/ckpt"
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session("spark://master:7077", {}))
    assert ensure_checkpoint_dir(Session("local[8]", {}))


def test_spread_only_touches_scans_with_fewer_splits_than_slots(spark, tmp):
    from ticketsift.sources.tables import spread

    slots = spark.sparkContext.defaultParallelism
    spark.range(1000).repartition(1).write.parquet(f"{tmp}/one")
    spark.range(1000).repartition(slots * 2).write.parquet(f"{tmp}/many")
    one, many = spark.read.parquet(f"{tmp}/one"), spark.read.parquet(f"{tmp}/many")
    assert spread(one).rdd.getNumPartitions() == slots
    kept = spread(many)
    assert "RoundRobinPartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
