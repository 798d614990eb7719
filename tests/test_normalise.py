import pytest
from pyspark.sql import functions as F

from ticketsift.functions.text import cut, pct_half_even, ustrip
from ticketsift.operators.normalise import (
    TicketError, check_auto_mode, check_context, check_manual_list, clean_category_list, normalise, validate,
)
from ticketsift.operators.ordering import assign_positions


def test_header_normalisation_and_clash(spark):
    df = spark.createDataFrame([("a", "b")], [" Issue Description ", "Ticket ID"])
    assert normalise(df).columns[:2] == ["issue_description", "ticket_id"]
    clash = spark.createDataFrame([("a", "b")], ["Issue Description", "issue_description "])
    with pytest.raises(TicketError):
        normalise(clash)


def test_required_column(spark):
    with pytest.raises(TicketError, match="issue_description"):
        normalise(spark.createDataFrame([("x",)], ["summary"]))


def test_blank_rows_dropped_and_unicode_strip(spark):
    rows = [("1", "  real text\t"), ("2", "\t  "), ("3", None), ("4", " x　"), ("5", "")]
    df = normalise(spark.createDataFrame(rows, "ticket_id string, issue_description string"))
    got = {r.ticket_id: r.issue_description for r in df.collect()}
    assert got == {"1": "real text", "4": "x"}
    assert set(df.columns) >= {"current_label", "resolution_notes"}
    assert {r.current_label for r in df.collect()} == {""}


def test_row_ids_when_absent(spark):
    df = spark.createDataFrame([(30, "c"), (10, "a"), (20, "b"), (40, " ")], "k long, issue_description string")
    from ticketsift.operators.normalise import clean_known, drop_blank, fill_defaults, normalise_columns

    d = drop_blank(normalise_columns(df))
    d = clean_known(fill_defaults(assign_positions(d, "k", buckets=2)))
    got = sorted((r.k, r.ticket_id) for r in d.collect())
    assert got == [(10, "Row 1"), (20, "Row 2"), (30, "Row 3")]


def test_present_blank_id_stays_blank(spark):
    df = normalise(spark.createDataFrame([(None, "a"), ("007", "b")], "ticket_id string, issue_description string"))
    assert sorted(r.ticket_id for r in df.collect()) == ["", "007"]


def test_validate_cap_and_empty(spark):
    df = spark.createDataFrame([("a",), ("b",)], "issue_description string")
    assert validate(df, max_rows=2).problems == []
    assert "2 rows" in validate(df, max_rows=1).problems[0]
    assert validate(df.filter("false")).problems


def test_argument_checks():
    assert check_context("123456789") and not check_context(" 1234567890 ")
    assert check_manual_list(["a"]) and not check_manual_list(["a", "b"])
    assert not check_manual_list([str(i) for i in range(15)]) and check_manual_list([str(i) for i in range(16)])
    assert clean_category_list([" a ", "", "a", "  "]) == ["a", "a"]
    assert check_auto_mode(50, ["a", "b"]) and not check_auto_mode(51, ["a", "b"])


def test_cut_and_half_even(spark):
    df = spark.createDataFrame([("x" * 80,), ("y" * 81,)], "d string")
    assert [r[0] for r in df.select(cut("d", 80)).collect()] == ["x" * 80, "y" * 80 + "..."]
    p = spark.createDataFrame([(1, 8), (5, 200), (7, 200), (1, 3)], "a long, b long")
    assert [r[0] for r in p.select(pct_half_even("a", "b")).collect()] == [12, 2, 4, 33]


def test_ustrip_matches_python(spark):
    samples = ["\x1c a \x1f", " x ", " \n tab\t", "\u0085y ", "none"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    assert [r[0] for r in df.select(ustrip("s")).collect()] == [s.strip() for s in samples]


def test_display_cuts_from_the_description_head_are_exact(spark):
    from pyspark.sql import functions as F

    from ticketsift.functions.text import cut, head_chars
    from ticketsift.plans.catalog import DISPLAY_HEAD

    texts = [("é" if i % 7 == 0 else "x") * i for i in range(0, 251)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("h", F.substring("t", 1, DISPLAY_HEAD))
    pairs = [(cut("t", 80), cut("h", 80)), (cut("t", 100), cut("h", 100)),
             (F.substring("t", 1, 80), F.substring("h", 1, 80)), (head_chars("t", 100), head_chars("h", 100))]
    rows = df.select(*[(a == b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).collect()
    assert all(all(r) for r in rows)
