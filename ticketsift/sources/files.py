"""File sources and sinks for ticket tables (SRC1-SRC7, SNK1-SNK3).

* CSV: header row, comma, ``"`` quoting with doubled quotes, newlines inside
  quoted fields; every column read as string (no inference, ids like ``007``
  survive).
* Encoding: each CSV file is checked as a whole for valid UTF-8 (one
  aggregate over its lines, one row per file back); the other files are read
  as windows-1252 (Latin-1 with its own characters translated).  Pipe-delimited ``.txt`` files are read as UTF-8 only.
* Missing-value tokens of a default CSV read become null (option).
* Malformed rows: short rows are padded; rows with surplus fields refuse the
  read, or with ``report=True`` are counted and handed back apart.
* SRC4 (first sheet of an .xlsx) is not built: no spreadsheet reader is
  available, and spreadsheet exports arrive as windows-1252 CSV (SRC2).
* ``multiline=True`` keeps newlines inside quoted fields but cannot split a
  file (one task per file); for large files without embedded newlines pass
  ``multiline=False`` so each file is read in many splits.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import NA_TOKENS, na_to_null
from ..operators.normalise import KNOWN, TicketError
from ..session import materialize

CORRUPT = "_corrupt_record"
#: The characters in which windows-1252 differs from Latin-1 (by code; five codes have none).
WINDOWS = {b: c for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))}
SUFFIXES = {".csv": ",", ".txt": "|"}


@dataclass
class ReadReport:
    files: int
    windows_1252: list[str]
    corrupt_rows: int | None = None
    quarantine: DataFrame | None = None   # the rows with surplus fields: line, _row


def _suffix(path: str) -> str:
    return os.path.splitext(path)[1].lower()


def check_suffixes(paths) -> None:
    """SRC5: unknown extensions are a named error (case-insensitive match)."""
    bad = [p for p in paths if _suffix(p) not in SUFFIXES]
    if bad:
        raise TicketError([f"unsupported file format: '{os.path.basename(p)}' (use .csv or pipe-delimited .txt)" for p in bad])


def listed_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files behind the caller's paths (folders, globs and URIs of any file
    system), as Spark lists them, in the order of the paths, then by name."""
    out: dict[str, None] = {}  # in the order they were met, each once
    for p in paths:
        names = spark.read.format("binaryFile").load(p).select("path").collect()
        out.update(dict.fromkeys(sorted(r["path"] for r in names)))
    return list(out)


def non_utf8_files(spark: SparkSession, files: list[str]) -> list[str]:
    """SRC2 detection: files with any line that is not valid UTF-8.

    The lines are spread over tasks; the aggregate returns one row per file.
    """
    lines = spark.read.text([_literal(f) for f in files]).select(F.col("_metadata.file_path").alias("f"), "value")
    bad = lines.groupBy("f").agg(F.bool_and(F.is_valid_utf8("value")).alias("ok")).filter(~F.col("ok"))
    names = {_plain(r["f"]) for r in bad.collect()}
    return [f for f in files if _plain(f) in names]


def _plain(uri: str) -> str:
    """A file name without scheme, host slashes and percent codes, for comparison."""
    return re.sub("^[a-z]+:/+", "/", unquote(uri))


def _literal(name: str) -> str:
    """A listed file name as a path of its own: nothing in it is a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", name)


def _reader(spark: SparkSession, sep: str, encoding: str, schema: T.StructType | None, multiline: bool = True):
    r = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("inferSchema", False)
        .option("encoding", encoding)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
    )
    return r.schema(schema) if schema is not None else r


def _header_schema(spark: SparkSession, paths, sep: str, encoding: str) -> T.StructType:
    cols = _reader(spark, sep, encoding, None).csv(list(paths)).columns
    return T.StructType([T.StructField(c, T.StringType()) for c in cols] + [T.StructField(CORRUPT, T.StringType())])


def read_files(spark: SparkSession, paths, na_tokens=NA_TOKENS, strict: bool = False,
               report: bool = False, multiline: bool = True) -> DataFrame | tuple[DataFrame, ReadReport]:
    """SRC1-SRC3, SRC5-SRC7: read ticket files of one layout into one table.

    All files must share one header layout and one delimiter.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if any(_suffix(p) for p in paths):
        check_suffixes([p for p in paths if _suffix(p)])
    files = listed_files(spark, paths)
    check_suffixes(files)
    seps = {SUFFIXES[_suffix(f)] for f in files}
    if len(seps) != 1:
        raise TicketError(["one read takes files of one kind: .csv or .txt"])
    sep = seps.pop()
    legacy = non_utf8_files(spark, files) if sep == "," else []
    other = set(legacy)
    parts = []
    for own, encoding in (([f for f in files if f not in other], "UTF-8"), (legacy, "ISO-8859-1")):
        if own:
            names = [_literal(f) for f in own]
            part = _strip_bom(_reader(spark, sep, encoding, _header_schema(spark, names, sep, encoding), multiline).csv(names))
            columns = [c for c in part.columns if c != CORRUPT]
            row = with_row_key(part.withColumn("_long", _surplus(len(columns), sep)), files)
            if encoding != "UTF-8":
                row = row.withColumns({c: _windows(F.col(f"`{c}`")) for c in [*columns, CORRUPT]})
            parts.append(row.toDF(*[_windows_text(c) if encoding != "UTF-8" else c for c in row.columns]))
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p, allowMissingColumns=True)
    data_cols = [c for c in df.columns if c not in (CORRUPT, "_row", "_long")]
    # counted together with a data column: Spark refuses scans of the raw record alone
    n = df.agg(F.count_if("_long").alias("n"), F.count(F.col(f"`{data_cols[0]}`"))).first()["n"]
    if n and (strict or not report):
        raise TicketError([f"{n} rows have more fields than the header; report=True hands them back apart"])
    out = df.filter("NOT _long").select(*[na_to_null(F.col(f"`{c}`"), na_tokens).alias(c) for c in data_cols], "_row")
    if report:
        apart = df.filter("_long").select(F.col(CORRUPT).alias("line"), "_row", F.col(f"`{data_cols[0]}`").alias("_first"))
        return out, ReadReport(len(files), legacy, n, materialize(apart, "long_rows").drop("_first"))
    return out


def with_row_key(scan: DataFrame, files: list[str]) -> DataFrame:
    """A file scan with its file order in ``_row``, a sortable text: place of the file
    in the caller's list, start of the block, row inside the task (which reads a
    block in order).  The places are a table joined by file name, so the plan does
    not grow with the number of files; Spark decides by its size how to join it."""
    name = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^[a-z]+:/+", "/")
    places = scan.sparkSession.createDataFrame([(_plain(f), k + 1) for k, f in enumerate(files)], "_file string, _place long")
    at = scan.select("*", name.alias("_name"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    key = F.concat_ws("-", F.lpad(F.col("_place").cast("string"), 10, "0"), F.lpad(F.col("_block").cast("string"), 19, "0"),
                      F.lpad(F.col("_line").cast("string"), 19, "0"))
    return at.join(places, F.col("_name") == F.col("_file"), "left").withColumn("_row", key).drop("_name", "_file", "_place", "_block", "_line")


def _surplus(fields: int, sep: str):
    """Whether a record that Spark could not fit into the header has more fields
    than it (a short one only lacks some and is padded)."""
    schema = ", ".join(f"c{k} string" for k in range(fields + 1))
    options = {"sep": sep, "quote": '"', "escape": '"', "nullValue": "\u0001", "emptyValue": "", "multiLine": "true"}
    last = F.from_csv(F.col(CORRUPT), F.lit(schema), options)[f"c{fields}"]
    return F.coalesce(F.col(CORRUPT).isNotNull() & last.isNotNull(), F.lit(False))


def _windows_text(text: str) -> str:
    """Text read as Latin-1, with windows-1252's own characters in the C1 range."""
    return text.translate(WINDOWS)


def _windows(col):
    return F.translate(col, "".join(map(chr, WINDOWS)), "".join(WINDOWS.values()))


def _strip_bom(df: DataFrame) -> DataFrame:
    first = df.columns[0]
    if first.startswith("\ufeff"):
        return df.withColumnRenamed(first, first[1:])
    return df


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """SNK1: header, no index, UTF-8, all columns; ``multi_tags`` always present.

    ``escape='"'`` doubles quotes and ``emptyValue=''`` writes blanks as
    nothing, which is what a default pandas export writes.  ``single_file``
    routes every row through one task: for small downloads only; large runs
    write one file per partition.
    """
    if "multi_tags" not in df.columns:
        df = df.withColumn("multi_tags", F.lit(""))
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_template(spark: SparkSession, path: str) -> None:
    """SNK2: the four known headers and zero rows."""
    empty = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in KNOWN]))
    empty.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_run(df: DataFrame, path: str, run_id: str) -> None:
    """SNK3 (saved runs): one folder per run, rows sorted by category inside it; a
    rerun of the same id replaces its folder and touches no other."""
    tagged = df.withColumn("run_id", F.lit(run_id)).sortWithinPartitions("new_category")
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def read_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """The rows of a saved run (only its folder is read)."""
    return spark.read.parquet(path).where(F.col("run_id") == run_id).drop("run_id")


def run_diff(spark: SparkSession, path: str, before: str, after: str, id_col: str = "ticket_id") -> DataFrame:
    """Tickets whose category differs between two saved runs: id, ``before``,
    ``after``, ``change`` (moved, added, removed).  A full outer join on the id, of
    ids and categories only."""
    old, new = (read_run(spark, path, r).select(F.col(id_col).alias(f"_{k}"), F.col("new_category").alias(k)) for k, r in (("before", before), ("after", after)))
    both = old.join(new, F.col("_before") == F.col("_after"), "full_outer")
    change = F.when(F.col("_before").isNull(), "added").when(F.col("_after").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "moved")
    return both.select(F.coalesce("_before", "_after").alias(id_col), "before", "after", change.alias("change")).where(F.col("change").isNotNull())
