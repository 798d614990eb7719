"""WARC archives in per-record Zstandard frames (operator 8): writer and reader.

An archive starts with a skippable frame that holds the dictionary its records
were compressed with, then has one frame per record.  ``write_archives`` lets
Spark's own text writer commit the frames (one archive per partition, on any
file system Spark writes to): the bytes it puts after each row are an empty
skippable frame, which every Zstandard reader passes over.  ``read_archives``
reads them as binary files, loads the dictionary, decodes frame by frame and
checks header syntax, lengths and digests.

Records of equal payloads: that of the smallest page id is the response, others
refer to it as revisits and carry no payload.

Rows: a null payload counts as empty; a null url gives no target header; a null
page id is always a response and never referred to; repeated rows each give a
record (those with the smallest id are all responses); extra columns are not
read.  An empty table gives an archive folder without records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, materialize
from .common import small_batches

# --- fixed values of the formats ----------------------------------------------
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_MAGIC = 0x184D2A50
FRAME_MAGIC = 0xFD2FB528
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
# ------------------------------------------------------------------------------
#: An empty skippable frame: what the writer puts after each row.
SEPARATOR = struct.pack("<II", SKIPPABLE_MAGIC, 0)
RECORD_URN = "<urn:page:{}>"
#: The dictionary is trained on at most so many payloads of at most so many characters.
DICT_SAMPLE, DICT_SAMPLE_CHARS, DICT_BYTES = 400, 20_000, 32 << 10


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def train_dictionary(payloads: list[bytes]) -> bytes:
    """A Zstandard dictionary, or no bytes where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, payloads, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit (``refers_to`` set) keeps the HTTP header only."""
    digest = sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", RECORD_URN.format("" if page_id is None else page_id)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", RECORD_URN.format(refers_to))]
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}")]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return f"{VERSION}\r\n{lines}\r\n".encode("utf-8", "replace") + block + b"\r\n\r\n"


def with_first_copies(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """``(i, u, p, first)``: ``first`` is the smallest id with the same payload
    where that is another row's, else null.  Only ids and digests are grouped;
    the payloads meet the short list of revisits (which Spark broadcasts only if
    the written table is small)."""
    base = pages.select(F.col(id_col).alias("i"), F.col(url_col).cast("string").alias("u"), F.coalesce(F.col(payload_col), F.lit("")).alias("p"))
    keys = base.select("i", F.sha1("p").alias("d"))
    first = keys.groupBy("d").agg(F.min("i").alias("first"))
    later = materialize(keys.join(first, "d").where(F.col("i") > F.col("first")).distinct(), "revisits")
    tagged = base.withColumn("d", F.sha1("p"))
    return tagged.join(later, ["i", "d"], "left").select("i", "u", "p", "first")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z", level: int = 3) -> None:
    """Write one archive per partition below ``path``."""
    spark = pages.sparkSession
    small_batches(spark)
    sample = pages.select(F.col(payload_col).alias("p")).where(F.length("p").between(1, DICT_SAMPLE_CHARS)).limit(DICT_SAMPLE)
    dictionary = train_dictionary([r["p"].encode("utf-8", "replace") for r in sample.collect()])

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        z = zstandard.ZstdCompressor(level=level, dict_data=trained, write_content_size=True, write_checksum=True)
        opened = not dictionary
        for b in batches:
            out = []
            if not opened and len(b):
                out.append(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                opened = True
            for i, u, p, first in zip(b["i"], b["u"], b["p"], b["first"], strict=True):
                first = None if pd.isna(first) else int(first)
                out.append(z.compress(record(None if pd.isna(i) else int(i), u, p.encode("utf-8", "replace"), first, date)))
            yield pd.DataFrame({"frame": out})

    rows = with_first_copies(pages, id_col, url_col, payload_col).mapInPandas(frames, "frame binary")
    rows.select(F.col("frame").cast("string")).write.option("lineSep", SEPARATOR.decode("latin-1")).text(path)


def split_records(archive: bytes) -> Iterator[bytes]:
    """The records of one archive, a frame each."""
    dictionary, at, view = None, 0, memoryview(archive)
    while at < len(archive):
        if len(archive) - at < 8:
            raise ValueError(f"cut-off frame at {at}")
        magic, size = struct.unpack_from("<II", archive, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE_MAGIC:
            if at + 8 + size > len(archive):
                raise ValueError(f"cut-off skippable frame at {at}")
            if magic == DICTIONARY_MAGIC:
                if at:
                    raise ValueError(f"the dictionary frame must come first, not at {at}")
                content = archive[8 : 8 + size]
                if content[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may itself be compressed
                    content = zstandard.ZstdDecompressor().decompress(content)
                dictionary = zstandard.ZstdCompressionDict(content)
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no Zstandard frame at {at}")
        expected = zstandard.frame_content_size(archive[at : at + 18])
        frame, parts, start = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj(), [], at
        while not frame.eof:
            piece = view[at : at + 65536]
            if not piece:
                raise ValueError(f"cut-off frame at {start}")
            parts.append(frame.decompress(piece))
            at += len(piece)
        at -= len(frame.unused_data)
        data = b"".join(parts)
        if expected >= 0 and len(data) != expected:
            raise ValueError(f"frame at {start}: {len(data)} bytes, its header says {expected}")
        yield data


def parse_record(data: bytes) -> dict:
    """Header fields and block of one record, checked."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not blank or not re.fullmatch(r"WARC/1\.[01]", version):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"header line without a name: {line[:80]!r}")
        if name.lower() in fields:
            raise ValueError(f"header {name} given twice")
        fields[name.lower()] = value.strip()
    for name in REQUIRED:
        if name.lower() not in fields:
            raise ValueError(f"header {name} is missing")
    if not fields["content-length"].isdigit():
        raise ValueError("Content-Length is not a number")
    length = int(fields["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest)} bytes with its end, Content-Length {length}")
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
        raise ValueError("block digest differs")
    return fields | {"block": block}


def page_of(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d*)>", urn or "")
    return int(m[1]) if m and m[1] else None


def read_row(data: bytes, payload: bool) -> tuple:
    """One record as a row; the payload's length and digest are checked."""
    r = parse_record(data)
    http, blank, body = r["block"].partition(b"\r\n\r\n")
    stated = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
    kind, digest = r["warc-type"], r.get("warc-payload-digest", "").removeprefix("sha1:")
    if not blank or not stated:
        raise ValueError("no HTTP header with a length in the block")
    size = int(stated[1])
    if kind == "response" and (len(body) != size or sha1_base32(body) != digest):
        raise ValueError("payload length or digest differs")
    if kind == "revisit" and (body or not re.fullmatch("[A-Z2-7]{32}", digest)):
        raise ValueError("a revisit has a digest and no payload")
    row = (page_of(r["warc-record-id"]), r.get("warc-target-uri"), size, digest, kind, page_of(r.get("warc-refers-to")))
    return (*row, body.decode("utf-8") if payload and kind == "response" else None) if payload else row


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Rows ``page_id, url, payload_bytes, payload_digest, record_type, refers_to``
    (and ``payload`` of responses) of the archives below ``path``.  A record that
    breaks the format fails the read with its archive's name."""
    small_batches(spark)
    cols = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payload]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload string" * payload

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                out, held = [], 0
                try:
                    for data in split_records(bytes(content)):
                        out.append(read_row(data, payload))
                        held += len(data) if payload else 100
                        if held > 4 << 20:
                            yield _frame(out, cols)
                            out, held = [], 0
                except (ValueError, zstandard.ZstdError) as e:
                    raise ValueError(f"{name}: {e}") from e
                yield _frame(out, cols)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, schema)


def _frame(rows: list[tuple], cols: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=cols)
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/ticketsift/warc-{uuid.uuid4().hex}"
