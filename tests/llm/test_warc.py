"""Operator 8: round trip, format checks, edge cases."""

import struct

import pytest
import zstandard

from ticketsift.llm import warc


def rows(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string, payload_digest string")


def test_round_trip(spark, tmp):
    data = [(5, "http://a/\r\nx", "same", "z"), (2, "http://b/", "same", "z"), (2, "http://b/", "same", "z"), (7, None, None, "z"), (1, "u", "", "z"), (9, "u", "é🙂" * 50_000, "z"), (None, "u", "same", "z")]
    data += [(100 + k, f"http://p/{k}", f"<html><body>page {k} of a site with a common frame</body></html>" * 3, "z") for k in range(300)]
    path = f"{tmp}/archives"
    warc.write_archives(rows(spark, data), path)
    got = warc.read_archives(spark, path).collect()
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    assert len(got) == len(data)
    assert [(r["record_type"], r["refers_to"]) for r in by[5]] == [("revisit", 2)]
    assert [(r["record_type"], r["refers_to"]) for r in by[2]] == [("response", None)] * 2
    assert [(r["record_type"], r["refers_to"]) for r in by[None]] == [("response", None)]
    assert (by[7][0]["record_type"], by[7][0]["refers_to"], by[7][0]["payload_bytes"]) == ("revisit", 1, 0)
    assert by[9][0]["payload"] == "é🙂" * 50_000 and by[9][0]["payload_bytes"] == 6 * 50_000
    assert by[5][0]["payload_digest"] == warc.sha1_base32(b"same") and by[5][0]["url"] == "http://a/%0D%0Ax"
    # the archives start with their dictionary
    first = spark.read.format("binaryFile").load(path).where("length > 0").select("content").first()[0]
    assert struct.unpack_from("<I", first)[0] == warc.DICTIONARY_MAGIC


def test_empty_table(spark, tmp):
    warc.write_archives(rows(spark, []), f"{tmp}/none")
    assert warc.read_archives(spark, f"{tmp}/none").count() == 0


def test_compressed_dictionary_and_plain_frames():
    raw = warc.train_dictionary([f"record {k} with some common words in it".encode() * 4 for k in range(500)])
    record = warc.record(1, "u", b"payload", None, "2024-01-01T00:00:00Z")
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw)).compress(record)
    packed = zstandard.ZstdCompressor().compress(raw)
    archive = struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed + frame + warc.SEPARATOR + zstandard.compress(record)
    assert list(warc.split_records(archive)) == [record, record]


@pytest.mark.parametrize("spoil", [
    lambda a: a[:-3], lambda a: b"junk" + a, lambda a: a + b"\x00",
])
def test_broken_archives_are_refused(spoil):
    archive = zstandard.compress(warc.record(1, "u", b"payload", None, "2024-01-01T00:00:00Z"))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.split_records(spoil(archive)))


@pytest.mark.parametrize("old, new", [
    (b"WARC/1.1", b"WARX/1.1"), (b"Content-Length: 9", b"Content-Length: 8"), (b"WARC-Date", b"WARC-Dat"), (b"payload", b"paxload"), (b"WARC-Type: response", b"WARC-Type response"),
])
def test_broken_records_are_refused(old, new):
    record = warc.record(1, "u", b"payload", None, "2024-01-01T00:00:00Z")
    assert warc.read_row(record, True)[-1] == "payload"
    with pytest.raises(ValueError):
        warc.read_row(record.replace(old, new) if old in record else record[:-1], True)
