from __future__ import annotations

import base64
import hashlib

import pytest

from costwise.llm import warc

SCHEMA = "page_id long, url string, html string"


def rows_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


PAGES = [
    (1, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (3, None, "<p>two é𝕏</p>"), (4, "http://c/\r\nX: y", None), (5, "u", ""),
    (6, "u", "x" * 300_000), (7, "u", "x" * 300_000), (2, "http://b/", "<p>one</p>"), (None, "n", "<p>two é𝕏</p>"), (8, "ü", "\r\n\r\nWARC/1.1\r\n"),
]


def test_records_and_round_trip(spark):
    archive = warc.write_archive(rows_of(spark, PAGES))
    found = warc.read_archive(spark, archive).collect()
    assert len(found) == len(PAGES)
    for page_id, _, html in PAGES:
        own = [r for r in found if r.page_id == page_id]
        assert all(r.payload_digest == digest(html) and r.payload_bytes == len((html or "").encode()) for r in own)
    kind = {r.page_id: (r.record_type, r.refers_to) for r in found if r.page_id != 2}
    assert kind == {1: ("revisit", 2), 3: ("response", None), 4: ("revisit", 5), 5: ("response", None), 6: ("revisit", 7),
                    7: ("response", None), None: ("revisit", 3), 8: ("response", None)}
    assert sorted((r.record_type, r.refers_to) for r in found if r.page_id == 2) == [("response", None), ("revisit", 2)]
    for r in found:  # exact bytes: header block, payload of a response, two line ends
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        html = next(h for p, _, h in PAGES if p == r.page_id) or ""
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode())
        assert rest == (html.encode() if r.record_type == "response" else b"") + b"\r\n\r\n"
        assert int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0]) == len(rest) - 4
        assert b"\r\nX: y" not in head
    assert spark.read.parquet(archive.payloads).count() == len({h or "" for _, _, h in PAGES})


def test_small_payloads_are_all_responses(spark):
    archive = warc.write_archive(rows_of(spark, PAGES), warc.Params(least=11))
    found = warc.read_archive(spark, archive, with_record=False).collect()
    for r in found:
        if r.payload_bytes < 11:
            assert (r.record_type, r.refers_to) == ("response", None)
    assert {r.page_id for r in found if r.record_type == "revisit"} == {6, None}


def test_empty_table_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    assert warc.read_archive(spark, warc.write_archive(rows_of(spark, []))).count() == 0
    df = rows_of(spark, PAGES[:3])
    for c in ("digest", "frame", "bytes", "record", "header", "kept"):
        df = df.withColumn(c, F.lit(1))
    assert warc.read_archive(spark, warc.write_archive(df)).count() == 3


def test_damage_is_noticed(spark):
    from pyspark.sql import functions as F

    archive = warc.write_archive(rows_of(spark, PAGES))
    payloads = spark.read.parquet(archive.payloads)
    other = warc.Archive(archive.headers, archive.payloads + "-other")
    one = payloads.select("frame").first().frame
    payloads.withColumn("frame", F.lit(one)).write.parquet(other.payloads)
    with pytest.raises(Exception, match="not what its digest says|Damaged"):
        warc.read_archive(spark, other).collect()
