"""WARC archives whose payloads are stored once.

An archive is two tables in the shared folder: ``headers`` keeps each record's exact header block,
``payloads`` the bytes of each distinct payload as one zstd frame under its SHA-256. Reading joins
them, checks every payload against its digest and length and gives the original records again.

Of records with equal payloads of at least ``least`` bytes the one with the largest page id (of
repeated rows with that id one) is the response and the others revisit it; smaller ones are all
responses. Bytes of a payload are moved to their digest's place after each task has dropped its own
repeats, and the choice of the response is made on ids and digests alone.

Defined cases: a null html is an empty payload; a null url has no target header; a null id sorts
before all others and is reported as null; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costwise.llm.storage import map_batches, prefixed, scratch


@dataclass(frozen=True)
class Params:
    #: Payloads of fewer bytes are never revisited.
    least: int = 0
    level: int = 3
    date: str = "1970-01-01T00:00:00Z"


@dataclass(frozen=True)
class Archive:
    headers: str
    payloads: str


class DamagedArchive(ValueError):
    pass


def _base32(data) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _payload(html) -> bytes:
    return (html or "").encode("utf-8", "surrogatepass")


def _digests(pages: DataFrame) -> DataFrame:
    """page_id, url, record (unique), digest, sha1, bytes of each row, without its payload."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 36
        for batch in batches:
            digest, sha1, size = [], [], []
            for html in batch.column(2):
                data = _payload(html.as_py())
                digest.append(hashlib.sha256(data).digest())
                sha1.append(_base32(data))
                size.append(len(data))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(range(n, n + len(size)), pa.int64()), pa.array(digest, pa.binary()),
                 pa.array(sha1, pa.string()), pa.array(size, pa.int64())],
                ["page_id", "url", "record", "digest", "sha1", "bytes"],
            )
            n += len(size)

    schema = f"page_id {kind}, url string, record long, digest binary, sha1 string, bytes long"
    return map_batches(prefixed(pages, "page_id", "url", "html"), run, schema)


def _frames(pages: DataFrame, p: Params) -> DataFrame:
    """digest, frame: each payload once for each task that holds it."""

    def run(batches):
        import zstandard

        pack, seen = zstandard.ZstdCompressor(level=p.level), set()
        for batch in batches:
            digest, frame = [], []
            for html in batch.column(0):
                data = _payload(html.as_py())
                own = hashlib.sha256(data).digest()
                if own not in seen:
                    seen.add(own)
                    digest.append(own)
                    frame.append(pack.compress(data))
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(frame, pa.binary())], ["digest", "frame"])

    return map_batches(pages.select("html"), run, "digest binary, frame binary")


def write_archive(pages: DataFrame, p: Params = Params()) -> Archive:
    """Write one record for each row of ``pages`` (page_id, url, html)."""
    spark = pages.sparkSession
    archive = Archive(scratch(spark, "warc-headers"), scratch(spark, "warc-payloads"))
    staged = scratch(spark, "warc-digests")
    _digests(pages).write.option("compression", "zstd").parquet(staged)
    rows = spark.read.parquet(staged)
    # the largest id as a number where it is one; a struct orders by its fields
    chosen = rows.filter(F.col("bytes") >= p.least).groupBy("digest").agg(F.max(F.struct("page_id", "record")).alias("kept"))
    kept = chosen.select("digest", F.col("kept.page_id").alias("kept_page"), F.col("kept.record").alias("kept_record"))
    revisit = F.col("kept_record").isNotNull() & (F.col("kept_record") != F.col("record"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    page = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    uri = lambda c, r: F.concat(F.lit("<urn:page:"), page(c), F.lit(":"), F.col(r).cast("string"), F.lit(">"))
    target = F.translate(F.regexp_replace("url", "[\r\n]+", "%0D%0A"), "\t", " ")
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", uri("page_id", "record")),
        line("WARC-Date", F.lit(p.date)),
        F.coalesce(line("WARC-Target-URI", target), F.lit("")),
        F.when(revisit, F.concat(
            line("WARC-Refers-To", uri("kept_page", "kept_record")),
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        )).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
        F.lit("\r\n"),
    )
    rows.join(kept, "digest", "left").select(
        "page_id", F.col("digest"), F.col("bytes").alias("payload_bytes"), F.encode(header, "utf-8").alias("header")
    ).write.option("compression", "zstd").parquet(archive.headers)
    _frames(pages, p).groupBy("digest").agg(F.first("frame").alias("frame")).write.option("compression", "none").parquet(archive.payloads)
    return archive


_FIELD = re.compile(rb"^([A-Za-z-]+): ([^\r\n]*)\r$", re.M)


def read_archive(spark: SparkSession, archive: Archive, with_record: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and, unless left out, the record's exact bytes
    (header block, payload of a response, two line ends), of every record.

    Raises DamagedArchive when a payload is missing or its bytes do not have its digest."""
    headers, payloads = spark.read.parquet(archive.headers), spark.read.parquet(archive.payloads)
    kind = headers.schema["page_id"].dataType.simpleString()
    joined = headers.join(payloads, "digest", "left").select("page_id", "digest", "payload_bytes", "header", "frame")

    def run(batches):
        import zstandard

        unpack, last, data, sha1 = zstandard.ZstdDecompressor(), None, b"", ""
        for batch in batches:
            out = ([], [], [], [], [])
            for digest, size, header, frame in zip(*(batch.column(i) for i in range(1, 5)), strict=True):
                own = digest.as_py()
                if own != last:  # rows of one payload come together
                    if not frame.is_valid:
                        raise DamagedArchive(f"payload {own.hex()} is missing")
                    data = unpack.decompress(frame.as_py(), max_output_size=max(1, size.as_py()))
                    if hashlib.sha256(data).digest() != own or len(data) != size.as_py():
                        raise DamagedArchive(f"payload {own.hex()} is not what its digest says")
                    last, sha1 = own, _base32(data)
                block = header.as_py()
                fields = {k.decode(): v.decode() for k, v in _FIELD.findall(block)}
                if fields["WARC-Payload-Digest"] != f"sha1:{sha1}":
                    raise DamagedArchive(f"{fields['WARC-Record-ID']} does not have its payload's digest")
                refers = fields.get("WARC-Refers-To", "").removeprefix("<urn:page:").rpartition(":")[0]
                out[0].append(len(data))
                out[1].append(sha1)
                out[2].append(fields["WARC-Type"])
                out[3].append(None if refers in ("", "null") else refers)
                if with_record:
                    out[4].append(block + (data if fields["WARC-Type"] == "response" else b"") + b"\r\n\r\n")
            arrays = [batch.column(0), pa.array(out[0], pa.int64()), *(pa.array(x, pa.string()) for x in out[1:4])]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            if with_record:
                arrays.append(pa.array(out[4], pa.binary()))
                names.append("record")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to string"
    found = map_batches(joined, run, schema + (", record binary" if with_record else ""))
    return found.withColumn("refers_to", F.col("refers_to").cast(kind))
