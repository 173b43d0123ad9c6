"""Content-addressed web archive.

Payload bytes are stored once, compressed, under the SHA-256 of what they were; every record's header block is stored apart, byte for byte. The
original records come back by joining the two. Of records with one payload, that of the smallest page is a response
and the others revisit it.

Edge cases: a null html is an empty payload; a null url is an empty one; payloads shorter than `least_bytes` are all
responses; rows that repeat a page with the same payload are records of their own, one of them the response; an empty
table gives an empty archive; other columns are ignored.
"""
from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
RECORD_ID = "urn:page:"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_block(page_id: int, copy: int, url: str, digest: str, size: int, refers_to: int | None) -> bytes:
    """Header lines of a record, up to and with the blank line."""
    name = f"{RECORD_ID}{page_id}" + (f":{copy}" if copy else "")
    clean = "".join(c for c in url if c not in "\r\n")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{name}>"),
              ("WARC-Date", DATE), ("WARC-Target-URI", clean), ("WARC-Payload-Digest", f"sha1:{digest}"),
              ("Content-Type", "text/html")]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", f"<{RECORD_ID}{refers_to}>")]
    fields.append(("Content-Length", str(size if refers_to is None else 0)))
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in fields), b"", b""])


def parse_header(block: bytes) -> dict[str, str]:
    if not block.startswith(VERSION + b"\r\n") or not block.endswith(b"\r\n\r\n"):
        raise ValueError("no header block of a WARC record")
    pairs = (line.split(b": ", 1) for line in block[:-4].split(b"\r\n")[1:])
    return {k.decode(): v.decode() for k, v in pairs}


def _payload(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _opened(stored: bytes, address: bytes) -> bytes:
    """The bytes of a stored payload, verified."""
    body = zstandard.ZstdDecompressor().decompress(stored)
    if hashlib.sha256(body).digest() != address:
        raise ValueError("a stored payload does not have its digest")
    return body


def _digests(pages: DataFrame) -> DataFrame:
    """(page_id, url, address, digest, size): what identifies a payload, without its bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [_payload(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([hashlib.sha256(x).digest() for x in data]),
                 pa.array([sha1_base32(x) for x in data]), pa.array([len(x) for x in data], pa.int64())],
                ["page_id", "url", "address", "digest", "size"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(
        run, "page_id long, url string, address binary, digest string, size long")


def write_archive(pages: DataFrame, path: str, scratch, least_bytes: int = 0) -> None:
    """Write the archive's two tables, `payloads` and `records`, into a folder.

    Only digests meet by payload, in partial aggregates; the bytes move once, by page, to those pages that a payload
    is stored for.
    """
    seen = scratch.settle(_digests(pages), "digests")
    first = seen.groupBy("address", "size").agg(F.min("page_id").alias("keeper"))
    # records that are alike in all of this differ in their number only
    alike = seen.groupBy("page_id", "url", "address", "digest", "size").count()
    numbered = (alike.join(first, ["address", "size"])
                .withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("count") - 1).cast("int")))))
    # pages of one id with one payload under several urls: the first url is the keeper's
    lead = alike.groupBy("page_id", "address").agg(F.min(F.coalesce("url", F.lit(""))).alias("lead"))
    numbered = numbered.join(lead.withColumnRenamed("page_id", "p").withColumnRenamed("address", "a"),
                             F.col("page_id").eqNullSafe(F.col("p")) & (F.col("address") == F.col("a")))
    keeps = (F.col("page_id").eqNullSafe(F.col("keeper")) & (F.col("copy") == 0)
             & (F.coalesce("url", F.lit("")) == F.col("lead")))
    refers = F.when((F.col("size") < least_bytes) | keeps, F.lit(None)).otherwise(F.col("keeper"))
    rows = numbered.select("page_id", "copy", "url", "address", "digest", "size", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [header_block(p, c, u or "", d, s, r) for p, c, u, _, d, s, r in zip(
                *(b.column(i).to_pylist() for i in range(7)))]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), b.column(3)], ["header", "address"])

    rows.mapInArrow(run, "header binary, address binary").write.parquet(f"{path}/records")
    keepers = first.select(F.col("keeper").alias("page_id"), "address")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=5)
        for b in batches:
            data = [_payload(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([hashlib.sha256(x).digest() for x in data], pa.binary()),
                 pa.array([pack.compress(x) for x in data], pa.binary())], ["at", "own", "payload"])

    # no id stands for the least one here; the digest tells the pages apart
    own = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(-(1 << 63))).alias("at"), "html").mapInArrow(
        packed, "at long, own binary, payload binary")
    own.join(keepers.select(F.coalesce("page_id", F.lit(-(1 << 63))).alias("at"), "address"), "at").where(
        "own = address").dropDuplicates(["at", "address"]).select("payload", "address").write.option(
        "compression", "uncompressed").parquet(f"{path}/payloads")
    scratch.free(seen)


def read_archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, payloads) as stored."""
    return spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/payloads")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload, record): every original record with its payload, and the bytes of its WARC record. A payload
    whose bytes do not have its digest fails the job."""
    records, payloads = read_archive(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, bodies = [], []
            for head, body, address in zip(*(b.column(i).to_pylist() for i in range(3))):
                body = _opened(body, address)
                bodies.append(body)
                out.append(head + (body if parse_header(head)["WARC-Type"] == "response" else b"") + b"\r\n\r\n")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bodies, pa.binary()), pa.array(out, pa.binary())],
                                             ["header", "payload", "record"])

    return records.join(payloads, "address").select("header", "payload", "address").mapInArrow(
        run, "header binary, payload binary, record binary")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """What the archive says of each record, from its header and its payload: page_id, payload_bytes, payload_digest,
    record_type, refers_to, url. Each stored payload is verified once and then met by address."""
    records, payloads = read_archive(spark, path)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, sizes = [], []
            for body, address in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                body = _opened(body, address)
                digests.append(sha1_base32(body))
                sizes.append(len(body))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(digests), pa.array(sizes, pa.int64())],
                                             ["address", "payload_digest", "payload_bytes"])

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def page(name: str | None):
            text = name[len(RECORD_ID) + 1:-1].split(":")[0] if name else "None"
            return None if text == "None" else int(text)
        for b in batches:
            heads = [parse_header(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([page(h["WARC-Record-ID"]) for h in heads], pa.int64()),
                 pa.array([h["WARC-Type"] for h in heads]),
                 pa.array([page(h.get("WARC-Refers-To")) for h in heads], pa.int64()),
                 pa.array([h["WARC-Target-URI"] for h in heads]),
                 pa.array([h["WARC-Payload-Digest"].split(":")[1] for h in heads]), b.column(1)],
                ["page_id", "record_type", "refers_to", "url", "stated", "address"])

    known = payloads.select("payload", "address").mapInArrow(
        verified, "address binary, payload_digest string, payload_bytes long")
    heads = records.select("header", "address").mapInArrow(
        parsed, "page_id long, record_type string, refers_to long, url string, stated string, address binary")
    agreed = F.when(F.col("stated") == F.col("payload_digest"), F.col("stated")).otherwise(
        F.raise_error(F.lit("a record's digest is not its payload's")))
    return heads.join(known, "address").select(
        "page_id", "payload_bytes", agreed.alias("payload_digest"), "record_type", "refers_to", "url")
