"""WARC archives of individually compressed records with a shared Zstandard dictionary.

The dictionary is trained on a bounded sample of the records to archive and stands in a leading
skippable frame; every record is a frame of its own, so a reader can start at any of them.
Files are written and read by Spark's own sinks and sources, on any store: the text sink writes
the frames of a task one after the other, with an empty skippable frame as its line separator.
"""
from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import hash_sample

# Fixed values of the formats: the dictionary's frame magic, and an empty skippable frame.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
DATE = "2020-01-01T00:00:00Z"       # of every record: a run's clock would make files differ

READ = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
        "refers_to long, payload binary")


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, refers_to``: of the rows with equal payloads of ``min_bytes`` and
    more, those that don't have the largest page_id refer to it; null for all others.

    A null html is an empty payload.  Rows that repeat the largest page_id are all responses; a
    null page_id refers to the largest of its group, if the group has one.  Payloads are
    compared by SHA-1 and length; the largest id per payload is pre-aggregated in each task."""
    p = (pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                      F.coalesce(F.col("html"), F.lit("")).alias("html"))
         .withColumn("_n", F.octet_length("html")).withColumn("_d", F.sha1("html")))
    twins = (p.where(F.col("_n") >= min_bytes).groupBy("_d", "_n")
             .agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_rows"))
             .where("_rows > 1").drop("_rows"))
    older = F.coalesce(F.col("page_id") < F.col("_last"), F.col("_last").isNotNull())
    return p.join(twins, ["_d", "_n"], "left").select(
        "page_id", "url", "html", F.when(older, F.col("_last")).alias("refers_to"))


def _record(page_id, url, html: str, refers_to) -> bytes:
    payload = html.encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    uri = "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url) if url else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = lambda p: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{p}')}>"
    head = ["WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"),
            "WARC-Record-ID: " + name(page_id), "WARC-Date: " + DATE, "WARC-Target-URI: " + uri,
            "WARC-Payload-Digest: sha1:" + digest, "X-Payload-Bytes: %d" % len(payload),
            "Content-Type: application/http; msgtype=response", "Content-Length: %d" % len(block)]
    if page_id is not None:
        head.append("X-Page-Id: %d" % page_id)
    if url is None:
        head.append("X-No-URL: 1")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 "WARC-Refers-To: " + name(refers_to), "X-Refers-To-Page: %d" % refers_to]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(pages: DataFrame, samples: int = 1000, sample_bytes: int = 32_768,
                     size: int = 65_536, stored: DataFrame | None = None) -> bytes:
    """A dictionary from at most ``samples`` records (those with the smallest hash of their id),
    of each ``sample_bytes`` at most; that bounds what reaches the driver.  It changes how small
    the archives get, never what they hold.  Empty if there is too little to learn from.
    ``stored``: the page_ids to choose from, if ``pages`` doesn't tell the revisits."""
    able = pages.where(F.col("refers_to").isNull() & F.col("html").isNotNull() & (F.col("html") != ""))
    stored = able if stored is None else stored
    ids = hash_sample(stored.select("page_id").where("page_id IS NOT NULL"), "page_id", samples)
    some = (able.join(F.broadcast(ids.distinct()), "page_id").dropDuplicates(["page_id"])
            .select("page_id", "url", F.substring("html", 1, sample_bytes).alias("html")).orderBy("page_id").collect())
    records = [_record(r["page_id"], r["url"], r["html"], None)[:sample_bytes] for r in some]
    try:
        return zstandard.train_dictionary(size, records).as_bytes() if len(records) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, path: str, dictionary: bytes, level: int = 3) -> None:
    """One archive per task: the dictionary's frame, a warcinfo record, then a frame for every
    row of ``pages`` (as ``mark_revisits`` gives them)."""

    def run(batches):
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=True).compress
        info = b"software: hostgraph\r\nformat: WARC File Format 1.1\r\n"
        first = [pack(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:"
                      + str(uuid.uuid5(uuid.NAMESPACE_URL, "warcinfo")).encode()
                      + b">\r\nWARC-Date: " + DATE.encode()
                      + b"\r\nContent-Type: application/warc-fields\r\nContent-Length: "
                      + str(len(info)).encode() + b"\r\n\r\n" + info + b"\r\n\r\n")]
        if dictionary:
            first.insert(0, struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
        for batch in batches:
            cols = [batch.column(n).to_pylist() for n in ("page_id", "url", "html", "refers_to")]
            for i in range(0, batch.num_rows, 256):
                frames = first + [pack(_record(*row)) for row in zip(*(c[i:i + 256] for c in cols))]
                first = []
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

    (pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "frame binary")
     .select(F.col("frame").cast("string").alias("value"))
     .write.option("lineSep", EMPTY_FRAME).option("compression", "none").text(path))


def _records(content: memoryview):
    """The decompressed frames of an archive, one at a time."""
    at, shared = 0, None
    while at < len(content):
        magic, = struct.unpack_from("<I", content, at)
        if magic in SKIPPABLE:
            size, = struct.unpack_from("<I", content, at + 4)
            if magic == DICTIONARY_MAGIC and at == 0:
                shared = zstandard.ZstdCompressionDict(bytes(content[8:8 + size]))
            at += 8 + size
            continue
        frame = zstandard.ZstdDecompressor(dict_data=shared).decompressobj()
        parts = []
        while not frame.eof:
            parts.append(frame.decompress(content[at:at + 16_384]))
            at += min(16_384, len(content) - at)
            if at >= len(content) and not frame.eof:
                raise ValueError("the archive ends inside a frame")
        at -= len(frame.unused_data)
        yield b"".join(parts)


def _parse(record: bytes) -> tuple | None:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    block = rest[:int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError("a payload doesn't match its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return (number("X-Page-Id"), None if "X-No-URL" in fields else fields["WARC-Target-URI"], kind,
            int(fields["X-Payload-Bytes"]), digest, number("X-Refers-To-Page"), payload)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per response and revisit record; the payload's bytes for responses, else null.
    Digests of payloads are checked.  A task reads one archive, and one record of it at a time."""
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rows, held = [], 0
                for record in _records(memoryview(batch.column(0)[k].as_buffer())):
                    if row := _parse(record):
                        rows.append(row)
                        held += len(record)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, READ)
