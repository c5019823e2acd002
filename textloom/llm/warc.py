"""WARC archives with revisit resolution.

Resolve. Headers alone (id, payload digest, payload size) are shuffled by digest. Of equal payloads of at least `least` bytes the record with the largest page_id is the
original, the others revisit it. The join of the other headers to the originals gives a small table of decisions, which is joined to the pages by page_id; no group of equal
payloads comes to one task, and adaptive execution splits a hot digest, whose rows are headers only.

Write. Every task writes one archive (.warc.gz), record by record: a gzip member each, a warcinfo first, with fresh headers (record id, date, digest, length). A response holds the HTTP
headers and the payload, a revisit the HTTP headers alone (their Content-Length is the payload's) and WARC-Refers-To, with the original's date and url.

Read. `read_archives` walks the members, of which it holds one at a time, and checks the digests of responses; `resolve` finds for each revisit the archive and offset of its original.

Cases. A null html is an empty payload. A null page_id is always a response and never an original. Repeated rows of the largest page_id are all responses; other repeated
rows revisit it alike. Line breaks in a url are percent-encoded; a null url gives no WARC-Target-URI. An empty table gives no archive and no row.
A very long page is a record like others; it is held whole while it is written or read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, islice
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, open_fs, work_path, write_once, written

DATE = "2024-01-01T00:00:00Z"
#: Fixed value of the format: the profile of revisits by identical payload digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "path string, offset long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def decisions(heads: DataFrame, least: int = 1000) -> DataFrame:
    """heads: page_id, url, digest, n_bytes -> page_id, digest, original, original_url: the records that become revisits."""
    large = heads.where((F.col("n_bytes") >= least) & F.col("page_id").isNotNull())
    last = F.max(F.struct("page_id", "url")).alias("last")  # of equal largest ids, the largest url
    originals = large.groupBy("digest").agg(last, F.min("page_id").alias("first")).select("digest", F.col("last.page_id").alias("original"), F.col("last.url").alias("original_url"), "first").where("first < original")
    return large.join(originals.drop("first"), "digest").where("page_id < original").select("page_id", "digest", "original", "original_url").distinct()


def gzipped(lines: list[str], body: bytes) -> bytes:
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join([*lines, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n") + pack.flush()


def named(page_id: int | None, digest: str, path: str = "", place: int = 0) -> str:
    """A record's id, of page id and payload; where the page id is null, of its place in its archive."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path}#{place}')}>" if page_id is None else f"<urn:page:{page_id}:{digest}>"


def target(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, origin_url: str | None = None, path: str = "", place: int = 0, date: str = DATE) -> bytes:
    """One record, gzipped; path and place: where it will stand."""
    digest = hashlib.sha1(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {named(page_id, digest, path, place)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + target(url))
    lines.append("WARC-Payload-Digest: sha1:" + digest)
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {named(refers_to, digest)}", f"WARC-Refers-To-Date: {date}", f"WARC-Profile: {PROFILE}"]
        if origin_url is not None:
            lines.append("WARC-Refers-To-Target-URI: " + target(origin_url))
    return gzipped([*lines, "Content-Type: application/http;msgtype=response"], http if refers_to is not None else http + payload)


def info(path: str, date: str = DATE) -> bytes:
    """The record at the head of an archive."""
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, path)}>", f"WARC-Date: {date}", f"WARC-Filename: {path.rsplit('/', 1)[-1]}", "Content-Type: application/warc-fields"]
    return gzipped(lines, b"format: WARC File Format 1.1\r\n")


def members(source: BinaryIO, block: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member; a block and one member are held at a time."""
    at, held = 0, source.read(block)
    while held:
        d, out, start = zlib.decompressobj(31), [], at
        while not d.eof:
            if not held:
                raise ValueError("a gzip member is cut off")
            out.append(d.decompress(held))
            at += len(held) - len(d.unused_data)
            held = d.unused_data or (b"" if d.eof else source.read(block))
        yield start, b"".join(out)
        held = held or source.read(block)


def number(text: str | None) -> int | None:
    m = re.search(r"<urn:page:(-?\d+)(?::[0-9a-f-]+)?>", text or "")
    return int(m[1]) if m else None


def parsed(content: bytes) -> tuple[int | None, int, str, str, int | None] | None:
    """What a response or revisit record says; None for others."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    if fields["WARC-Type"] not in ("response", "revisit"):
        return None
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload differs from its digest")
    return number(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], number(fields.get("WARC-Refers-To"))


def write_archives(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes pages (page_id, url, html) as deduplicated archives; (path, records) of each."""
    folder = work_path(pages.sparkSession, "warc")
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    revisits = written(decisions(base.select("page_id", "url", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("n_bytes")), least), "warc-decisions")
    revisits = revisits.withColumnRenamed("page_id", "p")
    planned = base.join(revisits, (F.col("page_id") == F.col("p")) & (F.sha1(F.col("html").cast("binary")) == F.col("digest")), "left").select("page_id", "url", "html", "original", "original_url")

    def write(batches):
        path, count = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0

        def records():
            nonlocal count
            for batch in batches:
                for page_id, url, html, original, where in zip(*(batch.column(c) for c in ("page_id", "url", "html", "original", "original_url")), strict=True):
                    count += 1
                    yield record(page_id.as_py(), url.as_py(), html.as_buffer().to_pybytes(), original.as_py(), where.as_py(), path, count)

        rows = records()
        if (first := next(rows, None)) is not None:
            write_once(path, chain([info(path), first], rows))
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [count]})

    return written(planned.mapInArrow(write, "path string, records long"), "warc-list")


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of the archives (path)."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, place = open_fs(path)
                with files.open_input_stream(place, compression=None) as source:
                    found = ((path, at, *said) for at, content in members(source) if (said := parsed(content)))
                    while rows := list(islice(found, 1000)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    parts = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return archives.select("path").repartition(parts, "path").mapInArrow(read, SCHEMA)


def resolve(records: DataFrame) -> DataFrame:
    """Revisit records with the archive and offset of their originals."""
    originals = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("d"), F.col("path").alias("original_path"), F.col("offset").alias("original_offset")).dropDuplicates(["refers_to", "d"])
    return records.where("record_type = 'revisit'").join(originals, "refers_to", "left").where("payload_digest = d").drop("d")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(load(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS g FROM pages),
o AS (SELECT g, max(page_id) AS o FROM p WHERE n >= 1000 GROUP BY g)
SELECT page_id, n AS payload_bytes, p.g AS payload_digest, CASE WHEN page_id < o.o THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < o.o THEN o.o END AS refers_to
FROM p LEFT JOIN o ON p.g = o.g AND n >= 1000
"""
