"""WARC archives with an index that is made as records are written, and reads of coalesced byte ranges.

Writing: every task streams its rows into archives of its own in the given folder, one gzip member per
record, and returns an index row (archive, offset, length, URL, digest) for each. An archive's name is new
for every attempt, and only a task that succeeded hands in index rows, so what a lost executor left
behind is never read. Reading: selected index rows are range-partitioned by archive and offset, into as many tasks as their bytes
call for, and each task merges ranges that lie close together into one read. Length and digest of a response are computed from the payload that was read; a
revisit, which has none, reports what its head says. A damaged gzip member or a record of another length than it says raises an error.

Equal payloads of ``min_revisit_bytes`` or more are stored once: rows with a smaller page_id than the
group's largest become revisit records, whose HTTP head keeps the payload's length. Null html counts as empty, a
null URL is left out of the record, control characters in a URL are percent-encoded. Repeated rows are
all written, and records of one page_id then share their WARC-Record-ID (equal rows at the largest page_id are all responses). A null page_id is always a response. A very long html is one record, which
must fit a task's memory a few times. Extra columns are ignored, whatever their names;
no rows, no archives.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltrail.llm.shared import shared_dir, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
INDEX = "archive string, offset long, length long, url string, payload_digest string, page_id long, record_type string"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = http if refers_to is not None else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(["WARC/1.1", *head, "", ""]).encode() + block + b"\r\n\r\n") + z.flush()


def parse(data: bytes) -> dict:
    """Headers (lower-cased names), the HTTP payload and its declared length of one record."""
    raw = zlib.decompress(data, 31)
    head, rest = raw.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC/1.1 record")
    out = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(out["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("the record does not end where its length says")
    http, payload = block.split(b"\r\n\r\n", 1)
    declared = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
    return out | {"payload": payload, "declared": int(declared[1])}


#: Payloads that occur more than once, up to which their table (about 100 bytes a row) is broadcast.
MAX_BROADCAST_PAYLOADS = 1_000_000


def with_revisits(pages: DataFrame, min_revisit_bytes: int = 1000) -> DataFrame:
    """page_id, url, html, payload_digest, refers_to.

    Only ids and digests are shuffled: a payload that occurs several times is one row, with the page that holds it, and these rows are counted before they are broadcast. Past
    ``MAX_BROADCAST_PAYLOADS`` they are joined by (page_id, payload_digest), which moves whole rows but no more for a payload that very many pages share.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html")).withColumn("payload_digest", F.sha1("html"))
    large = rows.where(F.octet_length("html") >= min_revisit_bytes).select("page_id", "payload_digest")
    holders = written(large.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").select("payload_digest", "refers_to"), "holders")
    if holders.count() <= MAX_BROADCAST_PAYLOADS:
        held = holders.withColumnRenamed("payload_digest", "_digest")
        return rows.join(F.broadcast(held), (rows["payload_digest"] == held["_digest"]) & (rows["page_id"] < held["refers_to"]), "left").drop("_digest")
    revisits = large.join(holders, "payload_digest").where("page_id < refers_to").distinct()
    return rows.join(revisits, ["page_id", "payload_digest"], "left")


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = 256 << 20) -> DataFrame:
    """Writes rows (as of with_revisits) below folder and returns the index, itself a table there."""

    def run(batches):
        where, path = fs.FileSystem.from_uri(folder)
        where.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        for b in batches:
            made = []
            for r in b.to_pylist():
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = where.open_output_stream(f"{path}/{name}", compression=None)  # the members are compressed already
                data = record(r["page_id"], r["url"], r["html"].encode(), r["payload_digest"], r["refers_to"])
                out.write(data)
                made.append((name, at, len(data), r["url"], r["payload_digest"], r["page_id"], "response" if r["refers_to"] is None else "revisit"))
                at += len(data)
            if made:
                cols = list(zip(*made, strict=True))
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["archive", "offset", "length", "url", "payload_digest", "page_id", "record_type"])
        if out is not None:
            out.close()

    return written(rows.select("page_id", "url", "html", "payload_digest", "refers_to").mapInArrow(run, INDEX), "index")


def read_records(index: DataFrame, folder: str, max_gap: int = 64 << 10, max_range: int = 8 << 20, task_bytes: int = 64 << 20, with_payload: bool = True) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest (and payload) of the index rows given."""
    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), (index.agg(F.sum("length")).first()[0] or 0) // task_bytes + 1)
    chosen = index.select("archive", "offset", "length").repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", *["payload"] * with_payload]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * with_payload]

    def rows_of(where, path, name, group):
        lo, hi = group[0][0], max(o + n for o, n in group)
        with where.open_input_file(f"{path}/{name}") as f:
            f.seek(lo)
            data = f.read(hi - lo)
        for o, n in group:
            r = parse(data[o - lo : o - lo + n])
            page, refers = r["warc-record-id"][10:-1], r.get("warc-refers-to")
            read = r["payload"]
            of = (r["declared"], r["warc-payload-digest"].removeprefix("sha1:")) if refers else (len(read), hashlib.sha1(read).hexdigest())
            yield (int(page) if page else None, r.get("warc-target-uri"), r["warc-type"], int(refers[10:-1]) if refers else None, *of, *[read] * with_payload)

    def run(batches):
        where, path = fs.FileSystem.from_uri(folder)
        name, group = None, []

        def flush():
            got = list(rows_of(where, path, name, group))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), types, strict=True)], names)

        for b in batches:
            for a, o, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if group and (a != name or o - sum(group[-1]) > max_gap or o + n - group[0][0] > max_range):
                    yield flush()
                    group = []
                name = a
                group.append((o, n))
        if group:
            yield flush()

    return chosen.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * with_payload)


def round_trip(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 1000) -> DataFrame:
    """Writes all pages, then reads all of them back by the index."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/archives"
    return read_records(write_archives(with_revisits(pages, min_revisit_bytes), folder), folder, with_payload=False)
