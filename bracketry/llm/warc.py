"""ARC (versions 1 and 2) to WARC: header lines and declared lengths are parsed, WARC records with ids, dates, types and digests are made from them.

Archives are files of Spark's own text writer, one file a task, so they can lie in any store that Spark writes to: a
WARC record ends in CR LF CR LF, whose last LF is the writer's line end. Reading goes by Content-Length, never by lines.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bracketry.llm.common import scratch_dir, small, table, tidy

#: Payloads from this size on are written once; other records of the same payload revisit it.
REVISIT_BYTES = 1000
#: Repeated digests that are broadcast; more of them are joined by a shuffle.
BROADCAST_DIGESTS = 100_000
#: Records of an archive file at most, and the bytes of records of mean size, so that a file fits a task when it is read back.
FILE_RECORDS, FILE_BYTES = 2_000, 64 << 20

# fixed values: ARC header fields by version
ARC1 = ("url", "ip", "date", "type", "length")
ARC2 = ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length")
_REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def clean_url(url: str) -> str:
    """Blanks and controls as %20 and so on; - for none."""
    return re.sub(r"[\s\x00-\x1f]", lambda m: f"%{ord(m[0]):02X}", url) or "-"


def arc_record(version: int, url: str, ip: str, date: str, mime: str, body: bytes, result: int = 200) -> bytes:
    """One ARC record: a header line of that version, the body, a line end. Blanks in the url are %20."""
    fields = {"url": clean_url(url), "ip": ip, "date": date, "type": mime, "length": str(len(body)), "result": str(result), "checksum": "-", "location": "-", "offset": "0", "filename": "-"}
    return " ".join(fields[f] for f in (ARC1 if version == 1 else ARC2)).encode() + b"\n" + body + b"\n"


def parse_arc(data: bytes) -> list[dict]:
    """The records of an ARC file or of a part of one. A version block (filedesc://) sets the version of what follows;
    without one the number of header fields tells it. A declared length that goes beyond the data, or a header of another
    form, raises ValueError."""
    out, at, version = [], 0, 0
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("ARC header without a line end")
        parts = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        names = ARC1 if len(parts) == len(ARC1) else ARC2 if len(parts) == len(ARC2) else None
        if not names:
            raise ValueError(f"ARC header of {len(parts)} fields")
        head = dict(zip(names, parts, strict=True))
        if not head["length"].isdigit() or end + 1 + int(head["length"]) > len(data):
            raise ValueError("ARC length beyond the data")
        body = data[end + 1 : end + 1 + int(head["length"])]
        at = end + 1 + len(body)
        if head["url"].startswith("filedesc://"):
            version = int(body.split(b" ", 1)[0] or b"0")
            continue
        out.append(head | {"version": version or (1 if names is ARC1 else 2), "body": body})
    return out


def warc_date(arc_date: str) -> str:
    """yyyymmddhhmmss (shorter ones are filled up) to ISO 8601; 1970 if it is no date."""
    digits = re.sub(r"\D", "", arc_date)[:14]
    try:
        return datetime.strptime((digits + "00000101000000"[len(digits) :])[:14], "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def record_id(url: str, date: str, key: str) -> str:
    """The same record always gets the same id."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{date} {key} {url}')}>"


def warc_record(arc: dict, key: str, sha1: str, refers_to: str | None = None, refers_url: str | None = None) -> bytes:
    """A WARC/1.0 record made from an ARC one: response with the body, or revisit (of the record of that key and url, made
    on the same date) without it."""
    date, digest = warc_date(arc["date"]), base64.b32encode(bytes.fromhex(sha1)).decode()
    http = f"HTTP/1.1 {arc.get('result', '200')} OK\r\nContent-Type: {arc['type']}\r\nContent-Length: {len(arc['body'])}\r\n\r\n".encode()
    block = http if refers_to is not None else http + arc["body"]
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(arc["url"], date, key)), ("WARC-Date", date), ("WARC-Target-URI", arc["url"]), ("WARC-IP-Address", arc["ip"]),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("X-Key", key), ("X-Payload-Bytes", str(len(arc["body"]))),
    ]
    if refers_to is not None:
        url = clean_url(refers_url or "-")
        head += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", record_id(url, date, refers_to)), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", date), ("X-Refers-To-Key", refers_to)]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[dict]:
    """Headers, block and, for responses, payload of each record of an archive."""
    at = 0
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError("WARC record cut short")
        at = end + 4 + size
        cut = block.find(b"\r\n\r\n")
        yield {"head": head, "block": block, "payload": block[cut + 4 :] if head["WARC-Type"] == "response" and cut >= 0 else None}


def arcs(pages: DataFrame) -> DataFrame:
    """key, sha1, refers_to, arc: an ARC record of each page; even keys in version 2, others in version 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("key", "url", "html")), strict=True)
            made = [arc_record(2 if (key or "0")[-1] in "02468" else 1, url or "-", "0.0.0.0", "19700101000000", "text/html", (html or "").encode()) for key, url, html in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "sha1", "refers_to", "refers_url")), pa.array(made, pa.binary())], names=["key", "sha1", "refers_to", "refers_url", "arc"])

    return pages.select("key", "sha1", "refers_to", "refers_url", "url", "html").mapInArrow(tidy(run), "key string, sha1 string, refers_to string, refers_url string, arc binary")


def convert(arc: DataFrame) -> DataFrame:
    """warc: the WARC records of rows of ARC data (key, sha1 of the payload or null, refers_to and refers_url or null, arc)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for key, sha1, refers_to, url, data in zip(*(batch.column(c).to_pylist() for c in ("key", "sha1", "refers_to", "refers_url", "arc")), strict=True):
                records = parse_arc(data or b"")
                for k, r in enumerate(records):
                    own = key if len(records) == 1 else f"{key}.{k}"
                    made.append(warc_record(r, own or "", sha1 if sha1 and len(records) == 1 else hashlib.sha1(r["body"]).hexdigest(), refers_to, url))
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["warc"])

    return arc.mapInArrow(tidy(run), "warc binary")


def write(warc: DataFrame, path: str, mean_bytes: float = 0) -> None:
    """Archive files (gzip as a whole) under path; with large records fewer go to a file."""
    records = max(1, min(FILE_RECORDS, int(FILE_BYTES / max(mean_bytes, 1))))
    lines = warc.select(F.substring("warc", F.lit(1), F.length("warc") - 1).cast("string").alias("value"))
    lines.write.option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """key, record_type, record_id, date, url, payload_bytes, payload_digest (hex), refers_to of each record; payloads are checked against their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            for data in batch.column("content").to_pylist():
                rows = []
                for r in parse_warc(zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data):
                    h, payload = r["head"], r["payload"]
                    digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {h['WARC-Record-ID']} doesn't match its digest")
                    size = int(h["X-Payload-Bytes"]) if payload is None else len(payload)
                    rows.append((h.get("X-Key") or None, h["WARC-Type"], h["WARC-Record-ID"], h["WARC-Date"], h["WARC-Target-URI"], size, digest, h.get("X-Refers-To-Key")))
                for at in range(0, len(rows), 10_000):
                    part = list(zip(*rows[at : at + 10_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 5 else pa.string()) for k, c in enumerate(part)], names=["key", "record_type", "record_id", "date", "url", "payload_bytes", "payload_digest", "refers_to"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(tidy(run), "key string, record_type string, record_id string, date string, url string, payload_bytes long, payload_digest string, refers_to string")


def with_revisits(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) with key, sha1 and refers_to: null for responses.

    Of rows with equal payloads of REVISIT_BYTES or more, those of the largest page_id are responses (repeated rows of it
    all), others refer to it. Rows without page_id come last and only refer if some row has one. Null html is empty.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("long").cast("string").alias("key"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    keyed = keyed.withColumns({"sha1": F.sha1(body), "n": F.length(body)})
    large = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("b")).where(F.length("b") >= REVISIT_BYTES)
    groups = large.groupBy(F.sha1("b").alias("d")).agg(F.max(F.col("page_id").cast("long")).alias("last"), F.max_by(F.col("url").cast("string"), F.col("page_id").cast("long")).alias("last_url"), F.count(F.lit(1)).alias("c")).where("c > 1 and last is not null")
    groups = groups.select("d", F.col("last").cast("string").alias("last"), "last_url")
    if small(groups, BROADCAST_DIGESTS):
        groups = F.broadcast(groups)
    joined = keyed.join(groups, F.col("sha1") == F.col("d"), "left")
    other = F.col("key").isNull() | (F.col("key") != F.col("last"))
    return joined.withColumns({"refers_to": F.when(other, F.col("last")), "refers_url": F.when(other, F.col("last_url"))}).select("key", "url", "html", "sha1", "refers_to", "refers_url")


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Pages through ARC records to WARC archives under path, and the archives read back."""
    spark = pages.sparkSession
    path = path or f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    mean = pages.agg(F.avg(F.octet_length(F.col("html").cast("string")))).first()[0]
    write(convert(arcs(with_revisits(pages))), path, (mean or 0) + 1000)
    return read(spark, path)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = round_trip(table(spark, sf_dir, "pages"))
    return back.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN g.last IS NOT NULL AND g.last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.last <> page_id THEN g.last END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND n >= 1000
"""
