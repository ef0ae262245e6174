"""WARC archives written and read by Spark, and captures joined from their records."""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, arrow_map, few

#: Between a record's headers and its block, and after the block.
END = "\r\n\r\n"
RECORD = (
    "record_id string, type string, uri string, date string, concurrent_to string, refers_to string, "
    "payload_digest string, content_type string, length long, payload_bytes long, payload_sha256 string, fields map<string,string>, block binary"
)


def _id(kind: str, key: Column) -> Column:
    """A urn:uuid made from the key, so that a task that runs again writes the same record."""
    h = F.sha2(F.concat(F.lit(f"{kind}:"), key).cast("binary"), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(kind: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}")]
    lines += [F.when(value.isNotNull(), F.concat(F.lit(f"\r\n{name}: "), value)).otherwise(F.lit("")) for name, value in headers]
    size = F.octet_length(block.cast("binary")).cast("string")
    return F.concat(*lines, F.lit("\r\nContent-Length: "), size, F.lit(END), block)


def write(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least: int = 100, file_bytes: int = 8 << 20) -> None:
    """Write a request, a response or revisit, and a metadata record for each row (page_id, url, html).

    The payload is the html in UTF-8 (null: empty). Of rows with one payload of at least `least`
    bytes that of the smallest page_id is a response and the others revisit it; shorter payloads
    are always responses. Payloads are told apart by SHA-256, which the smallest page_id is
    counted for in partial aggregates; the join back is narrow, so that Spark can split a digest
    that very many rows share, and the pages meet its result by page_id and digest, which is not skewed.
    Rows that repeat a page_id and its html make equal records, which are one capture when read;
    with another html they are another capture; a null page_id is written as "null". Control
    characters in a url become %20. Columns other than the three are not read. An empty table
    writes no records.

    Each record is a gzip member of its own, so that readers can seek. Archives hold records of
    about `file_bytes` of compressed bytes, or one that is larger.
    """
    spark = pages.sparkSession
    whole = F.coalesce(F.col("html"), F.lit(""))
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    rows = pages.select("page_id", F.col("url"), whole.alias("html"))
    digests = rows.select("page_id", F.sha2(F.encode("html", "UTF-8"), 256).alias("digest"), F.octet_length("html").alias("size"))
    digests = Stage(spark, "warc").keep(digests.where(F.col("size") >= least).select("page_id", "digest"))
    first = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    refers = digests.join(first, "digest").where("page_id <> first").select("page_id", "digest", "first").distinct()
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256)).join(few(Stage(spark, "warc").keep(refers)), ["page_id", "digest"], "left")
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    named = lambda kind, page: _id(kind, F.concat(page, F.lit(":"), F.col("digest")))
    main = named("main", key)
    headers = [("WARC-Target-URI", url), ("WARC-Date", F.lit(date))]
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END))
    host = F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)
    answer = [
        ("WARC-Record-ID", main), *headers, ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
    ]
    revisit = [
        *answer, ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Refers-To", named("main", F.col("first").cast("string"))), ("Content-Type", F.lit("application/http;msgtype=response")),
    ]
    request = F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    about = F.concat(F.lit("page-id: "), key, F.lit("\r\n"))
    records = rows.select(
        F.explode(
            F.array(
                _record("request", [("WARC-Record-ID", named("request", key)), *headers, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/http;msgtype=request"))], request),
                F.when(F.col("first").isNull(), _record("response", [*answer, ("Content-Type", F.lit("application/http;msgtype=response"))], F.concat(head, "html"))).otherwise(_record("revisit", revisit, head)),
                _record("metadata", [("WARC-Record-ID", named("metadata", key)), *headers, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/warc-fields"))], about),
            )
        ).alias("value")
    )

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Archives, each a row and without its last byte, which is the 0 that the text writer ends a row with."""
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for value in batch.column(0):
                held.append(gzip.compress(value.as_buffer().to_pybytes() + END.encode(), 6, mtime=0))
                size += len(held[-1])
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([_ended(held)], pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([_ended(held)], pa.binary())], ["value"])

    archives = arrow_map(records, members, "value binary").select(F.col("value").cast("string").alias("value"))
    archives.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def _ended(members: list[bytes]) -> bytes:
    """The members without the last one's last byte. That is 0, unless the record is of 16 MB or more: then an empty member follows."""
    if members[-1][-1]:
        members = [*members, gzip.compress(b"", mtime=0)]
    return b"".join(members)[:-1]


def unpack(data: bytes) -> Iterator[bytes]:
    """The gzip members of an archive, one at a time; an archive that is not compressed comes as it is."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    whole, at = memoryview(data), 0
    while at < len(data):
        out, member = zlib.decompressobj(31), []
        while not out.eof:
            part = whole[at : at + 65536]
            if not len(part):
                raise ValueError("an archive breaks off")
            member.append(out.decompress(part))
            at += len(part) - len(out.unused_data)
        yield b"".join(member)


def parse(data: bytes) -> Iterator[dict]:
    """The records of one member or archive; blocks are cut by Content-Length, so they may hold anything."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        if head < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:head].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        if head + 4 + size > len(data):
            raise ValueError(f"the record at byte {at} breaks off")
        yield headers | {"block": data[head + 4 : head + 4 + size]}
        at = head + 4 + size + 4


def _payload(record: dict) -> tuple[int | None, str | None]:
    """Size and SHA-256 of a response's payload, from its bytes; they must be what the record says."""
    if record.get("warc-type") != "response":
        return None, None
    payload = record["block"].partition(b"\r\n\r\n")[2] if record.get("content-type", "").startswith("application/http") else record["block"]
    found = hashlib.sha256(payload).hexdigest()
    kind, _, said = record.get("warc-payload-digest", "").partition(":")
    if kind.lower() in ("sha256", "sha-256") and said.lower() != found:
        raise ValueError(f"the payload of {record.get('warc-record-id')} is not what its digest says")
    return len(payload), found


def read(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """One row per record of the archives under `path` (gzip or plain).

    `payload_bytes` and `payload_sha256` are those of a response's payload as read; where the
    record gives a SHA-256 that is another one, that is an error. `fields` has the lines of a
    warc-fields block. Without `blocks`, blocks are read but left null, and only their length is
    given. A broken record is an error; a folder without archives gives no rows.
    """
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [*[pa.string()] * 8, pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    keys = ["warc-record-id", "warc-type", "warc-target-uri", "warc-date", "warc-concurrent-to", "warc-refers-to", "warc-payload-digest", "content-type"]

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for r in (r for member in unpack(content.as_buffer().to_pybytes()) for r in parse(member)):
                    fields = None
                    if r.get("content-type") == "application/warc-fields":
                        fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in r["block"].decode("utf-8", "replace").split("\r\n") if x)]
                    rows.append([*(r.get(k) for k in keys), len(r["block"]), *_payload(r), fields, r["block"] if blocks else None])
                    size += len(r["block"])
                    if size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,txt.gz,warc,warc.gz}").load(path)
    return arrow_map(files.select("content"), work, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: struct columns `response` (response or revisit), `request` and `metadata`.

    Request and metadata records find their response by WARC-Concurrent-To, in one pass: all
    records of a capture have one key. A capture without one of them has null there, and records
    whose capture is absent are left out. Of several records of one kind in a capture that of the
    smallest id counts, so repeated records are one. An empty table gives no rows.
    """
    cells = F.struct("record_id", "uri", "date", "refers_to", "payload_digest", "content_type", "length", "payload_bytes", "payload_sha256", "fields", "block", F.col("type"))
    kinds = {"response": F.col("type").isin("response", "revisit"), "request": F.col("type") == "request", "metadata": F.col("type") == "metadata"}
    capture = F.when(kinds["response"], F.col("record_id")).when(kinds["request"] | kinds["metadata"], F.col("concurrent_to"))
    picked = [F.min_by(F.when(own, cells), F.when(own, F.col("record_id"))).alias(kind) for kind, own in kinds.items()]
    return records.withColumn("_capture", capture).where("_capture is not null").groupBy("_capture").agg(*picked).where("response is not null").drop("_capture")


def new_path(root: str) -> str:
    return f"{root}/warc-{uuid.uuid4().hex}"
