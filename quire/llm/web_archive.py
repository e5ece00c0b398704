"""Legacy web archives (ARC) and their conversion to WARC.

Pages are first laid down as ARC files, as an old crawl would have left them; the
converter then parses each file by the header line its version block declares and by the
declared lengths, and synthesises what WARC asks for and ARC does not have: record ids,
ISO timestamps, record types and digests. Payloads seen before become revisits. The WARC
files are read back by their declared lengths as well.

Archives are written by the text writer, one row per record and no separator of its own,
so files, retries and commits are Spark's, in the shared folder of the session. They are
compressed as one gzip stream per file. Rows are dealt to files in turn, so many that a
file holds about ``FILE_BYTES``; a reader holds one file at a time.

Edge cases: a null html is an empty payload; a null or blank-ridden URL is written as
``-`` or with blanks escaped; a null page_id is left out of the record and comes back
null; rows of one id and equal payload are all the response if that id is the smallest;
an empty table gives no files and no rows. Only page_id, url and html are read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import checkpointed, scratch, stored, table

FILE_BYTES = 8 << 20
#: Revisits up to this number are broadcast to the records; more are joined by their ids, which differ.
BROADCAST_ROWS = 200_000
#: Payloads below this size are never revisits.
LEAST = 100
#: Fields of a record's header line, by the version that the file's first block declares.
FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "filename", "length"),
}
CRAWL_DATE = "20010203040506"


def _head(page_id: Column) -> Column:
    """HTTP head of a stored response; the page's id travels as a header."""
    own = F.when(page_id.isNotNull(), F.concat(F.lit("X-Page-Id: "), page_id.cast("string"), F.lit("\r\n"))).otherwise("")
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), own, F.lit("\r\n"))


def write_arc(pages: DataFrame, path: str, version: int) -> None:
    """ARC files of the given version: a version block, then a header line and content per page.

    The version block opens the file of every partition, so the rows of a file come from one
    partition that is written without being cut.
    """
    content = F.concat(_head(F.col("page_id")), F.coalesce("html", F.lit("")))
    url = F.coalesce(F.regexp_replace(F.col("url"), r"[\x00-\x20]", "%20"), F.lit("-"))
    length = F.octet_length(content).cast("string")
    if version == 1:
        line = F.concat_ws(" ", url, F.lit("0.0.0.0"), F.lit(CRAWL_DATE), F.lit("text/html"), length)
    else:
        line = F.concat_ws(" ", url, F.lit("0.0.0.0"), F.lit(CRAWL_DATE), F.lit("text/html"), F.lit("200"), F.upper(F.sha1(content)), F.lit("-"), F.lit("0"), F.lit("crawl.arc"), length)
    named = "URL IP-address Archive-date Content-type " + ("" if version == 1 else "Result-code Checksum Location Offset Filename ") + "Archive-length"
    body = f"{version} 0 quire\n{named}\n"
    block = f"filedesc://crawl.arc 0.0.0.0 {CRAWL_DATE} text/plain " + ("" if version == 1 else "200 - - 0 crawl.arc ") + f"{len(body)}\n{body}\n"
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    record = F.concat(F.when(first, F.lit(block)).otherwise(""), line, F.lit("\n"), content, F.lit("\n"))
    pages.select(record.alias("value")).write.option("compression", "gzip").option("lineSep", "\x00").text(path)


def arc_records(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """Header fields and content of every record, by the version that the first block declares."""
    at, version = 0, 1
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\x00"):  # between records
            at += 1
            continue
        end = data.index(b"\n", at)
        fields = data[at:end].decode("utf-8", "replace").split(" ")
        if fields[0].startswith("filedesc:"):
            size = int(fields[-1])
            body = data[end + 1 : end + 1 + size]
            version = int(body.split(b" ", 1)[0])
            yield {"version": version, "filedesc": True, "date": fields[2]}, body
        else:
            names = FIELDS[version]
            if len(fields) != len(names):
                raise ValueError(f"version {version} asks for {len(names)} fields: {data[at:end][:200]!r}")
            head = dict(zip(names, fields, strict=True))
            size = int(head["length"])
            yield head | {"version": version}, data[end + 1 : end + 1 + size]
        at = end + 1 + size


def iso_date(arc_date: str) -> str:
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*parts: str) -> str:
    h = hashlib.md5("\n".join(parts).encode()).hexdigest()
    return f"urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, date, head, payload, digest and record id of every page in ARC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                rows: list[tuple] = []
                size = 0
                for head, content in arc_records(zlib.decompress(batch.column(0)[k].as_buffer(), 47)):
                    if "filedesc" in head:
                        continue
                    http, _, payload = content.partition(b"\r\n\r\n")
                    own = re.search(rb"X-Page-Id: (-?\d+)", http)
                    digest = hashlib.sha256(payload).hexdigest()
                    page = int(own[1]) if own else None
                    rows.append((page, head["url"], iso_date(head["date"]), http.decode(), payload.decode(), digest, record_id(head["url"], str(page), digest)))
                    size += len(payload)
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), *[pa.string()] * 6]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["page_id", "url", "date", "head", "payload", "digest", "record_id"])

    return _files(spark, path).mapInArrow(run, "page_id long, url string, date string, head string, payload string, digest string, record_id string")


def write_warc(records: DataFrame, path: str, least: int = LEAST) -> None:
    """WARC files: a response per payload, revisits of it for the others, as said in the module's text."""
    # decided on ids and digests alone: a popular payload's records meet without their payloads, and Spark may split them
    keys = records.select("page_id", "digest", "record_id", F.octet_length("payload").cast("long").alias("_bytes")).filter(F.col("_bytes") >= least)
    firsts = keys.groupBy("digest").agg(F.min("page_id").alias("_first"), F.min_by("record_id", "page_id").alias("_first_record"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    later = keys.join(stored(firsts, "firsts"), "digest").filter(F.col("_first") < F.coalesce(F.col("page_id"), F.lit((1 << 63) - 1)))
    later = stored(later.select(F.col("record_id").alias("_again"), "_first_record").distinct(), "revisits")
    df = records.join(F.broadcast(later) if later.count() <= BROADCAST_ROWS else later, F.col("record_id") == F.col("_again"), "left")
    revisit = F.col("_again").isNotNull()
    block = F.concat(F.col("head"), F.lit("\r\n\r\n"), F.when(revisit, "").otherwise(F.col("payload")))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    refers = F.when(revisit, F.concat(line("WARC-Refers-To", F.concat(F.lit("<"), F.col("_first_record"), F.lit(">"))), F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n"))).otherwise("")
    record = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        refers,
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    df.select(record.alias("value")).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(path)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields and block of every record, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at {at}: {first[:100]}")
        head = dict(x.split(": ", 1) for x in lines)
        size = int(head["Content-Length"])
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_id, record_type, refers (a record id), payload_bytes and payload_digest as found in the records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                rows = []
                for head, block in warc_records(zlib.decompress(batch.column(0)[k].as_buffer(), 47)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    own = re.search(rb"X-Page-Id: (-?\d+)", http)
                    kind, declared = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != declared:
                        raise ValueError(f"payload of {head['WARC-Record-ID']} does not have its digest")
                    rows.append((int(own[1]) if own else None, head["WARC-Record-ID"].strip("<>"), kind, head["WARC-Refers-To"].strip("<>") if kind == "revisit" else None, len(payload) if kind == "response" else None, declared))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], names=["page_id", "record_id", "record_type", "refers", "payload_bytes", "payload_digest"])

    return _files(spark, path).mapInArrow(run, "page_id long, record_id string, record_type string, refers string, payload_bytes long, payload_digest string")


def convert(pages: DataFrame) -> DataFrame:
    """Pages to ARC, ARC to WARC, and what the WARC files hold: one row per page.

    Even ids go to version 1 files, odd ones and null to version 2.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    size = pages.agg(F.sum(F.octet_length("html").cast("long"))).first()[0] or 0
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    for version in (1, 2):
        even = F.coalesce(F.pmod("page_id", F.lit(2)) == 0, F.lit(False))
        part = pages.filter(even if version == 1 else ~even)
        write_arc(part.repartition(max(1, size // (2 * FILE_BYTES))), f"{arc}/v{version}", version)
    write_warc(stored(read_arc(spark, f"{arc}/v*"), "records"), warc)  # parsed once, read by column
    found = checkpointed(read_warc(spark, warc))
    responses = found.filter("record_type = 'response'").groupBy(F.col("record_id").alias("_record")).agg(F.min("page_id").alias("_page"), F.min("payload_bytes").alias("_bytes"))
    # only a revisit asks for another record, so only revisits are joined
    revisits = found.filter("record_type = 'revisit'").join(responses, F.col("refers") == F.col("_record"), "left")
    resolved = revisits.select("page_id", F.col("_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("_page").alias("refers_to"))
    own = found.filter("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(resolved)


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert(table(spark, sf_dir, "pages"))


QUERIES = {"op2_arc_to_warc": op2_arc_to_warc}
SQL = {
    "op2_arc_to_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS head FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id > head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > head THEN head END AS refers_to FROM f"""
}
