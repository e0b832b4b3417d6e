"""WARC archives with revisit records.

Headers (id, payload digest, size) are shuffled by digest. The record with the smallest
id of a digest keeps its payload; the others become revisits that refer to it. Archives
are written by Spark's text writer, whose line separator is the end of a WARC record, so
they work on any store and survive lost tasks. A reader parses archives one at a time,
by Content-Length, and revisits are joined to the responses that they refer to.

* NULL payload: empty. NULL url: no target field. Line breaks in a url are escaped.
* NULL id: a revisit if some record with an id has the payload, else a response.
* Rows that share the smallest id of a payload are all responses.
* Payloads smaller than ``min_bytes`` are never revisits.
* A revisit whose original is not in the archives has NULL size and refers_to.
* Other columns are ignored; an empty table gives an empty archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm.common import bounded_broadcast
from themeloom.operators.storage import shared_folder, written

# Names and layout of WARC 1.1.
VERSION = "WARC/1.1"
END = "\r\n"
RECORD_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORDS_PER_FILE = 2000
DATE = "1970-01-01T00:00:00Z"
FIELDS = "record_type string, record_id string, page_id string, uri string, refers_to_id string, payload_digest string, payload_bytes long, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, from 20 bits of its hex form at a time."""
    digits, letters = F.sha1(payload), []
    for part in range(8):
        bits = F.conv(F.substring(digits, 5 * part + 1, 5), 16, 10).cast("int")
        letters += [
            F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)
        ]
    return F.concat(*letters)


def mark_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds refers_to (NULL for responses) to records with page_id, digest, size, whole."""
    large = F.col("size") >= min_bytes
    firsts = written(
        records.where(large)
        .groupBy("digest")
        .agg(F.min(F.when(F.col("whole"), F.col("page_id"))).alias("first"), F.count("*").alias("_n"))
        .where((F.col("_n") > 1) & F.col("first").isNotNull())
        .drop("_n")
    )
    joined = records.join(bounded_broadcast(firsts), "digest", "left")
    kept = F.col("whole") & (F.col("page_id").eqNullSafe(F.col("first")) | ~large)
    return joined.withColumn("refers_to", F.when(~kept, F.col("first"))).drop("first")


def record_id(page_id: Column) -> Column:
    """An id that any task can derive: the name of a page in this archive set."""
    digits = F.md5(F.concat(F.lit("page:"), page_id.cast("string")))
    cuts = [F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def warc_text(marked: DataFrame, date: str = DATE) -> DataFrame:
    """One record per row as text, without the two line breaks that end it."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("size").cast("string"),
        F.lit(RECORD_END),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))

    def field(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))

    own = F.coalesce(record_id(F.col("page_id")), record_id(F.concat(F.lit("none:"), F.col("digest"))))
    head = F.concat(
        F.lit(VERSION + END),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", own),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", url),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        field("WARC-Profile", F.when(revisit, PROFILE)),
        field("WARC-Refers-To", F.when(revisit, record_id(F.col("refers_to")))),
        field("X-Page-Id", F.col("page_id").cast("string")),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END),
    )
    return marked.select(F.concat(head, block).alias("value"))


def page_records(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        "page_id", "url", payload.alias("payload"), base32_sha1(payload).alias("digest"),
        F.octet_length(payload).cast("long").alias("size"), F.lit(True).alias("whole"),
    )


def write_archives(records: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Deduplicated archives with fresh headers, gzipped, a bounded number of records each."""
    (
        warc_text(mark_revisits(records, min_bytes))
        .write.option("lineSep", RECORD_END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of each record; holds one record at a time."""
    held, more = bytearray(), True

    def fill(n: int) -> None:
        nonlocal more
        while more and len(held) < n:
            piece = next(chunks, None)
            if piece is None:
                more = False
            else:
                held.extend(piece)

    while True:
        # blank lines end a record
        fill(1)
        while held[:2] == b"\r\n" or (more and len(held) < 2):
            fill(2)
            if held[:2] != b"\r\n":
                break
            del held[:2]
            fill(2)
        if not held:
            return
        while (end := held.find(b"\r\n\r\n")) < 0:
            before = len(held)
            fill(before + 1)
            if len(held) == before:
                raise ValueError("the archive ends inside a header")
        lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields["content-length"])
        fill(end + 4 + n)
        if len(held) < end + 4 + n:
            raise ValueError("the archive ends inside a record")
        yield fields, bytes(held[end + 4 : end + 4 + n])
        del held[: end + 4 + n]


def unzipped(content: bytes) -> Iterator[bytes]:
    """The content, in pieces; gzipped as a whole or per record, or plain."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        stream = zlib.decompressobj(31)
        while True:
            piece = stream.decompress(content, 1 << 20)
            content = stream.unconsumed_tail
            if piece:
                yield piece
            if stream.eof or not (content or piece):
                break
        content = stream.unused_data if stream.eof else b""


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record; sizes and digests of responses are taken from their payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in FIELDS.split(", ")]
        kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for fields, block in parse(unzipped(content.as_py())):
                    kind = fields["warc-type"]
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if payload is not None:
                        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    rows.append((
                        kind, fields.get("warc-record-id"), fields.get("x-page-id"), fields.get("warc-target-uri"),
                        fields.get("warc-refers-to"), digest, None if payload is None else len(payload),
                        payload if payloads else None,
                    ))
                    held += len(block) if payloads else 0
                    if len(rows) == 1000 or held > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, FIELDS)


def resolved(records: DataFrame) -> DataFrame:
    """Records with size and page id of the original for each revisit."""
    headers = written(records.drop("payload"))
    originals = headers.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"),
        F.col("page_id").alias("refers_to"),
        F.col("payload_bytes").alias("_bytes"),
    )
    # repeated rows of one page share its record id
    originals = written(originals.dropDuplicates(["refers_to_id"]))
    # a response of NULL id is referred to by none, and few originals are hot
    told = headers.join(originals, "refers_to_id", "left")
    return told.withColumn("payload_bytes", F.coalesce("payload_bytes", "_bytes")).drop("_bytes")


def deduplicate_archives(spark: SparkSession, source: str, target: str, min_bytes: int = 0) -> None:
    """Read archives, resolve payloads that repeat, write them with fresh headers.

    Records that are revisits already stay so, and refer to the kept response.
    """
    records = written(read_archives(spark, source))
    sizes = resolved(records).select("record_id", F.col("payload_bytes").alias("size")).dropDuplicates(["record_id"])
    rows = records.drop("payload_bytes").join(written(sizes), "record_id")
    write_archives(
        rows.select(
            F.col("page_id").cast("long").alias("page_id"), F.col("uri").alias("url"),
            F.decode("payload", "UTF-8").alias("payload"), F.col("payload_digest").alias("digest"), "size",
            F.col("payload").isNotNull().alias("whole"),
        ),
        target,
        min_bytes,
    )


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages to archives, read these back, and report every record."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    write_archives(page_records(pages), path, min_bytes)
    kind = pages.schema["page_id"].dataType
    return resolved(read_archives(spark, path, payloads=False)).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
