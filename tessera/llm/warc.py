"""WARC archives from a chunked record table, and back.

``chunk_table`` streams every payload as rows of record identifier and chunk number, at most ``chunk_bytes`` each,
with the payload's running length; the last row of a record carries the SHA-1 that was updated chunk by chunk. No
Python task holds a whole payload. Of records with equal payloads the one with the largest page_id is the response
and the others revisit it. ``write_archives`` writes one WARC/1.1 record per chunk (a response or revisit, then
continuation segments) as gzip files through Spark's own writer, so any store that Spark can write will do.
``read_archives`` reads the files back record by record and takes every figure from them.

Null html is an empty payload. Repeated rows are records of their own: the last of them with the largest page_id
responds. page_id and url may be null. An empty table gives an empty archive. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_path

CHUNKS = "record long, page_id long, url string, chunk int, data binary, payload_bytes long, payload_digest string"
MARK = b"WARC/1.1"
#: Keys over which the records of one payload are dealt.
SALTS = 16
CRLF = "\r\n"


def chunk_table(pages: DataFrame, chunk_bytes: int = 1 << 20) -> DataFrame:
    """Rows of record identifier and chunk number; ``payload_digest`` stands in a record's last row only.

    Chunks also end inside every ``WARC/1.1`` of a payload, so that a record never holds what begins the next one.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.monotonically_increasing_id().alias("record"), "page_id", "url", payload.alias("payload"))
    steps = F.sequence(F.lit(0), F.greatest(F.octet_length("payload") - 1, F.lit(0)), F.lit(chunk_bytes))
    rows = rows.select("record", "page_id", "url", F.octet_length("payload").alias("size"), "payload", F.explode(steps).alias("at"))
    rows = rows.select("record", "page_id", "url", "size", "at", F.expr(f"substring(payload, at + 1, {chunk_bytes})").alias("data"))

    def run(batches):
        digest, now, k = hashlib.sha1(), None, 0
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for record, page, url, size, at, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if record != now:
                    digest, now, k = hashlib.sha1(), record, 0
                digest.update(data)
                ends = []
                found = data.find(MARK)
                while found >= 0:
                    ends.append(found + 4)
                    found = data.find(MARK, found + 4)
                begin = 0
                for end in [*ends, len(data)]:
                    last = end == len(data) and at + len(data) == size
                    row = (record, page, url, k, data[begin:end], at + end, base64.b32encode(digest.digest()).decode() if last else None)
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                    begin, k = end, k + 1
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["record", "page_id", "url", "chunk", "data", "payload_bytes", "payload_digest"])

    return rows.mapInArrow(run, CHUNKS)


def revisits(chunks: DataFrame, min_bytes: int = 0) -> DataFrame:
    """record, chunks, payload_bytes, payload_digest, and the record, page and address it revisits (null for responses).

    A payload that many pages share is one hot digest: only digests of several records are joined, and the side of the
    responses (one row a digest) is dealt to SALTS copies, so that their revisits spread.
    """
    heads = chunks.filter("payload_digest is not null").select("record", "page_id", "url", (F.col("chunk") + 1).alias("chunks"), "payload_bytes", "payload_digest")
    first = heads.groupBy("payload_digest").agg(F.max(F.struct("page_id", "record", "url")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    salts = F.explode(F.array(*map(F.lit, range(SALTS))))
    joined = heads.withColumn("salt", F.pmod(F.xxhash64("record"), F.lit(SALTS)).cast("int")).join(first.select("payload_digest", "first", salts.alias("salt")), ["payload_digest", "salt"], "left")
    again = F.col("first").isNotNull() & (F.col("first.record") != F.col("record")) & (F.col("payload_bytes") >= min_bytes)
    of = {f"of_{n}": F.when(again, F.col(f"first.{c}")) for n, c in (("record", "record"), ("page", "page_id"), ("url", "url"))}
    return joined.select("record", "chunks", F.col("payload_bytes").alias("total"), F.col("payload_digest").alias("digest"), *(c.alias(n) for n, c in of.items()))


def write_archives(chunks: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", min_bytes: int = 0) -> None:
    """Gzip WARC files below ``path``; a record's segments stand in one file, in order."""
    rows = chunks.drop("payload_bytes", "payload_digest").join(revisits(chunks, min_bytes), "record")
    rows = rows.filter("of_record is null or chunk = 0").sortWithinPartitions("record", "chunk")
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))
    urn = lambda c, k: F.concat(F.lit("<urn:x-record:"), c.cast("string"), F.lit(":"), k.cast("string"), F.lit(">"))
    first, again = F.col("chunk") == 0, F.col("of_record").isNotNull()
    split = (F.col("chunks") > 1) & ~again
    kind = F.when(~first, F.lit("continuation")).when(again, F.lit("revisit")).otherwise(F.lit("response"))
    http = F.when(first, F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("total").cast("string"), F.lit(CRLF * 2))).otherwise(F.lit(""))
    data = F.when(again, F.lit(b"")).otherwise(F.col("data"))
    rows = rows.withColumn("http", http.cast("binary")).withColumn("body", data)
    head = F.concat(
        F.lit(MARK.decode() + CRLF),
        line("WARC-Type", kind),
        line("WARC-Record-ID", urn(F.col("record"), F.col("chunk"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.concat(F.lit("<"), F.regexp_replace("url", r"[\r\n]", "%0A"), F.lit(">"))),
        line("WARC-Page-ID", F.col("page_id")),
        line("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("digest")))),
        line("WARC-Payload-Length", F.when(first, F.col("total"))),
        line("WARC-Refers-To", F.when(again, urn(F.col("of_record"), F.lit(0)))),
        line("WARC-Refers-To-Page-ID", F.when(again, F.col("of_page"))),
        line("WARC-Refers-To-Target-URI", F.when(again, F.regexp_replace("of_url", r"[\r\n]", "%0A"))),
        line("WARC-Refers-To-Date", F.when(again, F.lit(date))),
        line("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Segment-Number", F.when(split, F.col("chunk") + 1)),
        line("WARC-Segment-Origin-ID", F.when(split & ~first, urn(F.col("record"), F.lit(0)))),
        line("WARC-Segment-Total-Length", F.when(split & (F.col("chunk") + 1 == F.col("chunks")), F.col("total"))),
        line("Content-Type", F.when(first, F.lit("application/http; msgtype=response"))),
        line("Content-Length", F.octet_length("http") + F.octet_length("body")),
        F.lit(CRLF),
    )
    value = F.concat(head.cast("binary"), F.col("http"), F.col("body")).cast("string")
    rows.select(value.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the archives.

    A response's length and digest are counted from its bytes, segment by segment, and held against its headers; a
    revisit's are those of the headers. A record whose bytes do not fit its headers raises ValueError.
    """
    records = spark.read.schema("value string").option("lineSep", MARK.decode() + CRLF).text(path)
    records = records.filter(F.octet_length("value") > 0).select(F.col("value").cast("binary"))

    def run(batches):
        now: dict | None = None

        def close() -> tuple:
            size, digest = now["size"], base64.b32encode(now["sha1"].digest()).decode()
            if size != now["total"] or digest != now["digest"]:
                raise ValueError(f"record {now['id']}: {size} bytes, {digest}; its headers say {now['total']}, {now['digest']}")
            return now["page"], size, digest, "response", None

        def rows(batch):
            nonlocal now
            for raw in batch.column(0):
                head, _, rest = raw.as_py().partition(b"\r\n\r\n")
                field = dict(x.split(": ", 1) for x in head.decode().split(CRLF))
                size = int(field["Content-Length"])
                if rest[size:] != b"\r\n\r\n":
                    raise ValueError(f"record {field['WARC-Record-ID']} does not end where it should")
                block, kind = rest[:size], field["WARC-Type"]
                if kind == "continuation":
                    if now is None or field["WARC-Segment-Origin-ID"] != now["id"] or int(field["WARC-Segment-Number"]) != now["segment"] + 1:
                        raise ValueError(f"segment {field['WARC-Record-ID']} does not follow its origin")
                    now["segment"] += 1
                else:
                    if now is not None:
                        yield close()
                    now, page = None, int(field["WARC-Page-ID"]) if "WARC-Page-ID" in field else None
                    digest, total = field["WARC-Payload-Digest"].removeprefix("sha1:"), int(field["WARC-Payload-Length"])
                    if kind == "revisit":
                        of = field.get("WARC-Refers-To-Page-ID")
                        yield page, total, digest, "revisit", None if of is None else int(of)
                        continue
                    block = block.partition(b"\r\n\r\n")[2]
                    now = {"id": field["WARC-Record-ID"], "page": page, "digest": digest, "total": total, "size": 0, "sha1": hashlib.sha1(), "segment": 1}
                now["sha1"].update(block)
                now["size"] += len(block)

        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        pack = lambda got: pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], k) for i, k in enumerate(kinds)], names=names)
        for b in batches:
            yield pack(list(rows(b)))
        if now is not None:
            yield pack([close()])

    return records.mapInArrow(run, READ)


def archive(pages: DataFrame, chunk_bytes: int = 1 << 20, min_bytes: int = 0) -> str:
    """Write the pages' archives into the shared folder; their path."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(cut(chunk_table(pages, chunk_bytes), "chunks"), path, min_bytes=min_bytes)
    return path
