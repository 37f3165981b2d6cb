"""WARC archives with revisit records for repeated payloads, written and read as Spark files.

Headers (page, digest, size) are shuffled by digest; the chosen original of each digest joins back to the pages, which write
either a response with its payload or a revisit that refers to it, all with fresh headers. An archive file is WARC 1.1 text,
gzip-compressed, of at most PER_FILE records, so a reader's task holds one such file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = 1000
PER_FILE = 2000
_DATE = "2024-01-01T00:00:00Z"


def _record_id(column: str):
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(">"))


def resolve(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html of every row with payload_digest, payload_bytes and refers_to, which is null for responses.

    Of pages with equal payloads of at least least bytes the largest page_id is the response; smaller payloads are all responses.
    Null html is an empty payload. Of rows with one page_id and payload either all are responses or none. A null page_id is smaller than
    any; pages of one payload without any page_id are all responses. Only digests that several rows have are joined back.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    heads = pages.select("page_id", "url", "html", F.sha1(body).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes"))
    same = heads.filter(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
    joined = heads.join(same.filter("n > 1").drop("n"), ["payload_digest", "payload_bytes"], "left")
    return joined.withColumn("refers_to", F.when(~F.col("original").eqNullSafe(F.col("page_id")), F.col("original"))).drop("original")


def write(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Writes one record a row; null urls are empty. Rows with one page_id, or none, are records each, under one record id."""
    rows = resolve(pages, least)
    line = "\r\n"
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.coalesce("html", F.lit("")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=UTF-8{line}{line}"), body)
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]+", " ")
    head = F.concat(
        F.lit("WARC/1.1" + line),
        F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(line),
        F.lit("WARC-Record-ID: "), _record_id("page_id"), F.lit(line),
        F.lit("WARC-Target-URI: "), url, F.lit(line),
        F.lit(f"WARC-Date: {_DATE}{line}WARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit(line),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{line}WARC-Refers-To: "), _record_id("refers_to"), F.lit(line))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response" + line),
        F.lit("Content-Length: "), F.octet_length(http).cast("string"), F.lit(line + line),
    )
    rows.select(F.concat(head, http).alias("value")).write.option("lineSep", line + line).option("compression", "gzip").option("maxRecordsPerFile", PER_FILE).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, url, digest, refers_to, payload) of every record; a revisit has a null payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = memoryview(zlib.decompress(content.as_buffer(), wbits=31))
                at, rows = 0, []
                while at < len(data):
                    stop = at
                    while True:  # the header's end; headers are short
                        chunk = bytes(data[stop : stop + 4096])
                        cut = chunk.find(b"\r\n\r\n")
                        if cut >= 0:
                            stop += cut
                            break
                        stop += 4093
                    head = dict(x.split(": ", 1) for x in bytes(data[at:stop]).decode("utf-8").split("\r\n")[1:])
                    size = int(head["Content-Length"])
                    block = bytes(data[stop + 4 : stop + 4 + size])
                    payload = block[block.index(b"\r\n\r\n") + 4 :] if head["WARC-Type"] == "response" else None
                    rows.append((head["WARC-Record-ID"], head["WARC-Type"], head["WARC-Target-URI"], head["WARC-Payload-Digest"].removeprefix("sha1:"), head.get("WARC-Refers-To"), payload))
                    at = stop + 4 + size + 4
                    if len(rows) >= 200 or at >= len(data):
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], schema.field(k).type) for k in range(6)], schema=schema)
                        rows = []

    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, "record_id string, record_type string, url string, digest string, refers_to string, payload binary")


def summary(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), a revisit's payload being that of the response with its digest that it refers to."""
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    rows = records.select(number("record_id").alias("page_id"), "record_type", "digest", F.when(F.col("refers_to").isNotNull(), number("refers_to")).alias("refers_to"), F.octet_length("payload").cast("long").alias("own"), F.sha1("payload").alias("own_digest"))
    originals = rows.filter("record_type = 'response' and page_id is not null").select(F.col("page_id").alias("refers_to"), "digest", F.col("own").alias("other"), F.col("own_digest").alias("other_digest")).dropDuplicates(["refers_to", "digest"])
    return rows.join(originals, ["refers_to", "digest"], "left").select("page_id", F.coalesce("own", "other").alias("payload_bytes"), F.coalesce("own_digest", "other_digest").alias("payload_digest"), "record_type", "refers_to")
