"""WARC archives with revisit records.

Slim headers (page id, digest, size) are all that is shuffled by payload digest:
they are reduced to the smallest page id of each digest (a partial aggregate, so a
digest that a third of all pages share is one row a task) and joined to it, which
leaves the (page id, digest) pairs of the revisits.  Payloads meet these by page, not by
digest.  Records are written with fresh headers through Spark's text writer, whose
separator is the blank line pair that ends a WARC record, and the archives are
read back by walking their Content-Length fields.  A file is read by one task, so
pages are written by classes of size, each with its own number of records a file:
a file holds ``FILE_BYTES`` of payload at most, or one larger page.  The writer
compresses a file as one gzip member.  Reading resolves each revisit by a join with
the responses.

Payloads under ``MIN_REVISIT`` bytes are always full responses.

Defined results: null html is the empty payload; a null page_id never is an
original and is written without its page field; rows that repeat an original's
page_id are responses too; very long payloads are written whole; an empty table
gives an empty result; null urls are written as an empty target; further columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch_path

MIN_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 64 << 20
SIZE_CLASSES = (16 << 10, 256 << 10, 4 << 20, FILE_BYTES)  # upper bounds; larger payloads get a file each
PART_BYTES = 8 << 20  # of the rows that a reader hands on at once
FORMAT = "page_id long, payload_bytes long, payload_digest string, computed_digest string, record_type string, refers_to long, url string, payload string"


def headers(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages as (page_id, url, payload, payload_bytes, payload_digest)."""
    payload = F.coalesce(pages[html].cast("string"), F.lit(""))
    slim = pages.select(pages[page_id].cast("long").alias("page_id"), F.coalesce(F.regexp_replace(pages[url].cast("string"), r"\s+", "%20"), F.lit("")).alias("url"), payload.alias("payload"))
    return slim.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2(F.col("payload").cast("binary"), 256)})


def revisits(slim: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """(page_id, payload_digest, original) of the rows of ``slim`` headers that repeat an earlier payload."""
    least_id = (
        slim.filter(F.col("payload_bytes") >= least).groupBy("payload_digest")
        .agg(F.min("page_id").alias("original"), F.count("*").alias("_n"))
        .filter((F.col("_n") > 1) & F.col("original").isNotNull()).drop("_n")
    )
    again = slim.select("page_id", "payload_digest").join(least_id, "payload_digest").filter(~F.col("page_id").eqNullSafe(F.col("original")))
    return again.select("page_id", "payload_digest", "original").distinct()


def assign(pages: DataFrame, least: int = MIN_REVISIT, **names: str) -> DataFrame:
    """Pages with record_type and refers_to."""
    head = headers(pages, **names)
    again = materialise(revisits(head.select("page_id", "payload_bytes", "payload_digest"), least), "revisits")
    h, r = head.alias("h"), again.alias("r")
    joined = h.join(r, F.col("h.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("h.payload_digest") == F.col("r.payload_digest")), "left")
    revisit = F.col("r.original").isNotNull()
    return joined.select("h.*", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("r.original").alias("refers_to"))


def _uuid(*parts: Column) -> Column:
    h = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def record_text() -> Column:
    """One record without the closing blank lines."""
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, "").otherwise(F.col("payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _uuid(number("page_id"), F.col("payload_digest"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _uuid(number("refers_to"), F.col("payload_digest"))), line("X-Refers-To-Page", number("refers_to")))).otherwise(""),
        line("X-Page", number("page_id")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
    )


def write_archives(records: DataFrame, path: str) -> None:
    """Write assigned pages as gzip-compressed WARC files, in folders by class of size and by file of a task, in one pass."""
    size = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("payload_bytes"))
    bounds = F.array(*[F.lit(b) for b in SIZE_CLASSES])
    placed = records.select(record_text().alias("value"), F.size(F.filter(bounds, lambda b: b < size)).alias("size"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    # a task's rows are numbered, so that a file number stands for as many rows as a file of its class may hold
    filed = placed.select("value", "size", F.expr(f"_at div element_at(array({', '.join(str(max(1, FILE_BYTES // b)) for b in SIZE_CLASSES)}, 1), size + 1)").alias("file"))
    filed.write.partitionBy("size", "file").option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def parse(data: bytes):
    """(fields, payload) of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:stop].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        begin = stop + 4
        end = begin + int(fields["Content-Length"])
        yield fields, data[begin:end]
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} has no closing lines")
        at = end + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives in ``path``; see ``FORMAT``.  A file is read by one task."""

    def run(it):
        import pyarrow as pa

        names = [x.split()[0] for x in FORMAT.split(", ")]
        kinds = [pa.int64() if " long" in x else pa.string() for x in FORMAT.split(", ")]

        def batch_of(rows: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in it:
            for content in batch.column(0):
                data = content.as_py()
                rows, held = [], 0
                for fields, payload in parse(zlib.decompress(data, 47) if data[:2] == b"\x1f\x8b" else data):
                    kind = fields["WARC-Type"]
                    rows.append((
                        int(fields["X-Page"]) if fields["X-Page"] else None, len(payload), fields["WARC-Payload-Digest"].removeprefix("sha256:"),
                        hashlib.sha256(payload).hexdigest() if kind == "response" else None, kind, int(x) if (x := fields.get("X-Refers-To-Page")) else None, fields["WARC-Target-URI"], payload.decode("utf-8") if kind == "response" else None,
                    ))
                    held += len(payload)
                    if held > PART_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("length") > 0).select("content")
    return files.mapInArrow(run, FORMAT)


def resolve(records: DataFrame) -> DataFrame:
    """Revisits get the payload size of their response, joined by digest and page id."""
    slim = records.select("page_id", "payload_bytes", "payload_digest", "computed_digest", "record_type", "refers_to")
    responses = (
        slim.filter(F.col("record_type") == "response").groupBy(F.col("payload_digest").alias("_digest"), F.col("page_id").alias("_page"))
        .agg(F.max("payload_bytes").alias("_bytes"))
    )
    joined = slim.join(responses, (F.col("payload_digest") == F.col("_digest")) & (F.col("refers_to") == F.col("_page")), "left")
    return joined.select("page_id", F.coalesce("_bytes", "payload_bytes").alias("payload_bytes"), F.coalesce("computed_digest", "payload_digest").alias("payload_digest"), "record_type", "refers_to")


def round_trip(pages: DataFrame, path: str | None = None, **names: str) -> DataFrame:
    """Write ``pages`` as archives (by default in the shared folder) and return what reading them gives."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(assign(pages, **names), path)
    return resolve(read_archives(spark, path))
