"""WARC archives with revisit resolution.

Every page becomes one record whose block is the html in UTF-8. Headers alone (id, payload digest) are shuffled by
digest to find each payload's first record; records with the same payload and another id are written anew as `revisit`
records, with fresh headers and no block. Archives are written by Spark's text sink, whose line separator is the two
line ends that close a WARC record, so any store that Spark writes to will do and lost tasks leave nothing behind.

Defined results: null html is an empty payload; null ids stay and are never referred to, so a payload that only they
have is written once per row as a response; rows that repeat an id and a payload are responses all, if that id is the
payload's first; null urls have no target line; an empty table gives no records; other columns are ignored.
"""

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm.common import stored
from rolecall.session import scratch_path

#: Payloads smaller than this are never replaced by a revisit.
MIN_BYTES = 0
#: Records of an archive, at most; a task with more writes several.
ARCHIVE_RECORDS = 20_000
RECORD_END, LINE = "\r\n\r\n", "\r\n"
DATE = "2024-01-01T00:00:00Z"
# The alphabets of base32 as `conv` writes it and as RFC 4648 does, and the revisit profile of WARC 1.1.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's bytes: 20 bits, or 5 hexadecimal digits, make 4 letters."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def headers(pages: DataFrame) -> DataFrame:
    """(page_id, payload_digest, payload_bytes) of each row."""
    return pages.select("page_id", base32_sha1(F.coalesce("html", F.lit(""))).alias("payload_digest"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("payload_bytes"))


def revisits(heads: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(payload_digest, page_id, refers_to): ids that revisit, with the smallest id that has their payload.

    Payloads are grouped by digest with partial aggregates, so a payload that a third of all pages have moves one row a task.
    """
    heads = heads.where(F.col("payload_bytes") >= min_bytes)
    first = heads.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"))
    shared = first.where("refers_to < last").select("payload_digest", "refers_to")
    ids = heads.select("payload_digest", "page_id").distinct()
    return ids.join(shared, "payload_digest").where("page_id > refers_to").select("payload_digest", "page_id", "refers_to")


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def line(name: str, value: Column) -> Column:
    """A header line, or nothing for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(LINE)), F.lit(""))


def write(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> None:
    """Write one record per row of (page_id, url, html) below `folder`, payloads once each."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    heads = headers(pages)
    again = stored(revisits(heads, min_bytes), "revisits")
    marked = pages.withColumns({"payload_digest": base32_sha1(F.col("html")), "payload_bytes": F.octet_length("html").cast("long")})
    joined = marked.join(again, ["payload_digest", "page_id"], "left")
    back = F.col("refers_to").isNotNull()
    only = lambda value: F.when(back, value)
    text = F.concat(
        F.lit(f"WARC/1.1{LINE}"),
        line("WARC-Type", F.when(back, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]+", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("WARC-Refers-To", only(record_id(F.col("refers_to")))),
        line("WARC-Profile", only(F.lit(PROFILE))),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(back, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(LINE),
        F.when(back, F.lit("")).otherwise(F.col("html")),
    )
    joined.select(text.alias("value")).write.options(lineSep=RECORD_END, compression="gzip", maxRecordsPerFile=ARCHIVE_RECORDS).text(folder)


def parse(archive: bytes):
    """Records of an archive: (headers by lower-case name, block)."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        version, *lines = archive[at:end].decode().split(LINE)
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(head["content-length"])
        yield head, archive[end + 4 : end + 4 + size]
        at = end + 4 + size + len(RECORD_END)


def page_of(name: str | None) -> int | None:
    found = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(found) if found and found != "null" else None


def read(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of all records below `folder`.

    Length and digest of responses are taken from the block and must agree with the headers; a revisit's are those that
    its header states. `payload` is null for revisits.
    """
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    kinds |= {"payload": pa.binary()} if with_payload else {}

    def records(batches):
        import gzip

        for batch in batches:
            for archive in batch.column("content"):
                rows, held = [], 0
                for head, block in parse(gzip.decompress(archive.as_py())):
                    stated = head["warc-payload-digest"].removeprefix("sha1:")
                    size = int(head["x-payload-length"])
                    response = head["warc-type"] == "response"
                    if response and (len(block) != size or base64.b32encode(hashlib.sha1(block).digest()).decode() != stated):
                        raise ValueError(f"the block of {head['warc-record-id']} is damaged")
                    rows.append((page_of(head["warc-record-id"]), head.get("warc-target-uri"), size, stated, head["warc-type"], page_of(head.get("warc-refers-to")), *([block if response else None] * with_payload)))
                    held += len(block)
                    if len(rows) >= 2000 or with_payload and held > 16 << 20:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))

    out = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content").mapInArrow(records, out)


def resolved(records: DataFrame) -> DataFrame:
    """Records with the payload of what they refer to; rows of the same response go to its revisits by id."""
    responses = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload").alias("_payload")).dropDuplicates(["refers_to"])
    return records.join(responses, "refers_to", "left").withColumn("payload", F.coalesce("payload", "_payload")).drop("_payload")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives to a fresh folder below the shared one and read them back, without payloads."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    write(pages, folder)
    return read(spark, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
