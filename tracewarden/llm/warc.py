"""WARC archives with resolved revisits.

Headers (digest and page id) are grouped by payload digest; where several pages share one, the original is its
smallest page id and the others become revisit records that refer to it. A bit filter of bounded size tells which pages
share a digest, so all others are written where they were read, without a shuffle. Records get fresh headers; Spark's
text writer puts them down, by classes of size, so that no file is much larger than FILE_BYTES unless it holds one
record, and reading splits the files by the lengths that their headers give.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flag_by_bitmap, fresh_path, key_bitmap, python_batches, quoted, table, unused, written

#: Payloads under so many bytes are never deduplicated.
LEAST_BYTES = 100
#: Bytes of a file, which a task reads whole; and the payload sizes that part the classes.
FILE_BYTES = 64 << 20
CLASSES = (1 << 15, 1 << 19, 1 << 23)
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Record ids carry the page id, and a digest of url and payload, since page ids may repeat.
RECORD_ID = "urn:page:"


def resolve(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """pages with payload_bytes, payload_digest, record_type, refers_to and refers_to_url; every row is returned.

    Null payloads count as empty. Rows that repeat the original's id are responses too; of their urls, the first by code
    points is referred to. Null ids refer to the smallest other id, or are responses where there is none. Columns of pages
    with these names are replaced, all others pass through whatever their names; an empty table gives none.
    """
    new = ["payload_bytes", "payload_digest", "record_type", "refers_to", "refers_to_url"]
    names = [c for c in pages.columns if c.lower() not in new]
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    (row, original, url, shared_flag) = unused(pages, "row", "original", "original_url", "shared")
    rows = pages.select(F.struct(*quoted(names)).alias(row), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    me, mine = F.col(row)[id_col], F.col(row)[url_col] if url_col in names else F.lit(None).cast("string")
    headers = rows.filter(F.col("payload_bytes") >= LEAST_BYTES).select(me.alias("id"), mine.alias("url"), "payload_digest")
    groups = headers.groupBy("payload_digest").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url"))).alias("o"), F.count(F.lit(1)).alias("n"))
    shared = written(groups.filter("n > 1").select("payload_digest", F.col("o.id").alias(original), F.col("o.url").alias(url)), "shared-payloads")
    flagged = flag_by_bitmap(rows, "payload_digest", *key_bitmap(shared, "payload_digest"), shared_flag)
    flagged = flagged.withColumn(shared_flag, F.col(shared_flag) & (F.col("payload_bytes") >= LEAST_BYTES))
    alone = flagged.filter(~F.col(shared_flag)).withColumns({original: F.lit(None).cast(pages.schema[id_col].dataType), url: F.lit(None).cast("string")})
    joined = flagged.filter(shared_flag).join(shared, "payload_digest", "left")
    fields = [row, "payload_bytes", "payload_digest", original, url]
    out = alone.select(fields).unionByName(joined.select(fields))
    revisit = F.col(original).isNotNull() & ~F.col(original).eqNullSafe(F.col(row)[id_col])
    return out.select(
        *[F.col(row)[c].alias(c) for c in names], "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col(original)).alias("refers_to"), F.when(revisit, F.col(url)).alias("refers_to_url"),
    )


def percent_encoded(url):
    """White space and control characters, which would break a header, as %XX; null is empty."""
    url = F.coalesce(url, F.lit(""))
    breaks = r"[\x00-\x20\x7F]"
    return F.when(url.rlike(breaks), F.array_join(F.transform(F.split(url, ""), lambda c: F.when(c.rlike(breaks), F.concat(F.lit("%"), F.lpad(F.hex(c), 2, "0"))).otherwise(c)), "")).otherwise(url)


def as_records(resolved: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str | None = None) -> DataFrame:
    """(value, payload_bytes): each row's WARC record, without the blank lines that end it. Revisits hold HTTP headers only.

    Null payloads and urls are empty. Rows that are equal in id, url and payload get equal record ids, all others
    different ones. The date is that of the call unless given.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    revisit = F.col("record_type") == "revisit"
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    url, first_url = percent_encoded(F.col(url_col)), percent_encoded(F.col("refers_to_url"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    def record_id(page, at):
        return F.concat(F.lit(f"<{RECORD_ID}"), F.coalesce(F.col(page).cast("string"), F.lit("")), F.lit(":"), F.substring(F.sha2(F.concat_ws("|", "payload_digest", at), 256), 1, 32), F.lit(">"))

    original = F.concat(
        line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id("refers_to", first_url)), line("WARC-Refers-To-Date", F.lit(date)),
        F.when(first_url != "", line("WARC-Refers-To-Target-URI", first_url)).otherwise(""),
    )
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", record_id(id_col, url)), line("WARC-Date", F.lit(date)),
        F.when(url != "", line("WARC-Target-URI", url)).otherwise(""), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        F.when(revisit, original).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", length.cast("string")), F.lit(CRLF),
    )
    body = F.when(revisit, "").otherwise(F.coalesce(F.col(payload_col), F.lit("")))
    return resolved.select(F.concat(head, http, body).alias("value"), "payload_bytes")


def size_class(size):
    """0 for the smallest payloads; each class has files of so many records that they stay below FILE_BYTES."""
    out = F.lit(len(CLASSES))
    for k, most in reversed(list(enumerate(CLASSES))):
        out = F.when(size <= most, k).otherwise(out)
    return out


def write(records: DataFrame, path: str, present: list[int] | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Plain WARC files, one write for each class of payload size (those of `present`, or all); the blank lines that end a
    record are the writer's line separator. An empty table gives no file with a record."""
    for k in range(len(CLASSES) + 1) if present is None else present:
        most = max(1, file_bytes // CLASSES[k]) if k < len(CLASSES) else 1
        some = records.filter(size_class(F.col("payload_bytes")) == k).select("value")
        some.write.mode("append").option("lineSep", CRLF * 2).option("maxRecordsPerFile", most).text(path)


def classes_present(pages: DataFrame, payload_col: str = "html") -> list[int]:
    """The size classes that occur, four at most."""
    size = size_class(F.coalesce(F.octet_length(F.col(payload_col)), F.lit(0)))
    return sorted(r["k"] for r in pages.select(size.alias("k")).distinct().collect())


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; a length that does not fit raises ValueError."""
    at, end = 0, len(content)
    while at < end:
        stop = content.index(b"\r\n\r\n", at)
        first, *lines = content[at:stop].decode().split(CRLF)
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines)
        at = stop + 4 + int(headers["Content-Length"])
        if content[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record {headers['WARC-Record-ID']} does not end at byte {at}")
        yield headers, content[stop + 4 : at]
        at += 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    A response whose payload does not match its digest or length raises; revisits have a null payload, urls are as in the
    headers, and a folder of empty files gives no row. A task holds one file.
    """
    python_batches(spark)
    number = re.compile(rf"<{RECORD_ID}(-?\d*):[0-9a-f]*>")

    def page(value: str | None) -> int | None:
        found = number.fullmatch(value or "")
        return int(found[1]) if found and found[1] else None

    def rows(batches):
        for pdf in batches:
            for content in pdf["content"]:
                out = []
                for h, block in parse(content):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), h["WARC-Payload-Digest"].removeprefix("sha256:")
                    response = h["WARC-Type"] == "response"
                    if response and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"record {h['WARC-Record-ID']} does not hold its payload")
                    out.append((page(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), size, digest, h["WARC-Type"], page(h.get("WARC-Refers-To")), payload.decode() if response else None))
                for i in range(0, len(out), 200):
                    frame = pd.DataFrame(out[i : i + 200], columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
                    yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(rows, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: writes all pages as archives and reads them back."""
    path, pages = fresh_path(spark, "warc"), table(spark, sf_dir, "pages").select("page_id", "url", "html")
    write(as_records(resolve(pages)), path, classes_present(pages) or [0])
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
o AS (SELECT *, CASE WHEN n >= {LEAST_BYTES} THEN min(page_id) OVER (PARTITION BY d) END AS o FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN o IS NOT NULL AND o <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN o <> page_id THEN o END AS refers_to
FROM o
"""
