"""WARC archives in which equal payloads are stored once: writing, reading, revisits."""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veiltext.session import stored

END = "\r\n\r\n"  # after each record, and between its header and block
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = (
    "page_id bigint, url string, record_type string, record_id string, payload_bytes bigint, "
    "payload_digest string, refers_to_record string, payload string"
)


def record_id(key: Column, digest: Column) -> Column:
    """A record's name: the same page with the same payload keeps it in every run."""
    h = F.md5(F.concat_ws(":", key.cast("string"), digest))
    part = lambda at, n: F.substring(h, at, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def resolve_revisits(headers: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Rows that repeat an earlier payload: `page_id, url, payload_digest, original, original_url`.

    `headers` has `page_id, url, payload_bytes, payload_digest`, no payloads. Headers meet by digest:
    the smallest page of each digest is its original, found with partial sums, and every other page
    of at least `least_bytes` is joined to it. A digest with very many pages is split by adaptive
    execution, as one side of the join has one row per digest. A null page is never an original
    if the digest has a page with a number.
    """
    able = headers.filter(F.col("payload_bytes") >= least_bytes)
    first = (
        able.groupBy("payload_digest")
        .agg(F.min_by(F.struct("page_id", "url"), F.struct(F.col("page_id").isNull().alias("n"), "page_id", F.col("url").isNull().alias("u"), "url")).alias("o"),
             F.count(F.lit(1)).alias("pages"))
        .filter("pages > 1")
        .select("payload_digest", F.col("o.page_id").alias("original"), F.col("o.url").alias("original_url"))
    )
    same = F.col("page_id").eqNullSafe(F.col("original")) & F.col("url").eqNullSafe(F.col("original_url"))
    return able.join(first, "payload_digest").filter(~same).select(
        "page_id", "url", "payload_digest", "original", "original_url"
    )


def _line(name: str, value: Column) -> Column:
    """A header line; nothing for a null. Line ends within a value would break the header."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z",
                   least_bytes: int = 100, records_per_file: int = 1000) -> None:
    """Write one record per row of `pages` (`page_id, url, html`) into gzipped WARC files.

    A payload is the html in UTF-8, empty for a null. Of pages with equal payloads of at least
    `least_bytes`, the smallest is a response, the others revisit it: they have fresh headers that
    name the response, and no payload. Smaller payloads are always responses. Repeated rows (same
    page, address and payload) are all responses. Null pages and addresses leave out their header.

    The text sink writes the records, ended by the blank lines the format wants, so files appear
    only when their task has been committed.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    described = pages.select(
        "page_id", "url", html.alias("html"), F.octet_length(html).cast("bigint").alias("payload_bytes"),
        F.sha2(html.cast("binary"), 256).alias("payload_digest"),
    )
    revisits = stored(resolve_revisits(described.drop("html"), least_bytes)).select(
        F.col("page_id").alias("_page"), F.col("url").alias("_url"), F.col("payload_digest").alias("_digest"),
        F.lit(True).alias("again"), "original", "original_url",
    )
    joined = described.join(
        revisits.distinct(),
        F.col("page_id").eqNullSafe(F.col("_page")) & F.col("url").eqNullSafe(F.col("_url"))
        & (F.col("payload_digest") == F.col("_digest")),
        "left",
    )
    again = F.coalesce("again", F.lit(False))
    block = F.concat(F.lit(HTTP), F.when(again, "").otherwise(F.col("html")))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _line("WARC-Record-ID", record_id(F.col("page_id"), F.col("payload_digest"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _line("WARC-Refers-To", F.when(again, record_id(F.col("original"), F.col("payload_digest")))),
        _line("WARC-Refers-To-Target-URI", F.when(again, F.col("original_url"))),
        _line("WARC-Profile", F.when(again, PROFILE)),
        _line("Page-ID", F.col("page_id")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"), block,
    )
    (
        joined.select(record.alias("value")).write.option("lineSep", END)
        .option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)
    )


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of one archive, cut by the lengths the headers give."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at = 0
    while at < len(content):
        stop = content.index(b"\r\n\r\n", at)
        lines = content[at:stop].decode("utf-8").split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        begin = stop + 4
        end = begin + int(headers["Content-Length"])
        yield headers, content[begin:end]
        at = end + 4


def _parse(batches: Iterator[pd.DataFrame], payloads: bool) -> Iterator[pd.DataFrame]:
    names = [column.split()[0] for column in HEADERS.split(", ")]
    for batch in batches:
        for content in batch["content"]:
            found = []
            for head, block in records(bytes(content)):
                payload = block[block.index(b"\r\n\r\n") + 4:]
                whole = head["WARC-Type"] == "response"
                page = head.get("Page-ID")
                found.append((
                    None if page is None else int(page), head.get("WARC-Target-URI"),
                    head["WARC-Type"], head["WARC-Record-ID"], len(payload) if whole else None,
                    hashlib.sha256(payload).hexdigest() if whole
                    else head["WARC-Payload-Digest"].removeprefix("sha256:"),
                    head.get("WARC-Refers-To"), payload.decode("utf-8") if whole and payloads else None,
                ))
            yield pd.DataFrame(found, columns=names, dtype=object)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records under `path`: `page_id, url, record_type, record_id, payload_bytes,
    payload_digest, refers_to_record, payload`.

    The digest of a response is that of the payload read; a revisit has its header's, and no
    payload. Without `payloads` that column is null, for those who need headers only. A file is read whole by one task, so its size is set when it is written.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(partial(_parse, payloads=payloads), HEADERS)


def resolved_pages(found: DataFrame) -> DataFrame:
    """Each record with what it stands for: revisits get size and page of the response they name.

    Revisits meet responses by record name, headers only. `page_id, payload_bytes, payload_digest,
    record_type, refers_to`; a revisit whose response is missing has a null size and page.
    """
    heads = stored(found.drop("payload"))
    responses = (
        heads.filter("record_type = 'response'")
        .groupBy(F.col("record_id").alias("refers_to_record"))
        .agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("_bytes"))
    )
    first = heads.filter("record_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type",
        F.lit(None).cast("bigint").alias("refers_to"),
    )
    again = heads.filter("record_type = 'revisit'").join(responses, "refers_to_record", "left").select(
        "page_id", F.col("_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )
    return first.unionByName(again)
