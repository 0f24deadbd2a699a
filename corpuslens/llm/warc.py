"""WARC archives with revisit resolution.

Headers (page, digest, size) are shuffled by payload digest; of equal payloads of
at least ``MIN_BYTES`` the record with the largest page is the response and the
others become revisit records that name it. Payloads are dealt over as many archives as
their bytes need, and there meet the revisits among them. Archives are written by Spark's text
sink, whose line separator is the blank lines that end a WARC record, so a lost
task is written again and any file system that Spark writes serves. Every record gets the
date of the run. Reading parses each archive record by record, by their Content-Length
fields, and joins revisits to their responses.

Cases: null html is an empty payload, null url an empty target; a repeated row of
the response is a response as well; rows without a page id can only revisit;
other columns are ignored, whatever their names; an empty table gives no records.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.common import batches_of, filled, materialise, new_path, read

MIN_BYTES = 1000
SALTS = 16
#: An archive is read by one task, so its size is bounded: payload bytes, about, and records.
ARCHIVE_BYTES = 32 << 20
MIN_ARCHIVES = 16
RECORDS_PER_ARCHIVE = 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
RECORDS = "page_id long, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to long, intact boolean"


def revisits(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of the records that revisit another; ``headers``: page_id, digest, bytes."""
    large = headers.filter(F.col("bytes") >= min_bytes)
    # The pages of one payload, however many, are dealt over SALTS keys.
    repeated = (
        large.groupBy("digest")
        .agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
        .filter("n > 1 and refers_to is not null")
        .select("digest", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = large.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(repeated, ["digest", "salt"]).filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return joined.select("page_id", "digest", "refers_to").distinct()


def resolve(pages: DataFrame, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """page_id, url, html, digest, refers_to (null for responses), a partition for each archive."""
    html = filled("html")
    rows = pages.select("page_id", filled("url").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    headers = materialise(rows.select("page_id", "digest", F.octet_length("html").alias("bytes")), "warc-headers")
    total = headers.agg(F.sum(F.col("bytes").cast("long")).alias("n")).first()["n"] or 0
    archives = max(MIN_ARCHIVES, -(-total // archive_bytes))
    row_key = F.xxhash64("page_id", "digest")
    again = revisits(headers, min_bytes).select(row_key.alias("key"), F.col("page_id").alias("own_page"), F.col("digest").alias("own_digest"), "refers_to")
    dealt = rows.withColumn("key", row_key).repartition(archives, "key")
    # Joined by the hash that rows are dealt by; that page and digest agree is said by bounds, which are no further join keys.
    same = (F.col("digest") >= F.col("own_digest")) & (F.col("digest") <= F.col("own_digest"))
    page, own_page = F.coalesce("page_id", F.lit(-(2**63))), F.coalesce("own_page", F.lit(-(2**63)))
    joined = dealt.join(again.withColumnRenamed("key", "own_key").hint("shuffle_hash"), (F.col("key") == F.col("own_key")) & same & (page >= own_page) & (page <= own_page), "left")
    return joined.select("page_id", "url", "html", "digest", "refers_to")


def record(page_id: Column, url: Column, html: Column, digest: Column, refers_to: Column, date: str | None = None) -> Column:
    """A WARC/1.1 record without the blank lines that end it; ``date`` (UTC) is that of the run unless given."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def line(name: str, value: Column | str) -> Column:
        return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n"))

    def page_urn(x: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(x.cast("string"), F.lit("none")), F.lit(">"))

    is_response = refers_to.isNull()
    size = F.octet_length(html).cast("string")
    block = F.when(is_response, F.concat(F.lit(HTTP_HEAD), size, F.lit("\r\n\r\n"), html)).otherwise(F.lit(""))
    revisit = F.concat(line("WARC-Refers-To", page_urn(refers_to)), line("WARC-Profile", PROFILE))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(is_response, F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", page_urn(page_id)),
        line("WARC-Date", now if date is None else date),
        line("WARC-Target-URI", F.regexp_replace(url, r"[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(is_response, F.lit("")).otherwise(revisit),
        line("Content-Type", "application/http; msgtype=response"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_archives(resolved: DataFrame, path: str, records_per_archive: int = RECORDS_PER_ARCHIVE, date: str | None = None) -> None:
    columns = [F.col(c) for c in ("page_id", "url", "html", "digest", "refers_to")]
    records = resolved.select(record(*columns, date=date).alias("value"))
    writer = records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
    writer.option("maxRecordsPerFile", records_per_archive).text(path)


def parse(archive: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record; one record is held at a time."""
    while version := archive.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {version[:80]!r}")
        headers = {}
        while (line := archive.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[name.lower()] = value
        size = int(headers["content-length"])
        block = archive.read(size)
        if len(block) < size or archive.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {headers.get('warc-record-id')} is cut short")
        yield headers, block


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number not in ("", "none") else None


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """One row per record; ``intact``: the payload read has the digest of its header. ``payload`` adds the html."""
    names = [c.split()[0] for c in RECORDS.split(", ")] + ["html"] * payload
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

        for batch in batches_of(batches, 1, 1, "content"):  # an archive at a time
            out, held = [], 0
            for head, block in parse(gzip.GzipFile(fileobj=io.BytesIO(batch["content"][0].as_py()))):
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                is_response = head["warc-type"] == "response"
                body = block.partition(b"\r\n\r\n")[2]
                intact = hashlib.sha1(body).hexdigest() == digest if is_response else None
                size = len(body) if is_response else None
                row = (_page(head["warc-record-id"]), head["warc-type"], head["warc-target-uri"], digest, size, _page(head.get("warc-refers-to")), intact)
                out.append((*row, body.decode() if is_response else None) if payload else row)
                held += len(body) * payload
                if len(out) >= 500 or held > 4 << 20:
                    yield send(out)
                    out, held = [], 0
            if out:
                yield send(out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(rows, RECORDS + ", html string" * payload)


def resolved_records(records: DataFrame) -> DataFrame:
    """Revisits take the payload size of the response that they name; one that names none stays null."""
    revisits = records.filter("record_type = 'revisit'")
    named = revisits.select(F.col("refers_to").alias("page_id")).distinct()
    originals = (
        records.filter("record_type = 'response'")
        .join(named, "page_id", "left_semi")
        .groupBy("page_id")
        .agg(F.max("payload_bytes").alias("bytes"), F.max("payload_digest").alias("digest"))
        .select(F.col("page_id").alias("refers_to"), "bytes", "digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = revisits.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(originals, ["refers_to", "salt"], "left")
    filled_in = joined.withColumn("payload_bytes", F.when(F.col("digest") == F.col("payload_digest"), F.col("bytes")))
    return records.filter("record_type = 'response'").unionByName(filled_in.select(*records.columns))


def op5_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(resolve(read(spark, sf_dir, "pages")), path)
    records = resolved_records(materialise(read_archives(spark, path), "warc-headers"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
