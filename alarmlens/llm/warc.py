"""WARC transaction assembly (operator 12).

Every page becomes three records of an archive: a request, a response (or, where the payload was captured before, a revisit), and
metadata. Archives are gzipped WARC/1.1 files, written by Spark's text writer, whose line separator ends each record. They are read
back file by file; the records of a capture then meet through their concurrent-to identifiers, over one step or two, in either
direction, and make one nested row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Records of one archive file; a task holds one file, compressed, and one record.
FILE_RECORDS = 12_000
#: Copies of one capture that a row is expanded to at a time.
COPIES = 4096
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD = "type string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, date string, content_type string, head string, payload_bytes long, payload_digest string, declared_digest string, payload binary"
SHORT = ["record_id", "date", "target_uri", "content_type", "head"]
RESPONSE = ["type", "record_id", "refers_to", "date", "target_uri", "content_type", "head", "payload_bytes", "payload_digest", "declared_digest", "payload"]


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a 40-digit hexadecimal number: five hexadecimal digits are four of it."""
    value = lambda at: F.conv(F.substr(hex_digest, at, F.lit(5)), 16, 10).cast("int")
    digit = lambda v, shift: F.substr(F.lit(BASE32), F.shiftright(v, shift).bitwiseAND(31) + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(36), F.lit(5)), lambda at: F.concat(*[digit(value(at), s) for s in (15, 10, 5, 0)])), "")


def _urn(*parts: Column) -> Column:
    """A record identifier that is a function of the parts."""
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x1e")) for p in parts]), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: Column, record_id: Column, date: Column, uri: Column, content_type: str, block: Column, more: list[Column]) -> Column:
    """One record without its last line end. Null header lines are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.concat(F.lit("WARC-Date: "), date), F.concat(F.lit("WARC-Target-URI: "), uri), *more]
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block, F.lit("\r\n"))


def write(pages: DataFrame, path: str) -> None:
    """Writes pages (page_id, url, html) as archives below path.

    Of rows with equal payloads, those of the smallest page_id are responses, the others revisits of it (a null page_id is the
    largest). A null html is an empty payload; a null url gives records without a target. Line ends and spaces in a url are
    percent-encoded. A row that occurs again is the same capture, stored again under the same identifiers. Only payload hashes are
    grouped; html goes through one shuffle, in which payloads that many rows share are met by broadcast.
    """
    html, uri = F.coalesce(F.col("html"), F.lit("")), F.col("url")
    for bad, code in (("\r", "%0D"), ("\n", "%0A"), (" ", "%20")):
        uri = F.replace(uri, F.lit(bad), F.lit(code))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), uri.alias("uri"), html.alias("html"), F.sha2(html, 256).alias("payload"))
    order = F.struct(F.isnull("page_id").alias("no_id"), "page_id", F.isnull("uri").alias("no_uri"), "uri")
    classes = common.saved(rows.groupBy("payload").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("size")))
    met = common.joined(rows, classes, ["payload"], "size")

    key = lambda page, target: (page, target, F.col("payload"))
    of = key(F.col("page_id"), F.col("uri"))
    response, request, metadata = (_urn(F.lit(kind), *of) for kind in ("response", "request", "metadata"))
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id"))
    first = _urn(F.lit("response"), *key(F.col("first.page_id"), F.col("first.uri")))
    # pages have no time of capture; a day is derived from the id
    date = F.concat(F.date_add(F.lit("2024-01-01").cast("date"), F.coalesce(F.pmod("page_id", F.lit(366)), F.lit(0)).cast("int")).cast("string"), F.lit("T00:00:00Z"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    asked = F.regexp_extract(F.coalesce("uri", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)", 2)
    host = F.regexp_extract(F.coalesce("uri", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    get = F.concat(F.lit("GET "), F.when(asked == "", "/").otherwise(asked), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    about = F.when(F.col("page_id").isNull(), "").otherwise(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")))
    again = [F.when(~is_first, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")), F.when(~is_first, line("WARC-Refers-To", first)), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.sha1("html"))))]
    records = F.array(
        _record(F.lit("request"), request, date, F.col("uri"), "application/http;msgtype=request", get, [line("WARC-Concurrent-To", response)]),
        _record(F.when(is_first, "response").otherwise("revisit"), response, date, F.col("uri"), "application/http;msgtype=response", F.when(is_first, F.concat(http, "html")).otherwise(http), again),
        _record(F.lit("metadata"), metadata, date, F.col("uri"), "application/warc-fields", about, [line("WARC-Concurrent-To", response)]),
    )
    met.select(F.explode(records)).write.option("compression", "gzip").option("lineSep", "\r\n").option("maxRecordsPerFile", FILE_RECORDS).text(path)
    common.dropped(classes)


def parsed(content: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """The headers (names in lower case, with all their values) and block of each record of an archive, gzipped (in one member or many) or plain."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content))) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a record begins with {line[:40]!r}")
        headers: dict[str, list[str]] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        size = int(headers["content-length"][0])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("an archive ends inside a record")
        yield headers, block


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of all archives below path (RECORD). Length and digest of a response's payload are those of its bytes; a revisit has neither, but the digest that it declares. payload is null unless payloads."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T.StructType.fromDDL(RECORD))

    def row(headers: dict[str, list[str]], block: bytes) -> tuple:
        get = lambda name: headers.get(name, [None])[0]
        kind, body = get("warc-type"), None
        head = block
        if (get("content-type") or "").startswith("application/http"):
            head, _, body = block.partition(b"\r\n\r\n")
        declared = (get("warc-payload-digest") or "").removeprefix("sha1:") or None
        whole = body is not None and kind == "response"
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode() if whole else None
        return kind, get("warc-record-id"), headers.get("warc-concurrent-to", []), get("warc-refers-to"), get("warc-target-uri"), get("warc-date"), get("content-type"), head.decode("utf-8", "replace"), len(body) if whole else None, digest, declared, body if whole and payloads else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for headers, block in parsed(content.as_py()):
                    rows.append(row(headers, block))
                    size += len(block) if payloads else 0
                    if len(rows) >= common.SLICE_ROWS or size > 2**24:
                        yield _batch(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def assemble(records: DataFrame) -> DataFrame:
    """One row a capture: (capture, response, requests, metadata, copies).

    A record belongs to the response or revisit that it names as concurrent, or that names it; where there is none, to that of a
    record which does so. One without any makes a row of its own, without a response. Records that occur again word for word
    count once, in copies. A capture's requests and metadata are in its row, in order of their identifiers. Two different responses
    of one identifier are two rows.
    """
    fields = [c for c in records.columns]
    known = common.saved(records.groupBy(*fields).agg(F.count(F.lit(1)).alias("copies")))
    is_end = F.col("type").isin("response", "revisit")
    ends = known.where(is_end).select("record_id").distinct()
    links = known.select("record_id", F.explode("concurrent_to").alias("other"))
    edges = links.unionByName(links.select(F.col("other").alias("record_id"), F.col("record_id").alias("other"))).distinct()
    edges = edges.join(ends, "record_id", "left_anti")  # from what isn't a response
    near = edges.join(ends.select(F.col("record_id").alias("other")), "other").select("record_id", F.col("other").alias("capture"))
    far = edges.join(near.select("record_id").distinct(), "record_id", "left_anti").join(near.withColumnRenamed("record_id", "other"), "other").select("record_id", "capture").distinct()
    rest = known.where(~F.coalesce(is_end, F.lit(False))).join(near.unionByName(far), "record_id", "left").withColumn("capture", F.coalesce("capture", "record_id"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(kind, F.struct(*SHORT))))
    asked = F.col("type") == "request"
    rest = rest.groupBy("capture").agg(of(asked).alias("requests"), of(~asked).alias("metadata"), F.max("copies").alias("copies"))
    whole = known.where(is_end).select(F.col("record_id").alias("capture"), F.struct(*RESPONSE).alias("response"), F.col("copies").alias("own"))
    both = whole.join(rest, "capture", "full")
    out = both.select("capture", "response", *[F.coalesce(c, F.array()).alias(c) for c in ("requests", "metadata")], F.coalesce("own", "copies").alias("copies"))
    out.built_on = known
    return out


def expanded(captures: DataFrame) -> DataFrame:
    """Each capture as often as it was stored."""
    blocks = captures.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    return blocks.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES), F.col("copies") - F.col("block") * COPIES)))).drop("block", "copy", "copies")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as its archived records say: length and digest of its payload, and what it revisits.

    Both of a revisit's are those of the response that it refers to, read back. Null and repeated rows: see write() and assemble();
    a repeated row comes back as often as it occurs. An empty table gives no rows. Other columns are not read.
    """
    path = f"{common.shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(common.table(spark, sf_dir, "pages"), path)
    nested = assemble(read(spark, path))
    page = F.regexp_extract(F.get("metadata", F.lit(0))["head"], r"page-id: (-?\d+)", 1)
    flat = nested.select(F.when(page != "", page).cast("long").alias("page_id"), "response.record_id", "response.type", "response.refers_to", "response.payload_bytes", "response.payload_digest", "copies")
    captures = common.saved(flat)
    common.dropped(nested.built_on)
    common.remove_folder(spark, path)
    first = F.col("type") == "response"
    again = captures.where(~first).select("page_id", "refers_to", "copies")
    asked = again.groupBy("refers_to").agg(F.count(F.lit(1)).alias("size"))
    firsts = captures.where(first).select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("first_id"), "payload_bytes", "payload_digest")
    table = common.saved(asked.join(firsts, "refers_to", "left"))
    revisits = common.joined(again, table, ["refers_to"], "size").select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("first_id").alias("refers_to"), "copies")
    responses = captures.where(first).select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "copies")
    return expanded(responses.unionByName(revisits))


ORACLE = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, array_to_string([substr('{BASE32}', CAST((CAST('0x' || substr(x, (i // 4) * 5 + 1, 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1) FOR i IN range(0, 32)], '') AS payload_digest,
 CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM d"""
