"""WARC archives without repeated payloads: revisit resolution by payload digest.

Only headers (key, digest, length) are shuffled, grouped by payload digest; the
record with the smallest key of a digest is the original. Payload rows meet the
decisions that turn them into revisits on their own key, spread evenly over
archives of about ``archive_bytes``, and are written as WARC 1.1 text files whose
record separator is the format's empty lines, gzipped as a whole, so Spark's writer
commits them and a lost executor leaves no half archive. Archives are read back whole (their size
is bounded by the writer) and parsed by Content-Length; revisit records found in
archives get length and original by a join of headers on the digest.

Defined results: a null payload is an empty one; rows that repeat a key and its
payload are each written, and repeats of an original are originals; rows with a
null key are written as responses and never referred to unless no other row has
their payload; a null URI leaves its header out; control characters and spaces of
URIs are percent-encoded; an empty table writes no record. Other columns are not
looked at.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayline.llm.common import prepare, written

ARCHIVE_BYTES = 24 << 20
MIN_PAYLOAD_BYTES = 0
CRLF = "\r\n"
# Fixed values of the WARC 1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
URN = "urn:record:"


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 SHA-1 without prefix: each 5 hexadecimal digits give 4 of base 32."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def captures(rows: DataFrame, key: str, uri: str, payload: str) -> DataFrame:
    """The columns the writer takes: key, uri, payload, payload_digest, payload_bytes."""
    body = F.coalesce(F.col(payload), F.lit(""))
    return rows.select(
        F.col(key).cast("long").alias("key"), F.col(uri).alias("uri"), body.alias("payload"),
        sha1_base32(body.cast("binary")).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes"),
    )


def revisits(headers: DataFrame, min_bytes: int = MIN_PAYLOAD_BYTES) -> DataFrame:
    """(key, payload_digest, refers_to) of the records that repeat an earlier record's payload.

    ``headers`` has key, payload_digest and payload_bytes. A digest held by a third
    of all records is one row after partial aggregation, and the join back is an
    equi-join whose large partitions adaptive execution splits.
    """
    long = headers.filter((F.col("payload_bytes") >= min_bytes) & F.col("key").isNotNull())
    long = long.select("key", "payload_digest")
    first = (
        long.groupBy("payload_digest")
        .agg(F.min("key").alias("refers_to"), F.max("key").alias("last"))
        .filter(F.col("last") > F.col("refers_to"))
        .select(F.col("payload_digest").alias("d"), "refers_to")
    )
    return (
        long.join(first, F.col("payload_digest") == F.col("d"))
        .filter(F.col("key") > F.col("refers_to"))
        .select("key", "payload_digest", "refers_to").distinct()
    )


def _clean_uri(uri: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(uri, r"[\r\n]", "%0D"), r"[\x00-\x20\x7f]", "%20")


def _record(date: str) -> Column:
    """One WARC record as text: a response with its payload, or a revisit without."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    target = F.coalesce(F.concat(F.lit("WARC-Target-URI: "), _clean_uri(F.col("uri")), F.lit(CRLF)), F.lit(""))
    again = F.concat(
        F.lit(f"WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: <{URN}"), F.col("refers_to").cast("string"),
        F.lit(f">{CRLF}"),
    )
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(CRLF),
        F.lit(f"WARC-Record-ID: <{URN}"), F.coalesce(F.col("key").cast("string"), F.lit("null")), F.lit(f">{CRLF}"),
        F.lit(f"WARC-Date: {date}{CRLF}"), target, F.when(revisit, again).otherwise(F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit(CRLF),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block,
    )


def write_archives(rows: DataFrame, decisions: DataFrame, path: str, total_bytes: int,
                   date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write captures as archives under ``path``; those in ``decisions`` become revisits.

    Both sides are dealt by key to ``total_bytes / archive_bytes`` partitions, one
    archive each, so the join needs no other shuffle and no archive outgrows a task.
    """
    n = max(1, -(-total_bytes // archive_bytes))
    turned = decisions.select(F.col("key").alias("k"), F.col("payload_digest").alias("d"), "refers_to")
    spread = F.coalesce(F.col("key"), F.xxhash64("payload"))
    joined = rows.withColumn("spread", spread).repartition(n, "spread").join(
        turned.repartition(n, "k"),
        (F.col("spread") == F.col("k")) & F.col("key").isNotNull() & (F.col("payload_digest") == F.col("d")), "left",
    )
    joined.select(_record(date).alias("value")).write.option("lineSep", CRLF * 2).option(
        "compression", "gzip").text(path)


_NUMBER = re.compile(rb"<" + URN.encode() + rb"(-?\d+)>")


def parse_archive(data: bytes):
    """Yield (headers as a dict with lower-case names, offset and length of the block)."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
        size = int(head[b"content-length"])
        yield head, end + 4, size
        at = end + 4 + size + 4


def _number(value: bytes | None):
    found = _NUMBER.fullmatch(value) if value else None
    return int(found[1]) if found else None


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives (``*.gz`` too) under ``path``.

    For responses, length and digest are taken from the bytes read, not from the
    header; a revisit has the digest of its header and no length.
    """
    import pyarrow as pa

    prepare(spark)
    names = ["key", "uri", "record_type", "refers_to", "payload_digest", "payload_bytes"] + ["payload"] * with_payload
    schema = pa.schema([("key", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.string())][: len(names)])

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                data = content.as_py()
                data = gzip.decompress(data) if name.as_py().endswith(".gz") else data
                out = []
                for head, at, size in parse_archive(data):
                    kind = head[b"warc-type"].decode()
                    if kind not in ("response", "revisit"):
                        continue
                    digest, n, body = head.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode(), None, None
                    if kind == "response":
                        start = data.index(b"\r\n\r\n", at) + 4
                        payload = memoryview(data)[start : at + size]
                        n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        body = bytes(payload).decode("utf-8", "strict") if with_payload else None
                    out.append((_number(head.get(b"warc-record-id")), head.get(b"warc-target-uri", b"").decode() or None,
                                kind, _number(head.get(b"warc-refers-to")), digest, n, body)[: len(names)])
                    if len(out) >= 512:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    kinds = "key long, uri string, record_type string, refers_to long, payload_digest string, payload_bytes long"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(
        parse, kinds + ", payload string" * with_payload)


def resolved(headers: DataFrame) -> DataFrame:
    """Headers with each revisit's length filled from the original of its digest.

    A revisit that names no original gets the smallest key among the responses of
    its digest; one whose original is in no archive keeps what it has.
    """
    kept = headers.filter(F.col("record_type") == "response").groupBy("payload_digest").agg(
        F.min("key").alias("original"), F.max("payload_bytes").alias("full_bytes"))
    kept = kept.withColumnRenamed("payload_digest", "d")
    again = headers.filter(F.col("record_type") == "revisit").join(kept, F.col("payload_digest") == F.col("d"), "left")
    again = again.withColumn("refers_to", F.coalesce("refers_to", "original"))
    again = again.withColumn("payload_bytes", F.coalesce("payload_bytes", "full_bytes"))
    return headers.filter(F.col("record_type") == "response").unionByName(again.select(*headers.columns))


def deduplicate(spark: SparkSession, source: str, target: str, min_bytes: int = MIN_PAYLOAD_BYTES,
                date: str = "1970-01-01T00:00:00Z") -> None:
    """Rewrite the archives under ``source`` to ``target`` with fresh headers, each payload once.

    Revisits of ``source`` stay revisits of the smallest key of their payload.
    """
    records = read_records(spark, source, with_payload=True)
    heads = written(resolved(records.drop("payload")), "warc-heads")
    turned = written(revisits(heads.withColumn("payload_bytes", F.coalesce("payload_bytes", F.lit(min_bytes))), min_bytes),
                     "warc-revisits")
    original = heads.filter(F.col("record_type") == "revisit").select("key", "payload_digest", "refers_to")
    turned = turned.unionByName(original.join(turned, ["key", "payload_digest"], "left_anti"))
    # a first capture that was a revisit has no payload here: the next response of the digest keeps its own
    bodies = heads.filter((F.col("record_type") == "response") & F.col("key").isNotNull()).groupBy("payload_digest").agg(
        F.min("key").alias("body_key"))
    turned = written(
        turned.join(bodies, "payload_digest", "left")
        .withColumn("refers_to", F.coalesce("body_key", "refers_to"))
        .filter(F.col("key") != F.col("refers_to")).drop("body_key").distinct(), "warc-decisions")
    lengths = heads.select(F.col("key").alias("k"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("n")).distinct()
    total = heads.agg(F.sum(F.coalesce("payload_bytes", F.lit(0)) + 700)).first()[0] or 0
    rows = records.join(lengths, F.col("key").eqNullSafe(F.col("k")) & (F.col("payload_digest") == F.col("d")), "left").select(
        "key", "uri", F.coalesce("payload", F.lit("")).alias("payload"), "payload_digest",
        F.coalesce("payload_bytes", "n", F.lit(0)).alias("payload_bytes"))
    write_archives(rows, turned, target, total, date)


def archive(rows: DataFrame, path: str, min_bytes: int = MIN_PAYLOAD_BYTES) -> DataFrame:
    """Write ``captures`` rows as deduplicated archives; the resolved headers read back from them."""
    spark = rows.sparkSession
    heads = written(rows.select("key", "payload_digest", "payload_bytes"), "warc-heads")
    total = heads.agg(F.sum(F.col("payload_bytes") + 700)).first()[0] or 0
    write_archives(rows, revisits(heads, min_bytes), path, total)
    return resolved(written(read_records(spark, path), "warc-read"))


def oracle_sql(min_bytes: int = MIN_PAYLOAD_BYTES) -> str:
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS hexed FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
        '{BASE32}'[1 + ((('0x' || hexed[1 + 5 * (i // 4) : 5 + 5 * (i // 4)])::BIGINT >> (15 - 5 * (i % 4))) & 31)]), '')
        AS payload_digest FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {min_bytes} AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {min_bytes} AND page_id > first_id THEN first_id END AS refers_to
FROM f"""
